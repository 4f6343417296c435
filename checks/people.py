"""The test tables of the registered queries: orders and their customers in the roles of people.

Columns of ``orders`` and ``customer`` stand for a person's: the customer's balance for the age, the
order's priority and the customer's segment for the carried texts. The flag is a rule over price, age
and priority, so that there is something to learn. The joined table is written once per
application next to the checkpoints and read back, as a user's own table would be.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.session import shared_table_path
from veilframe.sources.tables import path_exists
from veilframe.spec import MaskSpec

PEOPLE = MaskSpec()
ORDERS_PEOPLE = MaskSpec(
    numeric="price_k", lower=1.0, upper=500.0, numeric_default=250.0, flag="big",
    category="status", category_pair=("F", "O"), carried=("priority", "segment"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _u(tag: str, key: Column) -> Column:
    text = F.md5(F.concat_ws(":", F.lit("42"), F.lit(tag), key.cast("string")))
    bits = F.conv(F.substring(text, 1, 13), 16, 10).cast("bigint")
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def written_once(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    place = hashlib.sha256(sf_dir.rstrip("/").encode()).hexdigest()[:10]
    path = shared_table_path(spark, f"{name}-{place}.parquet")
    if not path_exists(spark, f"{path}/_SUCCESS"):
        files = spark.sparkContext.defaultParallelism
        build(spark, sf_dir).repartition(files, "row_id").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def orders_with_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return orders.join(customer, orders.o_custkey == customer.c_custkey, "left")


def derive_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One person per order: balances from -1,000 to 10,000 give ages from 18 to 75."""
    balance = F.coalesce(F.col("c_acctbal"), F.lit(0.0))
    age = (F.lit(18) + F.floor((balance + F.lit(1000.0)) / F.lit(11000.0) * F.lit(58.0))).cast("int")
    hurry = F.when(F.col("education").isin("1-URGENT", "2-HIGH"), F.lit(15.0)).otherwise(F.lit(0.0))
    points = F.col("price") / F.lit(8000.0) + (F.col("age") - F.lit(18)) * F.lit(0.8) + hurry
    return (
        orders_with_customers(spark, sf_dir)
        .select(
            F.col("o_orderkey").alias("row_id"),
            age.alias("age"),
            F.when(F.col("o_custkey") % 2 == 0, "Female").otherwise("Male").alias("gender"),
            F.col("o_orderpriority").alias("education"),
            F.coalesce(F.col("c_mktsegment"), F.lit("none")).alias("occupation"),
            F.col("o_totalprice").alias("price"),
        )
        .withColumn("income", F.when(points >= 60, 1).otherwise(0))
    )


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One clean person per order."""
    rows = written_once(spark, sf_dir, "people", derive_people)
    return rows.select("row_id", "age", "gender", "income", "education", "occupation")


def people_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same people as text cells with damage that the cleaner must undo or drop."""
    hit = lambda divisor: F.col("row_id") % divisor == 0
    age = (
        F.when(hit(47), "21.5")
        .when(hit(43), "20.5")
        .when(hit(37), F.lit(None))
        .when(hit(31), "17")
        .when(hit(29), "95.5")
        .when(hit(19), "abc")
        .otherwise(F.col("age").cast("string"))
    )
    education = F.col("education")
    occupation = F.col("occupation")
    return people(spark, sf_dir).select(
        "row_id",
        age.alias("Age"),
        F.when(hit(17), "?").otherwise(F.col("gender")).alias("Gender"),
        F.col("income").cast("string").alias("Income"),
        F.when(hit(23), F.concat(F.lit("\t"), education, F.lit(" "))).otherwise(education).alias("Education"),
        F.when(hit(41), " ?").otherwise(occupation).alias("Occupation"),
    )


def people_aliased(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged people under other headers, income as text."""
    dirty = people_dirty(spark, sf_dir)
    return dirty.select(
        "row_id",
        F.col("Age").alias("AGE "),
        F.col("Gender").alias("sex"),
        F.col("Education").alias("education"),
        F.col("Occupation").alias("occupation"),
        F.when(F.col("Income") == "1", " >50K").otherwise(" <=50K").alias("class"),
    )


def orders_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other columns under the same roles (``ORDERS_PEOPLE``)."""
    return orders_with_customers(spark, sf_dir).select(
        F.col("o_orderkey").alias("row_id"),
        (F.col("o_totalprice") / F.lit(1000.0)).alias("price_k"),
        (F.col("o_totalprice") >= 250000).cast("int").alias("big"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
        F.coalesce(F.col("c_mktsegment"), F.lit("none")).alias("segment"),
    )


def people_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People with two keyed score columns that rise with the age (``p`` more than ``q``), for the metric operators."""
    chance = (F.col("age") - F.lit(17)) / F.lit(60.0)
    key = F.col("row_id")
    return people(spark, sf_dir).select(
        "row_id", "age", "gender", "income", "education", "occupation",
        F.col("income").alias("y"),
        (F.lit(0.7) * chance + F.lit(0.3) * _u("score", key)).alias("p"),
        (F.lit(0.4) * chance + F.lit(0.6) * _u("other", key)).alias("q"),
    )
