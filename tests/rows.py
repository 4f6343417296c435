"""Small tables for the tests."""


def people_rows(spark, rows):
    """Small person table from (age, gender, income) tuples."""
    data = [(i, a, g, y, "HS-grad", "Sales") for i, (a, g, y) in enumerate(rows)]
    schema = "row_id bigint, age int, gender string, income int, education string, occupation string"
    return spark.createDataFrame(data, schema)
