"""What the masks must keep, and what they must not depend on."""

import math

import pytest
from pyspark.sql import functions as F

from tests.rows import people_rows
from veilframe import Draws, MaskingConfig, MaskSpec
from veilframe.functions.draws import gaussian_pair, laplace
from veilframe.operators.masks import bucketed_swap, evaluate_masks, permuted_swap, release, table_facts, wide
from veilframe.streaming.masks import mask_stream

SPEC = MaskSpec()
NOISE = MaskingConfig("noise", noise_std=3.0, gender_mask_probability=0.15)
GENERAL = MaskingConfig("generalization", generalization_bin=20)
LAPLACE = MaskingConfig("differential_privacy", epsilon=1.0)
SWAP = MaskingConfig("data_swapping", swap_fraction=0.3)
PERTURB = MaskingConfig("feature_perturbation", perturbation_strength=0.2)
HYBRID = MaskingConfig(
    "hybrid", noise_std=1.5, generalization_bin=10, epsilon=2.0, swap_fraction=0.2, perturbation_strength=0.1
)
ALL = [NOISE, GENERAL, LAPLACE, SWAP, PERTURB, HYBRID]


def rows(df):
    shown = [F.round(c, 9).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes]
    return sorted(tuple(map(str, r)) for r in df.select(*shown).collect())


def test_same_result_for_any_partitioning(crowd):
    expected = rows(evaluate_masks(crowd.repartition(1), SPEC, ALL))
    assert rows(evaluate_masks(crowd.repartition(7), SPEC, ALL)) == expected
    assert rows(evaluate_masks(crowd.repartition(64), SPEC, ALL)) == expected


def test_many_settings_equal_single_ones(crowd):
    together = evaluate_masks(crowd, SPEC, ALL)
    for position, config in enumerate(ALL):
        alone = evaluate_masks(crowd, SPEC, [config], first_id=position)
        assert rows(together.where(F.col("config_id") == position)) == rows(alone)


@pytest.mark.parametrize("config", [SWAP, HYBRID])
@pytest.mark.parametrize("bucket_rows", [10, 100, 100_000])
def test_bucket_size_does_not_change_a_swap(crowd, config, bucket_rows):
    frame = evaluate_masks(crowd, SPEC, [config], bucket_rows=bucket_rows)
    assert rows(frame) == rows(evaluate_masks(crowd, SPEC, [config]))


@pytest.mark.parametrize(("fraction", "moved"), [(0.0, 0), (0.3, 450), (1.0, 1500), (2.0, 1500), (0.0005, 0)])
def test_swap_moves_pairs_among_exactly_n_rows(crowd, fraction, moved):
    config = MaskingConfig("data_swapping", swap_fraction=fraction)
    keyed = crowd.withColumn("age", (F.col("row_id") % 72 + 18).cast("int")).withColumn(
        "gender", F.concat(F.lit("g"), F.col("row_id").cast("string"))
    )
    frame = evaluate_masks(keyed, SPEC, [config])
    # Every gender text is unique here, so a moved row always shows.
    assert frame.where("o_gender <> m_gender").count() == moved
    before, after = frame.select("o_age", "o_gender"), frame.select("m_age", "m_gender")
    assert before.exceptAll(after).count() == 0
    assert frame.where("o_income <> m_income").count() == 0


def test_permuted_swap_is_a_permutation_at_any_range(crowd):
    frames = [permuted_swap(crowd, SPEC, SWAP, bucket_rows=rows).select("row_id", "o_age", "o_gender", "m_age", "m_gender").collect() for rows in (100, 100_000)]
    assert sorted(frames[0]) == sorted(frames[1])
    assert sorted((r["o_age"], r["o_gender"]) for r in frames[0]) == sorted((r["m_age"], r["m_gender"]) for r in frames[0])
    moved = sum((r["o_age"], r["o_gender"]) != (r["m_age"], r["m_gender"]) for r in frames[0])
    assert 0.2 * len(frames[0]) < moved <= 0.3 * len(frames[0]) + 1


def test_bucketed_swap_keeps_the_pairs(crowd):
    frame = bucketed_swap(crowd, SPEC, SWAP, 8)
    assert frame.select("o_age", "o_gender").exceptAll(frame.select("m_age", "m_gender")).count() == 0
    share = frame.where("o_age <> m_age or o_gender <> m_gender").count() / frame.count()
    assert 0.2 < share < 0.35


def test_suppression_invents_nothing(crowd):
    allowed = {"Female", "Male", "Suppressed", "Any", "Perturbed"}
    frame = evaluate_masks(crowd, SPEC, ALL)
    assert {r[0] for r in frame.select("m_gender").distinct().collect()} <= allowed


def test_bounds_hold(crowd):
    frame = evaluate_masks(crowd, SPEC, [NOISE, LAPLACE, PERTURB, HYBRID])
    assert frame.where("m_age < 18 or m_age > 90 or m_income < 0 or m_income > 1").count() == 0


def test_labels_only_for_generalisation(crowd):
    frame = evaluate_masks(crowd, SPEC, ALL)
    counts = {r["config_id"]: r["n"] for r in frame.groupBy("config_id").agg(F.count("m_age_label").alias("n")).collect()}
    assert counts == {0: 0, 1: 1500, 2: 0, 3: 0, 4: 0, 5: 0}
    assert frame.where("m_age_label is not null and m_age_label not rlike '^[0-9]+-[0-9]+$'").count() == 0


def test_release_has_the_original_columns(crowd):
    table = release(crowd, SPEC, GENERAL, Draws())
    assert table.columns == ["row_id", "age", "gender", "income", "education", "occupation"]
    assert {r[0] for r in table.select("income").distinct().collect()} == {"High", "Low"}
    for row in table.join(crowd.select("row_id", F.col("age").alias("true")), "row_id").collect():
        low, high = map(int, row["age"].split("-"))
        assert low <= row["true"] <= high and high - low == 19


def test_randomized_response_keep_rate(spark):
    n, epsilon = 20000, 1.0
    keep = math.exp(epsilon) / (1 + math.exp(epsilon))
    df = spark.range(n).select(
        F.col("id").alias("row_id"), F.lit(40).alias("age"), F.lit(0).alias("income"),
        F.when(F.col("id") % 2 == 0, "Female").otherwise("Male").alias("gender"),
        F.lit("e").alias("education"), F.lit("o").alias("occupation"),
    )
    frame = evaluate_masks(df, SPEC, [MaskingConfig("differential_privacy", epsilon=epsilon)])
    kept = frame.where("o_gender = m_gender").count() / n
    assert abs(kept - keep) < 4 * math.sqrt(keep * (1 - keep) / n)


def test_randomized_response_outside_the_pair(spark):
    """With three categories the pair comes from the spec; other values may be picked fairly or kept."""
    df = people_rows(spark, [(30, ("A", "B", "C")[i % 3], 0) for i in range(300)])
    found = evaluate_masks(df, SPEC, [MaskingConfig("differential_privacy", epsilon=0.01)])
    values = {r[0] for r in found.select("m_gender").distinct().collect()}
    assert values == {"A", "B", "C", "Female", "Male"}


@pytest.mark.parametrize("kind", ["sha256", "xxhash64"])
def test_draws_are_uniform_and_noise_has_its_scale(spark, kind):
    draws = Draws(7, kind)
    u = spark.range(50000).select(*[draws.uniform("k", "s", F.col("id"), i).alias(f"u{i}") for i in range(4)])
    z1, z2 = gaussian_pair(F.col("u0"), F.col("u1"))
    row = u.select(
        F.avg("u0").alias("mean"), F.min("u0").alias("low"), F.max("u0").alias("high"),
        F.corr("u0", "u1").alias("lanes"), F.avg(z1).alias("zm"), F.stddev(z1).alias("zs"), F.corr(z1, z2).alias("zc"),
        F.avg(F.abs(laplace(F.col("u2"), F.lit(3.0)))).alias("lap"),
    ).first()
    assert row["mean"] == pytest.approx(0.5, abs=0.01)
    assert 0 < row["low"] < 0.001 and 0.999 < row["high"] < 1
    assert abs(row["lanes"]) < 0.02 and abs(row["zc"]) < 0.02
    assert row["zm"] == pytest.approx(0, abs=0.02) and row["zs"] == pytest.approx(1, abs=0.02)
    assert row["lap"] == pytest.approx(3.0, rel=0.03)


def test_fast_draws_mask_too(crowd):
    frame = evaluate_masks(crowd, SPEC, ALL, Draws(1, "xxhash64"))
    assert frame.count() == 6 * crowd.count()
    assert rows(evaluate_masks(crowd.repartition(7), SPEC, ALL, Draws(1, "xxhash64"))) == rows(frame)
    other = evaluate_masks(crowd, SPEC, [NOISE], Draws(2, "xxhash64"))
    assert rows(other) != rows(frame.where("config_id = 0"))


def test_secret_seed_changes_the_noise(crowd):
    a, b = (evaluate_masks(crowd, SPEC, [NOISE], Draws(seed)) for seed in ("one secret", "another"))
    assert a.select("m_age").exceptAll(b.select("m_age")).count() > 1000


def test_only_sensitive_columns_are_masked(crowd):
    spec = MaskSpec(sensitive=("age",))
    frame = evaluate_masks(crowd, spec, ALL)
    assert frame.where("not (o_gender <=> m_gender) or o_income <> m_income or m_income_label is not null").count() == 0
    assert frame.where("config_id = 1 and m_age_label is null").count() == 0
    assert spec.identify(["income", "age"]) == ["age"]


def test_unknown_method_is_refused():
    with pytest.raises(ValueError, match="unknown masking method"):
        MaskingConfig("blur")
    with pytest.raises(ValueError, match="draw kind"):
        Draws(1, "md4")


def test_label_format():
    assert NOISE.label() == "noise|noise=3.0|bin=10|eps=1.0|gender_p=0.15|dp_fraction=0.7|swap=0.0|perturb=0.0"
    assert LAPLACE.total_epsilon() == 3.0 and NOISE.total_epsilon() is None


@pytest.mark.parametrize("config", ALL)
def test_empty_table_in_empty_table_out(spark, config):
    assert evaluate_masks(people_rows(spark, []), SPEC, [config]).count() == 0


@pytest.mark.parametrize("config", ALL)
def test_one_row_and_twins(spark, config):
    assert evaluate_masks(people_rows(spark, [(40, "Male", 1)]), SPEC, [config]).count() == 1
    assert evaluate_masks(people_rows(spark, [(40, "Male", 1)] * 2), SPEC, [config]).count() == 2


def test_extreme_parameters(crowd):
    zero = MaskingConfig("differential_privacy", epsilon=0.0)
    thin = MaskingConfig("generalization", generalization_bin=0)
    frame = evaluate_masks(crowd, SPEC, [zero, thin])
    assert frame.where("config_id = 0 and m_age not in (18, 90)").count() < 5
    assert frame.where("config_id = 1 and m_age_label <> concat(int(o_age), '-', int(o_age))").count() == 0


def test_missing_numbers_are_filled(spark):
    df = people_rows(spark, [(20, "Male", 1), (20, "Female", 0), (None, "Male", None), (60, "Female", 1)])
    facts = table_facts(df, SPEC)
    assert (facts.numeric_fill, facts.numeric_mode, facts.flag_fill) == (20.0, 20.0, 1.0)
    frame = evaluate_masks(df, SPEC, [GENERAL, LAPLACE])
    assert frame.where("m_age is null or m_income is null").count() == 0
    binned = frame.where("config_id = 0 and row_id = 2").first()
    assert (binned["m_age_label"], binned["m_income_label"]) == ("20-39", "Low")
    assert wide(df, SPEC).where("label is null").count() == 0


def test_table_facts(crowd):
    facts = table_facts(crowd, SPEC)
    expected = crowd.agg(F.stddev_samp("age").alias("s")).first()["s"]
    assert facts.rows == 1500 and facts.numeric_std == pytest.approx(expected, rel=1e-12)
    assert facts.category_pair(SPEC) == ("Female", "Male")


def test_stream_is_masked_like_a_table(spark, crowd, tmp_path):
    source = str(tmp_path / "in")
    crowd.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(crowd.schema).parquet(source)
    run = (
        mask_stream(stream, SPEC, NOISE, Draws()).writeStream.format("memory").queryName("masked_stream")
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    run.awaitTermination()
    assert rows(spark.table("masked_stream")) == rows(release(crowd, SPEC, NOISE, Draws()))
    with pytest.raises(ValueError, match="whole table"):
        mask_stream(stream, SPEC, SWAP, Draws())


def test_stream_keeps_missing_numbers_missing(spark, tmp_path):
    rows = people_rows(spark, [(40, "Male", 1), (None, "Female", 0)])
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = mask_stream(stream, SPEC, GENERAL, Draws()).writeStream.format("memory").queryName("binned_stream").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r["row_id"]: r["age"] for r in spark.table("binned_stream").collect()} == {0: "40-59", 1: None}


def test_absent_columns_are_skipped(crowd):
    table = release(crowd.drop("gender", "education"), SPEC, NOISE, Draws())
    assert table.columns == ["row_id", "age", "income", "occupation"] and table.count() == crowd.count()
