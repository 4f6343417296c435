"""Drift, privacy, utility, scoring and ranking against brute force on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.rows import people_rows
from veilframe import Draws, MaskingConfig, MaskSpec
from veilframe.operators import drift, features, moments, privacy, scoring, utility
from veilframe.operators.clean import cap_rows, clean_people, resolve_headers
from veilframe.operators.masks import evaluate_masks, wide
from veilframe.operators.models import unmasked
from veilframe.operators.project import add_category_code, project_numbers, text_codes
from veilframe.operators.ranking import cut_points, exact_median, number_rows, order_statistic, smallest_mode

SPEC = MaskSpec()
NOISE = MaskingConfig("noise", noise_std=3.0, gender_mask_probability=0.15)
LAPLACE = MaskingConfig("differential_privacy", epsilon=1.0)
GENERAL = MaskingConfig("generalization", generalization_bin=20)
PERTURB = MaskingConfig("feature_perturbation", perturbation_strength=0.2)


def step_functions(a, b):
    values = np.unique(np.concatenate([a, b]))
    gap = np.abs(
        np.searchsorted(np.sort(a), values, "right") / len(a) - np.searchsorted(np.sort(b), values, "right") / len(b)
    )
    return gap.max(), float((gap[:-1] * np.diff(values)).sum())


def divergence(a, b):
    low, high = min(a.min(), b.min()), max(a.max(), b.max())
    if low == high:
        return 0.0
    p, edges = np.histogram(a, bins=20, range=(low, high), density=True)
    q, _ = np.histogram(b, bins=edges, density=True)
    p, q = p + 1e-9, q + 1e-9
    p, q = p / p.sum(), q / q.sum()
    return float((p * np.log(p / q)).sum())


@pytest.mark.parametrize("buckets", [1, 3, 16, 256])
def test_drift_equals_brute_force_for_any_buckets(crowd, buckets):
    configs = [NOISE, LAPLACE, GENERAL, PERTURB]
    frame, original = evaluate_masks(crowd, SPEC, configs), wide(crowd, SPEC)
    edges = drift.spec_edges(original, SPEC, buckets)
    found = {(r["config_id"], r["feature"]): r for r in drift.drift_table(original, frame, SPEC, edges).collect()}
    data = frame.toPandas()
    assert len(found) == 4 * 5
    for config_id, group in data.groupby("config_id"):
        for feature in ("age", "income"):
            a, b = group[f"o_{feature}"].to_numpy(), group[f"m_{feature}"].to_numpy()
            ks, area = step_functions(a, b)
            row = found[(config_id, feature)]
            assert row["ks_statistic"] == pytest.approx(ks, abs=1e-12)
            assert row["wasserstein_distance"] == pytest.approx(area, abs=1e-9)
            assert row["kl_divergence"] == pytest.approx(divergence(a, b), abs=1e-9)


def test_drift_with_outliers_and_heavy_values(spark):
    """A far outlier and one value with a third of the rows leave the result exact."""
    rng = np.random.default_rng(3)
    spec = MaskSpec(upper=1e6)
    ages = np.concatenate([np.full(400, 30), rng.integers(18, 90, 799), [900_000]])
    df = people_rows(spark, [(int(a), "Male" if i % 3 else "Female", i % 2) for i, a in enumerate(ages)])
    frame = evaluate_masks(df, spec, [NOISE])
    row = drift.drift_table(wide(df, spec), frame, spec).where("feature = 'age'").first()
    data = frame.toPandas()
    ks, area = step_functions(data["o_age"].to_numpy(), data["m_age"].to_numpy())
    assert row["ks_statistic"] == pytest.approx(ks, abs=1e-12)
    assert row["wasserstein_distance"] == pytest.approx(area, rel=1e-9)


def test_table_does_not_drift_from_itself(crowd):
    found = drift.drift_table(wide(crowd, SPEC), unmasked(crowd, SPEC), SPEC).toPandas()
    for column in ("t_statistic", "ks_statistic", "kl_divergence", "wasserstein_distance", "mean_shift"):
        assert (found[column].abs() < 1e-12).all()
    assert (found["variance_preservation"] == 1).all()


def test_kl_bins_equal_numpy(spark):
    rng = np.random.default_rng(5)
    for low, high in [(0.0, 1.0), (18.0, 75.0), (-3.7, 11.1), (0.1, 0.7)]:
        values = np.concatenate([rng.uniform(low, high, 200), np.linspace(low, high, 21), [low, high]])
        df = spark.createDataFrame([(float(v),) for v in values], "v double")
        bins = [r[0] for r in df.select(drift.kl_bin(F.col("v"), F.lit(low), F.lit(high))).collect()]
        counts, _ = np.histogram(values, bins=20, range=(low, high))
        assert np.bincount(bins, minlength=20).tolist() == counts.tolist()


def test_moments_equal_pandas(crowd):
    found, cells = moments.profile(crowd, SPEC)
    data = project_numbers(crowd, SPEC).toPandas()
    for row in found.collect():
        column = data[row["feature"]]
        assert row["mean"] == pytest.approx(column.mean(), rel=1e-12)
        assert row["variance"] == pytest.approx(column.var(), rel=1e-12)
        assert row["std_pop"] == pytest.approx(column.std(ddof=0), rel=1e-12)
    covariance, correlation = data.cov(), data.corr()
    for row in cells.collect():
        assert row["covariance"] == pytest.approx(covariance.loc[row["feature_a"], row["feature_b"]], abs=1e-12)
        assert row["correlation"] == pytest.approx(correlation.loc[row["feature_a"], row["feature_b"]], abs=1e-12)


def test_codes_are_sorted_positions_of_each_setting(spark):
    texts = sorted({f"{a}{b}" for a in ("", "a", "ab", "abc", "é", "éa", "zz") for b in ("", "x", "xy", "abcd", "0")})
    rows = spark.createDataFrame([(k, t) for k in (1, 2) for t in texts[k:]], "config_id int, text string").repartition(5)
    found = {(r["config_id"], r["text"]): r["code"] for r in text_codes(rows, ["config_id"], "text", "code").collect()}
    assert found == {(k, t): i for k in (1, 2) for i, t in enumerate(sorted(texts[k:], key=lambda t: t.encode()))}


def test_constant_column_has_zero_correlation(spark):
    df = people_rows(spark, [(40, "Male", i % 2) for i in range(10)])
    _, cells = moments.profile(df, SPEC)
    constant = cells.where("feature_a = 'age' or feature_a = 'gender_code'").collect()
    assert all(r["correlation"] == 0 and r["covariance"] == 0 for r in constant)


def test_large_means_keep_their_precision(spark):
    spec = MaskSpec(upper=1e12)
    df = people_rows(spark, []).unionByName(
        spark.range(1000).selectExpr(
            "id as row_id", "int(1000000000 + id % 7) as age", "if(id % 2 = 0, 'Male', 'Female') as gender",
            "int(id % 2) as income", "'e' as education", "'o' as occupation",
        )
    )
    found, _ = moments.profile(df, spec)
    expected = np.var([i % 7 for i in range(1000)], ddof=1)
    # Doubles near 1e9 are 1.2e-7 apart, so the means are; sums of squares would lose every digit.
    assert found.where("feature = 'age'").first()["variance"] == pytest.approx(expected, rel=1e-7)


def test_reidentification_risk_is_classes_over_records(crowd):
    frame = evaluate_masks(crowd, SPEC, [GENERAL])
    sized = privacy.class_size_per_record(frame, ["m_age", "m_gender", "m_income"])
    by_record = sized.agg(F.avg(1 / F.col("class_size")).alias("risk")).first()["risk"]
    found = privacy.privacy_metrics(frame, SPEC).first()
    assert found["reidentification_risk"] == pytest.approx(by_record, rel=1e-12)
    assert sized.count() == 1500


def test_missing_identifiers_form_one_class(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "x")], "row_id int, g string")
    sizes = {r["row_id"]: r["class_size"] for r in privacy.class_size_per_record(df, ["g"]).collect()}
    assert sizes == {1: 2, 2: 2, 3: 1}


def test_measures_of_an_empty_table(spark):
    df = people_rows(spark, [])
    frame = evaluate_masks(df, SPEC, [NOISE, GENERAL])
    assert privacy.privacy_metrics(frame, SPEC).count() == 0
    assert drift.drift_table(wide(df, SPEC), frame, SPEC).count() == 0
    assert privacy.class_summary(privacy.equivalence_classes(frame, ["m_age"])).first()["reidentification_risk"] == 1.0


def test_information_loss_of_an_unchanged_table_is_zero(crowd):
    cube = moments.masked_cube(unmasked(crowd, SPEC), SPEC)
    assert utility.information_loss(cube, SPEC).first()["information_loss"] == 0.0
    assert privacy.disclosure_risk(cube, SPEC).first()["attribute_disclosure_risk"] == 1.0


@pytest.mark.parametrize(("p", "u", "w", "expected"), [(1.0, 1.0, 0.5, 1.05), (0.5, 0.75, 0.55, 0.29125)])
def test_objective(spark, p, u, w, expected):
    value = spark.range(1).select(utility.objective(F.lit(p), F.lit(u), w)).first()[0]
    assert value == pytest.approx(expected, rel=1e-12)


# --- scoring -----------------------------------------------------------------------------------


@pytest.mark.parametrize("part_rows", [7, 100_000])
def test_roc_auc_equals_pair_counting(spark, part_rows):
    rng = np.random.default_rng(11)
    y, p = rng.integers(0, 2, 500), np.round(rng.uniform(0, 1, 500), 2)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p, strict=True)], "y int, p double")
    pos, neg = p[y == 1], p[y == 0]
    pairs = (pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()
    assert scoring.roc_auc(df, part_rows=part_rows).first()["roc_auc"] == pytest.approx(pairs / (len(pos) * len(neg)))


def test_roc_auc_of_parts_in_several_ranges(spark):
    """A key may be named ``part``, which the ranges have a column for as well."""
    df = spark.createDataFrame([(k % 2, k / 40, "test" if k % 3 else "train") for k in range(40)], "y int, p double, part string")
    found, whole = (scoring.roc_auc(df, ["part"], part_rows=n).collect() for n in (5, 1000))
    assert sorted(found) == sorted(whole)


def test_scores_of_one_class_are_defined(spark):
    df = spark.createDataFrame([(1, 0.2, 0), (1, 0.9, 1)], "y int, p double, predicted int")
    assert scoring.roc_auc(df).first()["roc_auc"] == 0.0
    row = scoring.classifier_metrics(df.withColumn("predicted", F.lit(0))).first()
    assert (row["accuracy"], row["precision"], row["recall"], row["f1"], row["rmse"]) == (0, 0, 0, 0, 1)


def test_constant_probability_has_no_signal(spark):
    df = spark.createDataFrame([(1.0, 0.5), (2.0, 0.5)], "x double, p double")
    assert scoring.sensitive_signal(df, ["x"]).first()[0] == 0.0


def test_mutual_information_equals_two_way_tables(crowd):
    found = {r["feature"]: r[1] for r in features.mutual_information(crowd, ["gender"], {"age": (18, 90)}, "income").collect()}
    data = crowd.toPandas()

    def information(x, y):
        total = 0.0
        for a in set(x):
            for b in set(y):
                joint = np.mean((x == a) & (y == b))
                if joint:
                    total += joint * np.log(joint / (np.mean(x == a) * np.mean(y == b)))
        return total

    y = data["income"].to_numpy()
    assert found["gender_Male"] == pytest.approx(information((data["gender"] == "Male").to_numpy(), y), rel=1e-9)
    bins = np.clip(np.floor((data["age"].to_numpy() - 18) / 72 * 20), 0, 19)
    assert found["age"] == pytest.approx(information(bins, y), rel=1e-9)


def test_mutual_information_with_a_value_of_one_class(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 0), ("c", 0), ("c", 1)], "t string, label int")
    found = {r["feature"]: r[1] for r in features.mutual_information(df, ["t"], {}).collect()}
    x, y = np.array([1, 1, 0, 0, 0]), np.array([1, 1, 0, 0, 1])
    expected = sum(
        np.mean((x == a) & (y == b)) * np.log(np.mean((x == a) & (y == b)) / (np.mean(x == a) * np.mean(y == b)))
        for a in (0, 1) for b in (0, 1) if np.mean((x == a) & (y == b))
    )
    assert found["t_a"] == pytest.approx(expected, rel=1e-9)


# --- ranking and preparation -----------------------------------------------------------------------


@pytest.mark.parametrize("bucket_rows", [7, 100, 10_000])
def test_cut_points_equal_sorting(spark, bucket_rows):
    draws = Draws(5)
    df = spark.range(1000).select(
        F.col("id").alias("row_id"), (F.col("id") % 3).alias("k"),
        F.round(draws.uniform("a", "b", F.col("id")), 2).alias("u"),
    )
    limits = {0: [1, 100, 334], 1: [50], 2: [0, 5000]}
    found = cut_points(df, "k", "u", "row_id", limits, 334, bucket_rows)
    data = df.toPandas().sort_values(["u", "row_id"])
    for k, n in [(0, 1), (0, 100), (0, 334), (1, 50)]:
        row = data[data["k"] == k].iloc[n - 1]
        assert found[(k, n)] == (row["u"], row["row_id"])
    assert len(found) == 4


def test_cap_keeps_exactly_n(crowd):
    assert cap_rows(crowd, 200, SPEC, Draws()).count() == 200
    assert cap_rows(crowd, 5000, SPEC, Draws()).count() == 1500
    assert cap_rows(crowd, 0, SPEC, Draws()).count() == 0


def test_number_rows_is_consecutive(spark):
    df = number_rows(spark.range(1000).repartition(7).selectExpr("id as x"))
    numbers = sorted(r["row_id"] for r in df.collect())
    assert numbers == list(range(1000)) and df.select("x").distinct().count() == 1000


def test_exact_split_shares(crowd):
    parts = features.add_exact_split(wide(crowd, SPEC), Draws()).groupBy("label", "part").count().collect()
    for label in (0, 1):
        sizes = {r["part"]: r["count"] for r in parts if r["label"] == label}
        total = sum(sizes.values())
        assert sizes["train"] == round(total * 0.6) and abs(sizes["test"] - total * 0.2) <= 1


def test_dictionary_codes_are_sorted_positions(crowd):
    coded = add_category_code(crowd, "occupation", "code").select("occupation", "code").distinct().collect()
    expected = {v: i for i, v in enumerate(sorted(r["occupation"] for r in coded))}
    assert {r["occupation"]: r["code"] for r in coded} == expected


def test_projection_of_odd_cells(spark):
    cells = ["20-39", "40", "-5", "1e-5", "20-39-5", "", None, "x", " 12 ", "1_000"]
    df = spark.createDataFrame(
        [(i, c, "1", "g", "e", "o") for i, c in enumerate(cells)],
        "row_id int, age string, income string, gender string, education string, occupation string",
    )
    found = {r["row_id"]: r["age"] for r in project_numbers(df, SPEC, ["row_id"]).collect()}
    assert [found[i] for i in range(len(cells))] == [29.5, 40.0, -5.0, 1e-5, 0.0, 0.0, 0.0, 0.0, 12.0, 0.0]


def test_header_aliases():
    found = resolve_headers(["AGE ", "sex", "Education", "occupation", "class"])
    assert found == {"age": "AGE ", "gender": "sex", "income": "class", "education": "Education", "occupation": "occupation"}
    assert resolve_headers(["age", "sex", "gender", "class", "income", "education", "occupation"])["income"] == "income"
    with pytest.raises(KeyError, match="income"):
        resolve_headers(["age", "sex", "education", "occupation"])


def test_cleaning_rules(spark):
    rows = [
        ("95.5", "Male", ">50K", "a", "b"), ("17", " Male ", "<=50K", "a", "b"), ("20.5", "Male", "1", "a", "b"),
        ("21.5", "Male", "0", "a", "b"), ("abc", "Male", "0", "a", "b"), ("30", "?", "0", "a", "b"),
        ("30", "Male", "0", "a", " ?"), ("30", "nan", "0", "a", "b"), (None, "Male", "0", "a", "b"),
    ]
    df = spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)],
        "row_id int, Age string, Gender string, Income string, Education string, Occupation string",
    )
    found = {r["row_id"]: r for r in clean_people(df).collect()}
    assert sorted(found) == [0, 1, 2, 3, 6]
    assert [found[i]["age"] for i in (0, 1, 2, 3)] == [90, 18, 20, 22]
    assert [found[i]["income"] for i in (0, 1, 2, 3)] == [1, 0, 1, 0]
    assert found[1]["gender"] == "Male" and found[6]["occupation"] == "?"
    strict = {r["row_id"] for r in clean_people(df, strict=True).collect()}
    assert strict == {2, 3, 6}


def test_order_statistics_as_sorted(spark):
    rng = np.random.default_rng(4)
    for values in ([5.0], [2.0, 1.0], [1.0] * 50 + [3.0], rng.standard_normal(3001).tolist(), (10.0 ** rng.uniform(-12, 12, 400)).tolist()):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(3)
        assert exact_median(df, F.col("v")) == np.median(values)
        for rank in (0, len(values) // 3, len(values) - 1):
            assert order_statistic(df, F.col("v"), rank) == sorted(values)[rank]
    assert order_statistic(df, F.col("v"), len(values)) is None and exact_median(df.limit(0), F.col("v")) is None
    tied = spark.createDataFrame([(v,) for v in (3.0, 1.0, 3.0, 1.0, 2.0, None)], "v double")
    assert smallest_mode(tied, F.col("v")) == 1.0
