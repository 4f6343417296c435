"""Published numbers of one run, recomputed from its published means, variances and matrices."""

import math

import pytest
from pyspark.sql import functions as F

from veilframe.functions.numeric import normal_p_value
from veilframe.operators.drift import variance_preservation, welch_t
from veilframe.operators.utility import matrix_preservation, statistical_similarity

FEATURES = ["Age", "Income", "Gender_Code", "Education_Code", "Occupation_Code"]
ROWS = 5000
# Published means and variances of the original and of the best masked table.
OLD_MEAN = [39.0466, 0.3188, 0.5232, 2.789, 2.7986]
NEW_MEAN = [38.804, 0.3188, 1.2374, 2.789, 2.7986]
OLD_VARIANCE = [152.15605965193038, 0.2172100020004001, 0.24951166233246655, 2.6766143228645727, 3.7387857971594323]
NEW_VARIANCE = [200.03559111822364, 0.2172100020004001, 0.5627537907581517, 2.6766143228645727, 3.7387857971594323]
# Published correlations and covariances above the diagonal, in feature order.
OLD_CORRELATION = [
    0.2037222327192334, 0.012599815568291803, 0.0026085800383738996, 0.0040251438352023015, 0.020639067291961168,
    -0.09540843110636467, 0.07503587692504363, 0.009051039657367112, -0.019082841445968255, 0.013944808812545737,
]
NEW_CORRELATION = [
    0.18904761739047282, 0.0006816106068242835, -0.0005557074198821874, 0.007820376065125659, 0.008344615032701968,
    -0.09540843110636467, 0.07503587692504363, 0.015558672211631885, 0.0027667011658826343, 0.013944808812545737,
]
OLD_COVARIANCE = [
    1.1711781556311263, 0.07763440688137639, 0.0526431286257254, 0.09600444088817758, 0.004804800960192063,
    -0.07274774954990995, 0.06761984396879372, 0.007396679335867153, -0.018431206241248256, 0.04411342268453701,
]
NEW_COVARIANCE = [
    1.2461340268053611, 0.00723184636927431, -0.012858571714342841, 0.21386837367473538, 0.002917463492698533,
    -0.07274774954990995, 0.06761984396879372, 0.019095219043808773, 0.004013162632526502, 0.04411342268453701,
]


def lit(value):
    return F.lit(float(value))


@pytest.mark.parametrize(
    ("feature", "t", "p"), [(0, 0.9140843440093304, 0.36067252836651026), (2, -56.034545903621286, 0.0)]
)
def test_welch_and_p_value(spark, feature, t, p):
    statistic = welch_t(
        lit(OLD_MEAN[feature]), lit(OLD_VARIANCE[feature]), lit(ROWS),
        lit(NEW_MEAN[feature]), lit(NEW_VARIANCE[feature]), lit(ROWS),
    )
    row = spark.range(1).select(statistic.alias("t"), normal_p_value(statistic).alias("p")).first()
    assert row["t"] == pytest.approx(t, rel=1e-12)
    assert row["p"] == pytest.approx(p, abs=1e-6)


@pytest.mark.parametrize("t", [0.0, 0.1, 0.5, 1.0, 1.96, 2.5, 5.0, 10.0])
def test_p_value_follows_erfc(spark, t):
    found = spark.range(1).select(normal_p_value(lit(t)).alias("p")).first()["p"]
    assert found == pytest.approx(math.erfc(t / math.sqrt(2)), rel=2e-7)


def test_variance_preservation(spark):
    row = spark.range(1).select(
        variance_preservation(lit(OLD_VARIANCE[0]), lit(NEW_VARIANCE[0])).alias("age"),
        variance_preservation(lit(OLD_VARIANCE[2]), lit(NEW_VARIANCE[2])).alias("gender"),
    ).first()
    assert row["age"] == pytest.approx(0.6853261606812002, abs=1e-12)
    assert row["gender"] == 0.0


def long_matrix(spark, values, name, config):
    pairs = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]]
    rows = []
    for (a, b), value in zip(pairs, values, strict=True):
        rows += [(config, a, b, value), (config, b, a, value)]
    return spark.createDataFrame(rows, f"config_id int, feature_a string, feature_b string, {name} double")


@pytest.mark.parametrize(
    ("name", "old", "new", "kept"),
    [
        ("correlation", OLD_CORRELATION, NEW_CORRELATION, 0.8373140418565772),
        ("covariance", OLD_COVARIANCE, NEW_COVARIANCE, 0.773806133401088),
    ],
)
def test_matrix_preservation(spark, name, old, new, kept):
    before = long_matrix(spark, old, name, 0).drop("config_id")
    found = matrix_preservation(before, long_matrix(spark, new, name, 0), name).first()
    assert found[f"{name}_preservation"] == pytest.approx(kept, abs=1e-12)


def test_statistical_similarity(spark):
    def side(means, variances):
        rows = [
            (0, f, m, math.sqrt(v * (ROWS - 1) / ROWS)) for f, m, v in zip(FEATURES, means, variances, strict=True)
        ]
        return spark.createDataFrame(rows, "config_id int, feature string, mean double, std_pop double")

    found = statistical_similarity(side(OLD_MEAN, OLD_VARIANCE).drop("config_id"), side(NEW_MEAN, NEW_VARIANCE)).first()
    assert found["statistical_similarity"] == pytest.approx(0.8601763045252108, abs=1e-12)
