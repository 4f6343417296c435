"""Parzen search: proposals stay in range, repeat, and follow what the history says."""

from veilframe.functions.draws import Draws
from veilframe.plans.candidates import ADAPTIVE_BUDGET, CROSSOVER_BOUNDS, USED_FIELDS, canonical
from veilframe.plans.parzen import BIN_CHOICES, proposals, proposed_settings
from veilframe.spec import METHODS, MaskingConfig, config_frame


def history(spark, configs, scores):
    frame = config_frame(spark, configs)
    found = spark.createDataFrame(list(enumerate(scores)), "config_id int, objective_score double")
    return frame.join(found, "config_id")


def check(config):
    assert config == canonical(config)
    bounds = {**CROSSOVER_BOUNDS, "hybrid_dp_budget_fraction": ADAPTIVE_BUDGET}
    for name in USED_FIELDS[config.method]:
        if name == "generalization_bin":
            assert config.generalization_bin in BIN_CHOICES
        else:
            low, high = bounds[name]
            assert low - 1e-9 <= getattr(config, name) <= high + 1e-9


def test_proposals_follow_the_good_settings(spark):
    configs = [MaskingConfig("noise", noise_std=0.2 + k / 4, gender_mask_probability=0.1) for k in range(40)]
    configs += [MaskingConfig("generalization", generalization_bin=b, gender_mask_probability=p / 10) for b in BIN_CHOICES for p in range(5)]
    configs += [MaskingConfig("differential_privacy", epsilon=0.3 + k / 5) for k in range(25)]
    configs += [MaskingConfig("data_swapping", swap_fraction=k / 60) for k in range(25)]
    configs += [MaskingConfig("feature_perturbation", perturbation_strength=k / 60) for k in range(25)]
    configs += [MaskingConfig("hybrid", noise_std=0.1 + k / 10, epsilon=1.0 + k / 10) for k in range(25)]
    scores = [1.0 - abs(c.noise_std - 7.0) / 10 if c.method == "noise" else 0.1 for c in configs]
    past = history(spark, configs, scores).repartition(5)
    found = proposed_settings(past, 10, {c.label() for c in configs}, Draws())
    assert found == proposed_settings(past.coalesce(1), 10, {c.label() for c in configs}, Draws())
    assert len(found) == 10 and len({c.label() for c in found}) == 10
    for config in found:
        check(config)
    noisy = [c.noise_std for c in found if c.method == "noise"]
    assert len(noisy) >= 8 and sum(5.0 < s < 9.0 for s in noisy) >= 0.7 * len(noisy)
    assert proposed_settings(past, 4, set(), Draws(), first=100) != proposed_settings(past, 4, set(), Draws())


def test_without_or_with_little_history(spark):
    for configs, methods in (([], 3), ([MaskingConfig("data_swapping", swap_fraction=0.1)], 1)):
        rows = proposals(history(spark, configs, [0.5] * len(configs)), 40).collect()
        assert len(rows) == 40 and {r["method"] for r in rows} <= set(METHODS)
        for row in rows:
            check(MaskingConfig(**{k: v for k, v in row.asDict().items() if k != "proposal"}))
        assert len({r["method"] for r in rows}) >= methods
