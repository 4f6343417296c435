"""Candidate masking settings: a fixed grid, random picks, and crossover of earlier ones.

Settings are a few dozen small records, so they are made on the driver; the rows they are
applied to never are.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from itertools import product
from math import exp, log
from random import Random

from veilframe.spec import METHODS, MaskingConfig

# The grid.
GRID_NOISE = (0.5, 3.0, 8.0)
GRID_BINS = (10, 20, 30)
GRID_EPSILON = (0.5, 1.0, 3.0)
GRID_SWAP = (0.05, 0.20)
GRID_STRENGTH = (0.05, 0.20)
GRID_HYBRID = {"noise_std": (1.5, 6.0), "generalization_bin": (10, 20), "epsilon": (0.5, 2.0)}
HYBRID_SWAP = HYBRID_STRENGTH = 0.10

# Value lists and method shares of the random search, and its anchors.
METHOD_SHARES = (0.16, 0.16, 0.20, 0.13, 0.13, 0.22)
RANDOM_NOISE = (0.25, 0.5, 1.0, 1.5, 3.0, 6.0, 10.0)
RANDOM_BINS = (5, 10, 15, 20, 25, 30)
RANDOM_EPSILON = (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0)
RANDOM_SHARE = (0.0, 0.05, 0.10, 0.20, 0.35)
RANDOM_BUDGET = (0.5, 0.6, 0.7, 0.8)
ANCHORS = (
    MaskingConfig("noise", noise_std=1.5, gender_mask_probability=0.075),
    MaskingConfig("generalization", generalization_bin=10),
    MaskingConfig("differential_privacy", epsilon=1.0),
    MaskingConfig("data_swapping", swap_fraction=0.10),
    MaskingConfig("feature_perturbation", perturbation_strength=0.10),
    MaskingConfig(
        "hybrid", noise_std=3.0, generalization_bin=15, epsilon=2.0, gender_mask_probability=0.15,
        hybrid_dp_budget_fraction=0.7, swap_fraction=0.10, perturbation_strength=0.10,
    ),
)

# Jitter and bounds of crossover, and the bounds of the adaptive search.
CROSSOVER_JITTER = {"noise_std": 0.7, "epsilon": 0.35, "swap_fraction": 0.03, "perturbation_strength": 0.03}
CROSSOVER_BOUNDS = {
    "noise_std": (0.1, 12.0), "epsilon": (0.2, 6.0), "gender_mask_probability": (0.0, 0.65),
    "swap_fraction": (0.0, 0.45), "perturbation_strength": (0.0, 0.45),
}
CROSSOVER_BINS = (5, 10, 15, 20, 25)
ADAPTIVE_BUDGET = (0.5, 0.85)
ADAPTIVE_BINS = (5, 30)

USED_FIELDS = {  # the fields that a method looks at
    "noise": ("noise_std", "gender_mask_probability"),
    "generalization": ("generalization_bin", "gender_mask_probability"),
    "differential_privacy": ("epsilon",),
    "data_swapping": ("swap_fraction",),
    "feature_perturbation": ("perturbation_strength",),
    "hybrid": (
        "noise_std", "generalization_bin", "epsilon", "hybrid_dp_budget_fraction", "swap_fraction",
        "perturbation_strength",
    ),
}


def suppression_for(noise: float) -> float:
    """Suppression probability that goes with a noise level."""
    return min(noise / 20, 0.5)


def default_grid() -> list[MaskingConfig]:
    single = [
        *(MaskingConfig("noise", noise_std=s, gender_mask_probability=suppression_for(s)) for s in GRID_NOISE),
        *(MaskingConfig("generalization", generalization_bin=w) for w in GRID_BINS),
        *(MaskingConfig("differential_privacy", epsilon=e) for e in GRID_EPSILON),
        *(MaskingConfig("data_swapping", swap_fraction=f) for f in GRID_SWAP),
        *(MaskingConfig("feature_perturbation", perturbation_strength=s) for s in GRID_STRENGTH),
    ]
    hybrid = []
    for values in product(*GRID_HYBRID.values()):
        chosen = dict(zip(GRID_HYBRID, values, strict=True))
        hybrid.append(
            MaskingConfig(
                "hybrid",
                gender_mask_probability=suppression_for(chosen["noise_std"]),
                swap_fraction=HYBRID_SWAP,
                perturbation_strength=HYBRID_STRENGTH,
                **chosen,
            )
        )
    return single + hybrid


def random_config(method: str, rng: Random) -> MaskingConfig:
    """All fields drawn from their value lists, whatever the method uses."""
    noise = rng.choice(RANDOM_NOISE)
    return MaskingConfig(
        method,
        noise_std=noise,
        generalization_bin=rng.choice(RANDOM_BINS),
        epsilon=rng.choice(RANDOM_EPSILON),
        gender_mask_probability=suppression_for(noise),
        hybrid_dp_budget_fraction=rng.choice(RANDOM_BUDGET),
        swap_fraction=rng.choice(RANDOM_SHARE),
        perturbation_strength=rng.choice(RANDOM_SHARE),
    )


def random_search(count: int = 24, seed: int = 42) -> list[MaskingConfig]:
    """The anchors and ``count`` random settings."""
    rng = Random(seed)
    picks = [random_config(rng.choices(METHODS, METHOD_SHARES)[0], rng) for _ in range(count)]
    return distinct([*ANCHORS, *picks])


def cross(left: MaskingConfig, right: MaskingConfig, rng: Random) -> MaskingConfig:
    """Child of two settings: mean fields with jitter inside bounds, discrete fields inherited."""

    def blend(name: str) -> float:
        low, high = CROSSOVER_BOUNDS[name]
        middle = (getattr(left, name) + getattr(right, name)) / 2
        return max(low, min(high, middle + rng.gauss(0.0, CROSSOVER_JITTER.get(name, 0.0))))

    return MaskingConfig(
        rng.choice((left.method, right.method)),
        generalization_bin=rng.choice((left.generalization_bin, right.generalization_bin, *CROSSOVER_BINS)),
        hybrid_dp_budget_fraction=rng.choice(RANDOM_BUDGET),
        **{name: blend(name) for name in CROSSOVER_BOUNDS},
    )


def crossover_search(
    generations: int = 3,
    population: int = 10,
    seed: int = 49,
    parents: Sequence[MaskingConfig] | None = None,
) -> list[MaskingConfig]:
    """Generations of children; parents are drawn evenly from the last generation.

    Without ``parents`` the first generation is random. With measured ones (the best of a
    sweep) the children explore around them.
    """
    rng = Random(seed)
    current = list(parents) if parents else [random_config(rng.choice(METHODS), rng) for _ in range(population)]
    found = [] if parents else list(current)
    for _ in range(generations):
        current = [cross(rng.choice(current), rng.choice(current), rng) for _ in range(population)]
        found += current
    return distinct(found)


def ranged_config(method: str, rng: Random) -> MaskingConfig:
    """Setting drawn from the whole ranges of the fields that its method uses; the privacy budget on a log scale."""

    def within(name: str) -> float:
        return rng.uniform(*CROSSOVER_BOUNDS[name])

    low, high = CROSSOVER_BOUNDS["epsilon"]
    return canonical(
        MaskingConfig(
            method,
            noise_std=within("noise_std"),
            generalization_bin=rng.randint(*ADAPTIVE_BINS),
            epsilon=exp(rng.uniform(log(low), log(high))),
            gender_mask_probability=within("gender_mask_probability"),
            hybrid_dp_budget_fraction=rng.uniform(*ADAPTIVE_BUDGET),
            swap_fraction=within("swap_fraction"),
            perturbation_strength=within("perturbation_strength"),
        )
    )


def adaptive_settings(parents: Sequence[MaskingConfig], count: int, known: Iterable[str], seed: int) -> list[MaskingConfig]:
    """``count`` settings whose labels are not known yet, by turns children of the parents and drawn from the ranges."""
    rng, seen, found = Random(seed), set(known), []
    while len(found) < count:
        crossed = len(found) % 2 == 0
        config = cross(rng.choice(parents), rng.choice(parents), rng) if crossed else ranged_config(rng.choice(METHODS), rng)
        if config.label() in seen:
            config = ranged_config(rng.choice(METHODS), rng)
        if config.label() not in seen:
            seen.add(config.label())
            found.append(config)
    return found


def distinct(configs: Iterable[MaskingConfig]) -> list[MaskingConfig]:
    """First setting of each label."""
    by_label: dict[str, MaskingConfig] = {}
    for config in configs:
        by_label.setdefault(config.label(), config)
    return list(by_label.values())


def canonical(config: MaskingConfig) -> MaskingConfig:
    """Reset fields that the method ignores, so settings that mask alike share a label."""
    return MaskingConfig(config.method, **{name: getattr(config, name) for name in USED_FIELDS[config.method]})


def default_candidates(seed: int = 42) -> list[MaskingConfig]:
    """Grid, eight random picks with the anchors, and one generation of crossover."""
    return distinct([*default_grid(), *random_search(8, seed), *crossover_search(1, 6, seed + 7)])
