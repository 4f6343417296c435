"""Measure many masking settings over the whole table and rank them.

Settings are handled in chunks. One chunk is a handful of jobs whatever the number of its
settings: facts about the table, the category cube, the identifier classes and the value
histogram. Only per-setting summaries leave the executors.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions.draws import TRIAL, Draws
from veilframe.operators.drift import DEFAULT_BUCKETS, counted_drift, mean_drift, original_points, spec_edges
from veilframe.operators.masks import TableFacts, evaluate_masks, release, table_facts, wide
from veilframe.operators.models import FAST, ModelOptions, evaluate_models, unmasked
from veilframe.operators.moments import coded_cube, original_cube
from veilframe.operators.privacy import PRIVACY_COLUMNS, masked_identifiers, part_summary, privacy_metrics
from veilframe.operators.tally import (
    CELL_NUMBER,
    bucket_rows,
    cell_numbers,
    class_rows,
    cube_rows,
    pair_identifiers,
    tally,
    values_of_buckets,
    with_cells,
)
from veilframe.operators.utility import (
    DEFAULT_PRIVACY_WEIGHT,
    UTILITY_COLUMNS,
    baseline_summary,
    fidelity,
    model_summary,
    objective,
    utility_metrics,
)
from veilframe.plans.candidates import adaptive_settings, default_candidates
from veilframe.plans.parzen import proposed_settings
from veilframe.session import settle
from veilframe.spec import CONFIG_SCHEMA, MaskingConfig, MaskSpec, config_frame

ROWS_PER_BUCKET = 2_000
MOST_BUCKETS = 2_048

MODEL_RATES = ("overfitting_rate", "underfitting_rate", "memorization_risk_rate")
DRIFT_MEANS = (
    "mean_ks_statistic", "mean_kl_divergence", "mean_wasserstein_distance", "mean_variance_preservation",
)
RESULT_COLUMNS = (
    *[f.name for f in CONFIG_SCHEMA], "optimizer", *PRIVACY_COLUMNS, *UTILITY_COLUMNS, "objective_score",
    *DRIFT_MEANS, *MODEL_RATES,
)


@dataclass(frozen=True)
class SweepOptions:
    """How a sweep runs.

    ``models`` set to None screens settings without training: the model terms of the utility
    then count as fully retained, the same for every setting. Trials use the cheap draws;
    the winner is masked again with the draws of the release.
    """

    privacy_weight: float = DEFAULT_PRIVACY_WEIGHT
    configs_per_job: int = 16
    models: ModelOptions | None = FAST
    model_threads: int = 2
    draws: Draws = TRIAL
    identifiers: tuple[str, ...] | None = None


@dataclass
class Prepared:
    """What every chunk shares: the original side is measured once per sweep.

    ``cells`` number the texts of a row (``tally.cell_numbers``); None if they are too many.
    """

    table: DataFrame
    original: DataFrame
    cube: DataFrame
    facts: TableFacts
    edges: dict[str, list[float]]
    points: DataFrame
    cells: DataFrame | None


def prepare(df: DataFrame, spec: MaskSpec) -> Prepared:
    facts = table_facts(df, spec)
    original = wide(df, spec)
    buckets = max(DEFAULT_BUCKETS, min(MOST_BUCKETS, facts.rows // ROWS_PER_BUCKET))
    edges = spec_edges(original, spec, buckets)
    cube = original_cube(original, spec)
    return Prepared(df, original, cube, facts, edges, original_points(original, spec, edges), cell_numbers(cube, spec))


def measure(
    prepared: Prepared, spec: MaskSpec, configs: Sequence[MaskingConfig], options: SweepOptions, first_id: int = 0
) -> DataFrame:
    """Privacy, preservation and mean drift of every setting, one row each.

    Rows are masked twice: once for all that is counted, and once for the values of open buckets.
    """
    identifiers = masked_identifiers(spec, options.identifiers)
    counted_classes, cells, table, masked = pair_identifiers(spec, identifiers), prepared.cells, prepared.table, spec
    if cells is not None and (counted_classes or not identifiers):
        table, masked = with_cells(table, spec, cells), replace(spec, carried=(CELL_NUMBER,))
    else:
        cells = None
    frame = evaluate_masks(table, masked, configs, options.draws, prepared.facts, first_id)
    found = tally(frame, spec, prepared.edges, identifiers, first_id, len(configs), prepared.facts.rows)
    cube = coded_cube(settle(cube_rows(found, spec, cells)), spec)
    classes = part_summary(class_rows(found), ["config_id"]) if counted_classes else None
    drift = counted_drift(
        spec, (prepared.cube, cube), prepared.points, bucket_rows(found),
        lambda wanted: values_of_buckets(frame, spec, prepared.edges, wanted, first_id, len(configs)),
    )
    return (
        privacy_metrics(frame, spec, options.identifiers, cube, classes)
        .join(fidelity(prepared.cube, cube, spec), "config_id")
        .join(mean_drift(drift), "config_id")
    )


def trained(
    prepared: Prepared, spec: MaskSpec, configs: Sequence[MaskingConfig], options: SweepOptions, first_id: int = 0
) -> DataFrame:
    """Model summary of every setting; settings train side by side in a few threads."""
    spark = prepared.table.sparkSession

    def one(item: tuple[int, MaskingConfig]) -> DataFrame:
        config_id, config = item
        frame = evaluate_masks(prepared.table, spec, [config], options.draws, prepared.facts, config_id)
        rows = evaluate_models(frame, spec, options.models, binned=config.method == "generalization")
        return rows.withColumn("config_id", F.lit(config_id))

    with ThreadPoolExecutor(max_workers=max(1, options.model_threads)) as pool:
        parts = list(pool.map(inheritable_thread_target(spark)(one), enumerate(configs, start=first_id)))
    return model_summary(reduce(DataFrame.unionByName, parts), ["config_id"])


def retained(measured: DataFrame) -> DataFrame:
    """Model terms of a screening sweep."""
    return measured.select(
        "config_id",
        *[F.lit(1.0).alias(c) for c in ("masked_accuracy", "masked_roc_auc", "generalization_quality")],
        *[F.lit(0.0).alias(c) for c in MODEL_RATES],
    )


def score(
    measured: DataFrame, models: DataFrame, baseline: tuple[float, float], settings: DataFrame, options: SweepOptions
) -> DataFrame:
    """Result rows with utility and objective."""
    return (
        utility_metrics(measured, models, baseline)
        .withColumn("objective_score", objective(F.col("privacy_score"), F.col("utility_score"), options.privacy_weight))
        .join(settings, "config_id")
        .select(*RESULT_COLUMNS)
    )


def sweep(
    df: DataFrame,
    spec: MaskSpec,
    configs: Sequence[MaskingConfig] | None = None,
    options: SweepOptions | None = None,
    baseline: DataFrame | None = None,
    optimizer: str = "grid_random_genetic",
    prepared: Prepared | None = None,
    first_id: int = 0,
) -> DataFrame:
    """Result table of all settings, best first.

    ``baseline`` are model rows of the original table. Without them the same quick models
    are trained on the original, so like is compared with like.
    """
    options = options or SweepOptions()
    configs = default_candidates() if configs is None else list(configs)
    prepared = prepared or prepare(df, spec)
    spark = df.sparkSession
    if options.models is None:
        reference = (1.0, 1.0)
    else:
        rows = baseline if baseline is not None else evaluate_models(unmasked(df, spec), spec, options.models)
        reference = baseline_summary(rows)
    results = []
    for start in range(0, len(configs), options.configs_per_job):
        chunk, offset = configs[start : start + options.configs_per_job], first_id + start
        measured = settle(measure(prepared, spec, chunk, options, offset))
        models = retained(measured) if options.models is None else trained(prepared, spec, chunk, options, offset)
        settings = config_frame(spark, chunk, offset).withColumn("optimizer", F.lit(optimizer))
        results.append(settle(score(measured, models, reference, settings, options)))
    return ranked(reduce(DataFrame.unionByName, results))


def ranked(results: DataFrame) -> DataFrame:
    """Best objective first; the earlier setting wins a tie."""
    return results.orderBy(F.desc("objective_score"), "config_id")


def best_config(results: DataFrame) -> MaskingConfig:
    row = ranked(results).first()
    if row is None:
        raise ValueError("the sweep has no results")
    values = {f.name: row[f.name] for f in CONFIG_SCHEMA if f.name not in ("config_id", "config_label")}
    return MaskingConfig(**values)


def adaptive_sweep(
    df: DataFrame,
    spec: MaskSpec,
    configs: Sequence[MaskingConfig] | None = None,
    options: SweepOptions | None = None,
    baseline: DataFrame | None = None,
    rounds: int = 2,
    trials: int = 8,
    parents: int = 5,
    seed: int = 42,
    search: str = "parzen",
) -> DataFrame:
    """A sweep, then rounds of new settings.

    ``parzen`` proposes them from the densities of good and bad settings so far. ``crossover`` takes
    children of the best ``parents`` by turns with draws from the whole ranges, which also make up
    for proposals that were measured before: ``trials`` new settings are measured.
    """
    if search not in ("parzen", "crossover"):
        raise ValueError(f"unknown search: {search}")
    options = options or SweepOptions()
    configs = default_candidates() if configs is None else list(configs)
    prepared = prepare(df, spec)
    if options.models is not None and baseline is None:
        baseline = evaluate_models(unmasked(df, spec), spec, options.models)
    results = sweep(df, spec, configs, options, baseline, prepared=prepared)
    known = {config.label() for config in configs}
    next_id = len(configs)
    for number in range(rounds):
        top = [_config(row) for row in ranked(results).limit(parents).collect()]
        share = trials * (number + 1) // rounds - trials * number // rounds
        fresh = proposed_settings(results, share, known, Draws(seed), first=2 * trials * number) if search == "parzen" else []
        fresh += adaptive_settings(top, share - len(fresh), known | {c.label() for c in fresh}, seed + number)
        if not fresh:
            continue
        known |= {child.label() for child in fresh}
        found = sweep(df, spec, fresh, options, baseline, "adaptive", prepared, next_id)
        results = ranked(results.unionByName(found))
        next_id += len(fresh)
    return results


def _config(row: T.Row) -> MaskingConfig:
    return MaskingConfig(
        **{f.name: row[f.name] for f in CONFIG_SCHEMA if f.name not in ("config_id", "config_label")}
    )


def best_release(
    df: DataFrame, spec: MaskSpec, results: DataFrame, draws: Draws
) -> tuple[DataFrame, MaskingConfig]:
    """The winner's masked table; no other setting is ever materialised."""
    config = best_config(results)
    return release(df, spec, config, draws), config
