"""The whole run: profile, train, sweep, release the winner, write the reports."""

from __future__ import annotations

import argparse
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions.draws import Draws
from veilframe.operators.clean import cap_rows, clean_people, repeated_ids
from veilframe.operators.drift import drift_table
from veilframe.operators.masks import evaluate_masks, released, wide
from veilframe.operators.models import ModelOptions, evaluate_models, unmasked
from veilframe.operators.moments import matrices_long, moments_long, moments_wide, table_cube
from veilframe.operators.project import project_numbers
from veilframe.operators.ranking import number_rows
from veilframe.plans import report
from veilframe.plans.sweep import SweepOptions, adaptive_sweep, best_config
from veilframe.session import settle
from veilframe.sources.tables import read_numbered, read_people, read_table, write_report, write_rows
from veilframe.spec import MaskingConfig, MaskSpec

# Weight of the balance bonus and number of adaptive trials in a whole run.
RUN_PRIVACY_WEIGHT, RUN_TRIALS = 0.55, 8


@dataclass
class RunResult:
    results: DataFrame
    masked: DataFrame
    config: MaskingConfig
    summary: DataFrame


def load(
    spark: SparkSession, path: str, row_id: str | None = None, limit: int | None = None, draws: Draws | None = None
) -> DataFrame:
    """Clean person table from a file, or from the first known file of a folder.

    A key that is not unique is refused; without a key the rows are numbered.
    """
    raw = read_table(spark, path) if path.rstrip("/").lower().endswith((".csv", ".parquet")) else read_people(spark, path)
    keyed = raw.withColumnRenamed(row_id, "row_id") if row_id else raw
    if "row_id" not in keyed.columns:
        # Rows of Parquet files know their places; other formats are numbered through a checkpoint.
        keyed = read_numbered(spark, path) if path.rstrip("/").lower().endswith(".parquet") else number_rows(keyed)
    elif repeated_ids(keyed).limit(1).count():
        raise ValueError(f"{row_id or 'row_id'} is not unique")
    people = clean_people(keyed)
    return people if limit is None else cap_rows(people, limit, MaskSpec(), draws or Draws())


def write_profile(df: DataFrame, spec: MaskSpec, out: str, name: str) -> None:
    """Mean, variance, covariance and correlation of one table of numbers or codes."""
    wide_moments = settle(moments_wide(table_cube(df, spec), spec))
    long = settle(moments_long(wide_moments, spec).drop("config_id"))
    cells = settle(matrices_long(wide_moments, spec).drop("config_id"))
    write_report(long.select("feature", "mean"), f"{out}/{name}_mean")
    write_report(long.select("feature", "variance"), f"{out}/{name}_variance")
    write_report(cells.select("feature_a", "feature_b", "covariance"), f"{out}/{name}_covariance")
    write_report(cells.select("feature_a", "feature_b", "correlation"), f"{out}/{name}_correlation")


def run(
    people: DataFrame,
    out: str,
    draws: Draws,
    spec: MaskSpec | None = None,
    sweep_options: SweepOptions | None = None,
    model_options: ModelOptions | None = None,
    configs: list[MaskingConfig] | None = None,
    trials: int = RUN_TRIALS,
    masked_format: str = "parquet",
) -> RunResult:
    """Run everything on a clean table and write all outputs under ``out``.

    ``draws`` mask the released table; keep their seed secret when it is published. The clean
    table is written first and read back, so the passes over it do not clean it again.
    """
    spec = spec or MaskSpec()
    sweep_options = sweep_options or SweepOptions(privacy_weight=RUN_PRIVACY_WEIGHT)
    models = model_options or ModelOptions()

    write_rows(people, f"{out}/cleaned_working_dataset")
    people = people.sparkSession.read.parquet(f"{out}/cleaned_working_dataset")
    write_profile(people, spec, out, "original")
    baseline = settle(evaluate_models(unmasked(people, spec), spec, models))
    write_report(baseline, f"{out}/original_ml_metrics")

    results = settle(adaptive_sweep(people, spec, configs, sweep_options, baseline, trials=trials))
    write_report(report.tradeoff(results), f"{out}/privacy_utility_tradeoff")
    write_report(results.orderBy(F.desc("objective_score"), "config_id"), f"{out}/optimization_results")

    config = best_config(results)
    frame = evaluate_masks(people, spec, [config], draws)
    write_rows(released(frame, spec, config), f"{out}/best_masked_dataset", masked_format)
    masked = (
        people.sparkSession.read.option("header", True).csv(f"{out}/best_masked_dataset")
        if masked_format == "csv"
        else people.sparkSession.read.format(masked_format).load(f"{out}/best_masked_dataset")
    )
    # The released table is read as its users read it: ranges and levels are parsed back.
    numbers = project_numbers(masked, spec, keep=[spec.category, *spec.carried])
    write_profile(numbers, spec, out, "best_masked")

    best_models = settle(evaluate_models(frame, spec, models, binned=config.method == "generalization"))
    write_report(best_models, f"{out}/best_masked_ml_metrics")
    drift = settle(drift_table(wide(people, spec), frame, spec).drop("config_id").orderBy("feature"))
    write_report(drift, f"{out}/statistical_validation")

    write_report(report.setting_scores(results), f"{out}/top_config_scores")
    write_report(report.model_comparison(baseline, best_models), f"{out}/model_metric_comparison")
    write_report(report.stage_accuracies(baseline, best_models), f"{out}/generalization_diagnostics")
    write_report(report.loss_by_method(results), f"{out}/information_loss_by_method")
    write_report(report.drift_metrics(drift), f"{out}/transformation_impact")
    write_report(report.printed_settings(results), f"{out}/top_settings")
    summary = settle(report.run_summary(results))
    write_report(summary, f"{out}/run_summary")
    return RunResult(results, masked, config, summary)


def main() -> None:
    parser = argparse.ArgumentParser(description="Mask a person table and report what it costs.")
    parser.add_argument("input", help="CSV or Parquet file, or a folder with a known file name")
    parser.add_argument("output", help="folder for the masked table and the reports")
    parser.add_argument("--row-id", help="unique key column; numbered when absent")
    parser.add_argument("--limit", type=int, help="use only this many rows, drawn without replacement")
    parser.add_argument("--seed", required=True, help="seed of the draws; keep it secret when you publish")
    options = parser.parse_args()
    spark = SparkSession.builder.appName("veilframe").getOrCreate()
    people = load(spark, options.input, options.row_id, options.limit, Draws(options.seed))
    result = run(people, options.output, Draws(options.seed))
    result.summary.show(truncate=False, vertical=True)


if __name__ == "__main__":
    main()
