"""Registered queries: every operator over whole tables, with plain column names."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import cache

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.people import (
    ORDERS_PEOPLE,
    PEOPLE,
    orders_people,
    people,
    people_aliased,
    people_dirty,
    people_scores,
    table,
)
from checks.settings import (
    CAP,
    GENERAL,
    HYBRID,
    KEPT,
    LAPLACE,
    NOISE,
    ORDERS_GENERAL,
    ORDERS_NOISE,
    ORDERS_PERTURB,
    ORDERS_SWAP,
    PERTURB,
    PROPOSALS,
    SHARE,
    SIX,
    SWAP,
    SWAP_BUCKETS,
    WEIGHT,
)
from veilframe.functions.draws import TRIAL, Draws
from veilframe.functions.numeric import range_midpoint, rounded
from veilframe.operators import boosting, drift, features, masks, moments, neighbours, privacy, scoring, utility
from veilframe.operators.clean import binary_target, cap_rows, clean_people, income_flag, person_cells, share_rows
from veilframe.operators.models import ModelOptions, evaluate_models, unmasked
from veilframe.operators.project import add_category_code, fill_numbers, project_numbers
from veilframe.plans import parzen, report
from veilframe.plans.candidates import ANCHORS, crossover_search, default_candidates, default_grid, random_search
from veilframe.plans.sweep import SweepOptions, adaptive_sweep, measure, prepare, sweep
from veilframe.session import shared_table_path
from veilframe.sources.tables import read_numbered, read_people, write_rows
from veilframe.spec import MaskingConfig, MaskSpec, config_frame

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def tidy(df: DataFrame) -> DataFrame:
    """Doubles rounded, counts as BIGINT."""
    kinds = {"double": rounded, "float": rounded}
    return df.select(*[kinds[k](F.col(c)).alias(c) if k in kinds else F.col(c) for c, k in df.dtypes])


# --- preparation -------------------------------------------------------------------------


@query
def clean_people_table(spark, sf):
    return clean_people(people_dirty(spark, sf))


@query
def clean_people_aliased(spark, sf):
    return clean_people(people_aliased(spark, sf))


@query
def csv_round_trip(spark, sf):
    """The damaged people written as CSV, found in their folder by name, read as text and cleaned."""
    folder = shared_table_path(spark, f"csv-{uuid.uuid4().hex}")
    write_rows(people_dirty(spark, sf), f"{folder}/adult.csv", "csv")
    raw = read_people(spark, folder)
    return clean_people(raw.withColumn("row_id", F.col("row_id").cast("bigint")))


@query
def income_text_to_flag(spark, sf):
    return people_aliased(spark, sf).select("row_id", income_flag(F.col("class")).alias("income"))


@query
def missing_tokens(spark, sf):
    cells = person_cells(people_dirty(spark, sf))
    return cells.agg(
        *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in ("age", "gender", "income", "education", "occupation")]
    )


@query
def cap_sample(spark, sf):
    return cap_rows(people(spark, sf), CAP, PEOPLE, Draws())


@query
def share_sample(spark, sf):
    return share_rows(people(spark, sf), SHARE, PEOPLE, Draws())


@query
def row_numbers(spark, sf):
    return read_numbered(spark, f"{sf.rstrip('/')}/orders.parquet").select("row_id", "o_orderkey", "o_totalprice")


@query
def range_midpoints(spark, sf):
    table = masks.release(people(spark, sf), PEOPLE, GENERAL, Draws())
    return tidy(table.select("row_id", "age", range_midpoint(F.col("age")).alias("midpoint")))


@query
def category_codes(spark, sf):
    table = masks.release(people(spark, sf), PEOPLE, GENERAL, Draws())
    return add_category_code(table, "gender", "code").select("row_id", "gender", F.col("code").cast("bigint").alias("code"))


@query
def category_codes_of_names(spark, sf):
    """A text that no two rows share, with a long common prefix."""
    customer = table(spark, sf, "customer")
    return add_category_code(customer, "c_name", "code").select("c_custkey", "c_name", F.col("code").cast("bigint").alias("code"))


@query
def category_codes_of_dates(spark, sf):
    dated = table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd.MM.yyyy").alias("day"))
    return add_category_code(dated, "day", "code").select("o_orderkey", "day", F.col("code").cast("bigint").alias("code"))


@query
def numeric_projection(spark, sf):
    return tidy(project_numbers(masks.release(people(spark, sf), PEOPLE, GENERAL, Draws()), PEOPLE, ["row_id"]))


@query
def projection_of_mixed_flags(spark, sf):
    """One unreadable flag cell makes the whole flag column a level column."""
    return tidy(
        project_numbers(
            people(spark, sf).withColumn(
                "income", F.when(F.col("row_id") % 2 == 0, F.when(F.col("income") == 1, "High").otherwise("Low")).otherwise(F.col("income").cast("string"))
            ),
            PEOPLE,
            ["row_id"],
        )
    )


@query
def fill_missing_numbers(spark, sf):
    raw = people_dirty(spark, sf).select("row_id", F.col("Age").alias("age"), F.col("Income").alias("income"))
    return tidy(fill_numbers(raw, PEOPLE))


@query
def binary_targets(spark, sf):
    table = masks.release(people(spark, sf), PEOPLE, NOISE, Draws())
    return table.select("row_id", binary_target(F.col("income")).alias("target"))


@query
def one_hot_counts(spark, sf):
    from pyspark.ml.functions import vector_to_array

    table = masks.release(people(spark, sf), PEOPLE, GENERAL, Draws())
    texts = ["age", "gender", "education", "occupation"]
    model = features.design_model(table, [], texts)
    names = features.feature_names(model, [], texts)
    hot = model.transform(table).select(F.posexplode(vector_to_array("features")).alias("slot", "value"))
    names_array = F.array(*[F.lit(n) for n in names])
    return hot.groupBy("slot").agg(F.sum("value").cast("bigint").alias("ones")).select(
        F.element_at(names_array, F.col("slot") + 1).alias("feature"), "ones"
    )


# --- masks -------------------------------------------------------------------------------


def masked_rows(df: DataFrame, spec: MaskSpec, config: MaskingConfig) -> DataFrame:
    return masked_columns(masks.evaluate_masks(df, spec, [config]), spec)


def people_missing_ages(spark: SparkSession, sf: str) -> DataFrame:
    return people(spark, sf).withColumn("age", F.when(F.col("row_id") % 3 != 0, F.col("age")))


def masked_columns(frame: DataFrame, spec: MaskSpec) -> DataFrame:
    m = [f"m_{spec.numeric}", f"m_{spec.numeric}_label", f"m_{spec.category}", f"m_{spec.flag}", f"m_{spec.flag}_label"]
    return tidy(frame.select("row_id", *m))


@query
def mask_noise(spark, sf):
    return masked_rows(people(spark, sf), PEOPLE, NOISE)


@query
def mask_suppress(spark, sf):
    frame = masks.evaluate_masks(people(spark, sf), PEOPLE, [NOISE])
    return frame.groupBy("o_gender", "m_gender").agg(F.count(F.lit(1)).alias("n"))


@query
def mask_swap_exact(spark, sf):
    return masked_rows(people(spark, sf), PEOPLE, SWAP)


@query
def mask_swap_bucketed(spark, sf):
    return masked_columns(masks.bucketed_swap(people(spark, sf), PEOPLE, SWAP, SWAP_BUCKETS), PEOPLE)


@query
def mask_swap_permuted(spark, sf):
    """Exactly as many rows as ``mask_swap_exact`` moves, by a uniform permutation in 16 ranges."""
    df = people(spark, sf)
    return masked_columns(masks.permuted_swap(df, PEOPLE, SWAP, bucket_rows=max(1, df.count() // SWAP_BUCKETS)), PEOPLE)


@query
def mask_perturb(spark, sf):
    return masked_rows(people(spark, sf), PEOPLE, PERTURB)


@query
def mask_without_gender(spark, sf):
    """Columns that a table lacks are skipped."""
    return tidy(masks.release(people(spark, sf).drop("gender"), PEOPLE, NOISE, Draws()))


@query
def mask_perturb_missing(spark, sf):
    return masked_rows(people_missing_ages(spark, sf), PEOPLE, PERTURB)


@query
def mask_hybrid_missing(spark, sf):
    return masked_rows(people_missing_ages(spark, sf), PEOPLE, HYBRID)


@query
def mask_generalize(spark, sf):
    return masked_rows(people(spark, sf), PEOPLE, GENERAL)


@query
def mask_laplace(spark, sf):
    return masked_rows(people(spark, sf), PEOPLE, LAPLACE)


@query
def mask_randomized_response(spark, sf):
    frame = masks.evaluate_masks(people(spark, sf), PEOPLE, [LAPLACE])
    return frame.groupBy("o_gender", "m_gender").agg(F.count(F.lit(1)).alias("n"))


@query
def mask_rr_three_valued(spark, sf):
    return masked_rows(orders_people(spark, sf), ORDERS_PEOPLE, LAPLACE)


@query
def mask_hybrid(spark, sf):
    return masked_rows(people(spark, sf), PEOPLE, HYBRID)


@query
def mask_orders_noise(spark, sf):
    return masked_rows(orders_people(spark, sf), ORDERS_PEOPLE, ORDERS_NOISE)


@query
def mask_orders_generalize(spark, sf):
    return masked_rows(orders_people(spark, sf), ORDERS_PEOPLE, ORDERS_GENERAL)


@query
def mask_many_settings(spark, sf):
    """All six masks in one frame, summed up per setting."""
    frame = masks.evaluate_masks(people(spark, sf), PEOPLE, SIX, TRIAL)
    return tidy(
        frame.groupBy("config_id").agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("m_age").alias("mean_age"),
            F.avg("m_income").alias("mean_income"),
            F.count_if(F.col("m_gender") == F.col("o_gender")).alias("same_gender"),
            F.count("m_age_label").alias("binned"),
        )
    )


@query
def release_generalized(spark, sf):
    return masks.release(people(spark, sf), PEOPLE, GENERAL, Draws())


# --- profile and drift -----------------------------------------------------------------------


@query
def profile_moments(spark, sf):
    found, _ = moments.profile(people(spark, sf), PEOPLE)
    return tidy(found.select("feature", "n", "mean", "variance"))


@query
def covariance_long(spark, sf):
    _, cells = moments.profile(people(spark, sf), PEOPLE)
    return tidy(cells.select("feature_a", "feature_b", "covariance"))


@query
def correlation_long(spark, sf):
    _, cells = moments.profile(people(spark, sf), PEOPLE)
    return tidy(cells.select("feature_a", "feature_b", "correlation"))


def drift_of(df: DataFrame, spec: MaskSpec, configs: Sequence[MaskingConfig]) -> DataFrame:
    frame = masks.evaluate_masks(df, spec, configs, TRIAL)
    return drift.drift_table(masks.wide(df, spec), frame, spec)


def drift_columns(df: DataFrame, spec: MaskSpec, configs: Sequence[MaskingConfig], *columns: str) -> DataFrame:
    return tidy(drift_of(df, spec, configs).select("config_id", "feature", *columns))


@query
def drift_welch(spark, sf):
    df = people(spark, sf)
    frame = masks.evaluate_masks(df, PEOPLE, [NOISE, GENERAL], TRIAL)
    before = moments.moments(moments.original_cube(masks.wide(df, PEOPLE), PEOPLE), PEOPLE).drop("config_id")
    after = moments.moments(moments.masked_cube(frame, PEOPLE), PEOPLE)
    return tidy(drift.moment_drift(before, after))


@query
def drift_ks(spark, sf):
    return drift_columns(people(spark, sf), PEOPLE, [NOISE, LAPLACE], "ks_statistic")


@query
def drift_kl(spark, sf):
    return drift_columns(people(spark, sf), PEOPLE, [GENERAL, PERTURB], "kl_divergence")


@query
def drift_wasserstein(spark, sf):
    return drift_columns(people(spark, sf), PEOPLE, [NOISE, HYBRID], "wasserstein_distance")


@query
def drift_all_measures(spark, sf):
    return tidy(drift_of(people(spark, sf), PEOPLE, SIX))


@query
def drift_orders(spark, sf):
    return tidy(drift_of(orders_people(spark, sf), ORDERS_PEOPLE, [ORDERS_NOISE, ORDERS_GENERAL]))


@query
def drift_orders_swap(spark, sf):
    """A swap leaves the distribution of a continuous column as it was: no bucket is settled by its ends."""
    return tidy(drift_of(orders_people(spark, sf), ORDERS_PEOPLE, [ORDERS_SWAP]))


@query
def drift_orders_perturb(spark, sf):
    """Values that hardly move."""
    return tidy(drift_of(orders_people(spark, sf), ORDERS_PEOPLE, [ORDERS_PERTURB]))


# --- privacy -----------------------------------------------------------------------------------


@query
def equivalence_classes(spark, sf):
    frame = masks.evaluate_masks(people(spark, sf), PEOPLE, [GENERAL], TRIAL)
    classes = privacy.equivalence_classes(frame, ["m_age_label", "m_gender", "m_income_label"])
    return classes


@query
def class_size_per_record(spark, sf):
    frame = masks.evaluate_masks(people(spark, sf), PEOPLE, [GENERAL], TRIAL)
    sized = privacy.class_size_per_record(frame, ["m_age_label", "m_gender", "m_income_label"])
    return sized.select("row_id", "class_size")


@query
def k_anonymity_generalized(spark, sf):
    frame = masks.evaluate_masks(people(spark, sf), PEOPLE, [GENERAL], TRIAL)
    classes = privacy.equivalence_classes(frame, privacy.masked_identifiers(PEOPLE), ["config_id"])
    return tidy(privacy.class_summary(classes, ["config_id"]))


@query
def k_anonymity_by_education(spark, sf):
    """Identifiers may include carried columns."""
    frame = masks.evaluate_masks(people(spark, sf), PEOPLE, [GENERAL], TRIAL)
    columns = privacy.masked_identifiers(PEOPLE, ["age", "gender", "education"])
    return tidy(privacy.class_summary(privacy.equivalence_classes(frame, columns, ["config_id"]), ["config_id"]))


@query
def disclosure_risk(spark, sf):
    frame = masks.evaluate_masks(people(spark, sf), PEOPLE, SIX, TRIAL)
    return tidy(privacy.disclosure_risk(moments.masked_cube(frame, PEOPLE), PEOPLE))


@query
def privacy_score(spark, sf):
    return tidy(privacy.privacy_metrics(masks.evaluate_masks(people(spark, sf), PEOPLE, SIX, TRIAL), PEOPLE))


@query
def privacy_score_by_education(spark, sf):
    """Education is an identifier but not masked, so age alone tells about disclosure."""
    frame = masks.evaluate_masks(people(spark, sf), PEOPLE, SIX, TRIAL)
    return tidy(privacy.privacy_metrics(frame, PEOPLE, ["age", "education"]))


@query
def privacy_without_identifiers(spark, sf):
    return tidy(privacy.privacy_metrics(masks.evaluate_masks(people(spark, sf), PEOPLE, [NOISE, GENERAL], TRIAL), PEOPLE, []))


# --- utility -----------------------------------------------------------------------------------


def cubes(spark: SparkSession, sf: str, configs: Sequence[MaskingConfig]) -> tuple[DataFrame, DataFrame]:
    df = people(spark, sf)
    frame = masks.evaluate_masks(df, PEOPLE, configs, TRIAL)
    return moments.original_cube(masks.wide(df, PEOPLE), PEOPLE), moments.masked_cube(frame, PEOPLE)


@query
def matrix_preservation(spark, sf):
    old, new = cubes(spark, sf, SIX)
    before, after = moments.matrices(old, PEOPLE).drop("config_id"), moments.matrices(new, PEOPLE)
    correlation = utility.matrix_preservation(before, after, "correlation")
    return tidy(correlation.join(utility.matrix_preservation(before, after, "covariance"), "config_id"))


@query
def statistical_similarity(spark, sf):
    old, new = cubes(spark, sf, SIX)
    return tidy(
        utility.statistical_similarity(moments.moments(old, PEOPLE).drop("config_id"), moments.moments(new, PEOPLE))
    )


@query
def information_loss(spark, sf):
    _, new = cubes(spark, sf, SIX)
    return tidy(utility.information_loss(new, PEOPLE))


def scored_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Two score columns as two models on the test split, with the gender code."""
    table = add_category_code(features.add_split(people_scores(spark, sf), Draws()), "gender", "gender_code")
    both = F.array(*[F.struct(F.lit(name).alias("model"), F.col(c).alias("p")) for name, c in (("sharp", "p"), ("blunt", "q"))])
    return table.select("row_id", "part", "y", "age", "gender_code", F.explode(both).alias("s")).select(
        "row_id", "part", "y", "age", "gender_code", "s.model", "s.p", (F.col("s.p") >= 0.5).cast("int").alias("predicted")
    )


def model_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = scoring.evaluation_rows(scored_parts(spark, sf), ["model"], ["age", "gender_code"])
    return rows.withColumn("cv_accuracy_mean", F.col("validation_accuracy")).withColumn("cv_accuracy_std", F.lit(0.01))


@query
def utility_score(spark, sf):
    """Baseline: the sharp scores. Masked: both, for every setting."""
    old, new = cubes(spark, sf, [NOISE, GENERAL])
    rows = model_rows(spark, sf)
    baseline = utility.baseline_summary(rows.where(F.col("model") == "sharp"))
    each = rows.withColumn("config_id", F.explode(F.array(F.lit(0), F.lit(1))))
    found = utility.utility_metrics(utility.fidelity(old, new, PEOPLE), utility.model_summary(each, ["config_id"]), baseline)
    return tidy(found.select("config_id", *utility.UTILITY_COLUMNS))


@query
def objective_score(spark, sf):
    df = people(spark, sf)
    frame = masks.evaluate_masks(df, PEOPLE, [NOISE, GENERAL], TRIAL)
    score = privacy.privacy_metrics(frame, PEOPLE).select("config_id", "privacy_score")
    useful = utility_score(spark, sf).select("config_id", "utility_score")
    value = utility.objective(F.col("privacy_score"), F.col("utility_score"), WEIGHT)
    return score.join(useful, "config_id").select("config_id", F.round(value, 4).alias("objective_score"))


# --- models without training ---------------------------------------------------------------------


@query
def split_counts(spark, sf):
    parted = features.add_split(masks.wide(people(spark, sf), PEOPLE), Draws())
    return parted.groupBy("part", "label").agg(F.count(F.lit(1)).alias("n"))


@query
def split_exact(spark, sf):
    return features.add_exact_split(masks.wide(people(spark, sf), PEOPLE), Draws()).select("row_id", "label", "part")


@query
def fold_counts(spark, sf):
    folded = features.add_fold(masks.wide(people(spark, sf), PEOPLE), Draws(), 5)
    return folded.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n"))


@query
def class_weights(spark, sf):
    return tidy(features.class_weights(masks.wide(people(spark, sf), PEOPLE)))


def information_scores(spark: SparkSession, sf: str) -> DataFrame:
    return features.mutual_information(
        people(spark, sf), PEOPLE.texts, {"age": (PEOPLE.lower, PEOPLE.upper)}, label="income"
    )


@query
def mutual_information(spark, sf):
    return tidy(information_scores(spark, sf))


@query
def nearest_information(spark, sf):
    """Two continuous columns and one with few values against three and two classes."""
    days = F.datediff("o_orderdate", F.lit("1990-01-01"))
    orders = neighbours.nearest_information(
        table(spark, sf, "orders"), {"o_totalprice": F.col("o_totalprice"), "o_orderdate": days, "o_custkey": F.col("o_custkey")}, "o_orderstatus"
    )
    ages = neighbours.nearest_information(people(spark, sf), {"age": F.col("age")}, "income", k=5)
    return tidy(orders.union(ages))


@query
def top_k_features(spark, sf):
    return tidy(features.top_features(information_scores(spark, sf), KEPT))


@query
def classifier_metrics(spark, sf):
    return tidy(scoring.classifier_metrics(scored_parts(spark, sf), ["model", "part"]).drop("log_loss"))


@query
def log_loss(spark, sf):
    return tidy(scoring.classifier_metrics(scored_parts(spark, sf), ["model", "part"]).select("model", "part", "log_loss"))


@query
def roc_auc_rank(spark, sf):
    return tidy(scoring.roc_auc(scored_parts(spark, sf), ["model", "part"]))


@query
def sensitive_signal(spark, sf):
    test = scored_parts(spark, sf).where(F.col("part") == "test")
    return tidy(scoring.sensitive_signal(test, ["age", "gender_code"], ["model"]))


@query
def model_report_rows(spark, sf):
    return tidy(model_rows(spark, sf))


# --- sweep ---------------------------------------------------------------------------------------


SCREEN = SweepOptions(models=None, privacy_weight=WEIGHT, configs_per_job=32)


@query
def sweep_privacy(spark, sf):
    frame = masks.evaluate_masks(people(spark, sf), PEOPLE, default_grid(), TRIAL)
    return tidy(privacy.privacy_metrics(frame, PEOPLE))


@query
def parzen_proposals(spark, sf):
    """Settings proposed from the privacy that the grid's settings reach on the whole table."""
    people_rows = people(spark, sf)
    scores = tidy(privacy.privacy_metrics(masks.evaluate_masks(people_rows, PEOPLE, default_grid(), TRIAL), PEOPLE))
    history = config_frame(spark, default_grid()).join(scores.select("config_id", "privacy_score"), "config_id")
    return tidy(parzen.proposals(history, PROPOSALS, "privacy_score"))


@query
def sweep_searched_settings(spark, sf):
    """Random picks with anchors, and crossover children, without repeats."""
    configs = searched_settings()
    frame = masks.evaluate_masks(people(spark, sf), PEOPLE, configs, TRIAL)
    return tidy(privacy.privacy_metrics(frame, PEOPLE))


@cache
def searched_settings() -> tuple[MaskingConfig, ...]:
    found = {c.label(): c for c in [*random_search(6), *crossover_search(1, 4)]}
    return tuple(found.values())


@query
def sweep_fidelity(spark, sf):
    prepared = prepare(people(spark, sf), PEOPLE)
    found = measure(prepared, PEOPLE, default_grid(), SCREEN)
    return tidy(
        found.select(
            "config_id", "correlation_preservation", "covariance_preservation", "statistical_similarity",
            "information_loss", "mean_ks_statistic", "mean_kl_divergence", "mean_wasserstein_distance",
            "mean_variance_preservation",
        )
    )


def screened(spark: SparkSession, sf: str) -> DataFrame:
    return sweep(people(spark, sf), PEOPLE, list(ANCHORS), SCREEN)


@query
def sweep_best(spark, sf):
    return tidy(screened(spark, sf).limit(1).select("config_id", "config_label", "privacy_score", "utility_score", "objective_score"))


@query
def sweep_ranked(spark, sf):
    return tidy(screened(spark, sf).select("config_id", "method", "privacy_score", "utility_score", "objective_score"))


@query
def sweep_candidates(spark, sf):
    """All production candidates, ranked without training."""
    found = sweep(people(spark, sf), PEOPLE, default_candidates(), SCREEN)
    return tidy(found.select("config_id", "method", "privacy_score", "utility_score", "objective_score"))


QUICK = ModelOptions(models=("Logistic Regression", "Random Forest"), tune=False, cross_validate=False, trees=20)


@query
def sweep_full(spark, sf):
    """Sweep with trained models (rows-only check)."""
    options = SweepOptions(privacy_weight=WEIGHT, models=QUICK)
    return sweep(people(spark, sf), PEOPLE, [NOISE, GENERAL, SWAP], options)


@query
def sweep_rounds(spark, sf):
    """Adaptive rounds around the best settings (rows-only check)."""
    return adaptive_sweep(people(spark, sf), PEOPLE, list(ANCHORS), SCREEN, rounds=2, trials=4, parents=3)


# --- trained models ------------------------------------------------------------------------------


def trained(spark: SparkSession, sf: str, name: str, **options) -> DataFrame:
    quick = {"tune": False, "cross_validate": False} | options
    return evaluate_models(unmasked(people(spark, sf), PEOPLE), PEOPLE, ModelOptions(models=(name,), **quick))


@query
def train_logistic(spark, sf):
    return trained(spark, sf, "Logistic Regression")


@query
def train_forest(spark, sf):
    return trained(spark, sf, "Random Forest")


@query
def train_boosted(spark, sf):
    return trained(spark, sf, "XGBoost")


@query
def boosted_first_tree(spark, sf):
    """Splits and leaf values of the first round, on drawn rows and features."""
    df = people(spark, sf).withColumn("label", F.col("income"))
    design = features.design_model(df, ["age"], PEOPLE.texts)
    names = features.feature_names(design, ["age"], PEOPLE.texts)
    trees = boosting.boost(design.transform(df), vector_to_array("features"), names, 1, 2, 0.1, 0.85, 0.85, Draws())
    return tidy(boosting.tree_table(spark, trees[0], names, 0.1))


@query
def train_rff_svc(spark, sf):
    return trained(spark, sf, "SVM")


@query
def train_one_class(spark, sf):
    """Nothing to learn from people of one class: the fixed rows of all four families."""
    rich = people(spark, sf).where(F.col("income") == 1)
    return tidy(evaluate_models(unmasked(rich, PEOPLE), PEOPLE, ModelOptions(tune=False)))


@query
def grid_search(spark, sf):
    return trained(spark, sf, "Logistic Regression", tune=True, cross_validate=True)


# --- reports -------------------------------------------------------------------------------------


@query
def report_top_k(spark, sf):
    top = report.top_settings(screened(spark, sf), 5)
    return tidy(top.select("rank", "method", "privacy_score", "utility_score", "objective_score"))


@query
def report_unpivot(spark, sf):
    return tidy(report.setting_scores(screened(spark, sf)))


@query
def report_model_compare(spark, sf):
    rows = model_rows(spark, sf)
    old, new = rows.where(F.col("model") == "sharp"), rows.where(F.col("model") == "blunt")
    return tidy(report.model_comparison(old, new))


@query
def report_stage_accuracies(spark, sf):
    rows = model_rows(spark, sf)
    return tidy(report.stage_accuracies(rows.where(F.col("model") == "sharp"), rows.where(F.col("model") == "blunt")))


@query
def report_mean_scores(spark, sf):
    return tidy(report.mean_scores(report_model_compare(spark, sf), ["metric", "dataset"]))


@query
def report_loss_by_method(spark, sf):
    prepared = prepare(people(spark, sf), PEOPLE)
    configs = default_grid()
    losses = utility.information_loss(moments.masked_cube(masks.evaluate_masks(prepared.table, PEOPLE, configs, TRIAL), PEOPLE), PEOPLE)
    methods = F.create_map(*[F.lit(v) for i, c in enumerate(configs) for v in (i, c.method)])
    return tidy(report.loss_by_method(losses.withColumn("method", methods[F.col("config_id")])))


@query
def report_drift_metrics(spark, sf):
    return tidy(report.drift_metrics(drift_of(people(spark, sf), PEOPLE, [GENERAL])))


@query
def report_tradeoff(spark, sf):
    return tidy(report.tradeoff(screened(spark, sf)))


@query
def report_summary(spark, sf):
    return report.run_summary(screened(spark, sf))
