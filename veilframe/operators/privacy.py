"""Equivalence classes and disclosure risk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.numeric import clip01
from veilframe.operators.joins import join_summary
from veilframe.operators.moments import masked_cube
from veilframe.spec import MaskSpec

# Targets and weights of the privacy score, and of the two combined risks.
TARGET_K, TARGET_CLASS_SIZE = 10.0, 25.0
SCORE_WEIGHTS = {"k": 0.30, "class_size": 0.20, "reidentification": 0.20, "disclosure": 0.15, "leakage": 0.15}
MEMBERSHIP_WEIGHTS = {"reidentification": 0.65, "disclosure": 0.35}
LEAKAGE_WEIGHTS = {"disclosure": 0.55, "reidentification": 0.45}
SMALLEST_RANGE = 1e-9

PRIVACY_COLUMNS = (
    "k_anonymity",
    "average_equivalence_class_size",
    "reidentification_risk",
    "attribute_disclosure_risk",
    "membership_inference_risk",
    "information_leakage",
    "privacy_score",
    "privacy_loss",
)


def masked_identifiers(spec: MaskSpec, identifiers: Sequence[str] | None = None) -> list[str]:
    """Masked columns that form the equivalence classes.

    A bin's midpoint stands for its text, so typed values are grouped, never texts of numbers.
    """
    chosen = spec.quasi_identifiers if identifiers is None else identifiers
    return [c if c in spec.carried else f"m_{c}" for c in chosen if c in spec.maskable or c in spec.carried]


def equivalence_classes(df: DataFrame, identifiers: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Rows per combination of identifiers, missing values grouped together."""
    return df.groupBy(*keys, *identifiers).agg(F.count(F.lit(1)).alias("class_size"))


def class_size_per_record(df: DataFrame, identifiers: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Each row with the size of its class.

    The classes are counted with a map-side combine and joined back as their number allows, so
    a class that holds a third of all rows is never gathered. A window over the classes would
    sort that whole class in one task.
    """
    columns = [*keys, *identifiers]
    return join_summary(df, equivalence_classes(df, identifiers, keys), {c: F.col(c) for c in columns})


def class_summary(classes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Smallest and mean class, and re-identification risk.

    The mean over records of 1/size equals classes/records, so no join back is needed.
    """
    records = F.sum("class_size")
    return classes.groupBy(*keys).agg(
        F.coalesce(F.min("class_size"), F.lit(0)).cast("double").alias("k_anonymity"),
        F.coalesce(F.avg("class_size"), F.lit(0.0)).alias("average_equivalence_class_size"),
        F.coalesce(F.count(F.lit(1)) / records, F.lit(1.0)).alias("reidentification_risk"),
    )


def part_summary(parts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``class_summary`` of classes that were counted in parts (``tally.class_rows``)."""
    classes, records = F.sum("classes"), F.sum("records")
    return parts.groupBy(*keys).agg(
        F.min("smallest").cast("double").alias("k_anonymity"),
        (records / classes).alias("average_equivalence_class_size"),
        (classes / records).alias("reidentification_risk"),
    )


def disclosure_risk(cube: DataFrame, spec: MaskSpec, identifiers: Sequence[str] | None = None) -> DataFrame:
    """How much the masked sensitive values still tell about the original ones.

    Only sensitive columns among the identifiers count; without one the risk is 1.
    """
    chosen = spec.quasi_identifiers if identifiers is None else identifiers
    rows = F.sum("n")

    def closeness(role: str) -> Column:
        spread = F.max(f"old_{role}_max") - F.min(f"old_{role}_min")
        distance = F.sum(F.col("n") * F.col(f"{role}_gap")) / rows
        return clip01(F.lit(1.0) - distance / F.greatest(spread, F.lit(SMALLEST_RANGE)))

    same = F.sum(F.when(F.col("old_category") == F.col(spec.category), F.col("n")).otherwise(F.lit(0))) / rows
    terms = []
    if spec.is_sensitive(spec.numeric) and spec.numeric in chosen:
        terms.append(closeness("number"))
    if spec.is_sensitive(spec.flag) and spec.flag in chosen:
        terms.append(closeness("flag"))
    if spec.is_sensitive(spec.category) and spec.category in chosen:
        terms.append(same)
    total = F.lit(0.0)
    for term in terms:
        total = total + term
    risk = clip01(total / F.lit(float(len(terms)))) if terms else F.lit(1.0)
    return cube.groupBy("config_id").agg(risk.alias("attribute_disclosure_risk"))


def privacy_score(df: DataFrame) -> DataFrame:
    """Combined risks and the score, from the class summary and the disclosure risk."""
    reid, disclosure = F.col("reidentification_risk"), F.col("attribute_disclosure_risk")
    scored = df.withColumns(
        {
            "membership_inference_risk": clip01(
                F.lit(MEMBERSHIP_WEIGHTS["reidentification"]) * reid
                + F.lit(MEMBERSHIP_WEIGHTS["disclosure"]) * disclosure
            ),
            "information_leakage": clip01(
                F.lit(LEAKAGE_WEIGHTS["disclosure"]) * disclosure
                + F.lit(LEAKAGE_WEIGHTS["reidentification"]) * reid
            ),
        }
    )
    parts = {
        "k": F.least(F.col("k_anonymity") / F.lit(TARGET_K), F.lit(1.0)),
        "class_size": F.least(F.col("average_equivalence_class_size") / F.lit(TARGET_CLASS_SIZE), F.lit(1.0)),
        "reidentification": F.lit(1.0) - reid,
        "disclosure": F.lit(1.0) - disclosure,
        "leakage": F.lit(1.0) - F.col("information_leakage"),
    }
    total = F.lit(0.0)
    for name, weight in SCORE_WEIGHTS.items():
        total = total + F.lit(weight) * parts[name]
    return scored.withColumn("privacy_score", clip01(total)).withColumn(
        "privacy_loss", F.lit(1.0) - F.col("privacy_score")
    )


def worst_case(frame: DataFrame) -> DataFrame:
    """Result when no identifier is present: nothing is known to be protected."""
    worst = {name: 1.0 for name in PRIVACY_COLUMNS} | {
        "k_anonymity": 0.0,
        "average_equivalence_class_size": 0.0,
        "privacy_score": 0.0,
    }
    return frame.select("config_id").distinct().select("config_id", *[F.lit(v).alias(k) for k, v in worst.items()])


def privacy_metrics(
    frame: DataFrame,
    spec: MaskSpec,
    identifiers: Sequence[str] | None = None,
    cube: DataFrame | None = None,
    summary: DataFrame | None = None,
) -> DataFrame:
    """Privacy of every setting in a masked wide frame, one row per setting.

    ``cube`` and ``summary`` (of the classes of the same identifiers) are taken where they are known.
    """
    columns = masked_identifiers(spec, identifiers)
    if not columns:
        return worst_case(frame)
    if summary is None:
        summary = class_summary(equivalence_classes(frame, columns, ["config_id"]), ["config_id"])
    risk = disclosure_risk(masked_cube(frame, spec) if cube is None else cube, spec, identifiers)
    return privacy_score(summary.join(risk, "config_id")).select("config_id", *PRIVACY_COLUMNS)
