"""Quality rules: plain limits, and robust outliers per language and source.

Each text becomes a vector of transformed statistics. Within a language and source, the centre
and covariance come from the half or more of the texts whose covariance has the least
determinant (Rousseeuw's estimate, reached by concentration steps from two starts). A text whose
Mahalanobis distance from the centre is too large is rejected. Everything is DataFrame functions.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import checkpointed

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

# Transformed statistics, and the deviation below which a difference is of no account.
FLOORS = {"length": 0.25, "symbols": 0.5, "lines": 0.5, "repeats": 1.0}
SUBSET_PERCENT = 75  # of a group's texts that an estimate rests on
STEPS = 3
MIN_GROUP = 50  # texts; smaller groups are estimated together, per language and then over all
MAX_DISTANCE = 20.0  # squared; the chi-square distribution of four sound statistics passes it once in 2,000


def _repeat_words(ordered: str) -> Column:
    """Words in windows that occur twice or more: each such window adds the words up to the next one."""
    same = lambda e, i, by: F.coalesce(F.get(F.col(ordered), i + by)["h"] == e["h"], F.lit(False))
    places = F.array_sort(F.transform(F.filter(ordered, lambda e, i: same(e, i, -1) | same(e, i, 1)), lambda e: e["i"]))
    # Binding the places to a lambda variable keeps them from being sorted again for each element.
    added = F.flatten(
        F.transform(
            F.array(places),
            lambda p: F.transform(p, lambda x, i: F.least(F.lit(REPEAT_WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(REPEAT_WINDOW)))),
        )
    )
    total = F.aggregate(added, F.lit(0).cast("long"), lambda acc, x: acc + x)
    return F.when(F.col(ordered).isNotNull(), total).otherwise(F.lit(0).cast("long"))


def text_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text", group: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """_key, _g1 and _g2 (never null), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every row.

    A null text counts as empty.
    """
    words = F.filter(F.split("_text", SPACE), lambda w: w != "")
    rows = docs.select(
        docs[key].alias("_key"),
        *[F.coalesce(F.concat(F.lit("="), docs[g].cast("string")), F.lit("null")).alias(f"_g{k + 1}") for k, g in enumerate(group)],
        F.coalesce(docs[text], F.lit("")).alias("_text"),
    )
    keep = ["_key", *[f"_g{k + 1}" for k in range(len(group))]]
    last = F.col("n_words") - REPEAT_WINDOW
    hashed = rows.select(
        *keep,
        F.char_length(F.regexp_replace("_text", SPACE, "")).cast("long").alias("word_chars"),
        (F.char_length("_text") - F.char_length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("_text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.transform(words, lambda w: F.xxhash64(w)).alias("words"),
    )
    windowed = hashed.select(
        *keep,
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("words").cast("long").alias("n_words"),
        "words",
    ).select(
        "*",
        F.when(
            last >= 1,
            F.transform(F.sequence(F.lit(0).cast("long"), last), lambda i: F.xxhash64(*[F.get("words", i.cast("int") + k) for k in range(REPEAT_WINDOW)])),
        ).alias("hashes"),
    )
    sorted_windows = F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeated = windowed.select("*", F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), sorted_windows).alias("ordered"))
    return repeated.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", _repeat_words("ordered").alias("n_repeat_words")
    )


def _vector() -> dict[str, Column]:
    share = lambda part, whole: F.log1p(F.lit(100.0) * F.col(part) / F.greatest(F.col(whole), F.lit(1)))
    return {
        "length": F.log((F.col("word_chars") + 1.0) / (F.col("n_words") + 1.0)),
        "symbols": share("n_symbols", "word_chars"),
        "lines": F.log1p(F.col("n_dup_lines").cast("double")),
        "repeats": share("n_repeat_words", "n_words"),
    }


NAMES = tuple(FLOORS)
PAIRS = tuple(combinations_with_replacement(range(len(NAMES)), 2))
GROUP = ["_a", "_b"]


def _factor(moments: DataFrame, extra: list[str]) -> DataFrame:
    """Lower triangle l_jk of the covariance's root, and the logarithm of the determinant."""
    covariance = {}
    for j, k in PAIRS:
        c = F.col(f"s_{j}{k}") - F.col(f"m_{j}") * F.col(f"m_{k}")
        covariance[j, k] = F.greatest(c, F.lit(0.0)) + F.lit(FLOORS[NAMES[j]] ** 2) if j == k else c
    table = moments.select(*extra, *[f"m_{j}" for j in range(len(NAMES))], *[c.alias(f"c_{j}{k}") for (j, k), c in covariance.items()])
    for j in range(len(NAMES)):
        inner = sum((F.col(f"l_{j}{i}") * F.col(f"l_{j}{i}") for i in range(j)), F.lit(0.0))
        # Rounding could take a pivot below the floor that the true one has.
        table = table.withColumn(f"l_{j}{j}", F.sqrt(F.greatest(F.col(f"c_{j}{j}") - inner, F.lit(1e-6))))
        for k in range(j + 1, len(NAMES)):
            inner = sum((F.col(f"l_{j}{i}") * F.col(f"l_{k}{i}") for i in range(j)), F.lit(0.0))
            table = table.withColumn(f"l_{k}{j}", (F.col(f"c_{j}{k}") - inner) / F.col(f"l_{j}{j}"))
    return table.withColumn("log_det", sum((F.log(f"l_{j}{j}") for j in range(len(NAMES))), F.lit(0.0))).drop(*[f"c_{j}{k}" for j, k in PAIRS])


def _with_distance(rows: DataFrame, estimates: DataFrame, *more: str) -> DataFrame:
    """Rows with the squared Mahalanobis distance from their group's estimate, and its other columns."""
    joined = rows.join(estimates, [*GROUP, *more], "left")
    for j in range(len(NAMES)):
        inner = sum((F.col(f"l_{j}{i}") * F.col(f"y_{i}") for i in range(j)), F.lit(0.0))
        joined = joined.withColumn(f"y_{j}", (F.col(f"x_{j}") - F.col(f"m_{j}") - inner) / F.col(f"l_{j}{j}"))
    distance = sum((F.col(f"y_{j}") * F.col(f"y_{j}") for j in range(len(NAMES))), F.lit(0.0))
    return joined.withColumn("distance", distance)


def _moments(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(
        *[F.avg(f"x_{j}").alias(f"m_{j}") for j in range(len(NAMES))],
        *[F.avg(F.col(f"x_{j}") * F.col(f"x_{k}")).alias(f"s_{j}{k}") for j, k in PAIRS],
    )


def robust_estimates(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """Centre m_j and root l_jk of the covariance of each group, from rows _a, _b, x_j.

    One start is the medians with the floors as deviations, the other the plain moments. A step
    keeps the rows within the group's distance quantile and estimates again; sums and quantile
    sketches are combined in the tasks, so no group meets in one of them. Of the two results the
    one with the lesser determinant is taken.
    """
    by = ["start", *GROUP]
    medians = rows.groupBy(*GROUP).agg(*[F.percentile_approx(f"x_{j}", 0.5, 1000).alias(f"m_{j}") for j in range(len(NAMES))])
    for j, k in PAIRS:
        medians = medians.withColumn(f"s_{j}{k}", F.col(f"m_{j}") * F.col(f"m_{k}"))
    first = medians.withColumn("start", F.lit(0)).unionByName(_moments(rows, GROUP).withColumn("start", F.lit(1)))
    estimates = checkpointed(_factor(first, by))
    starts = rows.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
    for _ in range(steps):
        limits = (
            _with_distance(starts, estimates, "start")
            .groupBy(*by)
            .agg(F.percentile_approx("distance", SUBSET_PERCENT / 100, 1000).alias("limit"))
        )
        bounded = checkpointed(estimates.join(limits, by))
        near = _with_distance(starts, bounded, "start").where("distance <= limit")
        estimates = checkpointed(_factor(_moments(near, by), by))
    best = estimates.groupBy(*GROUP).agg(F.min_by("start", F.struct("log_det", "start")).alias("start"))
    return estimates.join(best, by).drop("start", "log_det")


def judge_quality(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    group: tuple[str, str] = ("lang", "source"),
    max_distance: float = MAX_DISTANCE,
    min_group: int = MIN_GROUP,
) -> DataFrame:
    """key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept.

    Groups of fewer than ``min_group`` texts are estimated together per language, and those that
    are then still too few, over all languages; if even these are too few, distance is 0. A null
    language or source is a value like any other. Texts that fail the plain limits take no part in
    the estimates. A null or empty text has no words and fails. Rows that repeat are judged alike;
    a null key stays null. Other columns are not looked at.
    """
    stats = checkpointed(text_statistics(docs, key, text, group))
    failed = (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEAT_PERCENT) * F.col("n_words"))
    rows = stats.withColumn("base_failed", failed).withColumns({f"x_{j}": c for j, c in enumerate(_vector().values())})
    sound = rows.where("not base_failed")
    sizes = sound.groupBy("_g1", "_g2").agg(F.count(F.lit(1)).alias("size"))
    pooled = sizes.where(F.col("size") < min_group).groupBy("_g1").agg(F.sum("size").alias("pool"))
    level = F.when(F.col("size") >= min_group, 0).when(F.col("pool") >= min_group, 1).otherwise(2)
    levels = checkpointed(sizes.join(pooled, "_g1", "left").select("_g1", "_g2", level.alias("level")))
    grouped = checkpointed(
        rows.join(levels, ["_g1", "_g2"], "left")
        .withColumn("_a", F.when(F.col("level") <= 1, F.col("_g1")).otherwise(F.lit("*")))
        .withColumn("_b", F.when(F.col("level") == 0, F.col("_g2")).otherwise(F.lit("*")))
        .drop("_g1", "_g2", "level")
    )
    vectors = grouped.where("not base_failed").select(*GROUP, *[f"x_{j}" for j in range(len(NAMES))])
    enough = vectors.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= min_group).select(*GROUP)
    estimates = robust_estimates(vectors.join(enough, GROUP))
    judged = _with_distance(grouped, estimates)
    distance = F.coalesce("distance", F.lit(0.0))
    return judged.select(
        F.col("_key").alias(key),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        distance.alias("distance"),
        (~F.col("base_failed") & (distance <= max_distance)).alias("kept"),
    )
