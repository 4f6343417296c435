"""Tree-structured Parzen search: new settings from the densities of good and bad ones (Bergstra et al. 2011).

The measured settings are split at a quantile of the objective. For the method, and for each field
that the chosen method uses, one density is built over the good settings and one over the others
whose methods use the field too. Values are drawn from the good density, and of each set of
draws the value stays at which it exceeds the other density the most.

History, kernels and draws are tables: fields are compared in one join on the field's name, and
each draw is keyed, so a history gives the same proposals anywhere.
"""

from __future__ import annotations

from collections.abc import Iterable
from math import log, pi, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions.draws import Draws
from veilframe.plans.candidates import ADAPTIVE_BUDGET, CROSSOVER_BOUNDS, USED_FIELDS
from veilframe.session import settle
from veilframe.spec import METHODS, MaskingConfig

DRAWS = 24  # values that compete for each field of a proposal
GOOD_SHARE, MOST_GOOD = 0.1, 25
FINEST = 100.0  # a kernel is at least this part of its range wide
BIN_CHOICES = (5, 10, 15, 20, 25, 30)
LOGISTIC = sqrt(3.0) / pi  # scale of a logistic curve of deviation 1
RANGES = {**CROSSOVER_BOUNDS, "hybrid_dp_budget_fraction": ADAPTIVE_BUDGET, "epsilon": tuple(log(v) for v in CROSSOVER_BOUNDS["epsilon"])}
CHOICES = {"method": METHODS, "generalization_bin": tuple(str(b) for b in BIN_CHOICES)}


def split_history(history: DataFrame, objective: str) -> DataFrame:
    """History with ``good``: the best tenth of the settings, rounded up, at most MOST_GOOD. Earlier ones win ties."""
    n = history.count()
    most = min(-(-n // round(1 / GOOD_SHARE)), MOST_GOOD)
    # One row for each measured setting.
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(objective), "config_id"))
    return history.withColumn("good", place <= most)


def _users(field: str) -> list[str]:
    return [m for m in METHODS if field in USED_FIELDS[m]]


def _uniform(draws: Draws, stage: str) -> Column:
    return draws.uniform("parzen", stage, F.concat_ws(":", "field", "proposal", "draw"))


def choose_categories(split: DataFrame, asked: DataFrame, field: str, draws: Draws) -> DataFrame:
    """proposal, field and the chosen one of CHOICES[field] for each row (proposal) of ``asked``."""
    spark = split.sparkSession
    values = spark.createDataFrame(list(enumerate(CHOICES[field])), "place int, value string")
    users = split if field == "method" else split.where(F.col("method").isin(_users(field)))
    seen = users.groupBy(F.col(field).cast("string").alias("value")).agg(
        F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")
    )
    counted = values.join(seen, "value", "left").na.fill(0, ["good", "bad"])
    everything, upto = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy("place")
    share = {s: (F.col(s) + 1) / F.sum(F.col(s) + 1).over(everything) for s in ("good", "bad")}
    odds = counted.withColumns({"p": share["good"], "ratio": F.log(share["good"]) - F.log(share["bad"])})
    odds = odds.withColumn("until", F.sum("p").over(upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # One row for each choice; each draw then falls between two known bounds.
    rows = sorted(odds.collect(), key=lambda row: row["place"])
    tried = asked.withColumns({"field": F.lit(field), "draw": F.explode(F.sequence(F.lit(0), F.lit(DRAWS - 1)))})
    tried = tried.withColumn("u", _uniform(draws, "choice"))
    hit = F.lit(len(rows) - 1)
    for row in reversed(rows[:-1]):
        hit = F.when(F.col("u") < F.lit(row["until"]), F.lit(row["place"])).otherwise(hit)
    tried = tried.withColumn("place", hit).withColumns({n: F.get(F.array(*[F.lit(row[n]) for row in rows]), F.col("place")) for n in ("value", "ratio")})
    best = F.max_by("value", F.struct(F.round("ratio", 9), -F.col("draw")))
    return tried.groupBy("proposal").agg(best.alias("value")).withColumn("field", F.lit(field))


def kernels(split: DataFrame) -> DataFrame:
    """field, good, at, mu, scale: one logistic kernel for each setting that uses the field, and a flat one over its range.

    A kernel reaches to the farther of its neighbours (or the end of the range), but is neither wider
    than the range nor finer than a part of it.
    """
    parts = []
    for field, (low, high) in RANGES.items():
        value = F.log(field) if field == "epsilon" else F.col(field).cast("double")
        own = split.where(F.col("method").isin(_users(field))).select("good", value.alias("mu"), "config_id")
        order = Window.partitionBy("good").orderBy("mu", "config_id")
        many = F.count(F.lit(1)).over(Window.partitionBy("good"))
        reach = F.greatest(F.col("mu") - F.lag("mu", 1, low).over(order), F.lead("mu", 1, high).over(order) - F.col("mu"))
        finest = F.lit(high - low) / F.least(F.lit(FINEST), many + F.lit(2))
        placed = own.select("good", F.row_number().over(order).alias("at"), "mu", F.least(F.greatest(reach, finest), F.lit(high - low)).alias("scale"))
        flat = split.sparkSession.createDataFrame([(g, 0, (low + high) / 2, high - low) for g in (True, False)], "good boolean, at int, mu double, scale double")
        parts += [k.select(F.lit(field).alias("field"), F.lit(low).alias("low"), F.lit(high).alias("high"), "good", "at", "mu", (F.col("scale") * LOGISTIC).alias("scale")) for k in (placed, flat)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _upto(x: Column | str) -> Column:
    """Share of a row's kernel that lies below x."""
    x = F.col(x) if isinstance(x, str) else x
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(x - F.col("mu")) / F.col("scale")))


def choose_numbers(split: DataFrame, methods: DataFrame, draws: Draws) -> DataFrame:
    """proposal, field, value for the numeric fields that each proposal's method uses."""
    spark = split.sparkSession
    known = settle(kernels(split))
    uses = spark.createDataFrame([(m, f) for m in METHODS for f in USED_FIELDS[m] if f in RANGES], "method string, field string")
    asked = methods.join(F.broadcast(uses), "method").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(DRAWS - 1))))
    sizes = known.where("good").groupBy("field").agg(F.count(F.lit(1)).alias("many"))
    asked = asked.join(F.broadcast(sizes), "field").withColumn("at", F.floor(_uniform(draws, "kernel") * F.col("many")).cast("int"))
    drawn = asked.withColumn("u", _uniform(draws, "value")).join(known.where("good"), ["field", "at"])
    inside = _upto("low") + F.col("u") * (_upto("high") - _upto("low"))
    x = F.greatest(F.least(F.col("mu") + F.col("scale") * F.log(inside / (F.lit(1.0) - inside)), F.col("high")), F.col("low"))
    drawn = settle(drawn.select("proposal", "field", "draw", x.alias("x")))
    z = F.exp(-F.abs(F.col("x") - F.col("mu")) / F.col("scale"))
    height = z / (F.col("scale") * (F.lit(1.0) + z) * (F.lit(1.0) + z)) / (_upto("high") - _upto("low"))
    dense = drawn.join(known, "field").groupBy("proposal", "field", "draw").agg(
        F.first("x").alias("x"),
        *[F.log(F.sum(F.when(F.col("good") == side, height)) / F.count_if(F.col("good") == side)).alias(name) for name, side in (("of_good", True), ("of_bad", False))],
    )
    best = F.max_by("x", F.struct(F.round(F.col("of_good") - F.col("of_bad"), 9), -F.col("draw")))
    chosen = dense.groupBy("proposal", "field").agg(best.alias("value"))
    return chosen.withColumn("value", F.when(F.col("field") == "epsilon", F.exp("value")).otherwise(F.col("value")))


def proposals(history: DataFrame, count: int, objective: str = "objective_score", draws: Draws | None = None, first: int = 0) -> DataFrame:
    """``count`` settings (proposal, and the fields of a setting) that promise more than those measured.

    ``history`` has a setting's fields, ``config_id`` and the objective, larger being better; without
    rows the ranges alone count. Fields that a proposal's method does not use keep their defaults.
    ``first`` numbers the proposals, so that later rounds draw anew.
    """
    draws = draws or Draws()
    spark = history.sparkSession
    split = settle(split_history(history, objective))
    asked = spark.range(first, first + count, 1, 1).select(F.col("id").alias("proposal"))
    methods = settle(choose_categories(split, asked, "method", draws).select("proposal", F.col("value").alias("method")))
    binned = methods.where(F.col("method").isin(_users("generalization_bin"))).select("proposal")
    bins = choose_categories(split, binned, "generalization_bin", draws).select("proposal", F.col("value").cast("int").alias("generalization_bin"))
    numbers = choose_numbers(split, methods, draws).groupBy("proposal").pivot("field", list(RANGES)).agg(F.first("value"))
    plain = MaskingConfig(METHODS[0])
    joined = methods.join(bins, "proposal", "left").join(numbers, "proposal", "left")
    fields = ["noise_std", "generalization_bin", "epsilon", "gender_mask_probability", "hybrid_dp_budget_fraction", "swap_fraction", "perturbation_strength"]
    return joined.select("proposal", "method", *[F.coalesce(F.col(f), F.lit(getattr(plain, f))).alias(f) for f in fields])


def proposed_settings(history: DataFrame, count: int, known: Iterable[str], draws: Draws, first: int = 0) -> list[MaskingConfig]:
    """At most ``count`` proposals whose labels are not known yet; twice as many are drawn, as some may repeat."""
    seen, found = set(known), []
    for row in proposals(history, 2 * count, draws=draws, first=first).orderBy("proposal").collect():
        config = MaskingConfig(**{k: v for k, v in row.asDict().items() if k != "proposal"})
        if config.label() not in seen and len(found) < count:
            seen.add(config.label())
            found.append(config)
    return found
