"""The six masks as column expressions.

``evaluate_masks`` fans rows out over many settings: the settings of one method are a
literal array that is exploded map-side, so the table is read once per method whatever the
number of settings, and nothing is shuffled before aggregation. One branch per method keeps
the generated code small enough for the JVM to compile, and draws only what the method
needs. ``release`` applies a single setting with literal parameters.

Original values are in ``o_*`` columns and masked ones in ``m_*``. A generalised number
keeps its bin midpoint in ``m_*`` and its text in ``m_*_label``, so all settings share
one schema.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions.draws import Draws, gaussian_pair, key_number, laplace
from veilframe.operators.ranking import BUCKET_ROWS, bucket_count, cut_points, draw_bucket, exact_median, smallest_mode, up_to, running_totals
from veilframe.session import settle
from veilframe.spec import GENERALIZED, METHODS, PERTURBED, SUPPRESSED, MaskingConfig, MaskSpec

SMALLEST_EPSILON = 1e-6
NUMBER, FLAG, CATEGORY = "__number", "__flag", "__category"


# --- table facts -----------------------------------------------------------------------


@dataclass(frozen=True)
class TableFacts:
    """What the masks must know about a table; one small row, computed once per table.

    ``numeric_std`` is the deviation once missing numbers are filled.
    ``categories`` is the number of distinct categories, 3 standing for any larger number.
    """

    rows: int
    numeric_std: float
    categories: int
    first_category: str | None
    last_category: str | None
    numeric_fill: float | None = None
    numeric_mode: float | None = None
    flag_fill: float | None = None

    def category_pair(self, spec: MaskSpec) -> tuple[str, str]:
        if self.categories == 2:
            return self.first_category, self.last_category
        return spec.category_pair


def table_facts(df: DataFrame, spec: MaskSpec) -> TableFacts:
    """Row count, spread and categories without a shuffle; medians and mode only if cells are missing.

    A third category lies strictly between the smallest and the largest one, so one existence
    check, which stops at the first hit, tells two categories from more.
    """
    number, flag, category = F.col(spec.numeric).cast("double"), F.col(spec.flag).cast("double"), F.col(spec.category)
    found = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(number).alias("numbers"),
        F.count(flag).alias("flags"),
        F.stddev_samp(number).alias("spread"),
        F.avg(number).alias("mean"),
        F.min(category).alias("first"),
        F.max(category).alias("last"),
    ).first()
    rows, first, last = found["rows"], found["first"], found["last"]
    categories = 0 if first is None else 1 if first == last else 2
    if categories == 2 and df.where((category > first) & (category < last)).limit(1).count():
        categories = 3
    fills: dict[str, float | None] = {}
    spread = found["spread"] or 0.0
    if rows > found["numbers"] or rows > found["flags"]:
        fills = missing_fills(df, number, flag, spec)
        spread = filled_spread(rows, found["numbers"], found["mean"], spread, fills["numeric_fill"])
    return TableFacts(rows, spread, categories, first, last, **fills)


def missing_fills(df: DataFrame, number: Column, flag: Column, spec: MaskSpec) -> dict[str, float]:
    """What stands in for missing cells: the median, in bins the mode, else the defaults."""
    middle, mode, level = exact_median(df, number), smallest_mode(df, number), exact_median(df, flag)
    return {
        "numeric_fill": spec.numeric_default if middle is None else middle,
        "numeric_mode": spec.numeric_default if mode is None else mode,
        "flag_fill": 0.0 if level is None else level,
    }


def filled_spread(rows: int, known: int, mean: float | None, spread: float, fill: float) -> float:
    """Sample deviation of ``known`` numbers and ``rows - known`` copies of the fill."""
    if rows < 2 or not known:
        return 0.0
    middle = (known * mean + (rows - known) * fill) / rows
    squares = (known - 1) * spread**2 + known * (mean - middle) ** 2 + (rows - known) * (fill - middle) ** 2
    return (squares / (rows - 1)) ** 0.5


# --- settings as columns ---------------------------------------------------------------


def _clamped(value: float, low: float, high: float) -> float:
    return max(low, min(high, float(value)))


def swap_size(fraction: float, rows: int) -> int:
    """Rows to swap: half-even rounding of the share, 0 when fewer than two would move."""
    size = round(rows * _clamped(fraction, 0.0, 1.0))
    return size if size >= 2 else 0


def setting_values(config_id: int, config: MaskingConfig, spec: MaskSpec, facts: TableFacts) -> dict[str, object]:
    """Numbers that the expressions need, derived once per setting instead of once per row."""
    width = max(int(config.generalization_bin), 1)
    strength = _clamped(config.perturbation_strength, 0.0, 1.0)
    budget = config.epsilon * (config.hybrid_dp_budget_fraction if config.method == "hybrid" else 1.0)
    epsilon = max(float(budget), SMALLEST_EPSILON)
    left, right = facts.category_pair(spec)
    return {
        "config_id": config_id,
        "key": config.key(),
        "key_number": key_number(config.key()),
        "method": config.method,
        "noise_std": float(config.noise_std),
        "suppress_p": float(config.gender_mask_probability),
        "width": width,
        "generalize_p": max(float(config.gender_mask_probability), min(0.5, width / 100)),
        "number_scale": (spec.upper - spec.lower) / epsilon,
        "flag_scale": 1.0 / epsilon,
        "epsilon": epsilon,
        "strength": strength,
        "number_sd": max(facts.numeric_std, 1.0) * strength,
        "flip_p": min(strength / 2, 0.35),
        "perturb_p": min(strength, 0.65),
        "swap_n": swap_size(config.swap_fraction, facts.rows),
        "swap_p": _clamped(config.swap_fraction, 0.0, 1.0),
        "swap_u": -1.0,
        "swap_id": None,
        "left": left,
        "right": right,
        "number_fill": facts.numeric_fill,
        "number_mode": facts.numeric_mode,
        "flag_fill": facts.flag_fill,
    }


SETTING_TYPE = (
    "config_id int, key string, key_number bigint, method string, noise_std double, suppress_p double, width bigint, "
    "generalize_p double, number_scale double, flag_scale double, epsilon double, strength double, "
    "number_sd double, flip_p double, perturb_p double, swap_n bigint, swap_p double, swap_u double, "
    "left string, right string, number_fill double, number_mode double, flag_fill double, swap_id "
)


def with_settings(df: DataFrame, settings: Sequence[dict[str, object]]) -> DataFrame:
    """One row per (row, setting). A single setting adds no fan-out at all.

    The settings enter as one literal that the optimiser folds into an array of structs.
    """
    fields = SETTING_TYPE + dict(df.dtypes)["row_id"]
    if len(settings) == 1:
        cfg = F.from_json(F.lit(json.dumps(settings[0], default=str)), fields)
    else:
        cfg = F.explode(F.from_json(F.lit(json.dumps(settings, default=str)), f"array<struct<{fields}>>"))
    return df.select("*", cfg.alias("cfg")).withColumn("config_id", F.col("cfg.config_id"))


def wide(df: DataFrame, spec: MaskSpec) -> DataFrame:
    """Original side of the wide frame; the label always comes from the original flag."""
    return df.select(
        F.col(spec.row_id).alias("row_id"),
        (F.coalesce(F.col(spec.flag).cast("double"), F.lit(0.0)) >= 0.5).cast("int").alias("label"),
        F.col(spec.numeric).cast("double").alias(f"o_{spec.numeric}"),
        F.col(spec.category).alias(f"o_{spec.category}"),
        F.col(spec.flag).cast("double").alias(f"o_{spec.flag}"),
        *[F.col(c) for c in spec.carried],
    )


# --- mask steps ------------------------------------------------------------------------
# Every step reads and writes the working columns NUMBER, FLAG and CATEGORY. A step leaves
# an attribute alone when the role is not sensitive.


def _set(df: DataFrame, spec: MaskSpec, number: Column, flag: Column, category: Column) -> DataFrame:
    values = {}
    if spec.is_sensitive(spec.numeric):
        values[NUMBER] = number
    if spec.is_sensitive(spec.flag):
        values[FLAG] = flag
    if spec.is_sensitive(spec.category):
        values[CATEGORY] = category
    return df.withColumns(values) if values else df


def _with_draws(df: DataFrame, draws: Draws, stage: str) -> DataFrame:
    key = "key" if draws.kind == "sha256" else "key_number"
    return draws.add(df, F.col(f"cfg.{key}"), stage, F.col("row_id"))


def _without_draws(df: DataFrame) -> DataFrame:
    return df.drop(*[f"__u{i}" for i in range(4)])


def _u(lane: int) -> Column:
    return F.col(f"__u{lane}")


def _cfg(name: str) -> Column:
    return F.col(f"cfg.{name}")


def suppress(category: Column, probability: Column, draw: Column, token: str) -> Column:
    """Replace a cell by ``token`` with the given probability."""
    return F.when(draw < probability, F.lit(token)).otherwise(category)


def noise_columns(spec: MaskSpec, category_too: bool = True) -> tuple[Column, Column, Column]:
    z_number, z_flag = gaussian_pair(_u(0), _u(1))
    number = _bounded(F.col(NUMBER), _cfg("noise_std") * z_number, spec.lower, spec.upper)
    flag = _bounded(F.col(FLAG), _cfg("noise_std") / F.lit(10.0) * z_flag, 0.0, 1.0)
    category = F.col(CATEGORY)
    if category_too:
        category = suppress(category, _cfg("suppress_p"), _u(2), SUPPRESSED)
    return number, flag, category


def perturb_columns(spec: MaskSpec) -> tuple[Column, Column, Column]:
    z, _ = gaussian_pair(_u(0), _u(1))
    old_number, old_flag = _filled(NUMBER, "number_fill"), _filled(FLAG, "flag_fill")
    active = _cfg("strength") > 0
    number = _bounded(old_number, _cfg("number_sd") * z, spec.lower, spec.upper)
    flag = F.when(_u(3) < _cfg("flip_p"), F.lit(1.0) - (old_flag >= 0.5).cast("double")).otherwise(old_flag)
    return (
        F.when(active, number).otherwise(F.col(NUMBER)),
        F.when(active, flag).otherwise(F.col(FLAG)),
        suppress(F.col(CATEGORY), _cfg("perturb_p"), _u(2), PERTURBED),
    )


def bin_start(number: Column, width: Column) -> Column:
    return (F.floor(number / width) * width).cast("bigint")


def bin_midpoint(start: Column, width: Column) -> Column:
    return start.cast("double") + (width.cast("double") - F.lit(1.0)) / F.lit(2.0)


def bin_label(start: Column, width: Column) -> Column:
    """Text of a bin; null without a start."""
    return F.concat(start.cast("string"), F.lit("-"), (start + width - 1).cast("string"))


def generalize_columns(category_too: bool = True) -> tuple[Column, Column, Column]:
    start = bin_start(_filled(NUMBER, "number_mode"), _cfg("width"))
    flag = (F.coalesce(F.col(FLAG), F.lit(0.0)) >= 0.5).cast("double")
    category = F.col(CATEGORY)
    if category_too:
        category = suppress(category, _cfg("generalize_p"), _u(2), GENERALIZED)
    return bin_midpoint(start, _cfg("width")), flag, category


def randomized_response(category: Column, left: Column, right: Column, epsilon: Column) -> Column:
    """Keep with probability e^eps / (1 + e^eps), else flip; outside the pair a flip is a fair pick."""
    keep = F.lit(1.0) / (F.lit(1.0) + F.exp(-epsilon))
    flip = _u(2) > keep
    return (
        F.when(flip & (category == left), right)
        .when(flip & (category == right), left)
        .when(flip, F.when(_u(3) < 0.5, left).otherwise(right))
        .otherwise(category)
    )


def laplace_columns(spec: MaskSpec) -> tuple[Column, Column, Column]:
    old_number, old_flag = _filled(NUMBER, "number_fill"), _filled(FLAG, "flag_fill")
    number = _bounded(old_number, laplace(_u(0), _cfg("number_scale")), spec.lower, spec.upper)
    flag = _bounded(old_flag, laplace(_u(1), _cfg("flag_scale")), 0.0, 1.0)
    return number, flag, randomized_response(F.col(CATEGORY), _cfg("left"), _cfg("right"), _cfg("epsilon"))


def _bounded(old: Column, noise: Column, low: float, high: float) -> Column:
    """Noised value inside its bounds; a missing value stays missing."""
    return F.when(old.isNotNull(), F.greatest(F.least(old + noise, F.lit(high)), F.lit(low)))


def _filled(column: str, fill: str) -> Column:
    """A working column with the setting's fill for missing cells; the fill is null where none are missing."""
    return F.coalesce(F.col(column), _cfg(fill))


# --- swapping --------------------------------------------------------------------------


def _swap_values(spec: MaskSpec) -> list[str]:
    return [c for c, role in ((NUMBER, spec.numeric), (CATEGORY, spec.category)) if spec.is_sensitive(role)]


def settle_swap_cuts(
    df: DataFrame, spec: MaskSpec, settings: Sequence[dict[str, object]], draws: Draws, rows: int, bucket_rows: int
) -> list[dict[str, object]]:
    """Add to each setting the draw of its last swapped row, so choosing rows is a filter."""
    limits = {s["config_id"]: [s["swap_n"]] for s in settings if 0 < s["swap_n"] < rows}
    cuts = {}
    if limits:
        drawn = _with_draws(with_settings(df.select("row_id"), settings), draws, "swap")
        cuts = cut_points(drawn, "config_id", "__u0", "row_id", limits, rows, bucket_rows)
    placed = []
    for s in settings:
        u, row_id = cuts.get((s["config_id"], s["swap_n"]), (2.0 if s["swap_n"] else -1.0, None))
        placed.append({**s, "swap_u": u, "swap_id": row_id})
    return placed


def _take_next(df: DataFrame, values: Sequence[str], buckets: int, across: bool) -> DataFrame:
    """Give every row the values of the next row in the random order of ``__u1``.

    Rows are ordered inside buckets. ``across`` links the buckets of a setting into one
    cycle: the last row of a bucket takes the values of the first row of the next bucket,
    which come from one small row per setting and bucket. The ordered rows are then kept: they are
    drawn, shuffled and sorted once, however often the result is read.
    """
    bucketed = _without_draws(df.withColumns({"__bucket": draw_bucket(_u(1), buckets), "__turn": _u(1)}))
    order = Window.partitionBy("config_id", "__bucket").orderBy("__turn", "row_id")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    moved = F.struct(*values)
    following = F.lead(moved).over(order)
    if not across:
        taken = bucketed.withColumn("__in", F.coalesce(following, F.first(moved).over(whole)))
    else:
        ordered = bucketed.withColumns({"__in": following, "__first": F.row_number().over(order) == 1})
        kept = settle(ordered.drop("__turn"))
        heads = kept.where("__first").select("config_id", "__bucket", moved.alias("__head"))
        ring = Window.partitionBy("config_id").orderBy("__bucket")
        all_heads = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        next_head = F.coalesce(F.lead("__head").over(ring), F.first("__head").over(all_heads))
        # heads: one row per setting and bucket, which also is the only one of its bucket without a next row.
        heads = settle(heads.select("config_id", "__bucket", next_head.alias("__next_head")))
        last = kept.where("__in is null").drop("__in").join(F.broadcast(heads), ["config_id", "__bucket"])
        taken = kept.where("__in is not null").unionByName(last.withColumnRenamed("__next_head", "__in"))
    return taken.withColumns({v: F.col(f"__in.{v}") for v in values})


def _permuted(df: DataFrame, values: Sequence[str], part_rows: int) -> DataFrame:
    """Give every row the values of a row of its setting drawn by a uniform permutation.

    Rows are ranked twice, by the draws ``__u1`` and ``__u2``; the k-th of the first order takes the
    values of the k-th of the second. Both ranks are counted by ranges and joined on (setting, rank), so
    no task holds more than a range, and a row may keep its own values.
    """
    one = F.lit(1).cast("bigint").alias("__one")
    takers = df.select("*", F.struct("__u1", "row_id").alias("__order"), one)
    givers = df.select("config_id", F.struct("__u2", "row_id").alias("__order"), F.struct(*values).alias("__in"), one)
    takers, givers = (running_totals(side, ["config_id"], "__order", ["__one"], part_rows) for side in (takers, givers))
    moved = takers.join(givers.select("config_id", "__one_upto", "__in"), ["config_id", "__one_upto"])
    return moved.withColumns({v: F.col(f"__in.{v}") for v in values})


def swap_rows(
    df: DataFrame,
    spec: MaskSpec,
    draws: Draws,
    settings: Sequence[dict[str, object]],
    bucket_rows: int = BUCKET_ROWS,
    uniform: bool = False,
) -> DataFrame:
    """Move (number, category) together among exactly ``swap_n`` rows of each setting.

    The chosen rows form one random cycle: each takes the values of the next one. Only they
    are shuffled, once; all other rows pass straight through. With ``uniform`` they are permuted
    instead, every permutation being equally likely, for two more shuffles of them. ``settings``
    carry their cuts (``settle_swap_cuts``).
    """
    moved = moved_rows(df, spec, draws, settings, bucket_rows, uniform)
    return df if moved is None else with_moved(df, draws, settings, moved)


def moved_rows(
    df: DataFrame,
    spec: MaskSpec,
    draws: Draws,
    settings: Sequence[dict[str, object]],
    bucket_rows: int = BUCKET_ROWS,
    uniform: bool = False,
) -> DataFrame | None:
    """The chosen rows with the values that they take, without ``cfg``; None if no row is moved."""
    values = _swap_values(spec)
    most = max(s["swap_n"] for s in settings)
    if not values or most == 0:
        return None
    drawn = _with_draws(df, draws, "swap")
    chosen = drawn.where(_chosen()).drop("cfg")
    columns = [c for c in df.columns if c != "cfg"]
    if uniform:
        return _permuted(chosen, values, bucket_rows).select(columns)
    return _take_next(chosen, values, bucket_count(most, bucket_rows), across=True).select(columns)


def with_moved(df: DataFrame, draws: Draws, settings: Sequence[dict[str, object]], moved: DataFrame) -> DataFrame:
    """``moved`` in place of the chosen rows of ``df``, both of them with these settings."""
    fields = SETTING_TYPE + dict(df.dtypes)["row_id"]
    texts = F.lit(json.dumps({str(s["config_id"]): s for s in settings}, default=str))
    by_id = F.from_json(texts, f"map<string, struct<{fields}>>")
    settled = moved.withColumn("cfg", F.element_at(by_id, F.col("config_id").cast("string")))
    rest = _with_draws(df, draws, "swap").where(~_chosen())
    return settled.select(df.columns).unionByName(rest.select(df.columns))


def _chosen() -> Column:
    return F.coalesce(up_to(_u(0), F.col("row_id"), _cfg("swap_u"), _cfg("swap_id")), F.lit(False))


def swap_rows_in_buckets(df: DataFrame, spec: MaskSpec, draws: Draws, buckets: int) -> DataFrame:
    """Cheaper swap: each row joins with probability ``swap_p`` and the chosen rows of each
    random bucket form a cycle of their own.

    No pass to find the cut or to link buckets; the number of swapped rows is a draw.
    """
    values = _swap_values(spec)
    if not values:
        return df
    drawn = _with_draws(df, draws, "swap")
    moved = _take_next(drawn.where(_u(0) < _cfg("swap_p")), values, buckets, across=False)
    return moved.select(df.columns).unionByName(drawn.where(_u(0) >= _cfg("swap_p")).select(df.columns))


# --- whole masks -----------------------------------------------------------------------


def _start(df: DataFrame, spec: MaskSpec, settings: Sequence[dict[str, object]]) -> DataFrame:
    frame = with_settings(df, settings)
    return frame.withColumns(
        {
            NUMBER: F.col(f"o_{spec.numeric}"),
            FLAG: F.col(f"o_{spec.flag}"),
            CATEGORY: F.col(f"o_{spec.category}"),
        }
    )


def _finish(df: DataFrame, spec: MaskSpec, method: str) -> DataFrame:
    """Masked columns under their public names; labels only where a setting generalises."""
    number, flag, width = F.col(NUMBER), F.col(FLAG), _cfg("width")
    number_label = flag_label = F.lit(None)
    if method == "generalization" and spec.is_sensitive(spec.numeric):
        start = (number - (width.cast("double") - F.lit(1.0)) / F.lit(2.0)).cast("bigint")
        number_label = bin_label(start, width)
    if method == "generalization" and spec.is_sensitive(spec.flag):
        flag_label = F.when(flag >= 0.5, F.lit("High")).otherwise(F.lit("Low"))
    return df.select(
        "config_id", "row_id", "label",
        f"o_{spec.numeric}", f"o_{spec.category}", f"o_{spec.flag}", *spec.carried,
        number.alias(f"m_{spec.numeric}"),
        number_label.cast("string").alias(f"m_{spec.numeric}_label"),
        F.col(CATEGORY).alias(f"m_{spec.category}"),
        flag.alias(f"m_{spec.flag}"),
        flag_label.cast("string").alias(f"m_{spec.flag}_label"),
    )


def _row_local(
    df: DataFrame, spec: MaskSpec, settings: list, draws: Draws, method: str
) -> DataFrame:
    """Settings of one method that looks at one row at a time."""
    drawn = _with_draws(_start(df, spec, settings), draws, method)
    steps = {
        "noise": lambda: noise_columns(spec),
        "generalization": lambda: generalize_columns(),
        "differential_privacy": lambda: laplace_columns(spec),
        "feature_perturbation": lambda: perturb_columns(spec),
    }
    return _finish(_set(drawn, spec, *steps[method]()), spec, method)


def _swapping(
    df: DataFrame, spec: MaskSpec, settings: list, draws: Draws, facts: TableFacts, bucket_rows: int
) -> DataFrame:
    placed = settle_swap_cuts(df, spec, settings, draws, facts.rows, bucket_rows)
    return _finish(swap_rows(_start(df, spec, placed), spec, draws, placed, bucket_rows), spec, "data_swapping")


def _hybrid(
    df: DataFrame, spec: MaskSpec, settings: list, draws: Draws, facts: TableFacts, bucket_rows: int
) -> DataFrame:
    """Noise, swap, perturbation, generalisation without the category, then a Laplace release.

    Stage statistics are taken first, one small row per setting each, and then enter the
    expressions as constants: the spread of the noised number, with its fills if cells are
    missing (swapping changes neither), and the categories that are present after perturbation.
    """

    def noised(some: list) -> DataFrame:
        start = _with_draws(_start(df, spec, some), draws, "noise")
        return _without_draws(_set(start, spec, *noise_columns(spec, category_too=False)))

    def perturbed(some: list) -> DataFrame:
        swapped = noised(some)
        if moved is not None:
            # Swapping does not look at what is settled after it, so its rows are the same for all uses.
            own = moved.where(F.col("config_id").isin([s["config_id"] for s in some]))
            swapped = with_moved(swapped, draws, some, own)
        drawn = _with_draws(swapped, draws, "feature_perturbation")
        return _without_draws(_set(drawn, spec, *perturb_columns(spec)))

    settings = settle_swap_cuts(df, spec, settings, draws, facts.rows, bucket_rows)
    moved = moved_rows(noised(settings), spec, draws, settings, bucket_rows)
    if facts.numeric_fill is not None:
        refilled = []
        for s in settings:
            fills = missing_fills(noised([s]), F.col(NUMBER), F.col(FLAG), spec)
            refilled.append(
                {**s, "number_fill": fills["numeric_fill"], "number_mode": fills["numeric_mode"], "flag_fill": fills["flag_fill"]}
            )
        settings = refilled
    if spec.is_sensitive(spec.numeric) and any(s["strength"] > 0 for s in settings):
        number = _filled(NUMBER, "number_fill")
        spread = noised(settings).groupBy("config_id").agg(F.stddev_samp(number).alias("sd")).collect()
        by_id = {r["config_id"]: r["sd"] or 0.0 for r in spread}
        settings = [{**s, "number_sd": max(by_id.get(s["config_id"], 0.0), 1.0) * s["strength"]} for s in settings]
    active = [s for s in settings if s["strength"] > 0]
    if spec.is_sensitive(spec.category) and active:
        # Without perturbation swapping keeps the table's own categories, so nothing to look up.
        present = (
            perturbed(active)
            .groupBy("config_id", CATEGORY)
            .agg(F.count(F.lit(1)).alias("n"))
            .groupBy("config_id")
            .agg(F.count(CATEGORY).alias("count"), F.min(CATEGORY).alias("low"), F.max(CATEGORY).alias("high"))
            .collect()
        )
        pairs = {r["config_id"]: (r["low"], r["high"]) if r["count"] == 2 else spec.category_pair for r in present}
        settings = [
            {**s, "left": pairs[s["config_id"]][0], "right": pairs[s["config_id"]][1]}
            if s["config_id"] in pairs
            else s
            for s in settings
        ]
    binned = _set(perturbed(settings), spec, *generalize_columns(category_too=False))
    final = _with_draws(binned, draws, "differential_privacy")
    return _finish(_set(final, spec, *laplace_columns(spec)), spec, "hybrid")


def evaluate_masks(
    df: DataFrame,
    spec: MaskSpec,
    configs: Sequence[MaskingConfig],
    draws: Draws | None = None,
    facts: TableFacts | None = None,
    first_id: int = 0,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Original and masked values of every row under every setting (``config_id`` = position)."""
    if not configs:
        raise ValueError("at least one masking setting is needed")
    draws = draws or Draws()
    facts = facts or table_facts(df, spec)
    settings = [setting_values(i, c, spec, facts) for i, c in enumerate(configs, start=first_id)]
    original = wide(df, spec)
    parts = []
    by_method = {m: [s for s in settings if s["method"] == m] for m in METHODS}
    for method, some in by_method.items():
        if not some:
            continue
        if method == "data_swapping":
            parts.append(_swapping(original, spec, some, draws, facts, bucket_rows))
        elif method == "hybrid":
            parts.append(_hybrid(original, spec, some, draws, facts, bucket_rows))
        else:
            parts.append(_row_local(original, spec, some, draws, method))
    frame = parts[0]
    for part in parts[1:]:
        frame = frame.unionByName(part)
    return frame


def released(frame: DataFrame, spec: MaskSpec, config: MaskingConfig) -> DataFrame:
    """Public columns of a masked frame that holds one setting."""
    binned = config.method == "generalization"

    def public(role: str) -> Column:
        suffix = "_label" if binned and spec.is_sensitive(role) else ""
        return F.col(f"m_{role}{suffix}").alias(role)

    return frame.select(
        F.col("row_id").alias(spec.row_id),
        public(spec.numeric),
        F.col(f"m_{spec.category}").alias(spec.category),
        public(spec.flag),
        *spec.carried,
    )


def with_all_roles(df: DataFrame, spec: MaskSpec) -> DataFrame:
    """The table with empty columns for the roles that it lacks."""
    kinds = {spec.numeric: "double", spec.flag: "double", spec.category: "string"}
    return df.withColumns({c: F.lit(None).cast(kind) for c, kind in kinds.items() if c not in df.columns})


def release(
    df: DataFrame,
    spec: MaskSpec,
    config: MaskingConfig,
    draws: Draws,
    facts: TableFacts | None = None,
) -> DataFrame:
    """The masked table under the original column names; columns that it lacks are skipped.

    Who knows the seed of ``draws`` can undo the noise, so there is no default one.
    """
    present = spec.present_in(df.columns)
    frame = evaluate_masks(with_all_roles(df, spec), present, [config], draws, facts)
    return released(frame, present, config).drop(*[c for c in spec.maskable if c not in df.columns])


def bucketed_swap(
    df: DataFrame, spec: MaskSpec, config: MaskingConfig, buckets: int, draws: Draws | None = None
) -> DataFrame:
    """Wide frame of the bucketed swap."""
    facts = TableFacts(0, 0.0, 0, None, None)
    start = _start(wide(df, spec), spec, [setting_values(0, config, spec, facts)])
    return _finish(swap_rows_in_buckets(start, spec, draws or Draws(), buckets), spec, config.method)


def permuted_swap(
    df: DataFrame, spec: MaskSpec, config: MaskingConfig, draws: Draws | None = None, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Wide frame of the swap by a uniform permutation."""
    draws, facts = draws or Draws(), table_facts(df, spec)
    placed = settle_swap_cuts(df, spec, [setting_values(0, config, spec, facts)], draws, facts.rows, bucket_rows)
    return _finish(swap_rows(_start(wide(df, spec), spec, placed), spec, draws, placed, bucket_rows, uniform=True), spec, config.method)
