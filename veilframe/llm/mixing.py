"""Mixing sources to target weights by entropy balancing.

Each source should give a set number of words to a training mix. Documents get rates, copies in
expectation, that differ as little from 1 as the targets allow: the divergence
sum(m * (r * ln(r) - r + 1)) over documents is least, with m = size ** evenness, under
sum(size * r) = target for each source and r <= most. Its dual has one multiplier for each source,
and the rates are exponentially tilted: r = min(most, exp(multiplier * size / m)).

Newton steps on the dual run for all sources at once, each as one aggregation over (source, size)
cells, inside brackets that always hold the root. Rates are then rounded into whole copies: cells
hand the words they round away to the next smaller size, and inside a cell a hash of the key picks
the documents with one copy more.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import checkpointed
from veilframe.operators.ranking import bucket_count, number_rows

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)  # by turns, for the sources in code point order, null last
PERCENT = 150  # words of the mix, of all words
MOST = 2  # copies of a document
EVENNESS = 0.5  # 0 tilts rates by size in full, 1 gives all documents of a source the same rate
STEPS = 200  # far above what brackets need to close on a double
SOURCE = ["_there", "_name"]


def water_level(sources: DataFrame, total: float, most: int) -> float:
    """Words for each unit of weight when ``total`` is shared and no source gets more than ``most`` times its size.

    Sources below the level are full; what they leave raises the level for the others. Each pass is
    one small aggregate, and the level only rises.
    """
    level = -1.0
    while True:
        full = F.col("size") * most < F.col("weight") * F.lit(level)
        found = sources.agg(F.sum(F.when(full, F.col("size") * most)).alias("taken"), F.sum(F.when(~full, F.col("weight"))).alias("weight")).first()
        if not found["weight"]:
            return math.inf
        risen = (total - (found["taken"] or 0)) / found["weight"]
        if risen <= level:
            return level
        level = risen


def source_targets(cells: DataFrame, weights: Sequence[int], percent: int, most: int) -> DataFrame:
    """One row for each source: its words, documents and target."""
    sources = cells.groupBy(*SOURCE).agg(F.sum(F.col("size") * F.col("docs")).alias("size"))
    sources = number_rows(sources.orderBy(F.desc("_there"), "_name"), "place")
    turn = F.get(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights)).cast("int"))
    sources = checkpointed(sources.withColumn("weight", turn).drop("place"))
    total = sources.agg(F.sum("size")).first()[0] or 0
    level = water_level(sources, total * percent / 100, most)
    return sources.withColumn("target", F.least(F.col("size") * F.lit(float(most)), F.col("weight") * F.lit(level))).drop("weight")


def _tilt(evenness: float):
    return F.pow(F.col("size").cast("double"), F.lit(1.0 - evenness))


def multipliers(cells: DataFrame, sources: DataFrame, most: int, evenness: float, steps: int = STEPS) -> DataFrame:
    """Sources with ``multiplier``, the root of the dual's slope; null where the target is all that the source can give.

    The slope is sum(size * rate) - target. It grows with the multiplier, so its sign tightens a
    bracket; a Newton step that leaves the bracket is replaced by its middle.
    """
    full = F.col("target") >= F.col("words") * F.lit(float(most))
    state = sources.withColumnRenamed("size", "words").withColumn("multiplier", F.when(~full, F.lit(0.0)))
    below = F.col("target") < F.col("words")
    # Every document with words has a tilt of at least 1, which bounds the root on either side.
    state = state.withColumn("low", F.when(below, F.greatest(F.log(F.col("target") / F.col("words")), F.lit(-700.0))).otherwise(0.0))
    state = checkpointed(state.withColumn("high", F.when(below, 0.0).otherwise(math.log(most))).withColumn("open", ~full))
    tilted = F.col("multiplier") * _tilt(evenness)
    capped = tilted >= math.log(most)
    words = F.col("size") * F.col("docs") * F.when(capped, F.lit(float(most))).otherwise(F.exp(tilted))
    bent = F.when(capped, 0.0).otherwise(words * _tilt(evenness))
    for _ in range(steps):
        asked = state.where("open").select(*SOURCE, "multiplier")
        slopes = cells.where("size > 0").join(asked, SOURCE).groupBy(*SOURCE).agg(F.sum(words).alias("given"), F.sum(bent).alias("curve"))
        state = state.join(slopes, SOURCE, "left")
        over = F.col("given") - F.col("target")
        met = F.abs(over) <= F.greatest(F.lit(1e-12) * F.col("target"), F.lit(1e-6))
        state = state.withColumn("low", F.when(over <= 0, F.col("multiplier")).otherwise(F.col("low")))
        state = state.withColumn("high", F.when(over > 0, F.col("multiplier")).otherwise(F.col("high")))
        newton = F.col("multiplier") - F.try_divide(over, F.col("curve"))
        inside = (newton > F.col("low")) & (newton < F.col("high"))
        middle = (F.col("low") + F.col("high")) / 2
        closed = (middle <= F.col("low")) | (middle >= F.col("high"))
        still = F.col("open") & ~F.coalesce(met | closed, F.lit(True))
        moved = F.when(still, F.when(inside, newton).otherwise(middle)).otherwise(F.col("multiplier"))
        state = state.withColumn("moved", moved).withColumn("still", still)
        state = state.select(*SOURCE, "words", "target", F.col("moved").alias("multiplier"), "low", "high", F.col("still").alias("open"))
        state = checkpointed(state)
        if state.where("open").isEmpty():
            break
    return state.select(*SOURCE, "words", "target", "multiplier")


def _rounded(cells: pa.Table, most: int) -> pa.Table:
    """Copies of each cell of one source: words that rounding takes away go to the next smaller size."""
    order = np.argsort(-cells.column("size").to_numpy(), kind="stable")
    cells = cells.take(pa.array(order))
    copies, carry = [], 0.0
    for size, docs, rate in zip(*(cells.column(c).to_pylist() for c in ("size", "docs", "rate")), strict=True):
        wanted = docs * rate + (carry / size if size else 0.0)
        copies.append(min(max(math.floor(wanted + 0.5), 0), most * docs))
        carry = (wanted - copies[-1]) * size if size else carry
    return cells.append_column("copies", pa.array(copies, pa.int64()))


def cell_copies(cells: DataFrame, solved: DataFrame, most: int, evenness: float) -> DataFrame:
    """Cells with ``copies``, the number that all documents of the cell get together.

    A source whose cells are rounded in one task has at most sqrt(2 * words) of them, as they
    differ in size.
    """
    rate = F.when(F.col("multiplier").isNull(), F.lit(float(most))).otherwise(F.least(F.exp(F.col("multiplier") * _tilt(evenness)), F.lit(float(most))))
    # Sums of doubles differ in their last bits from run to run; nine places do not.
    rated = cells.join(solved, SOURCE).withColumn("rate", F.round(rate, 9))
    rated = rated.select(*SOURCE, "size", "docs", "words", "target", "rate")
    schema = "_there boolean, _name string, size long, docs long, words long, target double, rate double, copies long"

    def rounded(table: pa.Table) -> pa.Table:
        return _rounded(table, most)

    return rated.groupBy(*SOURCE).applyInArrow(rounded, schema)


def mix_sources(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = WEIGHTS,
    percent: int = PERCENT,
    most: int = MOST,
    evenness: float = EVENNESS,
) -> DataFrame:
    """key, size, source_size, target, taken, source, copies, rate: how often the mix takes each document.

    ``size`` counts the words (null text: 0), ``target`` the words the mix should take from the source,
    ``taken`` those it takes from the document, copies times size. Sources weigh ``weights`` by turns in
    code point order, null last, and share ``percent`` of all words, each up to ``most`` times its own.
    A source misses its target by less than its shortest document, but for sources whose documents
    cannot make it up. Every row is placed; repeated rows of a key are told apart only by their
    number, and a null key is one more key. Documents without words get their copies too, and take nothing.
    The same rows give the same result, however they are split. Other columns are not looked at.
    """
    thin = checkpointed(
        docs.select(
            docs[key].alias("_key"),
            docs[source].isNotNull().alias("_there"),
            F.coalesce(docs[source], F.lit("")).alias("_name"),
            F.coalesce(F.regexp_count(docs[text], F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        )
    )
    cells = checkpointed(thin.groupBy(*SOURCE, "size").agg(F.count(F.lit(1)).alias("docs")))
    sources = checkpointed(source_targets(cells, weights, percent, most))
    solved = multipliers(cells, sources, most, evenness)
    cells = checkpointed(cell_copies(cells, solved, most, evenness))

    # Places of documents in their cell, by hash: counted for each part of the hash, ordered only inside it.
    parts = bucket_count(cells.agg(F.sum("docs")).first()[0] or 0)
    hashed = thin.withColumn("_hash", F.xxhash64("_key")).withColumn("_part", F.pmod("_hash", F.lit(parts)).cast("int"))
    distinct = checkpointed(hashed.groupBy(*SOURCE, "size", "_part", "_hash", "_key").agg(F.count(F.lit(1)).alias("_rows")))
    before = Window.partitionBy(*SOURCE, "size").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = distinct.groupBy(*SOURCE, "size", "_part").agg(F.sum("_rows").alias("_many"))
    starts = starts.withColumn("_start", F.coalesce(F.sum("_many").over(before), F.lit(0))).drop("_many")
    starts = starts.join(cells, [*SOURCE, "size"])
    inside = Window.partitionBy(*SOURCE, "size", "_part").orderBy("_hash", "_key").rowsBetween(Window.unboundedPreceding, -1)
    placed = distinct.withColumn("_inside", F.coalesce(F.sum("_rows").over(inside), F.lit(0))).join(starts, [*SOURCE, "size", "_part"])
    rows = placed.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("_rows"))))
    place = F.col("_start") + F.col("_inside") + F.col("_row") - 1
    copies = F.expr("copies DIV docs") + (place < F.col("copies") % F.col("docs")).cast("long")
    rows = rows.withColumn("_copies", copies)
    return rows.select(
        F.col("_key").alias(key),
        "size",
        F.col("words").alias("source_size"),
        "target",
        (F.col("_copies") * F.col("size")).alias("taken"),
        F.when(F.col("_there"), F.col("_name")).alias(source),
        F.col("_copies").alias("copies"),
        "rate",
    )
