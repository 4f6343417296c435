"""Phrase mining with an FM-index for each slice of the corpus.

Words that are frequent in their language get whole numbers; each slice's text, over these numbers,
is indexed by its Burrows-Wheeler transform. Intervals of the index are extended to the left through
the transform, word by word up to the longest phrase, which lists every phrase of the slice with its
count: no phrase is looked up or hashed. Counts are then summed across slices, in buckets drawn from
the phrase, and all further steps work on the phrases that are frequent.

A phrase can only be frequent if its words are, so rarer words end a run just as the end of a piece
does. Scores are exact: products beyond 64 bits are decimals.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import batch_of, checkpointed, column_of, mix, stored
from veilframe.llm.corpus_slices import CORPUS_SLICE_BYTES, coded_words, corpus_slices, packed, unpacked
from veilframe.operators.ranking import number_rows

LONGEST = 3
LEAST = 10  # occurrences of a candidate
ABSORBED_PERCENT = 50  # a phrase goes if a longer one around it has this share of its occurrences
TOP = 2000
SCALE = 1_000_000
PARTS = 64  # of a language's candidates, ranked apart before they are ranked together
BUCKET_GRAMS = 1 << 21  # phrases of slices that a task sums at a time, at most about

BREAKS = np.zeros(256, bool)  # ends of pieces: . , ; : ! ? and the line ends
BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
SEPARATORS = BREAKS.copy()
SEPARATORS[[0x20, 0x09]] = True

CODED = "slice long, langs array<string>, words array<string>, counts array<long>, sequence binary"
GRAMS = "depth int, bucket int, columns array<binary>, counts binary"


def coded(docs: DataFrame, text: str, lang: str, size: int = CORPUS_SLICE_BYTES) -> DataFrame:
    """One row for each slice: its words by language with counts, and all pieces as codes from 1, with 0 around each piece."""

    def run(batches):
        for number, batch in corpus_slices(batches, "_text", size):
            words = coded_words(column_of(batch, "_text"), SEPARATORS)
            languages = column_of(batch, "_lang").dictionary_encode()
            row = words.row_of_word()
            kinds = max(len(words.vocabulary), 1)
            of_word = languages.indices.to_numpy().astype(np.int64)[row]
            cells, codes, counts = np.unique(of_word * kinds + words.codes, return_inverse=True, return_counts=True)
            piece = np.cumsum(BREAKS[words.data])[words.starts] if len(row) else row
            opens = np.ones(len(row), bool)
            opens[1:] = (np.diff(row) != 0) | (np.diff(piece) != 0)
            sequence = np.zeros(len(row) + int(opens.sum()) + 1, np.int64)
            sequence[np.arange(len(row)) + np.cumsum(opens)] = codes + 1
            yield batch_of(
                slice=pa.array([number], pa.int64()),
                langs=pa.array([languages.dictionary.take(pa.array(cells // kinds)).to_pylist()], pa.list_(pa.string())),
                words=pa.array([words.vocabulary.take(pa.array(cells % kinds)).to_pylist()], pa.list_(pa.string())),
                counts=pa.array([counts], pa.list_(pa.int64())),
                sequence=pa.array([packed(sequence)], pa.binary()),
            )

    rows = docs.select(F.coalesce(docs[text], F.lit("")).alias("_text"), F.coalesce(docs[lang], F.lit("und")).alias("_lang"))
    return rows.mapInArrow(run, CODED)


class FMIndex:
    """Burrows-Wheeler index of a text of whole numbers from 1; 0 separates pieces, and begins and ends the text.

    Rows are the places of the text ordered by the ``depth`` numbers from there on. All places with
    the same phrase of up to ``depth`` numbers form an interval of rows. ``transform`` holds the number
    before each row's place. Sorted by it, the rows come in the order of the places one step to the
    left, so the interval of a phrase, extended to the left by a number, is the run of rows with
    that number in this order.
    """

    def __init__(self, text: np.ndarray, depth: int):
        self.text, self.depth = text, depth
        bits = int(text.max()).bit_length() if len(text) else 1
        if bits * depth < 64:
            rank = np.zeros(len(text), np.int64)
            for k in range(depth):
                rank = (rank << bits) | np.roll(text, -k)
        else:
            rank = text
            for _ in range(depth - 1):
                rank = np.unique(text * (int(rank.max()) + 1) + np.roll(rank, -1), return_inverse=True)[1]
        self.order = np.argsort(rank, kind="stable")
        self.transform = text[self.order - 1]
        self.onward = np.argsort(self.transform, kind="stable")  # row k continues, one number on, at row onward[k]

    def _intervals(self, symbol: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Beginnings and ends of runs of equal (symbol, inner), and the run of each row; -1 where there is no phrase."""
        opens = np.ones(len(symbol), bool)
        opens[1:] = (symbol[1:] != symbol[:-1]) | (inner[1:] != inner[:-1])
        low = np.flatnonzero(opens)
        high = np.append(low[1:], len(symbol))
        there = (symbol[low] > 0) & (inner[low] >= 0)
        number = np.where(there, np.cumsum(there) - 1, -1)
        return low[there], high[there], np.repeat(number, high - low)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Intervals of the single numbers."""
        symbol = self.text[self.order]
        return self._intervals(symbol, np.zeros(len(symbol), np.int64))

    def extended_left(self, interval_of_row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Intervals of all phrases one number longer than those of ``interval_of_row``."""
        return self._intervals(self.transform[self.onward], interval_of_row[self.onward])

    def phrases(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For 2, 3, ... numbers: the phrases (one row of numbers each, in order) and how often they occur."""
        _, _, of_row = self.words()
        for length in range(2, self.depth + 1):
            low, high, of_row = self.extended_left(of_row)
            at = self.order[low]
            yield np.stack([self.text[at + k] for k in range(length)], axis=1), high - low


def _phrases_of_slice(slice_rows: pa.Table, found: pa.Table, longest: int, buckets: int) -> pa.Table:
    row = slice_rows.slice(0, 1).to_pylist()[0]
    ids, at = found.column("id").to_numpy(), found.column("pos").to_numpy()
    order = np.argsort(ids)
    ids = ids[order]
    code = np.zeros(len(row["words"]) + 1, np.int64)
    code[at[order] + 1] = np.arange(1, len(ids) + 1)
    text = code[unpacked(row["sequence"])]
    text = text[(text > 0) | (np.roll(text, 1) > 0) | (np.arange(len(text)) == 0)]
    rows = []
    for phrases, counts in FMIndex(text, longest).phrases():
        grams = ids[phrases - 1]
        key = np.zeros(len(grams), np.uint64)
        for k in range(grams.shape[1]):
            key = mix(key + grams[:, k].astype(np.uint64) + np.uint64(1))
        bucket = (key % np.uint64(buckets)).astype(np.int64)
        by_bucket = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[by_bucket], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(edges)):
            chosen = by_bucket[edges[b] : edges[b + 1]]
            first = grams[chosen, 0]
            columns = [packed(np.diff(first, prepend=0)), *(packed(grams[chosen, k]) for k in range(1, grams.shape[1]))]
            rows.append((grams.shape[1], int(b), columns, packed(counts[chosen])))
    types = (pa.int32(), pa.int32(), pa.list_(pa.binary()), pa.binary())
    names = ("depth", "bucket", "columns", "counts")
    return pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(zip(names, types, strict=True))})


def _summed(table: pa.Table, least: int) -> pa.Table:
    """Counts of a bucket's phrases over all slices; those below ``least`` go."""
    parts = table.column("columns").to_pylist()
    columns = [np.concatenate([np.cumsum(unpacked(p[0])) for p in parts])]
    columns += [np.concatenate([unpacked(p[k]) for p in parts]) for k in range(1, len(parts[0]))]
    counts = np.concatenate([unpacked(c) for c in table.column("counts").to_pylist()])
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    opens = np.ones(len(order), bool)
    opens[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    low = np.flatnonzero(opens)
    total = np.add.reduceat(counts[order], low)
    kept = low[total >= least]
    grams = np.stack([c[kept] for c in columns], axis=1) if len(kept) else np.zeros((0, len(columns)), np.int64)
    offsets = np.arange(len(kept) + 1, dtype=np.int32) * grams.shape[1]
    return pa.table({"gram": pa.ListArray.from_arrays(pa.array(offsets), pa.array(grams.reshape(-1))), "f": pa.array(total[total >= least])})


def phrase_counts(slices: DataFrame, dictionary: DataFrame, words: int, longest: int, least: int) -> DataFrame:
    """gram (array of word ids), f: all phrases of 2 to ``longest`` words that occur ``least`` times over all slices."""
    vocabulary = slices.select(F.col("slice").alias("to_slice"), F.posexplode(F.arrays_zip("langs", "words")).alias("pos", "w"))
    vocabulary = vocabulary.select("to_slice", "pos", F.col("w.langs").alias("lang"), F.col("w.words").alias("word"))
    found = vocabulary.join(dictionary.select("lang", "word", "id"), ["lang", "word"]).select("to_slice", "pos", "id")
    buckets = max(1, ceil(words / BUCKET_GRAMS))

    def enumerated(slice_rows: pa.Table, found: pa.Table) -> pa.Table:
        return _phrases_of_slice(slice_rows, found, longest, buckets)

    def summed(table: pa.Table) -> pa.Table:
        return _summed(table, least)

    by_slice = slices.select("slice", "words", "sequence").groupBy("slice").cogroup(found.groupBy("to_slice"))
    return by_slice.applyInArrow(enumerated, GRAMS).groupBy("depth", "bucket").applyInArrow(summed, "gram array<long>, f long")


def mine_phrases(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    longest: int = LONGEST,
    least: int = LEAST,
    absorbed_percent: int = ABSORBED_PERCENT,
    top: int = TOP,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of 2 to ``longest`` words.

    Words stand between blanks and tabs in the pieces between punctuation and line ends, with A-Z
    lower-cased. ``a`` counts the phrase, ``l`` and ``r`` its two parts at the cut with the lowest
    score, floor(SCALE * a * a / (l * r)), the first of equal ones; ``n`` counts the language's words.
    A candidate occurs ``least`` times; one inside a longer candidate with ``absorbed_percent`` of its
    occurrences goes. Ties are broken by ``a``, then by the phrase in UTF-8 order. Every row counts,
    repeated ones too; a null text has no words, a null language is ``und``. A language without
    candidates has no rows. Other columns are not looked at.
    """
    slices = stored(coded(docs, text, lang))
    counted = slices.select(F.explode(F.arrays_zip("langs", "words", "counts")).alias("w"))
    counted = stored(counted.groupBy(F.col("w.langs").alias("lang"), F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("f")))
    totals = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    dictionary = checkpointed(number_rows(counted.where(F.col("f") >= least), "id"))
    words = counted.agg(F.sum("f")).first()[0] or 0
    phrases = checkpointed(phrase_counts(slices, dictionary, words, longest, least))

    known = phrases.select(F.col("gram").alias("part"), F.col("f").alias("part_f"), F.lit(None).cast("string").alias("part_lang"))
    single = dictionary.select(F.array("id").alias("part"), F.col("f").alias("part_f"), F.col("lang").alias("part_lang"))
    known = single.unionByName(known)
    cuts = phrases.select("gram", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("gram") - 1)).alias("k"))
    cuts = cuts.withColumn("part", F.expr("slice(gram, 1, k)")).withColumn("rest", F.expr("slice(gram, k + 1, size(gram))"))
    cuts = cuts.join(known, "part").select("gram", "a", "k", "rest", F.col("part_f").alias("l"), F.col("part_lang").alias("lang"))
    right = known.select(F.col("part").alias("rest"), F.col("part_f").alias("r"))
    score = F.expr(f"CAST(a AS DECIMAL(18, 0)) * CAST(a AS DECIMAL(18, 0)) * {SCALE} DIV (CAST(l AS DECIMAL(18, 0)) * CAST(r AS DECIMAL(18, 0)))")
    cuts = cuts.join(right, "rest").withColumn("score", score)
    best = cuts.groupBy("gram").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.max("a").alias("a"), F.max("lang").alias("lang"))

    inside = phrases.where(F.size("gram") > 2).select("f", F.col("gram").alias("longer"), F.explode(F.expr("sequence(2, size(gram) - 1)")).alias("many"))
    inside = inside.select("f", F.explode(F.expr("transform(sequence(1, size(longer) - many + 1), i -> slice(longer, i, many))")).alias("gram"))
    around = inside.groupBy("gram").agg(F.max("f").alias("around"))
    best = best.join(around, "gram", "left")
    best = best.where(F.col("around").isNull() | (100 * F.col("around") < absorbed_percent * F.col("a")))

    # Texts are fetched for those that can be among the first, ties included: first of parts drawn
    # by hash, so that no task orders all candidates of a language, then of the language.
    best = best.select("lang", "gram", "a", "cut.l", "cut.r", "cut.score").withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(PARTS)))
    for groups in (["lang", "part"], ["lang"]):
        order = Window.partitionBy(*groups).orderBy(F.desc("score"), F.desc("a"))
        best = best.withColumn("place", F.rank().over(order)).where(F.col("place") <= top).drop("place")
    best = checkpointed(best.drop("part"))
    spelled = best.select("gram", F.posexplode("gram").alias("at", "id")).join(dictionary.select("id", "word"), "id")
    spelled = spelled.groupBy("gram").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("words"))
    spelled = spelled.select("gram", F.array_join("words.word", " ").alias("phrase"))
    last = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.join(spelled, "gram").withColumn("rank", F.row_number().over(last).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
