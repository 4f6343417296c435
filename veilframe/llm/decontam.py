"""Benchmark decontamination by spaced seeds.

A seed is a hash of the words at fixed places of a short window; the other places are ignored,
so a seed survives substituted words there. Seeds of the benchmark items meet the seeds of every
place of every training text. The item and the text are then compared word by word along the
whole diagonal of a hit, and the stretch with the most equal words, of which at least half are
equal, decides. Short items have seeds of fewer places, and the shortest must match whole.

The benchmark is a stated query set: it is split into blocks of bounded size, each block is sent
to the tasks, and all texts are read against it. Texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import NOT_ALNUM, Words, batch_of, column_of, map_slices, ranges, slices, window_hashes, words_of

# Places of a window that count. They cover single, paired, every-third, alternate and alternately paired substitutions.
MASKS = ((0, 1, 2, 3, 4, 5), (0, 1, 2, 4, 5, 6), (0, 1, 3, 4, 6, 7), (0, 1, 2, 5, 6, 7), (0, 2, 4, 6, 8, 10), (0, 1, 4, 5, 8, 9))
MIN_EQUAL_WORDS = 12  # equal words that make a leak, in a stretch of at most twice as many
SHORT_ITEM_WORDS = 16  # shorter items make a leak with three quarters of their words
SHORT_MASKS = ((0, 1, 2, 4), (0, 3, 4, 5), (0, 1, 3, 6))  # one is left whole by any quarter of substitutions
EXACT_ITEM_WORDS = 6  # shorter items must match whole
# (places, fewest and most words of the items)
SEEDS = (
    *((mask, EXACT_ITEM_WORDS, 1 << 62) for mask in MASKS),
    *((mask, EXACT_ITEM_WORDS, SHORT_ITEM_WORDS - 1) for mask in SHORT_MASKS),
    *((tuple(range(n)), n, n) for n in range(1, EXACT_ITEM_WORDS)),
)
HITS_AT_ONCE = 1 << 19
WORDS_AT_ONCE = 1 << 21
BLOCK_BYTES = 8_000_000  # benchmark text in one block
OVERLAP = "item_words bigint, equal_words bigint, stretch_words bigint, start_word bigint"


def folded_words(column: pa.Array) -> Words:
    """Words of letters and digits, in lower case."""
    return words_of(pc.utf8_lower(column.cast(pa.large_string())), NOT_ALNUM)


@dataclass
class Index:
    """Seeds of a block of items, sorted by hash, with a table that most places fail at once."""

    ids: list
    words: Words
    seeds: np.ndarray
    item: np.ndarray
    place: np.ndarray
    bits: int
    maybe: np.ndarray
    kinds: list[int]  # numbers of the seeds that some item has
    needed: np.ndarray  # equal words that make a leak of an item

    @classmethod
    def of(cls, ids: list, texts: list[str]) -> Index:
        words = folded_words(pa.array(texts, pa.string()))
        left, row = words.left_in_row(), words.row_of_word()
        sizes = np.diff(words.rows)
        seeds, places, kinds = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], []
        for k, (mask, fewest, most) in enumerate(SEEDS):
            at = np.flatnonzero((left > mask[-1]) & (sizes[row] >= fewest) & (sizes[row] <= most))
            if len(at):
                seeds.append(seed_hashes(words.hashes, k)[at])
                places.append(at)
                kinds.append(k)
        seed, place = np.concatenate(seeds), np.concatenate(places)
        order = np.argsort(seed, kind="stable")
        seed, place = seed[order], place[order]
        bits = max(16, int(np.log2(len(seed) + 1)) + 6)
        maybe = np.zeros(1 << bits, bool)
        maybe[(seed >> np.uint64(64 - bits)).astype(np.int64)] = True
        needed = np.where(sizes < EXACT_ITEM_WORDS, sizes, np.minimum(MIN_EQUAL_WORDS, -(-3 * sizes // 4)))
        return cls(ids, words, seed, row[place], place - words.rows[row[place]], bits, maybe, kinds, needed)


def seed_hashes(hashes: np.ndarray, kind: int) -> np.ndarray:
    places = SEEDS[kind][0]
    return window_hashes(hashes, places[-1] + 1, places) ^ np.uint64(kind + 1)


def best_stretch(equal: np.ndarray) -> tuple[int, int]:
    """Start and end of the stretch with the most equal words, of which at least half are equal.

    Of several the shortest one, then the first one. It begins and ends with an equal word.
    """
    gain = np.concatenate([[0], np.cumsum(np.where(equal, 1, -1))])
    hits = np.concatenate([[0], np.cumsum(equal)])
    # The earliest start for each end: from there on no fewer words are equal than substituted.
    begin = np.searchsorted(-np.minimum.accumulate(gain), -gain, "left")
    same = hits - hits[begin]
    if not same.max():
        return 0, 0
    place = np.flatnonzero(equal)
    ends = np.flatnonzero(same == same.max())
    first, last = place[hits[begin[ends]]], place[hits[ends] - 1] + 1
    chosen = np.lexsort((first, last - first))[0]
    return int(first[chosen]), int(last[chosen])


def _hits(words: Words, index: Index) -> Iterator[np.ndarray]:
    """(row, item, shift) of the diagonals with a seed, a bounded number at once; one may come again."""
    left, row = words.left_in_row(), words.row_of_word()
    for k in index.kinds:
        seeds = seed_hashes(words.hashes, k)
        at = np.flatnonzero(index.maybe[(seeds >> np.uint64(64 - index.bits)).astype(np.int64)])
        at = at[left[at] > SEEDS[k][0][-1]]
        low, high = np.searchsorted(index.seeds, seeds[at], "left"), np.searchsorted(index.seeds, seeds[at], "right")
        many = high - low
        at, low, many = at[many > 0], low[many > 0], many[many > 0]
        total = np.cumsum(many)
        cuts = np.flatnonzero(np.diff(total // HITS_AT_ONCE)) + 1
        for part in np.split(np.arange(len(at)), cuts):
            if len(part):
                hit = ranges(low[part], many[part])
                place = np.repeat(at[part], many[part])
                yield np.unique(np.stack([row[place], index.item[hit], place - words.rows[row[place]] - index.place[hit]], axis=1), axis=0)


def _equal_enough(words: Words, index: Index, hits: np.ndarray) -> np.ndarray:
    """The hits on whose diagonals as many words are equal as the item needs."""
    row, item, shift = hits.T
    begin = np.maximum(0, -shift)
    size = np.minimum(np.diff(index.words.rows)[item], np.diff(words.rows)[row] - shift) - begin
    kept = np.zeros(len(hits), bool)
    cuts = np.flatnonzero(np.diff(np.cumsum(size) // WORDS_AT_ONCE)) + 1
    for part in np.split(np.arange(len(hits)), cuts):
        theirs = index.words.hashes[ranges(index.words.rows[item[part]] + begin[part], size[part])]
        ours = words.hashes[ranges(words.rows[row[part]] + shift[part] + begin[part], size[part])]
        same = np.bincount(np.repeat(np.arange(len(part)), size[part]), theirs == ours, len(part))
        kept[part] = same >= index.needed[item[part]]
    return hits[kept]


def overlaps(words: Words, index: Index) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item, equal words, words of the stretch, its first word) of each leak, the best one for each row and item."""
    best: dict[tuple[int, int], tuple] = {}
    for hits in _hits(words, index):
        enough = _equal_enough(words, index, hits)
        # All places of an item that must match whole are alike, so its first one is the best.
        whole = np.diff(index.words.rows)[enough[:, 1]] < EXACT_ITEM_WORDS
        again = np.concatenate([[False], (enough[1:, :2] == enough[:-1, :2]).all(axis=1)])[: len(enough)]
        for r, item, shift in enough[~(whole & again)].tolist():
            theirs = index.words.hashes[index.words.rows[item] : index.words.rows[item + 1]]
            ours = words.hashes[words.rows[r] : words.rows[r + 1]]
            begin, end = max(0, -shift), min(len(theirs), len(ours) - shift)
            equal = theirs[begin:end] == ours[begin + shift : end + shift]
            a, b = best_stretch(equal)
            same = int(equal[a:b].sum())
            if same >= index.needed[item]:
                entry = (-same, b - a, begin + shift + a)
                best[r, item] = min(best.get((r, item), entry), entry)
    for (r, item), (same, size, start) in sorted(best.items()):
        yield r, item, -same, size, start


def _blocks(benchmark: DataFrame, item: str, text: str) -> list[Broadcast]:
    """Indexes of the benchmark's blocks. A block holds about BLOCK_BYTES of text, whatever the benchmark's size."""
    items = benchmark.select(benchmark[item].alias("_item"), benchmark[text].alias("_text")).where("_text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0)).alias("bytes")).first()["bytes"]
    count = max(1, ceil(total / BLOCK_BYTES))
    indexes = []
    for block in range(count):
        rows = items.where(F.pmod(F.xxhash64("_item", "_text"), F.lit(count)) == block).orderBy("_item", "_text").collect()
        index = Index.of([r["_item"] for r in rows], [r["_text"] for r in rows])
        indexes.append(benchmark.sparkSession.sparkContext.broadcast(index))
    return indexes


def contaminated(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """One row for each document and benchmark item that overlap enough: key, item, item_words,
    equal_words, stretch_words and start_word of the best stretch.

    Enough are 12 equal words in a stretch of which at least half are equal; of an item with 6 to 15
    words three quarters, at most 12; of a shorter one all words. Words are runs of letters and
    digits in lower case. Null and empty texts overlap with nothing,
    and null items are left out; repeated rows or items are judged each by itself, null keys stay
    null. An empty benchmark or table has no rows. Other columns are not looked at.
    """
    kinds = [docs.select(key).schema[0].dataType.simpleString(), benchmark.select(item).schema[0].dataType.simpleString()]
    item_kind = pa.int64() if kinds[1] == "bigint" else None
    rows = docs.select(docs[key].alias("_key"), docs[text].alias("_text"))

    def searcher(index: Broadcast) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            block = index.value
            found = np.array(list(overlaps(folded_words(column_of(batch, "_text")), block)), np.int64).reshape(-1, 5)
            sizes = np.diff(block.words.rows)[found[:, 1]]
            return batch_of(
                _key=column_of(batch, "_key").take(pa.array(found[:, 0])),
                _item=pa.array([block.ids[i] for i in found[:, 1]], item_kind),
                item_words=sizes.astype(np.int64),
                equal_words=found[:, 2],
                stretch_words=found[:, 3],
                start_word=found[:, 4],
            )

        return run

    result = None
    for index in _blocks(benchmark, item, item_text):
        part = map_slices(rows, "_text", searcher(index), f"_key {kinds[0]}, _item {kinds[1]}, {OVERLAP}")
        result = part if result is None else result.union(part)
    return result.withColumnsRenamed({"_key": key, "_item": item})


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text overlaps with no benchmark item.

    Each row is judged by itself, without a join; null and empty texts stay.
    """
    for index in _blocks(benchmark, item, item_text):

        def run(batches: Iterator[pa.RecordBatch], index: Broadcast = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                column = column_of(batch, text)
                clean = np.ones(len(batch), bool)
                for low, high in slices(column):
                    clean[[low + r for r, *_ in overlaps(folded_words(column[low:high]), index.value)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
