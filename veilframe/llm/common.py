"""Helpers that several operators share: Arrow row mapping, vectorised words, lineage cuts."""

from __future__ import annotations

import ctypes
import ctypes.util
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.session import ensure_checkpoint_dir

SLICE_BYTES = 1 << 20  # texts are worked on in slices of about this size, so a task's memory stays flat


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage in the folder that driver and executors share."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage by a compressed table in the shared folder, for results that are read more than once by columns."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def absent_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def give_back_memory() -> None:
    """Hand freed memory back to the system, where the C library can; the allocator keeps it otherwise."""
    libc = ctypes.util.find_library("c")
    trim = getattr(ctypes.CDLL(libc), "malloc_trim", None) if libc else None
    if trim is not None:
        trim(0)


def crc32_mod(column: str, modulus: int) -> Column:
    """crc32 of a column's text, modulo a small number (null stays null)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes of text; one long text is a range of its own."""
    n = len(column)
    if not n:
        return
    lengths = np.asarray(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    group = np.cumsum(lengths, dtype=np.int64) // size
    cuts = np.flatnonzero(np.diff(group)) + 1
    edges = [0, *cuts.tolist(), n]
    yield from zip(edges[:-1], edges[1:], strict=True)


def map_slices(
    df: DataFrame, text: str, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, size: int = SLICE_BYTES
) -> DataFrame:
    """Apply ``function`` to slices of Arrow rows; Spark partitions the rows, nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for low, high in slices(column, size):
                yield function(batch.slice(low, high - low))

    return df.mapInArrow(run, schema)


def sampled(docs: DataFrame, ids: DataFrame, count: int, most_bytes: int) -> DataFrame:
    """Whole texts of ``docs`` (_key, _text) for a bounded sample of ``ids``: _key, _print (xxhash64 of the text), _bytes and other columns.

    The sample is the ids with the smallest hashes, at most ``count`` of them and ``most_bytes`` of
    text (a text that is too long by itself comes only when no other does). Each row of ``ids`` gives
    one row, however often ``docs`` repeats it.
    """
    others = [c for c in ids.columns if c not in ("_key", "_print")]
    first = ids.orderBy(F.xxhash64("_key", "_print"), "_key", "_print", *others).limit(count).collect()
    first = list({(r["_key"], r["_print"]): r for r in reversed(first)}.values())[::-1]
    kept, total = [], 0
    for row in first:
        if total + row["_bytes"] <= most_bytes:
            kept.append(row)
            total += row["_bytes"]
    chosen = docs.sparkSession.createDataFrame(kept or first[:1], ids.schema).drop("_bytes")
    joined = docs.withColumn("_print", F.xxhash64("_text")).join(F.broadcast(chosen), ["_key", "_print"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            pairs = list(zip(column_of(batch, "_key").to_pylist(), column_of(batch, "_print").to_pylist(), strict=True))
            new = {pair: k for k, pair in reversed(list(enumerate(pairs))) if pair not in seen}
            seen.update(new)
            yield batch.take(pa.array(sorted(new.values()), pa.int64()))

    return joined.mapInArrow(run, joined.schema).dropDuplicates(["_key", "_print"])


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """Python texts of a slice, null as the empty text."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


# Byte classes of the two word definitions in use.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.zeros(256, bool)  # everything in ASCII but digits and lower-case letters, after lower-casing
NOT_ALNUM[:0x80] = True
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_RANDOM = np.random.default_rng(20240501)
_BYTE_VALUE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        size = max(n, SLICE_BYTES * 2)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        known = np.cumprod(steps, dtype=np.uint64)
        if size <= SLICE_BYTES * 4:
            _POWERS[base] = known
    return known


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of a slice of texts: byte ranges in ``data``, hashes, and the first word of each row."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    rows: np.ndarray  # row k has the words rows[k]:rows[k + 1]
    bytes_at: np.ndarray  # row k has the bytes bytes_at[k]:bytes_at[k + 1]

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))

    def some_rows(self, low: int, high: int) -> Words:
        """The words of rows ``low`` to ``high``, the latter left out; ``data`` is shared."""
        a, b = self.rows[low], self.rows[high]
        return Words(self.data, self.starts[a:b], self.ends[a:b], self.hashes[a:b], self.rows[low : high + 1] - a, self.bytes_at[low : high + 1])

    def left_in_row(self) -> np.ndarray:
        """For each word, how many words its row has from there on."""
        return np.repeat(self.rows[1:], np.diff(self.rows)) - np.arange(len(self.starts))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column (null as empty) and where each row begins."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def word_edges(data: np.ndarray, at: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which bytes belong to words, where words begin and where they end; no word crosses a row."""
    n = len(data)
    inside = ~separators[data]
    first = inside.copy()
    last = inside.copy()
    if n:
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edges = at[(at > 0) & (at < n)]
        first[edges] = inside[edges]
        last[edges - 1] = inside[edges - 1]
    return inside, np.flatnonzero(first), np.flatnonzero(last) + 1


def words_of(column: pa.Array, separators: np.ndarray = SPACES) -> Words:
    """Words of lower-cased (A-Z) texts. Equal words have equal hashes; unequal ones differ but for 2^-64."""
    raw, at = bytes_of(column)
    data = LOWER[raw]
    n = len(data)
    _, starts, ends = word_edges(data, at, separators)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[data] * _powers(_BASE, n)[:n], out=total[1:])
    hashes = (total[ends] - total[starts]) * _powers(_BASE_INVERSE, n)[starts] if n else np.zeros(0, np.uint64)
    return Words(data, starts, ends, mix(hashes), np.searchsorted(starts, at), at)


@dataclass
class CodedTexts:
    """Words of many texts held at once: a small number for each word, and the bytes of each distinct word once.

    Takes a few bytes for each word; ``words_of`` takes tens for each byte of text.
    """

    codes: np.ndarray  # distinct word of each word
    rows: np.ndarray  # text k has the words rows[k]:rows[k + 1]
    hashes: np.ndarray  # of the distinct words, in order
    data: np.ndarray
    starts: np.ndarray  # of the distinct words' bytes
    ends: np.ndarray

    @classmethod
    def of(cls, column: pa.Array, separators: np.ndarray = SPACES) -> CodedTexts:
        known, local, counts, sizes, data = [], [], [], [], []
        for low, high in slices(column):
            words = words_of(column[low:high], separators)
            distinct, first, codes = np.unique(words.hashes, return_index=True, return_inverse=True)
            lengths = words.ends[first] - words.starts[first]
            known.append(distinct)
            local.append(codes.astype(np.int32))
            counts.append(np.diff(words.rows))
            sizes.append(lengths)
            data.append(words.data[ranges(words.starts[first], lengths)])
        joined = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        distinct, first = np.unique(joined(known, np.uint64), return_index=True)
        codes = [np.searchsorted(distinct, k).astype(np.int32)[c] for k, c in zip(known, local, strict=True)]
        sizes = joined(sizes, np.int64)
        ends = np.cumsum(sizes)[first]
        rows = np.append(0, np.cumsum(joined(counts, np.int64)))
        return cls(joined(codes, np.int32), rows, distinct, joined(data, np.uint8), ends - sizes[first], ends)

    def some_rows(self, low: int, high: int) -> Words:
        """The words of texts ``low`` to ``high``, the latter left out."""
        codes = self.codes[self.rows[low] : self.rows[high]]
        return Words(self.data, self.starts[codes], self.ends[codes], self.hashes[codes], self.rows[low : high + 1] - self.rows[low], np.zeros(0, np.int64))


def row_groups(rows: np.ndarray, words: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about so many words; a longer row is a range of its own."""
    group = rows[:-1] // words
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
    yield from ((a, b) for a, b in zip(edges[:-1], edges[1:], strict=True) if a < b)


_PLACE = mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)


def window_hashes(hashes: np.ndarray, size: int, mask: tuple[int, ...] | None = None) -> np.ndarray:
    """Hash of each run of ``size`` words (rows ignored); ``mask`` names the places that count."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in mask or range(size):
        out += hashes[k : k + n] * _PLACE[k]
    return mix(out)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Numbers start, start+1, ... of each (start, length) pair, one after another."""
    if not len(starts):
        return np.zeros(0, np.int64)
    total = np.cumsum(lengths)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(starts - total + lengths, lengths)


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def batch_of(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))
