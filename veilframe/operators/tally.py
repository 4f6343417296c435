"""All that a sweep asks of masked rows, from one pass over them.

Masking a row costs more than counting it, and a sweep masks every row once for each setting. So
the category cube, the counts of each value bucket and the equivalence classes are taken from the
same pass: tasks add them up in numpy (``mapInArrow``), and what they found meets in one shuffle.

- Cube and buckets are combined in the task; what is sent grows with categories and edges.
- Classes of a continuous column are mostly single rows. They are sent as packed numbers, some 16 bytes
  a row, in parts of about ``PART_ROWS``, drawn from the values; equal ones are combined in the task first.
  Parts are cut by a hash, but values are what is compared, so the classes are exact.

A second pass (``values_of_buckets``) gives the values of the few buckets that counts do not settle.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.operators.joins import BROADCAST_ROWS, join_summary
from veilframe.operators.project import NULL_TEXT, as_text
from veilframe.operators.ranking import bucket_count
from veilframe.session import settle
from veilframe.spec import MaskSpec

CUBE, BUCKETS, CLASSES = range(3)
PARTIAL = "config_id int, kind int, category string, part int, body binary"
FOUND = "config_id int, kind int, place int, texts array<string>, counts array<bigint>, numbers array<double>"
VALUES = "config_id int, feature string, bucket int, value double, b bigint"

CELL_NUMBER = "__cell"

BUFFER_ROWS = 200_000  # rows that are counted at a time
KEPT_ROWS = 2_000_000  # classes or values that a task holds before it sends them
KEPT_CELLS = 100_000  # cube cells that a task holds before it sends them
PART_ROWS = 1_000_000
DENSE = 1_000_000  # cell numbers up to this one are counted in place

# Columns of a cell's numbers, behind its size: two means, three co-moments, two gaps, four minima, four maxima.
MEANS, MOMENTS, GAPS, LOWS, HIGHS = slice(0, 2), slice(2, 5), slice(5, 7), slice(7, 11), slice(11, 15)
NAN_BITS, NULL_BITS = np.int64(0x7FF8000000000000), np.int64(0x7FF8000000000001)


def buffered(batches: Iterable[pa.RecordBatch], rows: int = BUFFER_ROWS) -> Iterator[dict[str, pa.Array]]:
    """Columns of about ``rows`` rows at a time."""

    def joined(some: list[pa.RecordBatch]) -> dict[str, pa.Array]:
        return {name: pa.concat_arrays([b.column(i) for b in some]) for i, name in enumerate(some[0].schema.names)}

    waiting, size = [], 0
    for batch in batches:
        if batch.num_rows:
            waiting.append(batch)
            size += batch.num_rows
        if size >= rows:
            yield joined(waiting)
            waiting, size = [], 0
    if waiting:
        yield joined(waiting)


def _numbers(column: pa.Array) -> np.ndarray:
    return column.fill_null(0.0).to_numpy(zero_copy_only=False)


# --- cube ----------------------------------------------------------------------------------


class Texts:
    """Texts (or cell numbers) of a column, numbered in the order that they are met; a missing one counts too."""

    def __init__(self) -> None:
        self.codes: dict[str | int | None, int] = {}

    def encode(self, column: pa.Array) -> np.ndarray:
        found = column.dictionary_encode(null_encoding="encode")
        known = [self.codes.setdefault(t, len(self.codes)) for t in found.dictionary.to_pylist()]
        return np.asarray(known, np.int64)[found.indices.to_numpy()]

    def decode(self, codes: np.ndarray) -> list[str]:
        texts = [str(t) for t in self.codes]
        return [texts[c] for c in codes]


def cells_of(columns: Sequence[np.ndarray], sizes: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each row, numbered from 0, and one row of each cell."""
    key, bound = np.zeros(len(columns[0]), np.int64), 1
    for codes, size in zip(columns, sizes, strict=True):
        if bound * size >= 2**62:
            key = np.unique(key, return_inverse=True)[1]
            bound = len(key)
        key, bound = key * size + codes, bound * size
    if bound > DENSE:
        _, rows, cells = np.unique(key, return_index=True, return_inverse=True)
        return cells, rows
    row = np.full(bound, -1)
    row[key] = np.arange(len(key))
    met = np.flatnonzero(row >= 0)
    place = np.zeros(bound, np.int64)
    place[met] = np.arange(len(met))
    return place[key], row[met]


def _extremes(cells: np.ndarray, size: int, low: Sequence[np.ndarray], high: Sequence[np.ndarray]) -> list[np.ndarray]:
    found = []
    for function, start, columns in ((np.fmin, np.inf, low), (np.maximum, -np.inf, high)):
        for values in columns:
            out = np.full(size, start)
            function.at(out, cells, values)
            found.append(out)
    return found


def measured_cells(cells: np.ndarray, size: int, new: Sequence[np.ndarray], old: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows and numbers of each cell; co-moments are taken around the cell's own means."""
    add = lambda values: np.bincount(cells, values, size)
    n = np.bincount(cells, minlength=size)
    means = [add(v) / n for v in new]
    x, y = (v - m[cells] for v, m in zip(new, means, strict=True))
    gaps = [add(np.abs(o - v)) / n for o, v in zip(old, new, strict=True)]
    ends = _extremes(cells, size, [*new, *old], [*new, *old])
    return n, np.stack([*means, add(x * x), add(y * y), add(x * y), *gaps, *ends], axis=1)


def merged_cells(cells: np.ndarray, size: int, n: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the same number as one."""
    add = lambda values: np.bincount(cells, values, size)
    total = np.zeros(size, np.int64)
    np.add.at(total, cells, n)
    means = [add(n * m) / total for m in numbers[:, MEANS].T]
    x, y = (m - mean[cells] for m, mean in zip(numbers[:, MEANS].T, means, strict=True))
    moments = [add(m + n * shift) for m, shift in zip(numbers[:, MOMENTS].T, (x * x, y * y, x * y), strict=True)]
    gaps = [add(n * g) / total for g in numbers[:, GAPS].T]
    ends = _extremes(cells, size, list(numbers[:, LOWS].T), list(numbers[:, HIGHS].T))
    return total, np.stack([*means, *moments, *gaps, *ends], axis=1)


class Cube:
    """Category cells of a task."""

    def __init__(self, texts: int, settings: int, parts: int) -> None:
        self.texts, self.settings, self.parts = [Texts() for _ in range(texts)], settings, parts
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, settings: np.ndarray, texts: Sequence[pa.Array], new: Sequence[np.ndarray], old: Sequence[np.ndarray]) -> None:
        codes = [settings, *[known.encode(t) for known, t in zip(self.texts, texts, strict=True)]]
        cells, rows = cells_of(codes, self._sizes())
        keys = np.stack([c[rows] for c in codes], axis=1)
        self._keep(keys, *measured_cells(cells, len(rows), new, old))
        if self.size > KEPT_CELLS:
            self._merge()

    def _sizes(self) -> list[int]:
        return [self.settings, *[max(1, len(t.codes)) for t in self.texts]]

    def _keep(self, keys: np.ndarray, n: np.ndarray, numbers: np.ndarray) -> None:
        self.waiting.append((keys, n, numbers))
        self.size += len(keys)

    def _merge(self) -> None:
        keys, n, numbers = (np.concatenate(parts) for parts in zip(*self.waiting, strict=True))
        cells, rows = cells_of(list(keys.T), self._sizes())
        self.waiting, self.size = [], 0
        self._keep(keys[rows], *merged_cells(cells, len(rows), n, numbers))

    def taken(self) -> Iterator[tuple]:
        """What was found, by setting and part; nothing is held any more."""
        if not self.waiting:
            return
        self._merge()
        (keys, n, numbers), self.waiting, self.size = self.waiting[0], [], 0
        texts = [t.decode(c) for t, c in zip(self.texts, keys[:, 1:].T, strict=True)]
        texts = list(zip(*texts, strict=True))
        part = np.array([zlib.crc32(repr(t).encode()) % self.parts for t in texts])
        place, rows = cells_of([keys[:, 0], part], [self.settings, self.parts])
        for group, row in enumerate(rows):
            some = np.flatnonzero(place == group)
            yield int(keys[row, 0]), CUBE, None, int(part[row]), pickle.dumps(([texts[i] for i in some], n[some], numbers[some]))


def joined_cells(bodies: list[bytes]) -> Iterator[tuple]:
    parts = [pickle.loads(body) for body in bodies]  # noqa: S301  written by ``Cube``
    known: dict[tuple, int] = {}
    cells = np.array([known.setdefault(t, len(known)) for texts, _, _ in parts for t in texts])
    n, numbers = merged_cells(cells, len(known), np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts]))
    for texts, size, values in zip(known, n.tolist(), numbers, strict=True):
        spread = values.copy()
        spread[MOMENTS] /= size
        yield 0, list(texts), [size], spread.tolist()


# --- buckets -------------------------------------------------------------------------------


class Buckets:
    """Counts, sums and bounds of a number's values per setting and bucket."""

    def __init__(self, edges: Sequence[float], settings: int) -> None:
        self.edges, self.width = np.asarray(edges, np.float64), len(edges) + 1
        size = settings * self.width
        self.n, self.sums = np.zeros(size, np.int64), np.zeros(size)
        self.low, self.high = np.full(size, np.inf), np.full(size, -np.inf)

    def add(self, settings: np.ndarray, values: np.ndarray) -> None:
        place = settings * self.width + np.searchsorted(self.edges, values, side="right")
        self.n += np.bincount(place, minlength=len(self.n))
        self.sums += np.bincount(place, values, len(self.n))
        np.fmin.at(self.low, place, values)
        np.maximum.at(self.high, place, values)

    def taken(self, feature: int) -> Iterator[tuple]:
        columns = [c.reshape(-1, self.width) for c in (self.n, self.sums, self.low, self.high)]
        for setting in np.flatnonzero(columns[0].sum(axis=1)):
            met = np.flatnonzero(columns[0][setting])
            yield int(setting), BUCKETS, None, feature, pickle.dumps((met, *[c[setting][met] for c in columns]))


def joined_buckets(bodies: list[bytes], feature: str) -> Iterator[tuple]:
    parts = [pickle.loads(body) for body in bodies]  # noqa: S301  written by ``Buckets``
    bucket, n, sums, low, high = (np.concatenate(c) for c in zip(*parts, strict=True))
    place, rows = cells_of([bucket], [int(bucket.max()) + 1])
    total = np.zeros(len(rows), np.int64)
    np.add.at(total, place, n)
    numbers = np.stack([np.bincount(place, sums, len(rows)), *_extremes(place, len(rows), [low], [high])], axis=1)
    for at, size, values in zip(bucket[rows].tolist(), total.tolist(), numbers.tolist(), strict=True):
        yield at, [feature], [size], values


# --- classes -------------------------------------------------------------------------------


def bits_of(column: pa.Array) -> np.ndarray:
    """Doubles as whole numbers that are equal where Spark groups the values together."""
    values = _numbers(column) + 0.0  # no negative zero
    bits = np.where(np.isnan(values), NAN_BITS, values.view(np.int64))
    return np.where(column.is_null().to_numpy(zero_copy_only=False), NULL_BITS, bits) if column.null_count else bits


def _hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    mixed = first.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (second.view(np.uint64) ^ np.uint64(0x1B873593)) * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ (mixed >> np.uint64(32))


def combined(first: np.ndarray, second: np.ndarray, n: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Equal pairs as one, with their rows and hashes, in the order of the hashes."""
    hashes = _hash(first, second)
    order = np.argsort(hashes)
    a, b, h = first[order], second[order], hashes[order]
    differ = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    if np.any(differ & (h[1:] == h[:-1])):  # two pairs of one hash may stand in turns
        order = np.lexsort((second, first, hashes))
        a, b, h = first[order], second[order], hashes[order]
        differ = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    starts = np.flatnonzero(np.concatenate([[True], differ]))
    if n is None:
        sizes = np.diff(np.append(starts, len(a)))
    else:
        sizes = np.add.reduceat(n[order], starts)
    return a[starts], b[starts], sizes, h[starts]


class Classes:
    """Pairs of masked numbers per setting and category."""

    def __init__(self, settings: int, parts: int) -> None:
        self.settings, self.parts = settings, parts
        self.texts = Texts()
        self.waiting: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        self.size = 0

    def add(self, settings: np.ndarray, category: pa.Array, first: np.ndarray, second: np.ndarray) -> None:
        codes = self.texts.encode(category)
        groups, rows = cells_of([settings, codes], [self.settings, len(self.texts.codes)])
        order = np.argsort(groups.astype(np.uint16) if len(rows) < 2**16 else groups, kind="stable")
        ends = np.cumsum(np.bincount(groups))
        first, second = first[order], second[order]
        for group, (row, end) in enumerate(zip(rows, ends, strict=True)):
            start = ends[group - 1] if group else 0
            self.waiting.setdefault((int(settings[row]), int(codes[row])), []).append((first[start:end], second[start:end]))
        self.size += len(settings)

    def taken(self) -> Iterator[tuple]:
        texts = list(self.texts.codes)
        for (setting, code), pairs in self.waiting.items():
            a, b, n, h = combined(*(np.concatenate(side) for side in zip(*pairs, strict=True)), None)
            part = ((h >> np.uint64(40)) * np.uint64(self.parts)) >> np.uint64(24)
            ends = np.searchsorted(part, np.arange(self.parts, dtype=np.uint64), side="right")
            for number, end in enumerate(ends):
                start = ends[number - 1] if number else 0
                if start < end:
                    yield setting, CLASSES, texts[code], number, _packed(a[start:end], b[start:end], n[start:end])
        self.waiting, self.size = {}, 0


def _packed(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> bytes:
    """Pairs and, where a pair has more than one row, their rows."""
    return np.int64(len(a)).tobytes() + a.tobytes() + b.tobytes() + (n.astype(np.int64).tobytes() if n.max() > 1 else b"")


def _unpacked(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    values = np.frombuffer(body, np.int64)
    size = int(values[0])
    n = values[1 + 2 * size :] if len(values) > 1 + 2 * size else np.ones(size, np.int64)
    return values[1 : 1 + size], values[1 + size : 1 + 2 * size], n


def joined_classes(bodies: list[bytes]) -> Iterator[tuple]:
    """Classes, smallest class and rows of one part."""
    _, _, sizes, _ = combined(*(np.concatenate(c) for c in zip(*map(_unpacked, bodies), strict=True)))
    yield 0, [], [len(sizes), int(sizes.min()), int(sizes.sum())], []


# --- the pass ------------------------------------------------------------------------------


def _sent(rows: Iterable[tuple], first_id: int) -> Iterator[pa.RecordBatch]:
    """Found pieces as batches of some megabytes."""
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.binary()]
    names = ["config_id", "kind", "category", "part", "body"]

    def batch(some: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), kinds, strict=True)], names)

    waiting, size = [], 0
    for setting, *rest in rows:
        waiting.append((setting + first_id, *rest))
        size += len(rest[-1])
        if size > 4_000_000:
            yield batch(waiting)
            waiting, size = [], 0
    if waiting:
        yield batch(waiting)


def counted(
    keys: int, edges: Sequence[Sequence[float]], first_id: int, settings: int, parts: int, classes: Sequence[bool]
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``classes`` tells which of the two numbers and the category are identifiers; empty, no class is counted."""

    def identifier(column: pa.Array, wanted: bool) -> np.ndarray:
        return bits_of(column) if wanted else np.zeros(len(column), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cube, kept = Cube(1 + keys, settings, parts), Classes(settings, parts)
        buckets = [Buckets(e, settings) for e in edges]
        for columns in buffered(batches):
            setting = columns["config_id"].to_numpy().astype(np.int64) - first_id
            new = [_numbers(columns[c]) for c in ("new_0", "new_1")]
            old = [_numbers(columns[c]) for c in ("old_0", "old_1")]
            category = columns["category"]
            cube.add(setting, [category.fill_null(NULL_TEXT), *[columns[f"key_{i}"] for i in range(keys)]], new, old)
            for known, values in zip(buckets, new, strict=True):
                known.add(setting, values)
            if classes:
                first, second = (identifier(columns[f"new_{i}"], classes[i]) for i in (0, 1))
                kept.add(setting, category if classes[2] else pa.nulls(len(setting), pa.string()), first, second)
            if kept.size >= KEPT_ROWS:
                yield from _sent(kept.taken(), first_id)
            if cube.size > KEPT_CELLS:
                yield from _sent(cube.taken(), first_id)
        yield from _sent(kept.taken(), first_id)
        yield from _sent(cube.taken(), first_id)
        for feature, known in enumerate(buckets):
            yield from _sent(known.taken(feature), first_id)

    return run


def joined(features: Sequence[str]) -> Callable[[tuple, pa.Table], pa.Table]:
    schema = pa.schema(
        [
            ("config_id", pa.int32()), ("kind", pa.int32()), ("place", pa.int32()), ("texts", pa.list_(pa.string())),
            ("counts", pa.list_(pa.int64())), ("numbers", pa.list_(pa.float64())),
        ]
    )

    def run(key: tuple, table: pa.Table) -> pa.Table:
        config_id, kind, _, part = (k.as_py() for k in key)
        bodies = table.column("body").to_pylist()
        if kind == CUBE:
            rows = joined_cells(bodies)
        elif kind == BUCKETS:
            rows = joined_buckets(bodies, features[part])
        else:
            rows = joined_classes(bodies)
        columns = list(zip(*rows, strict=True))
        count = len(columns[0])
        arrays = [[config_id] * count, [kind] * count, *columns]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(arrays, schema, strict=True)], schema=schema)

    return run


def pair_identifiers(spec: MaskSpec, identifiers: Sequence[str]) -> bool:
    """Whether the classes of these masked columns can be counted here: no carried column is among them."""
    return bool(identifiers) and set(identifiers) <= {f"m_{c}" for c in spec.maskable}


def tally(
    frame: DataFrame,
    spec: MaskSpec,
    edges: Mapping[str, Sequence[float]],
    identifiers: Sequence[str],
    first_id: int,
    settings: int,
    rows: int,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """Cube, buckets and classes of a masked wide frame, kept once; read by the functions below.

    ``identifiers`` are masked columns. Classes are counted if ``pair_identifiers`` holds for them.
    A frame with ``CELL_NUMBER`` has the number of the original texts in place of the carried ones.
    """
    numbers = list(enumerate(spec.numbers))
    keys = [F.col(CELL_NUMBER)]
    if CELL_NUMBER not in frame.columns:
        keys = [as_text(F.col(c)) for c in (f"o_{spec.category}", *spec.carried)]
    asked = frame.select(
        F.col("config_id").cast("int").alias("config_id"),
        F.col(f"m_{spec.category}").cast("string").alias("category"),
        *[key.alias(f"key_{i}") for i, key in enumerate(keys)],
        *[F.col(f"m_{c}").cast("double").alias(f"new_{i}") for i, c in numbers],
        *[F.col(f"o_{c}").cast("double").alias(f"old_{i}") for i, c in numbers],
    )
    classes = [f"m_{c}" in identifiers for c in (*spec.numbers, spec.category)] if pair_identifiers(spec, identifiers) else []
    run = counted(len(keys), [edges[c] for c in spec.numbers], first_id, settings, bucket_count(rows, part_rows), classes)
    partial = asked.mapInArrow(run, PARTIAL)
    return settle(partial.groupBy("config_id", "kind", "category", "part").applyInArrow(joined(spec.numbers), FOUND))


def cell_numbers(cube: DataFrame, spec: MaskSpec, limit: int = BROADCAST_ROWS) -> DataFrame | None:
    """A number for the texts of each cell of an original cube, kept once; None for a cube beyond ``limit``.

    In place of the texts it makes a masked row shorter wherever it is moved.
    """
    texts = cube.select(F.col(spec.category).alias("old_category"), *spec.carried)
    if texts.limit(limit + 1).count() > limit:
        return None
    return settle(texts.withColumn(CELL_NUMBER, F.monotonically_increasing_id()))


def with_cells(df: DataFrame, spec: MaskSpec, cells: DataFrame) -> DataFrame:
    """A table with ``CELL_NUMBER``; no row is moved."""
    names = {"old_category": spec.category} | {c: c for c in spec.carried}
    return join_summary(df, cells, {name: as_text(F.col(c)) for name, c in names.items()})


def cube_rows(found: DataFrame, spec: MaskSpec, cells: DataFrame | None = None) -> DataFrame:
    """The cells as ``moments.masked_cube`` groups them. ``cells`` tell the texts where the frame had their numbers."""
    rows = _cells(found, spec, ["old_category", *spec.carried] if cells is None else [CELL_NUMBER])
    if cells is None:
        return rows
    # cells: one row per cell of the original cube, at most BROADCAST_ROWS.
    return rows.join(F.broadcast(cells.withColumn(CELL_NUMBER, F.col(CELL_NUMBER).cast("string"))), CELL_NUMBER).drop(CELL_NUMBER)


def _cells(found: DataFrame, spec: MaskSpec, keys: Sequence[str]) -> DataFrame:
    texts = [spec.category, *keys]
    numbers = [
        "number_mean", "flag_mean", "number_var", "flag_var", "cross", "number_gap", "flag_gap",
        "number_min", "flag_min", "old_number_min", "old_flag_min", "number_max", "flag_max", "old_number_max", "old_flag_max",
    ]
    return found.where(F.col("kind") == CUBE).select(
        "config_id",
        *[F.col("texts")[i].alias(c) for i, c in enumerate(texts)],
        F.col("counts")[0].alias("n"),
        *[F.col("numbers")[i].alias(c) for i, c in enumerate(numbers)],
    )


def bucket_rows(found: DataFrame) -> DataFrame:
    """Masked rows, their sum and bounds per setting, feature and bucket."""
    numbers = [F.col("numbers")[i].alias(c) for i, c in enumerate(("s_b", "first_value", "last_value"))]
    return found.where(F.col("kind") == BUCKETS).select(
        "config_id", F.col("texts")[0].alias("feature"), F.col("place").alias("bucket"), F.col("counts")[0].alias("n_b"), *numbers
    )


def class_rows(found: DataFrame) -> DataFrame:
    """Classes, smallest class and rows of each part of a setting."""
    names = ("classes", "smallest", "records")
    return found.where(F.col("kind") == CLASSES).select("config_id", *[F.col("counts")[i].alias(c) for i, c in enumerate(names)])


# --- values of some buckets ------------------------------------------------------------------


def values_of_buckets(
    frame: DataFrame,
    spec: MaskSpec,
    edges: Mapping[str, Sequence[float]],
    wanted: Mapping[tuple[int, str], Sequence[int]],
    first_id: int,
    settings: int,
) -> DataFrame:
    """Masked values of the wanted buckets with their rows: (setting, feature, bucket, value, b).

    ``wanted`` has the buckets of each setting and feature. A value may come from several tasks.
    """
    features = [(i, c, np.asarray(edges[c], np.float64)) for i, c in enumerate(spec.numbers)]
    tables = {c: np.zeros((settings, len(e) + 1), bool) for _, c, e in features}
    for (config_id, feature), buckets in wanted.items():
        tables[feature][config_id - first_id, list(buckets)] = True

    def taken(pieces: dict[str, list]) -> Iterator[pa.RecordBatch]:
        for feature, some in pieces.items():
            if not some:
                continue
            setting, bucket, values = (np.concatenate(c) for c in zip(*some, strict=True))
            if not len(values):
                continue
            order = np.lexsort((values, setting))
            setting, bucket, values = setting[order], bucket[order], values[order]
            differ = (setting[1:] != setting[:-1]) | (values[1:] != values[:-1])
            starts = np.flatnonzero(np.concatenate([[True], differ]))
            n = np.diff(np.append(starts, len(values)))
            columns = [setting[starts] + first_id, [feature] * len(starts), bucket[starts], values[starts], n]
            kinds = [pa.int32(), pa.string(), pa.int32(), pa.float64(), pa.int64()]
            names = ["config_id", "feature", "bucket", "value", "b"]
            whole = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)
            for start in range(0, len(starts), 100_000):
                yield whole.slice(start, 100_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, size = {c: [] for _, c, _ in features}, 0
        for columns in buffered(batches):
            setting = columns["config_id"].to_numpy().astype(np.int64) - first_id
            for i, feature, cuts in features:
                values = _numbers(columns[f"new_{i}"])
                bucket = np.searchsorted(cuts, values, side="right")
                hit = np.flatnonzero(tables[feature][setting, bucket])
                pieces[feature].append((setting[hit], bucket[hit], values[hit] + 0.0))
                size += len(hit)
            if size >= KEPT_ROWS:
                yield from taken(pieces)
                pieces, size = {c: [] for _, c, _ in features}, 0
        yield from taken(pieces)

    some = frame.where(F.col("config_id").isin(sorted({config_id for config_id, _ in wanted})))
    asked = some.select(
        F.col("config_id").cast("int").alias("config_id"),
        *[F.col(f"m_{c}").cast("double").alias(f"new_{i}") for i, c, _ in features],
    )
    return asked.mapInArrow(run, VALUES)
