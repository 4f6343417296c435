"""Corpus slices: texts cut into bounded pieces of work whose words are coded as whole numbers.

A slice is what one task holds at a time, some megabytes of whole texts. Its words are exact
strings (no hashes) with codes in order of first occurrence. Coded slices are small, so they are
kept as rows of a table and later meet messages that other tasks send them, joined on the slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext

from veilframe.llm.common import LOWER, SPACES, bytes_of, column_of, slices, word_edges

CORPUS_SLICE_BYTES = 16 << 20


def corpus_slices(batches: Iterator[pa.RecordBatch], text: str, size: int = CORPUS_SLICE_BYTES) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Numbered slices of about ``size`` bytes of text: large batches are cut, small ones joined."""
    number = TaskContext.get().partitionId() << 32
    waiting, held = [], 0
    for batch in batches:
        column = column_of(batch, text)
        for low, high in slices(column, size):
            waiting.append(batch.slice(low, high - low))
            held += waiting[-1].nbytes
            if held >= size:
                yield number, _joined(waiting)
                number, waiting, held = number + 1, [], 0
    if waiting:
        yield number, _joined(waiting)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.concat_batches(batches)


@dataclass
class CodedWords:
    """Words of a slice: ``codes`` index ``vocabulary``; row k has the words rows[k]:rows[k + 1]."""

    codes: np.ndarray
    vocabulary: pa.Array
    rows: np.ndarray
    starts: np.ndarray
    data: np.ndarray

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))


def coded_words(column: pa.Array, separators: np.ndarray = SPACES, inner: np.ndarray | None = None) -> CodedWords:
    """Lower-cased (A-Z) words between ASCII separators, null texts as empty.

    With ``inner``, bytes outside it are stripped from both ends of each word; words of nothing else go.
    """
    raw, at = bytes_of(column)
    data = LOWER[raw]
    inside, starts, ends = word_edges(data, at, separators)
    if inner is not None and len(starts):
        solid = np.append(np.flatnonzero(inner[data]), len(data))
        starts = solid[np.searchsorted(solid, starts)]
        left = starts < ends
        starts, ends = starts[left], ends[left]
        ends = solid[np.searchsorted(solid, ends) - 1] + 1
        change = np.zeros(len(data) + 1, np.int8)
        change[starts] += 1
        change[ends] -= 1
        inside = np.cumsum(change[:-1], dtype=np.int8).astype(bool)
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    strings = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[inside]))
    coded = strings.dictionary_encode()
    return CodedWords(coded.indices.to_numpy().astype(np.int64), coded.dictionary, np.searchsorted(starts, at), starts, data)


def packed(values: np.ndarray) -> bytes:
    """Whole numbers >= 0 as compressed byte planes."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, : data[0]] = planes.T
    return wide.view("<u8").reshape(-1).astype(np.int64)
