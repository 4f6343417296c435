"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as an embedding of the word (one row per word that the fitting sample repeats, one
row for all others) beside the mean embedding of its character trigrams. Two gated recurrent
layers read a window of words in both directions, attention pools them, and a logistic unit
scores the window. All overlapping windows of a whole text are scored; the document's score is
a calibrated function of its highest window.

Labels are per document, so the windows to learn from are chosen by evidence: the words whose
presence sets labelled documents apart mark the positive windows, and positive documents that
hold none of them teach nothing. Fitting takes a bounded sample of labelled rows; scoring reads
every text in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import (
    NOT_ALNUM, CodedTexts, Words, batch_of, column_of, give_back_memory, map_slices, mix, ranges, row_groups, sampled, slices, window_hashes, words_of,
)

WINDOW, STRIDE = 24, 12  # a phrase of up to 13 words is whole in some window
WORD_SIZE, CHAR_SIZE, HIDDEN = 8, 8, 8
CHAR_ROWS = 1 << 13
FIT_ROWS = 4000  # labelled documents in the fitting sample
FIT_BYTES = 16 << 20  # of their texts
MAX_VOCABULARY = 60_000
STEPS, BATCH, RATE = 700, 256, 0.01
BATCH_WINDOWS = 2048
BATCH_ROWS_WORDS = 1 << 15  # words of the rows whose windows are scored at a time
BATCH_WORDS = 1 << 14  # distinct words whose characters are read at a time
SLICE = 2 << 20
CUT = 0.7


@dataclass
class UniqueWords:
    """Distinct words of a slice: vocabulary rows and character trigram rows."""

    of_word: np.ndarray  # for each word of the slice, its distinct word
    hashes: np.ndarray
    rows: np.ndarray
    grams: np.ndarray
    gram_begins: np.ndarray

    @classmethod
    def of(cls, words: Words, vocabulary: np.ndarray) -> UniqueWords:
        hashes, first, of_word = np.unique(words.hashes, return_index=True, return_inverse=True)
        return cls.spelled(of_word, hashes, words.data, words.starts[first], words.ends[first], vocabulary)

    @classmethod
    def spelled(cls, of_word: np.ndarray, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, vocabulary: np.ndarray) -> UniqueWords:
        sizes = ends - starts
        begins = np.cumsum(sizes) - sizes
        grams = np.zeros(int(sizes.sum()), np.uint16)
        for low in range(0, len(hashes), BATCH_WORDS):
            part = slice(low, low + BATCH_WORDS)
            here = data[ranges(starts[part], sizes[part])].astype(np.uint64)
            before, after = np.zeros_like(here), np.zeros_like(here)
            before[1:], after[:-1] = here[:-1], here[1:]
            first = begins[part] - begins[low]
            before[first], after[first + sizes[part] - 1] = 0, 0
            mixed = mix(before << np.uint64(16) | here << np.uint64(8) | after) % np.uint64(CHAR_ROWS)
            grams[begins[low] : begins[low] + len(here)] = mixed
        if len(vocabulary):
            place = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
            rows = np.where(vocabulary[place] == hashes, place + 1, 0)
        else:
            rows = np.zeros(len(hashes), np.int64)
        return cls(of_word, hashes, rows, grams, begins)


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters, scoring and gradients of the window network."""

    def __init__(self, words: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        size, h = WORD_SIZE + CHAR_SIZE, HIDDEN

        def normal(*shape: int, scale: float) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        self.p = {
            "word": normal(words + 1, WORD_SIZE, scale=0.3),
            "char": normal(CHAR_ROWS, CHAR_SIZE, scale=0.5),
            "input": normal(size, 6 * h, scale=size**-0.5),
            "bias": np.zeros(6 * h, np.float32),
            "forward": normal(h, 3 * h, scale=h**-0.5),
            "backward": normal(h, 3 * h, scale=h**-0.5),
            "attend": normal(2 * h, scale=0.3),
            "out": normal(2 * h, scale=0.5),
            "shift": np.full(1, -2, np.float32),
        }

    def vectors(self, rows: np.ndarray, grams: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Input vectors of distinct words."""
        if not len(rows):
            return np.zeros((0, WORD_SIZE + CHAR_SIZE), np.float32)
        edges = np.append(begins, len(grams))
        out = np.empty((len(rows), WORD_SIZE + CHAR_SIZE), np.float32)
        for low in range(0, len(rows), BATCH_WORDS):
            high = min(low + BATCH_WORDS, len(rows))
            sizes = np.diff(edges[low : high + 1])[:, None].astype(np.float32)
            char = self.p["char"][grams[edges[low] : edges[high]]]
            out[low:high, WORD_SIZE:] = np.add.reduceat(char, begins[low:high] - begins[low], axis=0) / sizes
            out[low:high, :WORD_SIZE] = self.p["word"][rows[low:high]]
        return out

    def gates(self, vectors: np.ndarray) -> list[np.ndarray]:
        """Each word's share of the gates: update and reset, then candidate, of both directions."""
        h = HIDDEN
        table = vectors @ self.p["input"] + self.p["bias"]
        return [np.ascontiguousarray(table[:, a:b]) for a, b in ((0, 2 * h), (2 * h, 3 * h), (3 * h, 5 * h), (5 * h, 6 * h))]

    def _layer(self, gates: list[np.ndarray], places: np.ndarray, weights: np.ndarray, backwards: bool, keep: list | None) -> np.ndarray:
        """Hidden states (places, windows, hidden) of one direction."""
        of_gates, of_candidate = np.ascontiguousarray(weights[:, : 2 * HIDDEN]), np.ascontiguousarray(weights[:, 2 * HIDDEN :])
        length, n = places.shape
        h = np.zeros((n, HIDDEN), np.float32)
        out = np.empty((length, n, HIDDEN), np.float32)
        for t in reversed(range(length)) if backwards else range(length):
            zr = h @ of_gates
            zr += gates[0][places[t]]
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            y = h @ of_candidate
            c = r * y
            c += gates[1][places[t]]
            np.tanh(c, out=c)
            if keep is not None:
                keep.append((t, z, r, c, y, h))
            np.subtract(h, c, out=out[t])
            h = out[t]
            h *= z
            h += c
        return out

    def logits(self, gates: list[np.ndarray], places: np.ndarray, real: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Window logits. ``places`` and ``real`` are (places, windows); places without a word are not attended to."""
        p = self.p
        kept: tuple[list, list] = ([], [])
        sides = [
            self._layer(gates[2 * k : 2 * k + 2], places, p[name], bool(k), kept[k] if keep is not None else None)
            for k, name in enumerate(("forward", "backward"))
        ]
        weight = sides[0] @ p["attend"][:HIDDEN] + sides[1] @ p["attend"][HIDDEN:]
        weight[~real] = -1e9
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.concatenate([(weight[:, :, None] * side).sum(axis=0) for side in sides], axis=1)
        if keep is not None:
            keep.update(states=np.concatenate(sides, axis=2), weight=weight, pooled=pooled, kept=kept)
        return pooled @ p["out"] + p["shift"][0]

    def gradients(self, vectors: np.ndarray, places: np.ndarray, real: np.ndarray, target: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the mean log loss, and those of the input vectors."""
        p, keep, h3 = self.p, {}, 3 * HIDDEN
        logit = self.logits(self.gates(vectors), places, real, keep)
        d_logit = ((_squash(logit) - target) / len(target)).astype(np.float32)
        states, attention, pooled = keep["states"], keep["weight"], keep["pooled"]
        g = {"out": pooled.T @ d_logit, "shift": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * p["out"]
        d_states = attention[:, :, None] * d_pooled
        d_weight = np.einsum("tnh,nh->tn", states, d_pooled)
        d_score = attention * (d_weight - (attention * d_weight).sum(axis=0))
        g["attend"] = np.einsum("tn,tnh->h", d_score, states)
        d_states += d_score[:, :, None] * p["attend"]
        d_gates = np.zeros((*places.shape, 6 * HIDDEN), np.float32)
        for k, name in enumerate(("forward", "backward")):
            d_h = np.zeros((len(target), HIDDEN), np.float32)
            g[name] = np.zeros_like(p[name])
            for t, z, r, c, y, h in reversed(keep["kept"][k]):
                d_h = d_h + d_states[t, :, k * HIDDEN : (k + 1) * HIDDEN]
                d_z = d_h * (h - c) * z * (1 - z)
                d_c = d_h * (1 - z) * (1 - c * c)
                d_r = d_c * y * r * (1 - r)
                d_gates[t, :, k * h3 : (k + 1) * h3] = np.concatenate([d_z, d_r, d_c], axis=1)
                d_y = np.concatenate([d_z, d_r, d_c * r], axis=1)
                g[name] += h.T @ d_y
                d_h = d_h * z + d_y @ p[name].T
        d_table = np.zeros((len(vectors), 6 * HIDDEN), np.float32)
        np.add.at(d_table, places.reshape(-1), d_gates.reshape(-1, 6 * HIDDEN))
        g["bias"] = d_table.sum(axis=0)
        g["input"] = vectors.T @ d_table
        return g, d_table @ p["input"].T


@dataclass
class ToxicityModel:
    vocabulary: np.ndarray
    network: Network
    slope: float
    shift: float

    def window_logits(self, words: Words | CodedTexts) -> tuple[np.ndarray, np.ndarray]:
        """Logit of every window of every row, and the rows they belong to; rows are read some at a time."""
        found = [(self._row_logits(words.some_rows(a, b)), a) for a, b in row_groups(words.rows, BATCH_ROWS_WORDS)]
        if not found:
            return np.zeros(0, np.float32), np.zeros(0, np.int64)
        return np.concatenate([logits for (logits, _), _ in found]), np.concatenate([row + a for (_, row), a in found])

    def _row_logits(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        unique = UniqueWords.of(words, self.vocabulary)
        vectors = self.network.vectors(unique.rows, unique.grams, unique.gram_begins)
        # The last row stands for places beyond the text.
        table = self.network.gates(np.concatenate([vectors, np.zeros((1, vectors.shape[1]), np.float32)]))
        starts, row = windows(words)
        logits = np.empty(len(starts), np.float32)
        end = words.rows[row + 1]
        for low in range(0, len(starts), BATCH_WINDOWS):
            part = slice(low, low + BATCH_WINDOWS)
            at = starts[part] + np.arange(WINDOW)[:, None]
            real = at < end[part]
            places = np.where(real, unique.of_word[np.minimum(at, len(words.hashes) - 1)], len(unique.rows))
            logits[part] = self.network.logits(table, places, real)
        return logits, row

    def highest(self, column: pa.Array) -> np.ndarray:
        """Highest window logit of each text; a text without words has none (-inf)."""
        words = words_of(column, NOT_ALNUM)
        best = np.full(len(column), -np.inf)
        if len(words.starts):
            logits, row = self.window_logits(words)
            np.maximum.at(best, row, logits.astype(np.float64))
        return best

    def scores(self, column: pa.Array) -> np.ndarray:
        """Calibrated probability of the label; 0 for a text without words."""
        best = self.highest(column)
        return np.where(np.isinf(best), 0.0, _squash(self.slope * np.clip(best, -15, 15) + self.shift))


def windows(words: Words | CodedTexts) -> tuple[np.ndarray, np.ndarray]:
    """First words of the overlapping windows of all rows, and the rows; the last words of a row are in some window."""
    counts = np.diff(words.rows)
    many = np.where(counts > 0, np.maximum(-(-(counts - WINDOW) // STRIDE), 0) + 1, 0)
    row = np.repeat(np.arange(len(counts)), many)
    number = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    return words.rows[row] + number * STRIDE, row


def _distinct_rows(texts: CodedTexts, slots: int = 12, shared: int = 3) -> np.ndarray:
    """Marks the first row of each family of near copies: rows that share few least shingle hashes with earlier ones."""
    distinct = np.ones(len(texts.rows) - 1, bool)
    seen: list[set[int]] = [set() for _ in range(slots)]
    for a, b in row_groups(texts.rows, BATCH_ROWS_WORDS):
        words = texts.some_rows(a, b)
        long = np.flatnonzero(np.diff(words.rows) >= 5)
        if not len(long):
            continue
        at = np.flatnonzero(words.left_in_row() >= 5)
        shingles = window_hashes(words.hashes, 5)[at]
        begins = np.searchsorted(at, words.rows[long])
        least = np.stack([np.minimum.reduceat(mix(shingles + np.uint64(k)), begins) for k in range(slots)], axis=1)
        for row, values in zip((long + a).tolist(), least.tolist(), strict=True):
            if sum(v in s for v, s in zip(values, seen, strict=True)) >= shared:
                distinct[row] = False
            else:
                for v, s in zip(values, seen, strict=True):
                    s.add(v)
    return distinct


def _presence(texts: CodedTexts, labels: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each distinct word, the numbers of positive and of negative rows (of those marked) that hold it."""
    held = np.zeros((2, len(texts.hashes)))
    for a, b in row_groups(texts.rows, BATCH_ROWS_WORDS):
        row = np.repeat(np.arange(a, b), np.diff(texts.rows[a : b + 1]))
        used = rows[row]
        pairs = np.unique(row[used] * len(texts.hashes) + texts.codes[texts.rows[a] : texts.rows[b]][used])
        word, positive = pairs % len(texts.hashes), labels[pairs // len(texts.hashes)] == 1
        held[0] += np.bincount(word, positive, len(texts.hashes))
        held[1] += np.bincount(word, ~positive, len(texts.hashes))
    return held


def _calibrate(best: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve from highest window logit to label, by damped Newton steps."""
    x = np.stack([best, np.ones(len(best))], axis=1)
    prior = np.array([1.0, 0.0])

    def loss(theta: np.ndarray) -> float:
        z = x @ theta
        return float(np.sum(np.logaddexp(0, z) - labels * z) + 0.5 * np.sum((theta - prior) ** 2))

    theta = prior
    for _ in range(60):
        p = _squash(x @ theta)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(2), x.T @ (p - labels) + (theta - prior))
        size = 1.0
        while size > 1e-4 and loss(theta - size * step) > loss(theta):
            size /= 2
        theta = theta - size * step
    return float(max(theta[0], 0.05)), float(theta[1])


def fit(texts: list[str], labels: np.ndarray, steps: int = STEPS, seed: int = 7) -> ToxicityModel:
    """Train on whole labelled texts. Without both labels, every text scores the share of label 1."""
    labels = np.asarray(labels)
    if not len(labels) or labels.min() == labels.max():
        share = float(labels.mean()) if len(labels) else 0.0
        return ToxicityModel(np.zeros(0, np.uint64), Network(0), 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    words = CodedTexts.of(pa.array(texts, pa.string()), NOT_ALNUM)
    distinct = _distinct_rows(words)
    hashes, (in_positive, in_negative) = words.hashes, _presence(words, labels, distinct)
    repeated = np.flatnonzero(in_positive + in_negative >= 2)
    if len(repeated) > MAX_VOCABULARY:
        commonest = np.argsort(-(in_positive + in_negative)[repeated], kind="stable")[:MAX_VOCABULARY]
        repeated = np.sort(repeated[commonest])
    vocabulary = hashes[repeated]
    # Evidence: a word stands in positive documents more often than the best of so many words would by chance.
    prior = float(np.clip(labels[distinct].mean(), 0.01, 0.99))
    holding = in_positive + in_negative
    surplus = (in_positive - holding * prior) / np.sqrt(np.maximum(holding, 1) * prior * (1 - prior))
    beyond_chance = np.sqrt(2 * np.log(max(len(repeated), 2))) + 1
    evident = hashes[(surplus > beyond_chance) & (in_positive > 4 * in_negative)]
    if not len(evident):
        evident = hashes[np.argsort(-surplus, kind="stable")[:10]]
    starts, row = windows(words)
    end = words.rows[row + 1]
    mark = np.append(0, np.cumsum(np.isin(hashes, evident)[words.codes], dtype=np.int32))
    marked = mark[np.minimum(starts + WINDOW, end)] > mark[starts]
    positive = np.flatnonzero(marked & (labels[row] == 1))
    negative = np.flatnonzero(labels[row] == 0)
    if not len(positive) or not len(negative):
        positive, negative = np.flatnonzero(labels[row] == 1), np.flatnonzero(labels[row] == 0)
    unique = UniqueWords.spelled(words.codes, hashes, words.data, words.starts, words.ends, vocabulary)
    network = Network(len(vocabulary), seed)
    model = ToxicityModel(vocabulary, network, 1.0, 0.0)
    rng = np.random.default_rng(seed)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in network.p.items()}
    gram_sizes = np.diff(np.append(unique.gram_begins, len(unique.grams)))
    hard = negative
    for step in range(steps):
        if step and step == steps // 2:  # the negative windows that still score high come up more often
            logits, _ = model.window_logits(words)
            hard = negative[np.argsort(-logits[negative], kind="stable")[: max(256, len(negative) // 50)]]
        picked = np.concatenate(
            [rng.choice(positive, BATCH // 4), rng.choice(negative, BATCH // 2), rng.choice(hard, BATCH // 4)]
        )
        target = np.repeat([1.0, 0.0], [BATCH // 4, BATCH - BATCH // 4]).astype(np.float32)
        at = starts[picked] + np.arange(WINDOW)[:, None]
        real = at < end[picked]
        used, places = np.unique(unique.of_word[np.where(real, at, starts[picked])], return_inverse=True)
        places = places.reshape(at.shape)
        rows = np.where(rng.random(len(used)) < 0.1, 0, unique.rows[used])  # some words act as unknown ones
        grams = unique.grams[ranges(unique.gram_begins[used], gram_sizes[used])]
        begins = np.cumsum(gram_sizes[used]) - gram_sizes[used]
        vectors = network.vectors(rows, grams, begins)
        g, d_vectors = network.gradients(vectors, places, real, target)
        g["word"], g["char"] = np.zeros_like(network.p["word"]), np.zeros_like(network.p["char"])
        np.add.at(g["word"], rows, d_vectors[:, :WORD_SIZE])
        spread = np.repeat(d_vectors[:, WORD_SIZE:] / gram_sizes[used][:, None], gram_sizes[used], axis=0)
        np.add.at(g["char"], grams, spread.astype(np.float32))
        rate = RATE * (1 - step / steps) + 1e-4
        for name, value in network.p.items():
            first, second = moments[name]
            first += 0.1 * (g[name] - first)
            second += 0.01 * (g[name] ** 2 - second)
            value -= rate * (first / (1 - 0.9 ** (step + 1))) / (np.sqrt(second / (1 - 0.99 ** (step + 1))) + 1e-6)
    logits, _ = model.window_logits(words)
    best = np.full(len(labels), -np.inf)
    np.maximum.at(best, row, logits.astype(np.float64))
    used = distinct & ~np.isinf(best)
    model.slope, model.shift = _calibrate(np.clip(best[used], -15, 15), labels[used])
    del words, unique, mark, logits, moments
    give_back_memory()  # the driver has other things to hold than what fitting took
    return model


def fit_sample(
    docs: DataFrame, labels: DataFrame, allowed: Column, key: str = "doc_id", text: str = "text", label: str = "toxic", fit_rows: int = FIT_ROWS
) -> tuple[list[str], np.ndarray]:
    """Texts and labels of at most ``fit_rows`` labelled documents that ``allowed`` (on the labels table) admits.

    Rows that repeat key and text count once. The sample is the rows with the smallest hashes, so it
    does not depend on the partitioning; their texts are whole, at most FIT_BYTES in all.
    """
    labelled = labels.where(allowed & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("_key")).agg(F.max(F.col(label).cast("int")).alias("_label"))
    rows = docs.select(docs[key].alias("_key"), F.coalesce(docs[text], F.lit("")).alias("_text"))
    ids = rows.select("_key", F.xxhash64("_text").alias("_print"), F.octet_length("_text").alias("_bytes"))
    ids = ids.groupBy("_key", "_print").agg(F.max("_bytes").alias("_bytes")).join(labelled, "_key")
    found = sorted(sampled(rows, ids, fit_rows, FIT_BYTES).collect(), key=lambda r: (r["_key"], r["_text"]))
    return [r["_text"] for r in found], np.array([r["_label"] for r in found], np.int64)


def toxicity(docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text", cut: float = CUT) -> DataFrame:
    """key, score (0 to 1) and predicted (score >= ``cut``) of every row.

    A null, empty or wordless text scores 0. Rows are scored each by itself, repeated ones alike;
    a null key stays null. Other columns are not looked at.
    """
    kind = docs.select(key).schema[0].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch_of(_key=column_of(batch, "_key"), score=pa.array(shared.value.scores(column_of(batch, "_text")), pa.float64()))

    rows = docs.select(docs[key].alias("_key"), docs[text].alias("_text"))
    scored = map_slices(rows, "_text", run, f"_key {kind}, score double", SLICE)
    return scored.select(F.col("_key").alias(key), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: ToxicityModel, text: str = "text", cut: float = CUT) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below ``cut``; null and empty texts stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = column_of(batch, text)
            keep = [shared.value.scores(column[low:high]) < cut for low, high in slices(column, SLICE)]
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, docs.schema)
