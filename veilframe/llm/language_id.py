"""Language identification by interpolated Kneser-Ney character models.

Every learned language has a model of its words' characters: a character is predicted from up to
three before it in the word. Counts are gathered over all rows to learn from; the lower orders
count in how many contexts a gram occurs, as Kneser and Ney have it. All grams lie in one sorted
array of hashes with the languages' numbers beside it, so scoring is a binary search. A text gets
the language of the lowest cross-entropy per character.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import Words, batch_of, checkpointed, column_of, map_slices, mix, sampled, slices, words_of

ORDER = 4
BEGIN, END = "\x02", "\x03"
KEEP = 16_384  # longer grams stay that occur at least sqrt(characters of their language) / KEEP times
REMEMBERED = 300_000  # distinct words whose scores a task keeps
CALIBRATION_ROWS = 2000
CALIBRATION_BYTES = 64 << 20
REJECTED_SHARE = 0.001  # of the calibration texts of a language
UNDETERMINED = "und"
SLICE = 1 << 20

NOT_LETTER = np.zeros(256, bool)  # ASCII but a-z; bytes of other characters count as letters
NOT_LETTER[:0x80] = True
NOT_LETTER[0x61:0x7B] = False
_PLACE = mix(np.arange(101, 101 + ORDER, dtype=np.uint64)) | np.uint64(1)


def letter_words(column: pa.Array) -> Words:
    return words_of(pc.utf8_lower(column.cast(pa.large_string())), NOT_LETTER)


def word_text(words: Words, at: np.ndarray) -> list[str]:
    data = words.data.tobytes()
    return [data[a:b].decode("utf-8", "replace") for a, b in zip(words.starts[at].tolist(), words.ends[at].tolist(), strict=True)]


def _code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts with their begin and end marks, and each point's place in its text."""
    marked = [BEGIN + t + END for t in texts]
    codes = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.array([len(t) for t in marked])
    return codes, np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _gram_hashes(codes: np.ndarray, order: int) -> np.ndarray:
    """Hash of the gram of this order that ends at each place (meaningless nearer to a word's begin)."""
    out = np.full(len(codes), order, np.uint64)
    for k in range(min(order, len(codes))):
        out[k:] += codes[: len(codes) - k] * _PLACE[k]
    return mix(out)


def _gram_counts(rows: DataFrame) -> DataFrame:
    """lang, gram, count: the longest gram at each place of each word (its begin mark too), summed in the task first."""

    def emit(totals: dict[tuple[str, str], int]) -> pa.RecordBatch:
        return batch_of(
            lang=pa.array([k[0] for k in totals], pa.string()),
            gram=pa.array([k[1] for k in totals], pa.string()),
            count=pa.array(list(totals.values()), pa.int64()),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[str, str], int] = {}
        for batch in batches:
            texts, langs = column_of(batch, "_text"), column_of(batch, "_lang")
            for low, high in slices(texts, SLICE):
                part, named = texts[low:high], langs[low:high]
                for lang in pc.unique(named).to_pylist():
                    words = letter_words(part.filter(pc.equal(named, lang)))
                    _, first, many = np.unique(words.hashes, return_index=True, return_counts=True)
                    marked = word_text(words, first)
                    codes, place = _code_points(marked)
                    weight = np.repeat(many, np.bincount(np.cumsum(place == 0) - 1, minlength=len(many))) if len(many) else many
                    letters = "".join([BEGIN + t + END for t in marked])
                    for order in range(1, ORDER + 1):
                        at = np.flatnonzero(place >= order - 1 if order == ORDER else place == order - 1)
                        _, where, which = np.unique(_gram_hashes(codes, order)[at], return_index=True, return_inverse=True)
                        sums = np.bincount(which, weight[at]).astype(np.int64) if len(at) else np.zeros(0, np.int64)
                        for e, c in zip(at[where].tolist(), sums.tolist(), strict=True):
                            gram = (lang, letters[e + 1 - order : e + 1])
                            totals[gram] = totals.get(gram, 0) + c
                if len(totals) > 500_000:
                    yield emit(totals)
                    totals = {}
        yield emit(totals)

    counted = rows.mapInArrow(run, "lang string, gram string, count bigint")
    return counted.groupBy("lang", "gram").agg(F.sum("count").alias("count"))


def kneser_ney_counts(rows: DataFrame) -> DataFrame:
    """lang, gram, count, occurrences for all orders: the count is the occurrences of the longest grams, contexts of the others.

    A gram that begins a word has nothing before it, so its occurrences count at any order.
    """
    level = checkpointed(_gram_counts(rows)).withColumn("occurrences", F.col("count"))
    long = level.where(F.char_length("gram") == ORDER)
    result = long
    for order in range(ORDER - 1, 0, -1):
        inner = (
            long.select("lang", F.expr("substring(gram, 2)").alias("gram"), "occurrences")
            .groupBy("lang", "gram")
            .agg(F.count(F.lit(1)).alias("count"), F.sum("occurrences").alias("occurrences"))
        )
        at_begin = level.where((F.char_length("gram") == order) & F.col("gram").startswith(BEGIN))
        long = inner.union(at_begin)
        result = result.union(long)
    return result


def kept_grams(counts: DataFrame) -> DataFrame:
    """lang, gram, count, total (count of all grams of the same context), ones, twos (grams of the order with these counts).

    Each language is pruned by itself, by occurrences: a gram occurs no more often than its context
    and its ending, so both stay with it. What is left out counts in the totals and is backed off.
    The limit grows with the root of a language's characters, so a larger input keeps more.
    """
    size = F.char_length("gram")
    context = F.expr("substring(gram, 1, char_length(gram) - 1)")
    limits = counts.where(size == 1).groupBy("lang").agg(F.floor(F.sqrt(F.sum("occurrences")) / KEEP).alias("least"))
    kinds = counts.where(F.col("gram") != BEGIN).groupBy("lang", size.alias("size"))
    kinds = kinds.agg(F.count_if(F.col("count") == 1).alias("ones"), F.count_if(F.col("count") == 2).alias("twos"))
    totals = counts.where(size > 1).groupBy("lang", context.alias("context")).agg(F.sum("count").alias("total"))
    kept = counts.join(F.broadcast(limits), "lang").where((size <= 2) | (F.col("occurrences") >= F.col("least")))
    kept = kept.withColumn("size", size).withColumn("context", context).join(F.broadcast(kinds), ["lang", "size"], "left")
    return kept.join(totals, ["lang", "context"], "left").select("lang", "gram", "count", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "ones", "twos")])


@dataclass
class LanguageModel:
    """Sorted gram hashes with, for each language, the discounted share and the weight of backing off."""

    langs: list[str]
    hashes: np.ndarray
    share: np.ndarray  # (grams, languages)
    back: np.ndarray  # (grams, languages): as a context
    base: np.ndarray  # weight of the uniform distribution before any gram
    sharpness: float = 1.0
    limits: dict[str, float] = field(default_factory=dict)  # rejected above this cross-entropy
    known: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    known_scores: np.ndarray | None = None

    def word_scores(self, texts: list[str]) -> np.ndarray:
        """Negative log-likelihood of each word under each language."""
        codes, place = _code_points(texts)
        probability = np.tile(self.base.astype(np.float64), (len(codes), 1))
        before = np.full(len(codes), -1)
        for order in range(1, ORDER + 1):
            hashes = _gram_hashes(codes, order)
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            found = (self.hashes[at] == hashes) & (place >= order - 1)
            if order > 1:
                # The context is the gram of one order less that ends one place before.
                context = np.concatenate([[-1], before[:-1]])
                usable = np.flatnonzero((context >= 0) & (place >= order - 1))
                probability[usable] *= self.back[context[usable]]
            probability[found] += self.share[at[found]]
            before = np.where(found, at, -1)
        surprise = -np.log(np.maximum(probability, 1e-12))
        surprise[place == 0] = 0
        return np.add.reduceat(surprise, np.flatnonzero(place == 0), axis=0) if len(texts) else np.zeros((0, len(self.langs)))

    def _scores_of(self, words: Words) -> np.ndarray:
        """Scores of all words of a slice, each distinct word once, remembered between slices."""
        hashes, first, which = np.unique(words.hashes, return_index=True, return_inverse=True)
        scores = np.zeros((len(hashes), len(self.langs)), np.float32)
        have = np.zeros(len(hashes), bool)
        if self.known_scores is not None and len(self.known):
            at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
            have = self.known[at] == hashes
            scores[have] = self.known_scores[at[have]]
        new = np.flatnonzero(~have)
        for low in range(0, len(new), 20_000):
            part = new[low : low + 20_000]
            scores[part] = self.word_scores(word_text(words, first[part]))
        if len(self.known) + len(new) > REMEMBERED or self.known_scores is None:
            self.known, self.known_scores = hashes, scores
        elif len(new):
            every = np.concatenate([self.known, hashes[new]])
            order = np.argsort(every, kind="stable")
            self.known, self.known_scores = every[order], np.concatenate([self.known_scores, scores[new]])[order]
        return scores[which]

    def cross_entropies(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character of each text under each language, and whether it has a letter."""
        words = letter_words(column)
        n = len(column)
        total = np.zeros((n, len(self.langs)))
        size = np.zeros(n)
        if len(words.starts):
            row = words.row_of_word()
            scores = self._scores_of(words)
            for k in range(len(self.langs)):
                total[:, k] = np.bincount(row, scores[:, k], n)
            lead = words.data & 0xC0  # continuation bytes are not characters
            points = np.concatenate([[0], np.cumsum(lead != 0x80)])
            size = np.bincount(row, points[words.ends] - points[words.starts] + 1, n)
        return total / np.maximum(size, 1)[:, None], size > 0

    def predict(self, column: pa.Array, reject: bool) -> tuple[list[str], np.ndarray]:
        """Language and confidence of each text."""
        entropies, any_word = self.cross_entropies(column)
        if not self.langs:
            return [UNDETERMINED] * len(column), np.zeros(len(column))
        letters = any_word & _has_letter(column, any_word)
        best = entropies.argmin(axis=1)
        gap = np.exp(-self.sharpness * (entropies - entropies.min(axis=1, keepdims=True)))
        confidence = np.where(letters, 1 / gap.sum(axis=1), 0.0)
        names = [self.langs[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
        if reject:
            low = entropies.min(axis=1)
            for k, name in enumerate(names):
                if letters[k] and low[k] > self.limits.get(name, np.inf):
                    names[k], confidence[k] = UNDETERMINED, 0.0
        return names, confidence


def _has_letter(column: pa.Array, maybe: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script; only texts without a-z are looked at closely."""
    plain = pc.fill_null(pc.match_substring_regex(column.cast(pa.large_string()), "[A-Za-z]"), False).to_numpy(zero_copy_only=False)
    for k in np.flatnonzero(maybe & ~plain).tolist():
        plain[k] = any(c.isalpha() for c in column[k].as_py())
    return plain


def _assemble(langs: list[str], table: dict[str, np.ndarray]) -> LanguageModel:
    """Probabilities from the counts: discounted shares, and what is left to the lower order."""
    grams, number, counts = table["gram"], table["lang"], table["count"]
    texts, which = np.unique(grams, return_inverse=True)
    sizes = np.char.str_len(texts)
    share = np.zeros((len(texts), len(langs)), np.float32)
    back = np.ones((len(texts), len(langs)), np.float32)
    base = np.full(len(langs), 1.0)
    hashes = np.zeros(len(texts), np.uint64)
    for order in range(1, ORDER + 1):
        at = np.flatnonzero(sizes == order)
        if len(at):
            codes = np.frombuffer("".join(texts[at].tolist()).encode("utf-32-le"), np.uint32).astype(np.uint64)
            hashes[at] = _gram_hashes(codes, order)[order - 1 :: order]
        alphabet = max(2, len(at)) if order == 1 else 0
        for k in range(len(langs)):
            own = np.flatnonzero((number == k) & (sizes[which] == order))
            if order == 1:
                own = own[texts[which[own]] != BEGIN]  # never predicted, only a context
            if not len(own):
                continue
            gram, count = which[own], counts[own].astype(np.float64)
            ones, twos = int(table["ones"][own[0]]), int(table["twos"][own[0]])
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            if order == 1:
                share[gram, k] = (count - discount) / count.sum()
                base[k] = discount * len(own) / count.sum() / alphabet
                continue
            parent = np.searchsorted(texts, texts[gram].astype(f"U{order - 1}"))  # contexts are always kept
            of_context = (count - discount) / table["total"][own]
            share[gram, k] = of_context
            held = np.unique(parent)
            back[held, k] = 1 - np.bincount(parent, of_context, len(texts))[held]
    order = np.argsort(hashes)
    return LanguageModel(langs, hashes[order], share[order], back[order], np.maximum(base, 1e-9))


def fit(
    docs: DataFrame,
    allowed: Column,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    calibration_rows: int = CALIBRATION_ROWS,
) -> LanguageModel:
    """Models of all languages named in the rows that ``allowed`` admits; null languages and texts are left out.

    Counts cover all these rows, and ``kept_grams`` says which ones the model holds. Confidence and
    rejection limits are set on the ``calibration_rows`` rows with the smallest hashes, repeated ones once.
    """
    rows = docs.where(allowed & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        docs[key].alias("_key"), docs[text].alias("_text"), docs[lang].alias("_lang")
    )
    table = kept_grams(checkpointed(kneser_ney_counts(rows.select("_text", "_lang")))).toArrow()
    langs = sorted(set(table["lang"].to_pylist()))
    number = {name: k for k, name in enumerate(langs)}
    if not langs:
        return LanguageModel([], np.zeros(1, np.uint64), np.zeros((1, 0)), np.ones((1, 0)), np.zeros(0))
    model = _assemble(
        langs,
        {
            "gram": np.array(table["gram"].to_pylist(), dtype=object).astype(str),
            "lang": np.array([number[x] for x in table["lang"].to_pylist()]),
            **{c: table[c].to_numpy() for c in ("count", "total", "ones", "twos")},
        },
    )
    shared = docs.sparkSession.sparkContext.broadcast(model)
    ids = rows.where("_key is not null").groupBy("_key", F.xxhash64("_text").alias("_print"), "_lang").agg(F.max(F.octet_length("_text")).alias("_bytes"))

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        entropies, letters = shared.value.cross_entropies(column_of(batch, "_text"))
        return batch_of(
            lang=column_of(batch, "_lang"), letters=letters, entropies=pa.array(entropies.tolist(), pa.list_(pa.float64()))
        )

    chosen = sampled(rows.select("_key", "_text"), ids, calibration_rows, CALIBRATION_BYTES)
    measured = map_slices(chosen, "_text", measure, "lang string, letters boolean, entropies array<double>", SLICE).where("letters").collect()
    if measured:
        entropies = np.array([r["entropies"] for r in measured])
        truth = np.array([number[r["lang"]] for r in measured])
        every = np.arange(len(truth))
        losses = {}
        for sharpness in (1, 2, 4, 8, 16, 32, 64):
            x = -sharpness * entropies
            x -= x.max(axis=1, keepdims=True)
            losses[sharpness] = -np.mean(x[every, truth] - np.log(np.exp(x).sum(axis=1)))
        model.sharpness = float(min(losses, key=losses.get))
        own = entropies[every, truth]
        model.limits = {name: float(np.quantile(own[truth == k], 1 - REJECTED_SHARE)) * 1.1 for k, name in enumerate(langs) if (truth == k).any()}
    shared.unpersist()
    return model


def identify(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text", reject: bool = False) -> DataFrame:
    """key, lang_pred, score (confidence, 0 to 1) of every row.

    A null text or one without a letter is ``und`` with score 0; with ``reject``, so is a text whose
    cross-entropy is above its language's limit. Ties go to the first language by name. Rows are
    judged each by itself; a null key stays null. Other columns are not looked at.
    """
    kind = docs.select(key).schema[0].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, confidence = shared.value.predict(column_of(batch, "_text"), reject)
        return batch_of(_key=column_of(batch, "_key"), lang_pred=pa.array(names, pa.string()), score=pa.array(confidence, pa.float64()))

    rows = docs.select(docs[key].alias("_key"), docs[text].alias("_text"))
    return map_slices(rows, "_text", run, f"_key {kind}, lang_pred string, score double", SLICE).withColumnRenamed("_key", key)
