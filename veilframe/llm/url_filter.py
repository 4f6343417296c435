"""URL filter: list rules first, then the likelihood ratio of two character models.

The longest fitting rule of a list decides. All other URLs are judged by two variable-order
Markov models over the characters of host and path, one of accepted and one of rejected URLs:
the context is the longest one that the counts hold, smoothed by all shorter ones (Witten-Bell).
A URL's log-likelihood difference per character is compared with a threshold that is calibrated
on labelled URLs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import batch_of, checkpointed, column_of, map_slices, mix

ORDER = 6  # longest gram: five characters of context
KEEP = 4096  # longer grams stay that occur at least sqrt(characters) / KEEP times in the URLs of either label
MIN_COUNT = 2  # of grams longer than two characters
SCORE_STEPS = 1 << 16  # of a score, in the counts that the threshold is picked from
BEGIN, END = "\x02", "\x03"
_PLACE = mix(np.arange(201, 201 + ORDER, dtype=np.uint64)) | np.uint64(1)

# Parts of host names that mark a URL as a rejected example.
REJECTED_HOST_WORDS = ("bets", "casino", "escort", "lottery", "pills", "poker", "porn", "replica", "viagra", "xxx")


@dataclass(frozen=True)
class Rule:
    """A host with a path prefix, written like ``net/`` or ``example.org/es/``."""

    text: str
    allow: bool

    def fits(self, host: Column, path: Column) -> Column:
        name, _, rest = self.text.partition("/")
        return ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    letters = "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, letters.upper(), letters), F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(rules: Sequence[Rule], host: Column, path: Column) -> Column:
    """Struct of the longest fitting rule's text and verdict, or null; of equally long rules the first one."""
    chosen = F.lit(None).cast("struct<rule:string,allow:boolean>")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        named = F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.allow).alias("allow"))
        chosen = F.when(rule.fits(host, path), named).otherwise(chosen)
    return chosen


def _code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    marked = [BEGIN + t + END for t in texts]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(t) for t in marked], np.int64)
    begins = np.cumsum(sizes) - sizes
    return codes, np.arange(len(codes)) - np.repeat(begins, sizes), begins


def _gram_hashes(codes: np.ndarray, order: int) -> np.ndarray:
    out = np.full(len(codes), order, np.uint64)
    for k in range(min(order, len(codes))):
        out[k:] += codes[: len(codes) - k] * _PLACE[k]
    return mix(out)


def gram_counts(labelled: DataFrame) -> DataFrame:
    """gram (hash), context (hash), size, accepted, rejected: occurrences in the URLs of either label.

    ``labelled`` has _url and _accept. Each task sums its own part first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 5000):
                part = batch.slice(low, 5000)
                accept = np.array(column_of(part, "_accept").to_pylist(), bool)
                codes, place, begins = _code_points(column_of(part, "_url").to_pylist())
                label = accept[np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(codes))))]
                shorter = np.full(len(codes), 0, np.uint64)
                for order in range(1, ORDER + 1):
                    hashes = _gram_hashes(codes, order)
                    at = np.flatnonzero(place >= max(order - 1, 1))
                    context = np.concatenate([shorter[:1], shorter[:-1]])
                    unique, first, which = np.unique(hashes[at], return_index=True, return_inverse=True)
                    yield batch_of(
                        gram=unique.view(np.int64),
                        context=context[at][first].view(np.int64),
                        size=pa.array(np.full(len(unique), order), pa.int32()),
                        accepted=np.bincount(which, label[at], len(unique)).astype(np.int64),
                        rejected=np.bincount(which, ~label[at], len(unique)).astype(np.int64),
                    )
                    shorter = hashes

    counted = labelled.mapInArrow(run, "gram bigint, context bigint, size int, accepted bigint, rejected bigint")
    return counted.groupBy("gram").agg(
        F.first("context").alias("context"), F.first("size").alias("size"), F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")
    )


@dataclass
class RatioModel:
    """Sorted grams with their probabilities in context, for accepted (column 0) and rejected URLs (1)."""

    hashes: np.ndarray
    share: np.ndarray  # occurrences / (occurrences of the context + kinds after it)
    back: np.ndarray  # as a context: kinds after it / (occurrences + kinds)
    threshold: float = 0.0  # accepted at or above this difference per character

    def differences(self, texts: list[str]) -> np.ndarray:
        """Log-likelihood under the accepted model less that under the rejected one, per character."""
        codes, place, begins = _code_points(texts)
        probability = np.full((len(codes), 2), 1 / 256)
        before = np.full(len(codes), 0)  # the empty context
        for order in range(1, ORDER + 1):
            hashes = _gram_hashes(codes, order)
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            found = (self.hashes[at] == hashes) & (place >= order - 1)
            context = before if order == 1 else np.concatenate([[-1], before[:-1]])
            usable = np.flatnonzero((context >= 0) & (place >= max(order - 1, 1)))
            probability[usable] *= self.back[context[usable]]
            hit = usable[found[usable]]
            probability[hit] += self.share[at[hit]]
            before = np.where(found, at, -1)
        logs = np.log(probability)
        logs[place == 0] = 0
        if not len(texts):
            return np.zeros(0)
        total = np.add.reduceat(logs[:, 0] - logs[:, 1], begins)
        return total / np.maximum(np.diff(np.append(begins, len(codes))) - 1, 1)


def _assemble(table: pa.Table) -> RatioModel:
    """Witten-Bell weights: a context gives its kinds of followers as weight to the next shorter one."""
    grams = table["gram"].to_numpy().view(np.uint64)
    order = np.argsort(grams)
    grams = np.concatenate([[np.uint64(0)], grams[order]])  # the empty context sorts first
    counts = np.stack([table["accepted"].to_numpy()[order], table["rejected"].to_numpy()[order]], axis=1).astype(np.float64)
    counts = np.concatenate([np.zeros((1, 2)), counts])
    context = table["context"].to_numpy().view(np.uint64)[order]
    parent = np.concatenate([[0], np.minimum(np.searchsorted(grams, context), len(grams) - 1)])
    known = grams[parent] == np.concatenate([[np.uint64(0)], context])
    share, back = np.zeros_like(counts), np.ones_like(counts)
    inside = np.flatnonzero(known)[1:]
    for k in (0, 1):
        total = np.bincount(parent[inside], counts[inside, k], len(grams))
        kinds = np.bincount(parent[inside], counts[inside, k] > 0, len(grams))
        whole = np.maximum(total + kinds, 1e-12)
        share[inside, k] = counts[inside, k] / whole[parent[inside]]
        held = total > 0
        back[held, k] = kinds[held] / whole[held]
    return RatioModel(grams, share, back)


def kept_grams(grams: DataFrame) -> DataFrame:
    """The grams that the models hold: all up to two characters, and longer ones common enough for either label.

    Each label has a limit of its own, which grows with the root of its characters, so a rare label
    keeps its grams and a larger input keeps more. A gram occurs no more often than its context, so
    contexts stay with their grams.
    """
    sums = grams.where("size = 1").agg(*[F.sum(c).alias(c) for c in ("accepted", "rejected")]).first()
    enough = F.lit(False)
    for label in ("accepted", "rejected"):
        enough = enough | (F.col(label) >= max(1, int((sums[label] or 0) ** 0.5 / KEEP)))
    return grams.where((F.col("size") <= 2) | (enough & (F.col("accepted") + F.col("rejected") >= MIN_COUNT)))


def threshold(scored: DataFrame) -> float:
    """The cut that misjudges the smallest share of either label, of all rows of ``scored`` (_score, _accept).

    Rows are counted by label and score, rounded to steps of the range of all scores, and the cut
    lies midway between two of the steps that rows have. Without both labels all rows are on one side.
    """
    edges = scored.agg(F.min("_score").alias("low"), F.max("_score").alias("high"), F.count_if("_accept").alias("accepted"), F.count_if(~F.col("_accept")).alias("rejected")).first()
    if not edges["accepted"] or not edges["rejected"]:
        return -np.inf if edges["accepted"] or not edges["rejected"] else np.inf
    step = max((edges["high"] - edges["low"]) / SCORE_STEPS, 1e-12)
    counts = scored.groupBy(F.round((F.col("_score") - edges["low"]) / step).cast("long").alias("place")).agg(
        F.count_if("_accept").alias("accepted"), F.count_if(~F.col("_accept")).alias("rejected")
    )
    rows = sorted(counts.collect())
    place, accepted, rejected = np.array([list(r) for r in rows], np.int64).T
    wrong_low = np.concatenate([[0], np.cumsum(accepted)]) / accepted.sum()  # accepted ones below the cut
    wrong_high = 1 - np.concatenate([[0], np.cumsum(rejected)]) / rejected.sum()
    cut = int(np.argmin(wrong_low + wrong_high))
    scores = edges["low"] + place * step
    ends = np.concatenate([[scores[0] - 1], scores, [scores[-1] + 1]])
    return float((ends[cut] + ends[cut + 1]) / 2)


def fit(labelled: DataFrame) -> RatioModel:
    """Fit on all rows of ``labelled`` (_url: host and path, _accept), the threshold on all of them too.

    Without both labels all URLs are accepted or all rejected.
    """
    model = _assemble(kept_grams(checkpointed(gram_counts(labelled))).toArrow())
    shared = labelled.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = shared.value.differences(column_of(batch, "_url").to_pylist())
        return batch_of(_score=pa.array(scores, pa.float64()), _accept=column_of(batch, "_accept"))

    scored = checkpointed(map_slices(labelled.select("_url", "_accept"), "_url", run, "_score double, _accept boolean"))
    model.threshold = threshold(scored)
    shared.unpersist()
    return model


def judge_urls(
    pages: DataFrame,
    rules: Sequence[Rule],
    key: str = "page_id",
    url: str = "url",
    rejected_words: Sequence[str] = REJECTED_HOST_WORDS,
) -> DataFrame:
    """key, host, path, rule (text or null), verdict (allow or block), difference (per character).

    Examples to learn from: URLs whose host has one of ``rejected_words`` or that a block rule
    fits are rejected ones, all others are accepted ones. A URL without host
    and path (null, empty, no ``://``) has difference 0 and is judged like any other. Rows are judged
    each by itself; a null key stays null. Other columns are not looked at.
    """
    kind = pages.select(key).schema[0].dataType.simpleString()
    host, path = split_url(pages[url])
    ruled = pages.select(pages[key].alias("_key"), host.alias("host"), path.alias("path")).withColumn(
        "chosen", longest_rule(rules, F.col("host"), F.col("path"))
    )
    ruled = ruled.withColumn("_url", F.concat("host", "path"))
    spam = F.lit(False)
    for word in rejected_words:
        spam = spam | F.col("host").contains(word)
    label = ~spam & F.coalesce(F.col("chosen.allow"), F.lit(True))
    model = fit(ruled.where("_url <> ''").select("_url", label.alias("_accept")))
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = column_of(batch, "_url").to_pylist()
        scores = np.where([bool(t) for t in texts], shared.value.differences(texts), 0.0)
        named = {c: column_of(batch, c) for c in ("_key", "host", "path", "rule", "allow")}
        return batch_of(**named, difference=pa.array(scores, pa.float64()))

    rows = ruled.select("_key", "host", "path", F.col("chosen.rule").alias("rule"), F.col("chosen.allow").alias("allow"), "_url")
    judged = map_slices(rows, "_url", run, f"_key {kind}, host string, path string, rule string, allow boolean, difference double")
    verdict = F.coalesce("allow", F.col("difference") >= F.lit(float(model.threshold)))
    return judged.select(
        F.col("_key").alias(key), "host", "path", "rule", F.when(verdict, "allow").otherwise("block").alias("verdict"), "difference"
    )
