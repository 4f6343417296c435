"""Personal data: exact shapes first, then bootstrapped extraction by context.

The exact shapes (e-mail, IP address, payment card, phone) are the seeds. Their surroundings are
lexical patterns: the words before and after. A graph joins patterns and the instances that they
surround; a few rounds of scoring on Spark pass confidence from seeds to patterns and from
patterns to instances that no exact shape covers. Instances with enough confidence count as
seeds when patterns are admitted in the next round, so what one context reveals opens others, and
they become further spans of the kind of their patterns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import absent_names, batch_of, checkpointed, column_of, map_slices, slices, texts_of

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)++")
# A match never ends inside a run of digits, so the next one can only begin at the start of one.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DOTTED = re.compile(r"[0-9]\.[0-9]")
RUN = re.compile(r"""[^\x20\x09-\x0D"'<>()\[\]{},;:=]+""")
# Digits joined by blanks, dots, hyphens, slashes and parentheses; no group of digits touches a letter.
GROUPED = re.compile(r"[+(]{0,2}(?<!\w)[0-9]++(?!\w)(?:[\x20./()-]{1,3}+[0-9]++(?!\w))*+")
BREAKS = re.compile(r"[\x20()]")
MARKER = re.compile(r"[0-9@]")
WORD = re.compile(r"[^\W\d_]+")
CONTEXT_REACH = 48  # code points on either side in which context words are looked for

ROUNDS = 3
MIN_SEEDS = 3  # distinct seeds or instances with enough confidence that a trusted pattern surrounds
MIN_CONFIDENCE = 0.8


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the exact shapes, by start and kind."""
    found = []
    if "@" in text:
        found += _emails(text)
    if DOTTED.search(text):
        found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(_at_most_255(p) for p in m.group().split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def _emails(text: str) -> list[tuple[int, int, int]]:
    """Places of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found from each @ outwards in linear time."""
    found, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            found.append((start, 0, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    return found


def _at_most_255(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def shape_fits(value: str) -> list[str]:
    """Kinds that an identifier without an exact shape can still be, by what it is made of."""
    digits = sum(c.isascii() and c.isdigit() for c in value)
    plain = all(c in "0123456789 ().+-/" for c in value)
    kinds = []
    if "@" in value[1:-1]:
        kinds.append("email")
    if plain and value.count(".") == 3 and 4 <= digits <= 12:
        kinds.append("ip")
    if plain and 12 <= digits <= 19:
        kinds.append("card")
    if plain and 7 <= digits <= 15:
        kinds.append("phone")
    return kinds


def _context(text: str, start: int, end: int) -> tuple[str, str]:
    """The two words before and the word after, in lower case."""
    before = WORD.findall(text[max(0, start - CONTEXT_REACH) : start].lower())[-2:]
    after = WORD.search(text[end : end + CONTEXT_REACH].lower())
    return " ".join(before), after.group() if after else ""


def _grouped(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, list[str]]]:
    """(start, end, kinds) of the joined digits between the exact shapes that a single run does not hold whole."""
    found, low = [], 0
    for start, end in [*((a, b) for a, _, b in base), (len(text), len(text))]:
        for m in GROUPED.finditer(text, low, start) if start > low else ():
            a, b = m.span()
            if ")" not in m.group():
                a += m.group().startswith("(")
            if BREAKS.search(text, a, b):
                kinds = shape_fits(text[a:b])
                if kinds:
                    found.append((a, b, kinds))
        low = max(low, end)
    return found


MENTION = "array<struct<start:bigint,end:bigint,kind:string,value:string,before:string,after:string,kinds:array<string>,part:boolean>>"


def mentions(docs: DataFrame, key: str, text: str) -> DataFrame:
    """_key, _print (hash of the text), _spans (exact shapes) and _mentions: spans and other identifiers in context.

    A run of characters inside a longer group of joined digits is a mention too, marked as its part.
    """
    kind = docs.select(key).schema[0].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
    text_type, number = pa.string(), pa.int64()
    names = ("start", "end", "kind", "value", "before", "after", "kinds", "part")
    mention = pa.list_(pa.struct(list(zip(names, (number, number, *[text_type] * 4, pa.list_(text_type), pa.bool_()), strict=True))))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans, found = [], []
        for t in texts_of(batch, "_text"):
            base = base_spans(t)
            spans.append([{"start": a, "kind": k, "end": b} for a, k, b in base])
            row = []
            for a, k, b in base:
                before, after = _context(t, a, b)
                row.append((a, b, KINDS[k], t[a:b], before, after, [KINDS[k]], False))
            groups = _grouped(t, base) if MARKER.search(t) else []
            for a, b, kinds in groups:
                row.append((a, b, None, t[a:b], *_context(t, a, b), kinds, False))
            taken = passed = 0
            for m in RUN.finditer(t) if MARKER.search(t) else ():
                a, b = m.span()
                if not MARKER.search(t, a, b):
                    continue
                while taken < len(base) and base[taken][2] <= a:
                    taken += 1
                if any(x < b and y > a for x, _, y in base[taken:]):
                    continue
                value = m.group().strip(".!?*#$%&|-")
                kinds = shape_fits(value) if value else []
                if kinds:
                    a += m.group().index(value)
                    b = a + len(value)
                    while passed < len(groups) and groups[passed][1] <= a:
                        passed += 1
                    part = passed < len(groups) and groups[passed][0] < b
                    row.append((a, b, None, value, *_context(t, a, b), kinds, part))
            found.append([dict(zip(names, r, strict=True)) for r in row])
        return batch_of(
            _key=column_of(batch, "_key"), _print=column_of(batch, "_print"), _spans=pa.array(spans, span), _mentions=pa.array(found, mention)
        )

    rows = docs.select(docs[key].alias("_key"), F.xxhash64(docs[text]).alias("_print"), docs[text].alias("_text"))
    schema = f"_key {kind}, _print bigint, _spans array<struct<start:bigint,kind:int,end:bigint>>, _mentions {MENTION}"
    return map_slices(rows, "_text", run, schema)


def _patterns() -> Column:
    """Patterns of a mention: the words before it, and the nearest words on both sides."""
    last = F.element_at(F.split("m.before", " "), -1)
    pair = F.when((F.col("m.before") != "") & (F.col("m.after") != ""), F.concat(F.lit("around "), last, F.lit(" _ "), F.col("m.after")))
    lead = F.when(F.col("m.before") != "", F.concat(F.lit("before "), F.col("m.before")))
    return F.explode(F.array_compact(F.array(pair, lead)))


def trusted_instances(found: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """kind, value of the identifiers that the scored graph of patterns and instances vouches for.

    Edges are (pattern, kind, value) with a count, summed before they are shuffled. In each round
    a pattern is admitted that surrounds ``min_seeds`` distinct values with ``min_confidence``, seeds
    or instances found in earlier rounds. Its confidence in a kind is the mean confidence of its
    instances, weighed by the logarithm of their counts. An instance's confidence is one less the
    chance that all its patterns err. Seeds keep confidence 1. Parts of a longer candidate are
    judged, but neither admit patterns nor weigh in them.
    """
    whole = F.count_if(~F.col("part"))
    edges = checkpointed(
        found.select(F.explode("_mentions").alias("m"))
        .select(
            _patterns().alias("pattern"), F.col("m.kind").isNotNull().alias("seed"), F.explode("m.kinds").alias("kind"), F.col("m.value").alias("value"), F.col("m.part").alias("part")
        )
        .groupBy("pattern", "kind", "value")
        .agg(F.bool_or("seed").alias("seed"), F.bool_or(~F.col("seed")).alias("plain"), F.log2(whole + F.lit(1.0)).alias("weight"))
    )
    # Patterns with fewer values can be admitted in no round; they leave the graph.
    worthy = edges.where("weight > 0").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("values")).where(F.col("values") >= min_seeds)
    graph = checkpointed(edges.join(worthy.select("pattern", "kind"), ["pattern", "kind"]).withColumn("found", F.lit(0.0)))
    confidence = F.when(F.col("seed"), 1.0).otherwise(F.col("found"))
    for _ in range(rounds):
        sure = F.count_if((F.col("weight") > 0) & (confidence >= min_confidence))
        scores = graph.groupBy("pattern", "kind").agg((F.sum(F.col("weight") * confidence) / F.sum("weight")).alias("score"), sure.alias("sure"))
        scored = graph.where("plain").join(scores.where(F.col("sure") >= min_seeds).drop("sure"), ["pattern", "kind"])
        doubt = F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("score")))))
        instances = scored.groupBy("kind", "value").agg((1 - doubt).alias("now"))
        graph = checkpointed(
            graph.join(instances, ["kind", "value"], "left").select("pattern", "kind", "value", "seed", "plain", "weight", F.coalesce("now", F.lit(0.0)).alias("found"))
        )
    return graph.where(F.col("plain") & (F.col("found") >= min_confidence)).select("kind", "value").distinct()


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, _print (hash of the text), base and spans: arrays of (start, kind, end) by start and kind.

    ``base`` has the exact shapes, ``spans`` also those found by context. Starts and ends count
    code points; the end is exclusive. Kinds are numbers into KINDS. Null and empty texts have no
    spans. Rows that repeat key and text all get the same spans; a null key stays null. Other
    columns are not looked at.
    """
    found = checkpointed(mentions(docs, key, text))
    trusted = trusted_instances(found)
    numbers = F.create_map(*[x for k, name in enumerate(KINDS) for x in (F.lit(name), F.lit(k))])
    earlier = Window.partitionBy("_key", "_print").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    more = (
        found.select("_key", "_print", F.explode("_mentions").alias("m"))
        .where("m.kind is null")
        .select("_key", "_print", "m.start", "m.end", F.col("m.value").alias("value"), F.explode("m.kinds").alias("kind"))
        .join(trusted, ["kind", "value"])
        .withColumn("number", numbers[F.col("kind")])
        .groupBy("_key", "_print", "start", "end")
        .agg(F.min("number").alias("kind"))
        .withColumn("reached", F.max("end").over(earlier))
        .where("reached is null or reached < end")  # a part inside a longer span says nothing new
        .groupBy("_key", "_print")
        .agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))
        .withColumnsRenamed({"_key": "_other_key", "_print": "_other_print"})
    )
    same = F.col("_key").eqNullSafe(F.col("_other_key")) & F.col("_print").eqNullSafe(F.col("_other_print"))
    every = F.array_sort(F.concat("_spans", F.coalesce("more", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))))
    return found.join(more, same, "left").select(F.col("_key").alias(key), "_print", F.col("_spans").alias("base"), every.alias("spans"))


def _written(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])))


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of the exact shapes, the SHA-256 of their list, and the list of all spans."""
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select(key, *counts, F.sha2(_written("base"), 256).alias("base_sha256"), _written("spans").alias("spans"))


def redacted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, with each span replaced by its kind in brackets.

    Overlapping spans are replaced as one, named after the first. Null texts stay null.
    """
    its_key, its_print, its_spans = absent_names(docs, "_other_key", "_other_print", "_spans")
    found = find_personal_data(docs, key, text).where(F.size("spans") > 0).select(
        F.col(key).alias(its_key), F.col("_print").alias(its_print), F.col("spans").alias(its_spans)
    )
    found = found.dropDuplicates([its_key, its_print])
    same = docs[key].eqNullSafe(found[its_key]) & (F.xxhash64(docs[text]) == found[its_print])
    joined = docs.join(found, same, "left").select(*[docs[c] for c in docs.columns], found[its_spans])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for low, high in slices(batch.column(at)):
                part = batch.slice(low, high - low)
                spans, texts = part.column(part.num_columns - 1), part.column(at)
                if spans.null_count < len(part):
                    texts = pa.array(
                        [_replace(t, s) if s else t for t, s in zip(texts.to_pylist(), spans.to_pylist(), strict=True)], texts.type
                    )
                columns = [texts if k == at else part.column(k) for k in range(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names[:-1])

    return joined.mapInArrow(run, docs.schema)


def _replace(text: str, spans: list[dict]) -> str:
    out, at = [], 0
    for s in spans:
        if s["start"] >= at:
            out += [text[at : s["start"]], f"[{KINDS[s['kind']]}]"]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])

