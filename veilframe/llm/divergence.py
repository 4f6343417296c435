"""Source divergence audit by chunk factorization.

How far do the sources of a language differ in their terms, and by which terms? Texts are
factored into whitespace chunks (without the signs at their ends): a document is a list of distinct
chunks with counts, and a chunk that the whole corpus repeats billions of times is tokenized once.
The documents of a term's chunks, summed, are at least the documents of the term, so most rare terms
are known to be rare before any text is looked at again. The others are joined back to the slices of
the corpus that use the chunk, where distinct documents and occurrences are counted for each
language, source and term.

A chunk is sent at most once for each slice, so no key of that join holds more than one row for
each slice, however frequent the chunk is. All arithmetic is on whole numbers.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import batch_of, checkpointed, column_of, ranges, stored
from veilframe.llm.corpus_slices import CORPUS_SLICE_BYTES, coded_words, corpus_slices, packed, unpacked

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCS = 30  # documents of a language that a kept term is in, at least
PRIOR = 5  # added to each count
SCALE = 1_000_000_000
TOP_TERMS = 50
BLOCK_ROWS = 1 << 18  # counts that a task compares at a time
BLOCK_CELLS = 1 << 22
BROADCAST_GROUPS = 50_000  # (language, source) groups sent to all tasks; more are joined by shuffle

TERM_BYTES = np.ones(256, bool)  # bytes that TERM admits, in lower-cased UTF-8
TERM_BYTES[:0x80] = False
TERM_BYTES[0x61:0x7B] = True

FACTORED = (
    "slice long, langs array<string>, sources array<string>, group_of binary, per_row binary, codes binary, counts binary, kinds long, "
    "chunks array<struct<chunk: string, docs: int>>"
)
COUNTED = "lang string, source string, term string, docs long, n long"


def factored(docs: DataFrame, text: str, lang: str, source: str, size: int = CORPUS_SLICE_BYTES) -> DataFrame:
    """One row for each slice of the corpus: its distinct chunks, and for each document the chunks it has and how often."""

    def run(batches):
        for number, batch in corpus_slices(batches, "_text", size):
            words = coded_words(column_of(batch, "_text"), inner=TERM_BYTES)
            kinds = max(len(words.vocabulary), 1)
            pairs, counts = np.unique(words.row_of_word() * kinds + words.codes, return_counts=True)
            per_row = np.bincount(pairs // kinds, minlength=batch.num_rows)
            groups = pa.StructArray.from_arrays([column_of(batch, "_lang"), column_of(batch, "_source")], ["lang", "source"])
            known: dict[tuple, int] = {}
            group_of = [known.setdefault((g["lang"], g["source"]), len(known)) for g in groups.to_pylist()]
            in_docs = np.bincount(pairs % kinds, minlength=len(words.vocabulary))
            chunks = pa.StructArray.from_arrays([words.vocabulary.cast(pa.string()), pa.array(in_docs, pa.int32())], ["chunk", "docs"])
            yield batch_of(
                slice=pa.array([number], pa.int64()),
                langs=pa.array([[g[0] for g in known]], pa.list_(pa.string())),
                sources=pa.array([[g[1] for g in known]], pa.list_(pa.string())),
                group_of=pa.array([packed(np.array(group_of, np.int64))], pa.binary()),
                per_row=pa.array([packed(per_row)], pa.binary()),
                codes=pa.array([packed(pairs % kinds)], pa.binary()),
                counts=pa.array([packed(counts)], pa.binary()),
                kinds=pa.array([len(chunks)], pa.int64()),
                chunks=pa.ListArray.from_arrays(pa.array([0, len(chunks)], pa.int32()), chunks),
            )

    rows = docs.select(*[F.coalesce(docs[c], F.lit("")).alias(n) for c, n in ((text, "_text"), (lang, "_lang"), (source, "_source"))])
    return rows.mapInArrow(run, FACTORED)


def _terms_counted(slice_rows: pa.Table, found: pa.Table) -> pa.Table:
    """Documents and occurrences of each group and term of one slice."""
    row = slice_rows.slice(0, 1).to_pylist()[0]
    chunk_kinds = int(row["kinds"])
    order = np.argsort(found.column("pos").to_numpy(), kind="stable")
    at = found.column("pos").to_numpy()[order]
    coded = found.column("term").combine_chunks().take(pa.array(order)).dictionary_encode()
    term_codes, terms = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    many = np.bincount(at, minlength=chunk_kinds)
    starts = np.cumsum(many) - many

    codes, counts, per_row = (unpacked(row[c]) for c in ("codes", "counts", "per_row"))
    group_of, doc = unpacked(row["group_of"]), np.repeat(np.arange(len(per_row)), per_row)
    copies = many[codes]
    term = term_codes[ranges(starts[codes], copies)]
    doc, occurrences = np.repeat(doc, copies), np.repeat(counts, copies)
    kinds = max(len(terms), 1)
    cells, cell_of = np.unique(group_of[doc] * kinds + term, return_inverse=True)
    occurred = np.zeros(len(cells), np.int64)
    np.add.at(occurred, cell_of, occurrences)
    in_doc = np.unique(doc * kinds + term)
    docs = np.bincount(np.searchsorted(cells, group_of[in_doc // kinds] * kinds + in_doc % kinds), minlength=len(cells))
    group = pa.array(cells // kinds)
    return pa.table(
        {
            "lang": pa.array(row["langs"], pa.string()).take(group),
            "source": pa.array(row["sources"], pa.string()).take(group),
            "term": terms.cast(pa.string()).take(pa.array(cells % kinds)),
            "docs": pa.array(docs.astype(np.int64)),
            "n": pa.array(occurred),
        }
    )


def term_counts(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 1, size: int = CORPUS_SLICE_BYTES
) -> DataFrame:
    """lang, source, term, docs (distinct documents) and n (occurrences) of all documents; nulls count as ''.

    Terms in fewer than ``least_docs`` documents of all languages may be left out.
    """
    slices = stored(factored(docs, text, lang, source, size))
    used = slices.select(F.col("slice").alias("to_slice"), F.posexplode("chunks").alias("pos", "c")).select("to_slice", "pos", "c.chunk", "c.docs")
    tokenized = used.groupBy("chunk").agg(F.sum("docs").alias("docs"))
    tokenized = stored(tokenized.select("chunk", "docs", F.explode(F.regexp_extract_all("chunk", F.lit(TERM), F.lit(0))).alias("term")))
    common = tokenized.groupBy("term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).select("term")
    found = used.join(tokenized.join(common, "term").select("chunk", "term"), "chunk").select("to_slice", "pos", "term")
    coded = slices.drop("chunks")

    def counted(slice_rows: pa.Table, found: pa.Table) -> pa.Table:
        return _terms_counted(slice_rows, found)

    by_slice = coded.groupBy("slice").cogroup(found.groupBy("to_slice")).applyInArrow(counted, COUNTED)
    return by_slice.groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))


def _share(count: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms)), exactly."""
    whole = f"CAST({count} + {PRIOR} AS DECIMAL(20, 0)) * {SCALE}"
    return F.expr(f"CASE WHEN {terms} > 0 THEN 1 + ({whole}) DIV CAST({total} + {PRIOR} * {terms} AS DECIMAL(20, 0)) END")


def _block_distances(counts: pa.Table, groups: pa.Table) -> pa.Table:
    """Summed differences of each ordered pair of sources over the terms of one block."""
    sources = groups.column("source").to_pylist()
    place = {s: k for k, s in enumerate(sources)}
    coded = counts.column("term").combine_chunks().dictionary_encode()
    coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
    absent = np.array([0 if p is None else p for p in groups.column("absent").to_pylist()], np.int64)
    shares = np.repeat(absent[:, None], len(coded.dictionary), axis=1)
    rows = np.array([place[s] for s in counts.column("source").to_pylist()], np.int64)
    shares[rows, coded.indices.to_numpy()] = counts.column("p").to_numpy()
    names, values = [], []
    for k in range(len(sources)):
        names.append(sources[:k] + sources[k + 1 :])
        values.append(np.delete(np.abs(shares - shares[k]).sum(axis=1), k))
    lang = groups.column("lang")[0].as_py()
    others = len(sources) - 1
    return pa.table(
        {
            "lang": pa.array([lang] * (len(sources) * others), pa.string()),
            "source": pa.array([s for s in sources for _ in range(others)], pa.string()),
            "item": pa.array([s for part in names for s in part], pa.string()),
            "value": pa.array(np.concatenate(values) if values else np.zeros(0, np.int64), pa.int64()),
        }
    )


def audit_sources(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP_TERMS
) -> DataFrame:
    """lang, source, part, item, value, rank: distances between sources and the terms that set a source apart.

    A language keeps the terms in at least ``least_docs`` of its documents (rows; repeated ones
    count each). ``pair`` rows hold the summed difference of term shares to each other source of the
    language, ``term`` rows the ``top`` terms whose share in the source is above the language's.
    Null text, language and source count as ''. Ties go by UTF-8 order. A group without terms has
    pairs only, a language with one source has no pairs, an empty table no rows. Other columns are
    not looked at.
    """
    counts = stored(term_counts(docs, text, lang, source, least_docs))
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n_lang"))
    kept = checkpointed(kept.where(F.col("docs") >= least_docs).drop("docs"))
    cells = stored(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "n_lang"))
    groups = docs.select(F.coalesce(docs[lang], F.lit("")).alias("lang"), F.coalesce(docs[source], F.lit("")).alias("source")).distinct()
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n_lang").alias("lang_total"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(langs, "lang", "left").join(totals, ["lang", "source"], "left").na.fill(0, ["terms", "lang_total", "total"])
    groups = checkpointed(groups.withColumn("absent", _share("0", "total", "terms")))

    sizes = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")).agg(F.max("sources").alias("most"), F.sum("sources").alias("all")).first()
    facts = groups.select("lang", "source", "terms", "total", "lang_total")
    few = (sizes["all"] or 0) <= BROADCAST_GROUPS
    shares = cells.join(F.broadcast(facts) if few else facts, ["lang", "source"]).select(
        "lang", "source", "term", _share("n", "total", "terms").alias("p"), _share("n_lang", "lang_total", "terms").alias("q")
    )
    above = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))

    # Blocks of terms by hash; the matrix of a block, sources by terms, is what a task holds.
    blocks = max(1, ceil(cells.count() / BLOCK_ROWS), ceil((sizes["most"] or 0) * kept.count() / BLOCK_CELLS))
    block = F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int")
    every = F.explode(F.when(F.col("terms") > 0, F.sequence(F.lit(0), F.lit(blocks - 1))).otherwise(F.array(F.lit(0))))
    left = shares.select(F.col("lang").alias("of_lang"), block.alias("of_block"), "source", "term", "p")
    right = groups.select("lang", every.alias("block"), "source", "absent")

    def distances(counts: pa.Table, groups: pa.Table) -> pa.Table:
        return _block_distances(counts, groups)

    pairs = left.groupBy("of_lang", "of_block").cogroup(right.groupBy("lang", "block"))
    pairs = pairs.applyInArrow(distances, "lang string, source string, item string, value long")
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    parts = [
        pairs.withColumn("rank", rank).withColumn("part", F.lit("pair")),
        above.withColumn("rank", rank).where(F.col("rank") <= top).withColumn("part", F.lit("term")),
    ]
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return parts[0].select(columns).unionByName(parts[1].select(columns))
