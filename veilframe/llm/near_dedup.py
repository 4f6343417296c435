"""Near-duplicate groups by SuperMinHash signatures, banding, exact verification and union-find.

Equal shingle sets are folded into one class first, so copies cost one row each. Signatures of
the classes are cut into bands; classes that share a band's key are candidates. They are not
compared pair by pair but with the most typical document around. Pairs that this leaves in
different components are compared only if they differ from that document in the same way, which
links require (see ``_cross_pairs``); so no link that shares a band is lost. Every link is
confirmed on the full shingle sets.

Miss chance: with 24 bands of 4 slots, two sets of similarity 0.85 share no bucket with
probability (1 - 0.85^4)^24 = 2e-8.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import Words, absent_names, batch_of, checkpointed, column_of, map_slices, mix, window_hashes, words_of
from veilframe.llm.components import components

BANDS = 24
BAND_SIZE = 4
SHINGLE = 5
SKETCH_LANES = 8
_ROUND = np.uint64(0xD1B54A32D192ED03)
_LEVEL_BITS = np.uint64(56)
_LANES = [f"flips_{k}" for k in range(SKETCH_LANES)]


def shingle_sets(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted, and where each row begins.

    A row with fewer words than ``size`` has its whole sequence as one shingle; without words, none.
    """
    counts = np.diff(words.rows)
    at_word = np.flatnonzero(words.left_in_row() >= size)
    hashes = window_hashes(words.hashes, size)[at_word]
    row = np.repeat(np.arange(len(counts)), np.maximum(counts - size + 1, 0))
    for short in range(1, size):
        rows = np.flatnonzero(counts == short)
        if len(rows):
            grams = window_hashes(words.hashes, short)[words.rows[rows]] ^ np.uint64(short)
            hashes, row = np.concatenate([hashes, grams]), np.concatenate([row, rows])
    order = np.argsort(row, kind="stable")
    hashes, row = hashes[order], row[order]
    begins = np.searchsorted(row, np.arange(len(counts) + 1))
    for a, b in zip(begins[:-1], begins[1:], strict=True):
        hashes[a:b].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    return hashes[new], np.searchsorted(row[new], np.arange(len(counts) + 1))


def super_minhash(elements: np.ndarray, begins: np.ndarray, slots: int) -> np.ndarray:
    """SuperMinHash signatures (Ertl 2017), one row of ``slots`` numbers for each set.

    Each element visits all slots in a random order of its own. In round j it puts the number
    (j, random) into its j-th slot, and a slot keeps its least number. Once every slot of a set
    holds a number of a round so far, later rounds cannot change it, and the set is done. Rounds
    run over all sets at a time. An empty set keeps the largest number in all slots.
    """
    sets = len(begins) - 1
    signature = np.full(sets * slots, np.iinfo(np.uint64).max, np.uint64)
    owner = np.repeat(np.arange(sets), np.diff(begins))
    order = None  # each element's permutation of the slots, as far as it has been drawn
    for level in range(slots):
        if not len(elements):
            break
        odd, even = (np.uint64((2 * level + k) * int(_ROUND) % 2**64) for k in (1, 2))
        draw = mix(elements + odd)
        pick = level + (mix(elements ^ even) >> np.uint64(32)).astype(np.int64) % (slots - level)
        if order is None:
            slot = pick
        else:
            every = np.arange(len(elements))
            slot = order[every, pick].astype(np.int64)
            order[every, pick] = order[:, level]
            order[:, level] = slot
        number = np.uint64(level) << _LEVEL_BITS | draw >> (np.uint64(64) - _LEVEL_BITS)
        np.minimum.at(signature, owner * slots + slot, number)
        open_sets = (signature.reshape(sets, slots) >= np.uint64(level + 1) << _LEVEL_BITS).any(axis=1)
        going = open_sets[owner]
        elements, owner = elements[going], owner[going]
        if order is None:
            order = np.tile(np.arange(slots, dtype=np.uint16), (len(elements), 1))
            every = np.arange(len(elements))
            order[every, pick[going]] = 0
            order[:, 0] = pick[going]
        else:
            order = order[going]
    return signature.reshape(sets, slots)


def band_keys(signature: np.ndarray, bands: int, size: int) -> np.ndarray:
    """One key for each band of each signature; keys of different bands differ."""
    parts = signature.reshape(len(signature), bands, size)
    keys = np.zeros(parts.shape[:2], np.uint64)
    for k in range(size):
        keys = mix(keys + parts[:, :, k])
    return mix(keys + np.arange(1, bands + 1, dtype=np.uint64) * _ROUND)


def _long_lists(values: np.ndarray) -> pa.Array:
    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(values.reshape(-1).view(np.int64)))


def signatures(docs: DataFrame, key: str, text: str, bands: int = BANDS, band_size: int = BAND_SIZE) -> DataFrame:
    """_id, _x (hash of the text), _n (size of the shingle set), _k1 and _k2 (128-bit key of the set), _bands."""
    kind = docs.select(key).schema[0].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, begins = shingle_sets(words_of(column_of(batch, "_text")))
        counts = np.diff(begins)
        keys = []
        for salt in (np.uint64(0), _ROUND):
            total = np.zeros(len(hashes) + 1, np.uint64)
            np.cumsum(mix(hashes ^ salt), out=total[1:])
            keys.append((total[begins[1:]] - total[begins[:-1]]).view(np.int64))
        signature = super_minhash(hashes, begins, bands * band_size)
        return batch_of(
            _id=column_of(batch, "_id"),
            _x=column_of(batch, "_x"),
            _n=counts.astype(np.int64),
            _k1=keys[0],
            _k2=keys[1],
            _bands=_long_lists(band_keys(signature, bands, band_size)),
        )

    rows = docs.select(docs[key].alias("_id"), F.xxhash64(docs[text]).alias("_x"), docs[text].alias("_text"))
    return map_slices(rows, "_text", run, f"_id {kind}, _x bigint, _n bigint, _k1 bigint, _k2 bigint, _bands array<bigint>")


def _sets_of(texts: DataFrame) -> DataFrame:
    """node, and the shingle set of _text as an array."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, begins = shingle_sets(words_of(column_of(batch, "_text")))
        shingles = pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(hashes.view(np.int64)))
        return batch_of(node=column_of(batch, "node"), shingles=shingles)

    return map_slices(texts, "_text", run, "node bigint, shingles array<bigint>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    shared = F.size(F.array_intersect("sa", "sb"))
    return (
        pairs.join(sets.toDF("a", "sa"), "a")
        .join(sets.toDF("b", "sb"), "b")
        .select("a", "b", shared.alias("shared"), (F.size("sa") + F.size("sb") - shared).alias("either"))
        .where(F.lit(100) * F.col("shared") >= F.lit(percent) * F.col("either"))
        .select("a", "b")
    )


def _pairs(one: str, other: str) -> list:
    return [F.least(one, other).alias("a"), F.greatest(one, other).alias("b")]


def _references(members: DataFrame) -> DataFrame:
    """node, band and ``ref``: the most typical document within two steps of the band.

    A band's hub is its member that shares most bands with most others. The members' hubs in
    their other bands are looked at too, so all bands of a family get the same reference.
    """
    hubs = members.groupBy("band").agg(F.max(F.struct("weight", "node")).alias("hub"))
    best = members.join(hubs, "band").groupBy("node").agg(F.max("hub").alias("hub"))
    known = members.join(best, "node")
    refs = known.groupBy("band").agg(F.max("hub").alias("ref")).select("band", F.col("ref.node").alias("ref"))
    return members.select("band", "node").join(refs, "band")


def _sketch(rows: Window) -> dict[str, Column]:
    """Bits that the differences (shingle, has) of ``rows`` flip; those of two rows' both sets cancel out."""
    place = F.xxhash64("shingle", "has")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(place, F.lit(64)).cast("int"))
    lane = F.pmod(F.shiftright(place, 6), F.lit(SKETCH_LANES))
    return {name: F.bit_xor(F.when(lane == k, bit).otherwise(F.lit(0).cast("bigint"))).over(rows) for k, name in enumerate(_LANES)}


def _cross_pairs(referred: DataFrame, links: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs in a band that may still be linked although their components differ.

    Take A and B of a band with reference H. If both are linked to H they are in one component
    already, so let B not be. With a and b the shingles in which A and B differ from H, and
    c = (100 - percent) / (100 + percent), a link of A and B needs |a| + |b| - 2 |a & b| <= c (|A| + |B|),
    while |b| > c (|B| + |H|). So 2 |a & b| > |a| - c (|A| - |H|): A shares about half of its
    differences with B. Then one of A's rarest differences, as many as leave fewer than that half,
    is shared with B. If more are needed than A lacks of H's shingles, some of those that A has
    beside H's must be shared, and only these are looked at. Differences that no document of another
    component has in the same way count in full against a link: with u_A and u_B of them and a' and b'
    the others, a link needs u_A + u_B + |a' ^ b'| <= c (|A| + |B|). The numbers of a' and b' bound |a' ^ b'|
    from below, and so do the bits in which their sketches differ: each difference flips one of
    SKETCH_LANES * 64 bits. So a group of copies that differ in ways of their own gives few pairs, however large it is.
    """
    named = referred.join(roots, "node", "left").withColumn("component", F.coalesce("root", "node")).drop("root")
    others = named.where("node <> ref").groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    still_open = others.where("low < high").select("band")
    linked = links.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("ref")), F.struct(F.col("b").alias("node"), F.col("a").alias("ref")))).alias("e"))
    linked = linked.select("e.*").distinct().withColumn("linked", F.lit(True))
    asked = named.join(still_open, "band").where("node <> ref").select("node", "ref", "component").distinct().join(linked, ["node", "ref"], "left")
    differing = (
        asked.join(sets.toDF("node", "own"), "node")
        .join(sets.toDF("ref", "its"), "ref")
        .select(
            "node", "ref", "component", "linked", F.size("own").alias("n_own"), F.array_except("own", "its").alias("more"), F.array_except("its", "own").alias("less")
        )
    )
    sizes = [F.size("more").alias("n_more"), F.size("less").alias("n_less")]
    both = F.concat(
        F.transform("more", lambda x: F.struct(x.alias("shingle"), F.lit(True).alias("has"))),
        F.transform("less", lambda x: F.struct(x.alias("shingle"), F.lit(False).alias("has"))),
    )
    tokens = checkpointed(differing.select("node", "ref", "component", "linked", "n_own", *sizes, F.explode(both).alias("t")).select("*", "t.*").drop("t"))
    at = ["ref", "shingle", "has"]
    held = tokens.groupBy(*at).agg(F.count(F.lit(1)).alias("holders"), F.min("component").alias("low"), F.max("component").alias("high"))
    counted = tokens.join(held.where("low < high").drop("low", "high"), at)
    all_of = F.col("n_more") + F.col("n_less")
    slope = F.lit((100 - percent) / (100 + percent))
    counted = counted.withColumn("needed", F.floor((all_of - slope * (F.col("n_more") - F.col("n_less"))) / 2) + 1)
    own = Window.partitionBy("node", "ref")
    counted = counted.withColumn("alone", all_of - F.count(F.lit(1)).over(own)).withColumn("alone_more", F.col("n_more") - F.count_if("has").over(own))
    counted = counted.withColumn("excess", (100 + percent) * F.col("alone") - (100 - percent) * F.col("n_own"))
    known_more = F.col("n_more") - F.col("alone_more")
    counted = counted.withColumns({"known_more": known_more, "known_less": all_of - F.col("alone") - known_more, **_sketch(own)})
    # Differences that no other component shares come first in the order and match nothing, so only their number matters.
    by_extra = F.col("needed") > F.col("n_less")
    rarest = Window.partitionBy("node", "ref").orderBy("holders", F.desc("has"), "shingle")
    place = F.row_number().over(rarest) + F.when(by_extra, F.col("alone_more")).otherwise(F.col("alone"))
    first = counted.where(~by_extra | F.col("has")).withColumns({"place": place, "prefix": all_of - F.col("needed") + 1}).where("place <= prefix")
    sides = ["component", "excess", "known_more", "known_less", *_LANES]
    first = first.select(*at, F.col("node").alias("one"), *[F.col(c).alias(f"one_{c}") for c in sides])
    second = counted.where("linked is null").select(*at, "node", *sides)
    first, second = first.alias("x"), second.alias("y")
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in at]
    flipped = sum((F.bit_count(F.col(f"x.one_{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in _LANES), F.lit(0))
    uneven = sum((F.abs(F.col(f"x.one_{c}") - F.col(f"y.{c}")) for c in ("known_more", "known_less")), F.lit(0))
    least = F.col("x.one_excess") + F.col("y.excess") + (100 + percent) * F.greatest(flipped, uneven)
    possible = (F.col("x.one_component") != F.col("y.component")) & (least <= 0)
    return first.join(second, [*same, possible]).select(F.least("one", "node").alias("a"), F.greatest("one", "node").alias("b")).distinct()


def near_duplicate_groups(
    docs: DataFrame,
    percent: int = 85,
    key: str = "doc_id",
    text: str = "text",
    bands: int = BANDS,
    band_size: int = BAND_SIZE,
) -> DataFrame:
    """key, n_shingles, component_id (smallest key of the group), kept (whether the key is that one).

    Documents are linked if 100 * shared shingles >= ``percent`` * all shingles of the two.
    One row for each input row; rows that repeat a key are grouped by their own texts. A null,
    empty or wordless text has 0 shingles and is a group of its own. A null key never names a
    group with other keys; a group of null keys has a null component_id. Other columns are not
    looked at. The texts are read twice: for signatures, and for the candidates' full sets.
    """
    rows = checkpointed(signatures(docs, key, text, bands, band_size))
    classes = checkpointed(
        rows.where("_n > 0")
        .groupBy("_k1", "_k2")
        .agg(
            F.min("_id").alias("first_id"),
            F.min(F.struct("_id", "_x")).alias("owner"),
            F.count(F.lit(1)).alias("copies"),
            F.first("_bands").alias("_bands"),
        )
        .withColumn("node", F.monotonically_increasing_id())
    )
    banded = classes.select("node", F.explode("_bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    members = checkpointed(banded.join(shared, "band"))
    typical = members.groupBy("node").agg(F.sum("members").alias("weight"))
    members = checkpointed(members.join(typical, "node").select("node", "band", "weight"))

    owners = classes.join(typical, "node", "left_semi").select("node", "owner.*")
    texts = docs.select(docs[key].alias("_key"), docs[text].alias("_text"))
    same_row = (F.xxhash64("_text") == owners["_x"]) & F.col("_key").eqNullSafe(owners["_id"])
    sets = checkpointed(_sets_of(texts.join(owners, same_row).select("node", "_text")))
    if sets.agg((F.count("node") > F.countDistinct("node")).alias("repeated")).first()["repeated"]:
        sets = sets.dropDuplicates(["node"])

    referred = checkpointed(_references(members))
    pairs = referred.where("node <> ref").select(F.least("node", "ref").alias("a"), F.greatest("node", "ref").alias("b")).distinct()
    links = checkpointed(_confirmed(pairs, sets, percent))
    roots = components(links)
    more = checkpointed(_cross_pairs(referred, links, roots, sets, percent))
    if not more.isEmpty():
        roots = components(roots.union(_confirmed(more, sets, percent)))  # each root's star stands for its links

    grouped = classes.join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "_k1", "_k2", "first_id", "copies")
    whole = grouped.groupBy("root").agg(F.min("first_id").alias("component"), F.sum("copies").alias("size")).where("size > 1")
    named = grouped.join(whole, "root").select("_k1", "_k2", "component")
    component = F.when(F.col("named"), F.col("component")).otherwise(F.col("_id"))
    return (
        rows.select("_id", "_n", "_k1", "_k2")
        .join(named.withColumn("named", F.lit(True)), ["_k1", "_k2"], "left")
        .select(
            F.col("_id").alias(key),
            F.col("_n").alias("n_shingles"),
            F.when(F.col("_n") > 0, component).otherwise(F.col("_id")).alias("component_id"),
        )
        .withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
    )


def one_of_each_group(docs: DataFrame, percent: int = 85, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, of the documents that ``near_duplicate_groups`` keeps.

    Rows that repeat a kept key count as one document if their texts are equal; one of them stays.
    """
    its_key, its_rows = absent_names(docs, "__kept", "__rows")
    groups = near_duplicate_groups(docs, percent, key, text)
    kept = checkpointed(groups.where("kept").groupBy(F.col(key).alias(its_key)).agg(F.count(F.lit(1)).alias(its_rows)))
    columns = [docs[c] for c in docs.columns]
    joined = docs.join(kept, docs[key].eqNullSafe(kept[its_key]))
    single = joined.where(kept[its_rows] == 1).select(*columns)
    repeated = joined.where(kept[its_rows] > 1).select(*columns).dropDuplicates([key, text])
    return single if kept.where(F.col(its_rows) > 1).isEmpty() else single.union(repeated)
