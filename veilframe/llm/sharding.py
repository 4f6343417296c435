"""Sharding by balanced label propagation.

Linked documents (equal texts) should share a shard, and all shards hold the same number of
documents, give or take one. Documents begin in shards drawn by hash. In each round a group's
documents move towards the shards that already hold most of the group, as far as the shards'
quotas admit; documents without links fill what is left. Rounds work on counts per group and
shard, never on pairs of documents.

Shares of full shards leave small groups cut whose main shard has no room. So groups that are
still cut, and small groups out of overfull shards, then move as a whole to shards drawn by their
free places, until no group can be mended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import checkpointed

SHARDS = 40
ROUNDS = 4
MENDING_ROUNDS = 40  # far above what mending needs: each round halves the cut groups or so
OVERHEAD = 16  # bytes of a row beside its text
GROUP = ["_h", "_c", "_l"]


def _placed(units: DataFrame) -> DataFrame:
    """Documents of each group in each shard, with the shard's place in the group's order."""
    held = units.groupBy(*GROUP, "shard").agg(F.sum("docs").alias("held"))
    order = Window.partitionBy(*GROUP).orderBy(F.desc("held"), F.xxhash64(*GROUP, "shard"))
    return held.withColumn("place", F.row_number().over(order)).withColumn("group_docs", F.sum("held").over(Window.partitionBy(*GROUP)))


def propagate(units: DataFrame, quota: int, rounds: int = ROUNDS) -> DataFrame:
    """Move units towards their groups' main shards.

    ``units`` has the group's columns, ``first`` (shard drawn), ``docs`` and ``shard``; a group has at
    most one unit for each shard, so windows over a group are bounded by the number of shards. A
    group needs ceil(docs / quota) shards; its fullest ones are its main shards, and units in others
    ask to move to one of them. A shard admits requests up to the places that its staying units
    leave: those of the largest pull first, the last class by hash. Requests are counted by class,
    not ranked one by one. Units that are not admitted stay over quota until a later round.
    """
    for _ in range(rounds):
        placed = checkpointed(_placed(units))
        needed = F.ceil(F.col("group_docs") / F.lit(quota))
        main = placed.where(F.col("place") <= needed).select(*GROUP, F.col("shard").alias("target"), F.col("place").alias("turn"), F.col("held").alias("pull"))
        asking = (
            units.join(placed.select(*GROUP, "shard", "place", needed.alias("needed")), [*GROUP, "shard"])
            .where(F.col("place") > F.col("needed"))
            .withColumn("turn", ((F.col("place") - 1) % F.col("needed") + 1).cast("int"))
        )
        asking = asking.join(main, [*GROUP, "turn"]).withColumn("class", F.floor(F.log2("pull") * 2).cast("int"))
        requests = checkpointed(asking.select(*GROUP, "first", "docs", "target", "class"))
        leaving = requests.select(*GROUP, "first", F.lit(True).alias("leaving"))
        staying = units.join(leaving, [*GROUP, "first"], "left").where("leaving is null")
        load = staying.groupBy("shard").agg(F.sum("docs").alias("load"))
        upward = Window.partitionBy("target").orderBy(F.desc("class"))
        asked = requests.groupBy("target", "class").agg(F.sum("docs").alias("asked")).withColumn("until", F.sum("asked").over(upward))
        free = F.greatest(F.lit(quota) - F.coalesce("load", F.lit(0)), F.lit(0))
        admitted = asked.join(load, asked["target"] == load["shard"], "left").select(
            "target", "class", ((free - (F.col("until") - F.col("asked"))) / F.col("asked")).alias("share")
        )
        draw = F.pmod(F.xxhash64(*GROUP, "first", "target"), F.lit(1 << 20)) / F.lit(float(1 << 20))
        moves = requests.join(admitted, ["target", "class"]).where(draw < F.col("share")).select(*GROUP, "first", "target")
        units = checkpointed(
            units.join(moves, [*GROUP, "first"], "left").select(*GROUP, "first", "docs", F.coalesce("target", "shard").alias("shard"))
        )
        if moves.isEmpty():
            break
    return units


def mend(units: DataFrame, shards: int, quota: int, rounds: int = MENDING_ROUNDS) -> DataFrame:
    """Move whole groups of at most ``quota`` documents that are cut, or that stand in an overfull shard, to free places.

    A shard above its quota gives up small groups by hash, about as many documents as it has too many.
    Each moving group draws a shard with a chance in proportion to the free places; the shard admits
    groups by another draw, as many as it has places for. Loads are one row for each shard.
    """
    for number in range(rounds):
        held = units.groupBy(*GROUP, "shard").agg(F.sum("docs").alias("held"))
        groups = checkpointed(
            held.groupBy(*GROUP).agg(F.sum("held").alias("docs"), F.count(F.lit(1)).alias("parts"), F.max_by("shard", F.struct("held", "shard")).alias("home"))
        )
        small = F.col("docs") <= quota
        # Per shard: documents of groups, and those of whole small groups in it. Both are bounded by the shards.
        loads = {r["shard"]: r["held"] for r in held.groupBy("shard").agg(F.sum("held").alias("held")).collect()}
        whole = {r["home"]: r["docs"] for r in groups.where(small & (F.col("parts") == 1)).groupBy("home").agg(F.sum("docs").alias("docs")).collect()}
        free = [max(0, quota - loads.get(s, 0)) for s in range(shards)]
        leaving = [min(1.0, max(0, loads.get(s, 0) - quota) / whole[s]) if whole.get(s) else 0.0 for s in range(shards)]
        if not sum(free):
            break

        def draw(name: str, number: int = number) -> Column:
            return F.pmod(F.xxhash64(*GROUP, F.lit(f"{name}{number}")), F.lit(1 << 30)) / F.lit(float(1 << 30))

        gone = F.get(F.array(*[F.lit(x) for x in leaving]), F.col("home"))
        moving = groups.where(small & ((F.col("parts") > 1) | (draw("leave") < gone)))
        edges = [sum(free[:s]) / sum(free) for s in range(shards)]
        targets = [s for s in range(shards) if free[s]]
        moving = moving.withColumn("target", _steps([edges[s] for s in targets], targets, draw("target")))
        moving = checkpointed(moving.select(*GROUP, "docs", "target", draw("admit").alias("admit")))
        asked = {r["target"]: r["docs"] for r in moving.groupBy("target").agg(F.sum("docs").alias("docs")).collect()}
        if not asked:
            break
        share = [free[s] / asked[s] if asked.get(s) else 0.0 for s in range(shards)]
        admitted = moving.where(F.col("admit") < F.get(F.array(*[F.lit(x) for x in share]), F.col("target"))).select(*GROUP, "target")
        units = checkpointed(units.join(admitted, GROUP, "left").select(*GROUP, "first", "docs", F.coalesce("target", "shard").alias("shard")))
    return units


def _ranked(rows: DataFrame) -> DataFrame:
    """Rows with ``rank``, 0, 1, ... within each wanted shard, in the order of the group and key.

    The rows are sorted across all partitions by range; ranks follow from each partition's count,
    of which there is one small row per partition.
    """
    # A repeated key is told apart by a hash of its place, so that no equal rows pile up in one range.
    order = ["wanted", *GROUP, "_key", "_apart"]
    rows = rows.withColumn("_apart", F.xxhash64(F.monotonically_increasing_id()))
    ordered = checkpointed(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    )
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    ordered = ordered.withColumns({"_part": part, "_place": place})
    counts = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("many"))
    before = counts.withColumn("before", F.sum("many").over(Window.orderBy("_part")) - F.col("many")).select("_part", "before")
    starts = ordered.groupBy("wanted").agg(F.count(F.lit(1)).alias("many"))
    starts = starts.withColumn("start", F.sum("many").over(Window.orderBy("wanted")) - F.col("many")).select("wanted", "start")
    # One row per partition and one per shard: both are small by construction.
    return (
        ordered.join(F.broadcast(before), "_part")
        .join(F.broadcast(starts), "wanted")
        .withColumn("rank", F.col("before") + F.col("_place") - F.col("start"))
        .drop("_part", "_place", "_at", "_apart", "before", "start")
    )


def _steps(table: list, values: list[int], at: Column) -> Column:
    """Value of the last step that is not above ``at``."""
    chosen = F.lit(values[0])
    for edge, value in zip(table[1:], values[1:], strict=True):
        chosen = F.when(at >= F.lit(edge), F.lit(value)).otherwise(chosen)
    return chosen


def shard_documents(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """key, size, text_crc32, law (``rows``), shard, slot (0, 1, ... in the shard), grown_shard (null).

    Documents with equal texts are linked; a null text is linked with nothing and has no checksum.
    Every row is placed, repeated ones and null keys too; how the table is split into files or
    partitions does not matter. Shards hold floor or ceil of the rows
    divided by the shards. The work moves no text. Other columns are not looked at.
    """
    size = (F.coalesce(F.octet_length(docs[text]), F.lit(0)) + F.lit(OVERHEAD)).cast("long")
    thin = checkpointed(
        docs.select(
            docs[key].alias("_key"),
            size.alias("size"),
            F.crc32(docs[text].cast("binary")).alias("_c"),
            F.xxhash64(docs[text]).alias("_h"),
            F.octet_length(docs[text]).alias("_l"),
        ).withColumn("first", F.pmod(F.xxhash64("_key", "_h"), F.lit(shards)).cast("int"))
    )
    total = thin.count()
    quota, more = divmod(total, shards)
    cells = thin.where("_l is not null").groupBy(*GROUP, "first").agg(F.count(F.lit(1)).alias("docs"))
    linked = cells.groupBy(*GROUP).agg(F.sum("docs").alias("group_docs")).where("group_docs > 1").select(*GROUP)
    units = checkpointed(cells.join(linked, GROUP).withColumn("shard", F.col("first")))
    units = mend(propagate(units, max(quota, 1), rounds), shards, max(quota, 1))

    wanted = F.coalesce("shard", F.lit(shards))  # one past the last: no wish
    placed = thin.join(units.select(*GROUP, "first", "shard"), [*GROUP, "first"], "left").withColumn("wanted", wanted).drop("first", "shard")
    ranked = _ranked(placed)
    counted = {r["wanted"]: r["many"] for r in units.groupBy(F.col("shard").alias("wanted")).agg(F.sum("docs").alias("many")).collect()}
    room = [quota + (s < more) for s in range(shards)] + [0]
    load = [counted.get(s, 0) for s in range(shards)]
    load.append(total - sum(load))
    surplus = [max(0, n - r) for n, r in zip(load, room, strict=True)]
    free = [max(0, r - n) for n, r in zip(load, room, strict=True)][:shards]
    kept = [min(n, r) for n, r in zip(load, room, strict=True)]
    # Rows beyond their shard's room go, in order, to the free places of all shards, in order.
    spare_at = [sum(surplus[:s]) - room[s] for s in range(shards + 1)]
    takers = [s for s in range(shards) if free[s]]
    edges = [sum(free[:s]) for s in takers]
    by_wish = lambda values: F.get(F.array(*[F.lit(v).cast("long") for v in values]), F.col("wanted"))
    stays = F.col("rank") < by_wish(room)
    number = F.col("rank") + by_wish(spare_at)
    taker = _steps(edges, takers, number) if takers else F.lit(0)
    taken_from = _steps(edges, [edges[k] - kept[s] for k, s in enumerate(takers)], number) if takers else F.lit(0)
    return ranked.select(
        F.col("_key").alias(key),
        "size",
        F.col("_c").alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.when(stays, F.col("wanted")).otherwise(taker).cast("int").alias("shard"),
        F.when(stays, F.col("rank")).otherwise(number - taken_from).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
