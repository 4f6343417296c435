"""Connected components of an edge table, by union-find inside partitions and star joins across them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import batch_of, checkpointed

TASK_EDGES = 200_000  # two numbers each


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over one partition's edges; each node but the roots gets an edge to its root."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    found = [(x, find(x)) for x in parent]
    found = np.array([e for e in found if e[0] != e[1]], np.int64).reshape(-1, 2)
    yield batch_of(node=found[:, 0], root=found[:, 1])


def components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, root) for every node that an edge touches and that is not itself a root.

    ``edges`` has two non-null long columns; direction, repeats and loops do not matter. The root
    is the smallest node of the component. Each round hooks neighbours to their minimum, first
    towards larger and then towards smaller nodes, so the edges never get more than they were,
    and a long chain halves. Once no more than ``task_edges`` are left, one task takes them all. An
    empty table has no rows.
    """
    stars = checkpointed(edges.toDF("node", "root").mapInArrow(_forest, "node bigint, root bigint"))
    while stars.count() > task_edges:
        if _is_star_forest(stars):
            return stars
        both = stars.union(stars.select("root", "node"))
        least = both.groupBy("node").agg(F.min("root").alias("least"))
        larger = (
            both.join(least, "node")
            .where("root > node")
            .select(F.col("root").alias("node"), F.least("node", "least").alias("root"))
            .distinct()
        )
        least = larger.groupBy("node").agg(F.min("root").alias("least"))
        smaller = larger.join(least, "node").where("root <> least").select(F.col("root").alias("node"), F.col("least").alias("root"))
        stars = checkpointed(smaller.union(least.select("node", "least")).mapInArrow(_forest, "node bigint, root bigint"))
    return checkpointed(stars.coalesce(1).mapInArrow(_forest, "node bigint, root bigint"))


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether no node has two roots, and no root has a root."""
    sides = edges.select("node", F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("root", F.lit(0), F.lit(1)))
    wrong = sides.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)")
    return wrong.isEmpty()
