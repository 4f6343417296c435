"""MLlib's random forest, and the same forest grown on groups of rows where many rows fall into the same bins.

A forest sees a row only through its bins, label and weight. Rows that agree in these differ in what the
trees draw of them alone: a tree's bag holds a row Poisson(1) times, so n equal rows Poisson(n) times
in all. Where such rows are many they become one row with its size, and every level of all trees costs a
pass over the groups: a task adds up labels per tree, node, feature and bin, and each tree's cells meet
in one task that finds the splits of its nodes. Both are bounded by the trees, never by the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from math import ceil, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Model
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasFeaturesCol
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.operators.boosting import GAIN_PLACES, _binned, bin_edges, bin_places
from veilframe.operators.features import GROUPED_SHARE
from veilframe.operators.ranking import bucket_count
from veilframe.session import settle

LEAST_ROWS = 100_000  # below, MLlib's passes over the rows are as quick
GROUPS_PER_TASK = 20_000
MOST_BINS = 256  # bins are bytes
KNOWN_SCORES = 1 << 18  # scores of different rows that a task keeps
CELLS = "tree int, cell array<int>, zeros array<double>, ones array<double>, rows array<double>"
SPLITS = "tree int, node int, feature int, bin int, zeros double, ones double, low_zeros double, low_ones double"


@dataclass
class Tree:
    """A tree in arrays: the children of node k are ``child[k]`` and the next one. A feature of -1 marks a leaf.

    Rows whose bin is at most ``bin`` go to the first child. Nodes from ``start`` on are the latest level.
    """

    feature: np.ndarray = field(default_factory=lambda: np.full(1, -1, np.int32))
    bin: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int16))
    child: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int32))
    share: np.ndarray = field(default_factory=lambda: np.zeros(1))  # of label 1
    start: int = 0

    def grow(self, splits: pd.DataFrame) -> None:
        """A new level under the split nodes."""
        if not self.start:
            self.share[0] = splits["ones"].iloc[0] / (splits["zeros"].iloc[0] + splits["ones"].iloc[0])
        splits = splits[splits["feature"] >= 0].sort_values("node")
        node, size, more = splits["node"].to_numpy(), len(self.feature), 2 * len(splits)
        zeros, ones = (splits[c].to_numpy() for c in ("zeros", "ones"))
        low_zeros, low_ones = (splits[c].to_numpy() for c in ("low_zeros", "low_ones"))
        self.feature[node], self.bin[node] = splits["feature"], splits["bin"]
        self.child[node] = size + 2 * np.arange(len(node))
        high_zeros, high_ones = zeros - low_zeros, ones - low_ones
        shares = np.stack([low_ones / (low_zeros + low_ones), high_ones / (high_zeros + high_ones)], axis=1).reshape(-1)
        self.feature = np.concatenate([self.feature, np.full(more, -1, np.int32)])
        self.bin = np.concatenate([self.bin, np.zeros(more, np.int16)])
        self.child = np.concatenate([self.child, np.zeros(more, np.int32)])
        self.share = np.concatenate([self.share, shares])
        self.start = size

    def prune(self) -> None:
        """Two leaves that predict the same label become one, as MLlib's trees have it."""
        for node in np.flatnonzero(self.feature >= 0)[::-1]:
            leaves = slice(self.child[node], self.child[node] + 2)
            if (self.feature[leaves] < 0).all() and len(set(self.share[leaves] > 0.5)) == 1:
                self.feature[node] = -1

    def node_of(self, bins: np.ndarray) -> np.ndarray:
        """The node without children that each row reaches."""
        node, every = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while True:
            feature = self.feature[node]
            inner = feature >= 0
            if not inner.any():
                return node
            above = bins[every, np.maximum(feature, 0)] > self.bin[node]
            node = np.where(inner, self.child[node] + above, node)


@dataclass(frozen=True)
class Plan:
    """What growing needs to know; ``kept`` features are tried at each node."""

    seed: int
    features: int
    bins: int
    kept: int
    depth: int
    least_rows: int
    least_gain: float
    bootstrap: bool
    rate: float

    def draws(self, group: bytes, rows: int, trees: int) -> np.ndarray:
        """How often each tree's bag holds one of the group's rows: the sum of a Poisson draw for each of them."""
        if not self.bootstrap:
            return np.full(trees, float(rows))
        token = int.from_bytes(hashlib.blake2b(group, digest_size=8).digest(), "big")
        return np.random.default_rng([self.seed % 2**64, token]).poisson(rows * self.rate, trees).astype(float)

    def tried(self, number: int, tree: Tree) -> np.ndarray:
        """Features that each node of the tree's latest level may split on."""
        width = len(tree.feature) - tree.start
        drawn = np.random.default_rng([self.seed % 2**64, number, tree.start]).random((width, self.features))
        return np.sort(np.argsort(drawn, axis=1)[:, : self.kept], axis=1)


def cell_sums(groups: DataFrame, trees: Sequence[Tree], open_trees: Sequence[int], plan: Plan) -> DataFrame:
    """For each tree its cells (node, feature, bin) of the latest level, summed within tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        keys, label, weight, size = (table.column(c).to_pylist() for c in ("bins", "label", "weight", "n"))
        bins = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, plan.features)
        tokens = (k + np.array([y, w]).tobytes() for k, y, w in zip(keys, label, weight, strict=True))
        times = np.stack([plan.draws(t, n, len(trees)) for t, n in zip(tokens, size, strict=True)])
        label, weight = np.array(label), np.array(weight)
        for number in open_trees:
            tree = trees[number]
            node, tried = tree.node_of(bins), plan.tried(number, tree)
            there = (node >= tree.start) & (times[:, number] > 0)
            at, drawn, one = node[there] - tree.start, times[there, number], label[there] >= 0.5
            place = bins[there][np.arange(len(at))[:, None], tried[at]]
            cell = ((at[:, None] * plan.kept + np.arange(plan.kept)) * plan.bins + place).reshape(-1)
            parts = [drawn * weight[there] * ~one, drawn * weight[there] * one, drawn]
            sums = [np.bincount(cell, np.repeat(p, plan.kept), len(tried) * plan.kept * plan.bins) for p in parts]
            found = np.flatnonzero(sums[2])
            if not len(found):
                continue
            held = [pa.array([s[found]], pa.list_(pa.float64())) for s in sums]
            arrays = [pa.array([number], pa.int32()), pa.array([found.astype(np.int32)], pa.list_(pa.int32())), *held]
            yield pa.RecordBatch.from_arrays(arrays, names=["tree", "cell", "zeros", "ones", "rows"])

    return groups.mapInArrow(run, CELLS)


def _impurity(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    total = np.maximum(zeros + ones, 1e-300)
    return 1 - (zeros / total) ** 2 - (ones / total) ** 2


def best_splits(cells: pd.DataFrame, trees: Sequence[Tree], plan: Plan) -> pd.DataFrame:
    """The split of each node of one tree that lowers the Gini impurity most, if any does; the first feature and bin win ties."""
    number = int(cells["tree"].iloc[0])
    tried = plan.tried(number, trees[number])
    shape = (len(tried), plan.kept, plan.bins)
    place = np.concatenate(cells["cell"].to_list())
    sums = [np.bincount(place, np.concatenate(cells[c].to_list()), np.prod(shape)).reshape(shape) for c in ("zeros", "ones", "rows")]
    low = [s.cumsum(axis=2) for s in sums]
    whole = [s[:, :, -1:] for s in low]
    high = [w - s for w, s in zip(whole, low, strict=True)]
    total = np.maximum(whole[0] + whole[1], 1e-300)
    gain = _impurity(whole[0], whole[1])
    for zeros, ones, _ in (low, high):
        gain = gain - (zeros + ones) / total * _impurity(zeros, ones)
    usable = (low[2] >= max(plan.least_rows, 1)) & (high[2] >= max(plan.least_rows, 1))
    gain = np.where(usable, gain.round(GAIN_PLACES), 0.0).reshape(len(tried), -1)
    best = gain.argmax(axis=1)
    worth = (gain.max(axis=1) > 0) & (gain.max(axis=1) >= plan.least_gain)
    node = np.flatnonzero(worth | (trees[number].start == 0))  # the root's row tells its labels even if it is a leaf
    slot, at = np.divmod(best[node], plan.bins)
    columns = {"tree": number, "node": node + trees[number].start, "feature": np.where(worth[node], tried[node, slot], -1), "bin": at}
    columns |= {"zeros": whole[0][node, slot, 0], "ones": whole[1][node, slot, 0]}
    return pd.DataFrame(columns | {"low_zeros": low[0][node, slot, at], "low_ones": low[1][node, slot, at]})


def grow_forest(groups: DataFrame, count: int, plan: Plan, share: float) -> list[Tree]:
    """``count`` trees, all grown by a level in one pass over the groups; ``share`` of label 1 is that of a tree without splits."""
    trees, open_trees = [Tree(share=np.full(1, share)) for _ in range(count)], list(range(count))
    for _ in range(plan.depth):
        cells = cell_sums(groups, trees, open_trees, plan)
        found = cells.groupBy("tree").applyInPandas(lambda part: best_splits(part, trees, plan), SPLITS).toPandas()
        for number, splits in found.groupby("tree"):
            trees[number].grow(splits)
        open_trees = sorted(found.loc[found["feature"] >= 0, "tree"].unique().tolist())
        if not open_trees:
            break
    for tree in trees:
        tree.prune()
    return trees


class GroupedForest(RandomForestClassifier):
    """A random forest that passes rows of the same bins, label and weight as one row where they are many."""

    def _fit(self, dataset: DataFrame):
        label, weight = F.col(self.getLabelCol()).cast("double"), F.lit(1.0)
        if self.isDefined(self.weightCol) and self.getWeightCol():
            weight = F.col(self.getWeightCol()).cast("double")
        vector = vector_to_array(self.getFeaturesCol())
        first = dataset.select(F.size(vector).alias("n")).first()
        most = self.getMaxBins()
        subsets = {"sqrt": lambda n: ceil(sqrt(n)), "all": lambda n: n}
        strategy = self.getFeatureSubsetStrategy()
        if first is None or most > MOST_BINS or strategy not in subsets or (not self.getBootstrap() and self.getSubsamplingRate() < 1):
            return super()._fit(dataset)
        if dataset.count() < LEAST_ROWS:
            return super()._fit(dataset)
        rows = dataset.select(vector.alias("values"), label.alias("label"), weight.alias("weight"))
        edges = bin_edges(rows, "values", first["n"], most)
        same = rows.withColumn("bins", _binned(F.col("values"), edges)).groupBy("bins", "label", "weight")
        groups = settle(same.agg(F.count(F.lit(1)).alias("n")))
        found = groups.agg(
            F.count("*").alias("groups"), F.sum("n").alias("rows"), F.max("label").alias("largest"),
            (F.sum(F.col("n") * F.col("weight") * F.col("label")) / F.sum(F.col("n") * F.col("weight"))).alias("share"),
        ).first()
        if found["rows"] < GROUPED_SHARE * found["groups"] or found["largest"] > 1:
            return super()._fit(dataset)
        plan = Plan(
            self.getSeed(), first["n"], max(len(e) + 1 for e in edges), subsets[strategy](first["n"]), self.getMaxDepth(),
            self.getMinInstancesPerNode(), self.getMinInfoGain(), self.getBootstrap(), self.getSubsamplingRate(),
        )
        dealt = groups.repartition(bucket_count(found["groups"], GROUPS_PER_TASK)).persist(StorageLevel.MEMORY_AND_DISK)
        trees = grow_forest(dealt, self.getNumTrees(), plan, found["share"])
        dealt.unpersist()
        return GroupedForestModel(trees, edges, self.getFeaturesCol())


class GroupedForestModel(Model, HasFeaturesCol):
    """Adds rawPrediction, probability and prediction: the mean of the label shares in the leaves."""

    def __init__(self, trees: Sequence[Tree] = (), edges: Sequence[Sequence[float]] = (), featuresCol: str = "features"):
        super().__init__()
        self._set(featuresCol=featuresCol)
        self.trees, self.edges = list(trees), [list(e) for e in edges]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        trees, ends = self.trees, [np.array(e, np.float64) for e in self.edges]

        @F.pandas_udf("double")
        def chance(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            known: dict[bytes, float] = {}
            for batch in batches:
                if batch.empty:
                    yield pd.Series([], dtype=float)
                    continue
                keys = [row.tobytes() for row in bin_places(batch, ends)]
                if len(known) > KNOWN_SCORES:
                    known.clear()
                fresh = list({k for k in keys if k not in known})
                if fresh:
                    bins = np.frombuffer(b"".join(fresh), np.uint8).reshape(len(fresh), -1)
                    known.update(zip(fresh, np.mean([tree.share[tree.node_of(bins)] for tree in trees], axis=0), strict=True))
                yield pd.Series([known[k] for k in keys])

        scored = dataset.withColumn("__chance", chance(vector_to_array(self.getFeaturesCol())))
        p, votes = F.col("__chance"), F.lit(float(len(trees)))
        return scored.withColumns(
            {
                "rawPrediction": array_to_vector(F.array((F.lit(1.0) - p) * votes, p * votes)),
                "probability": array_to_vector(F.array(F.lit(1.0) - p, p)),
                "prediction": (p > 0.5).cast("double"),
            }
        ).drop("__chance")
