"""Second-order gradient boosting for the 0/1 label: histogram trees on Newton gains.

Each round fits a tree to the gradients and curvatures of the log loss (Friedman 2001; Chen and
Guestrin 2016). Rows stay where they are: a pass adds up gradients and curvatures per tree node,
feature and value bin inside the tasks. The cells of all tasks are summed by the driver, by Spark
where they are many, and where even the sums are many (thousands of features) windows over bins
find the splits in Spark too; the driver then sees one row for each node. Margins are kept with the
rows, but for those of the latest rounds, so a round costs one pass for each level of its tree.
Rows of the same label and bins have the same margin. Where they are many they become one row that
knows how often each round draws it, so the table itself is passed once in SETTLE_ROUNDS rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter, HasSeed, HasStepSize
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilframe.functions.draws import Draws
from veilframe.operators.features import worth_grouping
from veilframe.session import settle

MOST_BINS = 256  # bins are bytes
PENALTY = 1.0  # added to each node's curvature
LEAST_CURVATURE = 1.0  # of a child
LEAST_GAIN = 1e-6
GAIN_PLACES = 9  # gains that agree to so many places are ties, which the first feature and bin win
SETTLE_ROUNDS = 10  # rounds after which the rows are written with their margins
DRIVER_CELLS = 1 << 22  # cells that the driver reads at most; beyond, the splits are found in Spark


@dataclass
class Tree:
    """A complete binary tree in arrays: node k has the children 2k + 1 and 2k + 2. A feature of -1 marks a leaf.

    Rows whose bin is at most ``bin``, or whose value is at most ``edge``, go to the first child.
    """

    depth: int
    feature: np.ndarray = field(init=False)
    bin: np.ndarray = field(init=False)
    edge: np.ndarray = field(init=False)
    gain: np.ndarray = field(init=False)
    gradient: np.ndarray = field(init=False)
    curvature: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        size = 2 ** (self.depth + 1) - 1
        self.feature, self.bin = np.full(size, -1), np.zeros(size, np.int64)
        self.edge, self.gain, self.gradient, self.curvature = (np.zeros(size) for _ in range(4))

    def split(self, node: int, row, edge: float) -> None:
        self.feature[node], self.bin[node], self.edge[node], self.gain[node] = row["feature"], row["bin"], edge, row["gain"]
        self.gradient[node], self.curvature[node] = row["g"], row["h"]
        self.gradient[2 * node + 1], self.curvature[2 * node + 1] = row["g_low"], row["h_low"]
        self.gradient[2 * node + 2], self.curvature[2 * node + 2] = row["g"] - row["g_low"], row["h"] - row["h_low"]

    def values(self, rate: float) -> np.ndarray:
        """Newton steps of all nodes, shrunk by the learning rate."""
        return -rate * self.gradient / (self.curvature + PENALTY)

    def node_of(self, columns: np.ndarray, levels: int, limits: np.ndarray) -> np.ndarray:
        """Node that each row reaches after ``levels`` steps; rows are compared with ``limits`` by node."""
        node, every = np.zeros(len(columns), np.int64), np.arange(len(columns))
        for _ in range(levels):
            feature = self.feature[node]
            above = columns[every, np.maximum(feature, 0)] > limits[node]
            node = np.where(feature >= 0, 2 * node + 1 + above, node)
        return node


def bin_edges(values: DataFrame, column: str, features: int, most: int = MOST_BINS) -> list[list[float]]:
    """Upper ends of each feature's bins but the last: its distinct values, or quantiles where they are too many."""
    item = F.posexplode(column).alias("feature", "value")
    distinct = values.select(item).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    first = F.row_number().over(Window.partitionBy("feature").orderBy("value"))
    few = distinct.withColumn("place", first).where(F.col("place") <= most)
    found: list[list[float]] = [[] for _ in range(features)]
    for row in few.groupBy("feature").agg(F.sort_array(F.collect_list("value")).alias("values")).collect():
        found[row["feature"]] = list(row["values"])
    many = [f for f in range(features) if len(found[f]) == most]
    shares = [i / most for i in range(1, most)]
    if many:
        quantiles = values.agg(*[F.percentile_approx(F.col(column)[f], shares, 10_000).alias(f"q{f}") for f in many]).first()
        for f in many:
            found[f] = [*sorted(set(quantiles[f"q{f}"])), np.inf]
    return [edges[:-1] for edges in found]


def bin_places(batch: pd.Series, ends: Sequence[np.ndarray]) -> np.ndarray:
    """Bins of the rows of arrays, as bytes."""
    values = np.stack(batch.to_numpy())
    bins = np.stack([np.searchsorted(e, values[:, k], side="left") for k, e in enumerate(ends)], axis=1)
    return bins.astype(np.uint8)


def _binned(vector: Column, edges: Sequence[Sequence[float]]) -> Column:
    ends = [np.array(e, np.float64) for e in edges]

    @F.pandas_udf("binary")
    def place(batch: pd.Series) -> pd.Series:
        if batch.empty:
            return pd.Series([], dtype=object)
        return pd.Series([row.tobytes() for row in bin_places(batch, ends)])

    return place(vector)


def _matrix(batch: pa.RecordBatch, features: int) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("bins"))
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, features)


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy()


def _margin(batch: pa.RecordBatch, bins: np.ndarray, steps: Sequence[tuple[Tree, np.ndarray]]) -> np.ndarray:
    """The rows' margins with the steps of trees that came after they were written."""
    return sum((values[tree.node_of(bins, tree.depth, tree.bin)] for tree, values in steps), _numbers(batch, "margin"))


def cell_sums(rows: DataFrame, tree: Tree, level: int, features: int, steps: Sequence[tuple[Tree, np.ndarray]] = ()) -> DataFrame:
    """node, feature, bin, g, h: gradients and curvatures of the rows at one level of the tree, summed within tasks.

    A row with ``times`` counts so often.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, width = 2**level - 1, 2**level
        sums = np.zeros((2, width * features * MOST_BINS))
        for batch in batches:
            if not batch.num_rows:
                continue
            bins = _matrix(batch, features)
            label, times = _numbers(batch, "label"), _numbers(batch, "times") if "times" in batch.schema.names else 1.0
            chance = 1 / (1 + np.exp(-_margin(batch, bins, steps)))
            node = tree.node_of(bins, level, tree.bin)
            there = node >= start
            cell = ((node[there] - start)[:, None] * features + np.arange(features)) * MOST_BINS + bins[there]
            for k, weight in enumerate((times * (chance - label), times * chance * (1 - chance))):
                sums[k] += np.bincount(cell.reshape(-1), np.repeat(weight[there], features), sums.shape[1])
        cells = np.flatnonzero(sums[1] > 0)
        columns = (cells // MOST_BINS // features + start, cells // MOST_BINS % features, cells % MOST_BINS)
        arrays = [*[pa.array(c.astype(np.int32)) for c in columns], pa.array(sums[0][cells]), pa.array(sums[1][cells])]
        yield pa.RecordBatch.from_arrays(arrays, names=["node", "feature", "bin", "g", "h"])

    return rows.mapInArrow(run, "node int, feature int, bin int, g double, h double")


def best_splits(cells: DataFrame, allowed: Sequence[int]) -> DataFrame:
    """The split with the largest gain for each node, if any gain is worth it; the first feature and bin win ties."""
    dealt = cells.where(F.col("feature").isin(list(allowed))).repartition("node", "feature")  # one exchange serves the sums and the windows
    summed = dealt.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    column = Window.partitionBy("node", "feature")
    upto = column.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lower = summed.select(
        "node", "feature", "bin",
        F.sum("g").over(upto).alias("g_low"), F.sum("h").over(upto).alias("h_low"), F.sum("g").over(column).alias("g"), F.sum("h").over(column).alias("h"),
    )

    def worth(g: Column, h: Column) -> Column:
        return g * g / (h + F.lit(PENALTY))

    g_high, h_high = F.col("g") - F.col("g_low"), F.col("h") - F.col("h_low")
    gain = worth(F.col("g_low"), F.col("h_low")) + worth(g_high, h_high) - worth(F.col("g"), F.col("h"))
    usable = (F.col("h_low") >= LEAST_CURVATURE) & (h_high >= LEAST_CURVATURE)
    ranked = lower.withColumn("gain", F.round(gain, GAIN_PLACES)).where(usable & (F.col("gain") > LEAST_GAIN))
    order = F.struct("gain", -F.col("feature"), -F.col("bin"))
    best = F.max_by(F.struct("feature", "bin", "gain", "g_low", "h_low", "g", "h"), order)
    return ranked.groupBy("node").agg(best.alias("s")).select("node", "s.*")


def best_of_cells(cells: list, level: int, features: int, allowed: Sequence[int]) -> list[dict]:
    """``best_splits`` of cells that the driver holds; several rows of a cell are added up."""
    start, width = 2**level - 1, 2**level
    g, h = np.zeros((2, width, features, MOST_BINS))
    if cells:
        node, feature, place, part_g, part_h = (np.array(c) for c in zip(*cells, strict=True))
        np.add.at(g, (node - start, feature, place), part_g)
        np.add.at(h, (node - start, feature, place), part_h)
    g_low, h_low = g.cumsum(axis=2), h.cumsum(axis=2)
    g, h = g_low[:, :, -1:], h_low[:, :, -1:]
    gain = g_low**2 / (h_low + PENALTY) + (g - g_low) ** 2 / (h - h_low + PENALTY) - g**2 / (h + PENALTY)
    usable = (h_low >= LEAST_CURVATURE) & (h - h_low >= LEAST_CURVATURE)
    usable[:, [f for f in range(features) if f not in set(allowed)]] = False
    gain = np.where(usable, gain.round(GAIN_PLACES), 0.0).reshape(width, -1)
    found = []
    for k, at in enumerate(gain.argmax(axis=1)):
        if gain[k, at] > LEAST_GAIN:
            f, b = divmod(int(at), MOST_BINS)
            totals = {"g_low": g_low[k, f, b], "h_low": h_low[k, f, b], "g": g[k, f, 0], "h": h[k, f, 0]}
            found.append({"node": start + k, "feature": f, "bin": b, "gain": gain[k, at], **totals})
    return found


def find_splits(cells: DataFrame, level: int, features: int, allowed: Sequence[int], partitions: int, most: int = DRIVER_CELLS) -> list:
    """Best splits of one level, one row for each node. Few cells are summed by the driver, more by Spark."""
    bound = 2**level * features * MOST_BINS
    if bound > most:
        return best_splits(cells, allowed).collect()
    if bound * partitions > most:
        cells = cells.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    return best_of_cells(cells.collect(), level, features, allowed)


def chosen_features(draws: Draws, number: int, names: Sequence[str], share: float) -> list[int]:
    """Features that round ``number`` may split on: a keyed draw of ``share`` of them."""
    drawn = sorted(range(len(names)), key=lambda k: hashlib.sha256(f"{draws.seed}:boost:columns{number}:{names[k]}".encode()).hexdigest())
    return sorted(drawn[: max(1, int(share * len(names)))])


def grow_tree(
    rows: DataFrame,
    depth: int,
    edges: Sequence[Sequence[float]],
    allowed: Sequence[int],
    partitions: int,
    steps: Sequence[tuple[Tree, np.ndarray]] = (),
    most: int = DRIVER_CELLS,
) -> Tree:
    """One tree on the gradients at the rows' margins, moved by ``steps``."""
    tree = Tree(depth)
    for level in range(depth):
        cells = cell_sums(rows, tree, level, len(edges), steps)
        splits = find_splits(cells, level, len(edges), allowed, partitions, most)
        if not splits:
            break
        for row in splits:
            tree.split(row["node"], row, edges[row["feature"]][row["bin"]])
    return tree


def _stepped(rows: DataFrame, steps: Sequence[tuple[Tree, np.ndarray]], features: int) -> DataFrame:
    """Rows with their margins moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                moved = pa.array(_margin(batch, _matrix(batch, features), steps))
                yield batch.set_column(batch.schema.get_field_index("margin"), "margin", moved)

    return rows.mapInArrow(run, rows.schema)


def boost(
    df: DataFrame,
    features: Column,
    names: Sequence[str],
    rounds: int,
    depth: int,
    rate: float,
    row_share: float = 1.0,
    feature_share: float = 1.0,
    draws: Draws | None = None,
    label: str = "label",
    row_id: str = "row_id",
) -> list[Tree]:
    """Trees of ``rounds`` rounds on the array column ``features``; each round draws its rows by ``row_id``.

    An empty table or a label with one value gives trees that split nothing. Margins are written
    every SETTLE_ROUNDS rounds, with what the next ones draw of each group; between, each pass adds
    the steps of the latest few trees itself, so plans stay short and a lost executor costs a read.
    """
    if not names:
        return []
    draws = draws or Draws()
    values = df.select(F.col(row_id).cast("bigint").alias("row_id"), F.col(label).cast("double").alias("label"), features.alias("values"))
    edges = bin_edges(values, "values", len(names))
    rows = values.select("row_id", "label", _binned(F.col("values"), edges).alias("bins"), F.lit(0.0).alias("margin"))
    rows = settle(rows).persist(StorageLevel.MEMORY_AND_DISK)
    grouped = worth_grouping(rows, "label", "bins")

    def drawn(number: int) -> Column:
        return draws.below("boost", f"rows{number}", F.col("row_id"), row_share)

    work, trees, steps, before = rows, [], [], []
    for number in range(rounds):
        if number % SETTLE_ROUNDS == 0 and (grouped or number):
            if grouped:  # all earlier trees' steps are few for groups
                before += steps
                turns = range(number, min(number + SETTLE_ROUNDS, rounds))
                groups = rows.groupBy("label", "bins", "margin").agg(F.array(*[F.count_if(drawn(k)) for k in turns]).alias("drawn"))
                moved = settle(_stepped(groups, before, len(names)))
            else:
                moved = settle(_stepped(work, steps, len(names)))
            moved.persist(StorageLevel.MEMORY_AND_DISK)
            if work is not rows or not grouped:
                work.unpersist()
            work, steps = moved, []
        if grouped:
            sample = work.select("label", "bins", "margin", F.col("drawn")[number % SETTLE_ROUNDS].cast("double").alias("times")).where("times > 0")
        else:
            sample = work if row_share >= 1 else work.where(drawn(number))
        tree = grow_tree(sample, depth, edges, chosen_features(draws, number, names, feature_share), work.rdd.getNumPartitions(), steps)
        trees.append(tree)
        if tree.feature[0] >= 0:  # else there was nothing to learn from this draw
            steps.append((tree, tree.values(rate)))
    work.unpersist()
    rows.unpersist()
    return trees


def tree_table(spark: SparkSession, tree: Tree, names: Sequence[str], rate: float) -> DataFrame:
    """node, feature and edge (null in leaves), gain, gradient, curvature and value of a tree's nodes that rows reach."""
    reached = [0]
    for node in reached:
        if tree.feature[node] >= 0:
            reached += [2 * node + 1, 2 * node + 2]
    values = tree.values(rate)
    rows = []
    for node in reached:
        split = tree.feature[node] >= 0
        shown = (names[tree.feature[node]], float(tree.edge[node]), float(tree.gain[node])) if split else (None, None, None)
        rows.append((node, *shown, float(tree.gradient[node]), float(tree.curvature[node]), float(values[node])))
    schema = "node int, feature string, edge double, gain double, gradient double, curvature double, value double"
    return spark.createDataFrame(rows, schema)


def margins(trees: Sequence[Tree], rate: float, features: Column) -> Column:
    """Log odds of the label from the values of the array column ``features``."""
    steps = [(tree, tree.values(rate)) for tree in trees if tree.feature[0] >= 0]

    @F.pandas_udf("double")
    def total(batch: pd.Series) -> pd.Series:
        if batch.empty or not steps:
            return pd.Series(np.zeros(len(batch)))
        columns = np.stack(batch.to_numpy())
        return pd.Series(sum(values[tree.node_of(columns, tree.depth, tree.edge)] for tree, values in steps))

    return total(features)


class _BoostingParams(HasFeaturesCol, HasLabelCol, HasMaxIter, HasStepSize, HasSeed):
    maxDepth = Param(Params._dummy(), "maxDepth", "levels of a tree", TypeConverters.toInt)
    rowShare = Param(Params._dummy(), "rowShare", "share of the rows drawn for a round", TypeConverters.toFloat)
    featureShare = Param(Params._dummy(), "featureShare", "share of the features drawn for a round", TypeConverters.toFloat)


class SecondOrderBoosting(Estimator, _BoostingParams):
    """``boost`` as an MLlib estimator, so that it takes part in pipelines and grid searches."""

    def __init__(self, featuresCol="features", labelCol="label", maxIter=120, maxDepth=3, stepSize=0.08, rowShare=0.85, featureShare=0.85, seed=42):
        super().__init__()
        self._setDefault(maxDepth=3, rowShare=1.0, featureShare=1.0)
        self._set(
            featuresCol=featuresCol, labelCol=labelCol, maxIter=maxIter, maxDepth=maxDepth, stepSize=stepSize,
            rowShare=rowShare, featureShare=featureShare, seed=seed,
        )

    def _fit(self, dataset: DataFrame) -> SecondOrderBoostingModel:
        vector = vector_to_array(self.getFeaturesCol())
        first = dataset.select(F.size(vector).alias("n")).first()
        names = [str(k) for k in range(first["n"] if first else 0)]
        depth, rate = self.getOrDefault(self.maxDepth), self.getStepSize()
        trees = boost(
            dataset, vector, names, self.getMaxIter(), depth, rate,
            self.getOrDefault(self.rowShare), self.getOrDefault(self.featureShare), Draws(self.getSeed()), self.getLabelCol(),
        )
        return self._copyValues(SecondOrderBoostingModel(trees, rate))


class SecondOrderBoostingModel(Model, _BoostingParams):
    """Adds rawPrediction, probability and prediction."""

    def __init__(self, trees: Sequence[Tree] = (), rate: float = 0.1):
        super().__init__()
        self.trees, self.rate = list(trees), rate

    def _transform(self, dataset: DataFrame) -> DataFrame:
        margin = margins(self.trees, self.rate, vector_to_array(self.getFeaturesCol()))
        scored = dataset.withColumn("__margin", margin)
        chance = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("__margin")))
        return scored.withColumns(
            {
                "rawPrediction": array_to_vector(F.array(-F.col("__margin"), F.col("__margin"))),
                "probability": array_to_vector(F.array(F.lit(1.0) - chance, chance)),
                "prediction": (F.col("__margin") > 0).cast("double"),
            }
        ).drop("__margin")
