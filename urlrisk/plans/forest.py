"""Forests as node tables: one projection scores with them, and any SQL engine can.

A node table comes from a fitted MLlib forest (:func:`flatten`) or from
:func:`fit_random_trees`, whose splits follow from a seed and the range of each
feature, so that two passes over the rows give the whole forest: one for the
ranges, one that counts the classes in all leaves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urlrisk.schema import FEATURES, SEED
from urlrisk.session import new_path

NODES = "tree int, node int, feature string, threshold double, left int, right int, share double"
RANDOM_TREES = 16
RANDOM_DEPTH = 4
# Thresholds lie at sixteenths of a feature's range, leaves hold 1024ths: sums of both are exact in doubles.
STEPS = 16
LEAF_UNITS = 1024
# More nodes than this make a projection that takes longer to plan than rows to score.
MAX_NODES = 4_000


@dataclass(frozen=True)
class Node:
    """A split (go left if ``feature <= threshold``) or, without feature, a leaf with the share of class 1."""

    tree: int
    node: int
    feature: str | None
    threshold: float | None
    left: int | None
    right: int | None
    share: float | None


@dataclass(frozen=True)
class Forest:
    nodes: tuple[Node, ...]

    def probability(self) -> Column:
        """Mean over the trees of the share of class 1 in the leaf of a row."""
        if len(self.nodes) > MAX_NODES:
            raise ValueError(f"a forest of {len(self.nodes)} nodes is scored by its library, not by a projection")
        by_tree: dict[int, dict[int, Node]] = {}
        for node in self.nodes:
            by_tree.setdefault(node.tree, {})[node.node] = node

        def walk(tree: dict[int, Node], at: int) -> Column:
            node = tree[at]
            if node.feature is None:
                return F.lit(float(node.share))
            left = F.col(node.feature) <= F.lit(node.threshold)
            return F.when(left, walk(tree, node.left)).otherwise(walk(tree, node.right))

        total = None
        for _, tree in sorted(by_tree.items()):
            leaf = walk(tree, min(tree))
            total = leaf if total is None else total + leaf
        return total / F.lit(float(len(by_tree)))

    def importances(self) -> dict[str, int]:
        """How many splits use each feature."""
        used = [node.feature for node in self.nodes if node.feature]
        return {name: used.count(name) for name in FEATURES}

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(n.tree, n.node, n.feature, n.threshold, n.left, n.right, n.share) for n in self.nodes]
        return spark.createDataFrame(rows, NODES)

    def save(self, spark: SparkSession, path: str) -> None:
        self.table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")


def of_table(nodes: DataFrame) -> Forest:
    """A forest from its node table, whose size is bounded by trees and depth."""
    return Forest(tuple(Node(*row) for row in nodes.select(*(f.split()[0] for f in NODES.split(", "))).orderBy("tree", "node").collect()))


def load(spark: SparkSession, path: str) -> PipelineModel | Forest:
    """What a train job saved: a forest as node table or a pipeline of the library."""
    nodes = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/nodes")
    if nodes.getFileSystem(spark._jsc.hadoopConfiguration()).exists(nodes):
        return of_table(spark.read.parquet(f"{path}/nodes"))
    return PipelineModel.load(path)


def flatten(model: PipelineModel) -> DataFrame:
    """Node table of the library's fitted forest, read from what it saves."""
    spark = SparkSession.active()
    path = new_path(spark, "forest")
    model.stages[-1].write().save(path)
    node, names = F.col("nodeData"), F.array(*map(F.lit, FEATURES))
    inner = node["leftChild"] >= 0
    stats = node["impurityStats"]
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"),
        node["id"].alias("node"),
        F.when(inner, names[node["split"]["featureIndex"]]).alias("feature"),
        F.when(inner, node["split"]["leftCategoriesOrThreshold"][0]).alias("threshold"),
        F.when(inner, node["leftChild"]).alias("left"),
        F.when(inner, node["rightChild"]).alias("right"),
        F.when(~inner, stats[1] / (stats[0] + stats[1])).alias("share"),
    )


# ---------------------------------------------------------------- randomised trees


def random_split(tree: int, node: int, seed: int = SEED) -> tuple[str, int]:
    """Feature of an inner node and which sixteenth of its range is the threshold; nodes count from 1 as in a heap."""
    digest = hashlib.md5(f"{seed}|{tree}|{node}".encode()).digest()
    return FEATURES[digest[0] % len(FEATURES)], 1 + digest[1] % (STEPS - 1)


def leaf_share(zeros: int, ones: int, n0: int, n1: int) -> float:
    """Share of class 1 in a leaf if both classes had equal weight, in whole units; one half for an empty leaf."""
    a, b = (zeros / n0 if n0 else 0.0), (ones / n1 if n1 else 0.0)
    return int(LEAF_UNITS * b / (a + b)) / LEAF_UNITS if a + b else 0.5


def fit_random_trees(
    rows: DataFrame, trees: int = RANDOM_TREES, depth: int = RANDOM_DEPTH, seed: int = SEED, features: Sequence[str] = FEATURES
) -> Forest:
    """Trees with random splits over rows with features and ``label``; leaf shares are counted with balanced classes.

    The counts have ``trees * 2 ** depth`` rows at most and are combined before
    the shuffle. Rows without a label of 0 or 1 are left out. Without rows all
    shares are one half.
    """
    rows = rows.filter(F.col("label").isin(0, 1))
    ends = rows.agg(*(f(name).alias(f"{f.__name__}_{name}") for name in features for f in (F.min, F.max))).first()
    first_leaf = 1 << depth
    splits = {}
    for tree in range(trees):
        for node in range(1, first_leaf):
            name, step = random_split(tree, node, seed)
            low, high = ends[f"min_{name}"] or 0, ends[f"max_{name}"] or 0
            splits[tree, node] = name, low + (high - low) * step / STEPS

    def leaf(tree: int, node: int = 1) -> Column:
        if node >= first_leaf:
            return F.lit(node)
        name, threshold = splits[tree, node]
        return F.when(F.col(name) <= F.lit(float(threshold)), leaf(tree, 2 * node)).otherwise(leaf(tree, 2 * node + 1))

    leaves = F.array(*(leaf(tree) for tree in range(trees)))
    counted = (
        rows.select("label", F.posexplode(leaves).alias("tree", "leaf"))
        .groupBy("tree", "leaf")
        .agg(F.count_if(F.col("label") == 0).alias("zeros"), F.count_if(F.col("label") == 1).alias("ones"))
        .collect()
    )
    n0, n1 = (sum(row[x] for row in counted if row["tree"] == 0) for x in ("zeros", "ones"))
    shares = {(row["tree"], row["leaf"]): leaf_share(row["zeros"], row["ones"], n0, n1) for row in counted}
    nodes = [Node(tree, node, name, float(threshold), 2 * node, 2 * node + 1, None) for (tree, node), (name, threshold) in splits.items()]
    for tree in range(trees):
        for node in range(first_leaf, 2 * first_leaf):
            nodes.append(Node(tree, node, None, None, None, None, shares.get((tree, node), 0.5)))
    return Forest(tuple(nodes))
