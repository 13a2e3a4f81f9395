"""Train and evaluate the weighted random forest with MLlib."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlrisk.operators.metrics import eval_metrics
from urlrisk.operators.sample import train_test_split, with_class_weight
from urlrisk.plans.forest import RANDOM_DEPTH, RANDOM_TREES, Forest, fit_random_trees
from urlrisk.schema import FEATURES, SEED
from urlrisk.session import materialize

TREES = 100
DEPTH = 15


@dataclass(frozen=True)
class Trained:
    model: PipelineModel | Forest
    metrics: DataFrame
    importances: DataFrame
    summary: DataFrame


def fit(train: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> PipelineModel:
    """Fit on ``FEATURES`` and ``label`` with balanced class weights.

    The weighted rows are written once and read back: the fit passes over them
    for every level of the trees.
    """
    weighted = materialize(
        with_class_weight(train).select(
            *FEATURES, F.col("label").cast("double").alias("label"), "weight"
        ),
        "train",
    )
    forest = RandomForestClassifier(
        numTrees=trees,
        maxDepth=depth,
        seed=seed,
        weightCol="weight",
        featuresCol="features",
        labelCol="label",
        maxBins=256,
        maxMemoryInMB=1024,
    )
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="error")
    return Pipeline(stages=[assembler, forest]).fit(weighted)


def apply_model(model: PipelineModel | Forest, rows: DataFrame) -> DataFrame:
    """Add ``prediction`` and ``confidence``, the probability of that prediction.

    Rows whose ``status`` is not ``ok`` pass through in the same projection and
    get nulls, so a bad URL never stops a batch and no second scan is needed.
    """
    ok = F.col("status") == "ok" if "status" in rows.columns else F.lit(True)
    if isinstance(model, Forest):
        chance = F.col("_chance")
        return rows.withColumn("_chance", F.when(ok, model.probability())).select(
            *rows.columns,
            F.when(ok, (chance > 0.5).cast("int")).alias("prediction"),
            F.when(ok, F.greatest(chance, 1 - chance)).alias("confidence"),
        )
    filled = rows.withColumns({f"_{name}": F.col(name) for name in FEATURES}).withColumns(
        {name: F.when(ok, F.col(name)).otherwise(0) for name in FEATURES}
    )
    scored = model.transform(filled)
    return scored.select(
        *[F.col(f"_{name}").alias(name) if name in FEATURES else F.col(name) for name in rows.columns],
        F.when(ok, F.col("prediction").cast("int")).alias("prediction"),
        F.when(ok, F.array_max(vector_to_array("probability"))).alias("confidence"),
    )


def evaluate(model: PipelineModel | Forest, test: DataFrame) -> DataFrame:
    return eval_metrics(apply_model(model, test))


def importances(model: PipelineModel | Forest) -> DataFrame:
    """One row per feature; twelve rows, whatever the data size. Randomised trees give the share of splits."""
    from pyspark.sql import SparkSession

    if isinstance(model, Forest):
        used = model.importances()
        rows = [(name, used[name] / max(sum(used.values()), 1)) for name in FEATURES]
    else:
        weights = model.stages[-1].featureImportances
        rows = [(name, float(weights[i])) for i, name in enumerate(FEATURES)]
    return SparkSession.active().createDataFrame(rows, "feature STRING, importance DOUBLE")


def summary(model: PipelineModel | Forest, train_rows: DataFrame, test_rows: DataFrame) -> DataFrame:
    """One row: rows of both parts, phishing rows of the first, features and trees."""
    if isinstance(model, Forest):
        features, trees = len(FEATURES), len({node.tree for node in model.nodes})
    else:
        features, trees = model.stages[-1].numFeatures, model.stages[-1].getNumTrees
    parts = train_rows.select(F.lit(True).alias("_train"), "label").unionByName(test_rows.select(F.lit(False).alias("_train"), "label"))
    return parts.agg(
        F.count_if("_train").alias("n_train"),
        F.count_if(F.col("_train") & (F.col("label") == 1)).alias("n_train_phishing"),
        F.count_if(~F.col("_train")).alias("n_test"),
    ).select("*", F.lit(features).alias("n_features"), F.lit(trees).alias("n_trees"))


def train(rows: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> Trained:
    """Split by URL, fit on the train part, measure on the rest."""
    rows = materialize(rows, "training-set")
    train_rows, test_rows = train_test_split(rows, seed)
    model = fit(train_rows, trees, depth, seed)
    return Trained(model, evaluate(model, test_rows), importances(model), summary(model, train_rows, test_rows))


def train_random(rows: DataFrame, trees: int = RANDOM_TREES, depth: int = RANDOM_DEPTH, seed: int = SEED) -> Trained:
    """The same with randomised trees, which take two passes over the rows."""
    rows = materialize(rows, "training-set")
    train_rows, test_rows = train_test_split(rows, seed)
    model = fit_random_trees(train_rows, trees, depth, seed)
    return Trained(model, evaluate(model, test_rows), importances(model), summary(model, train_rows, test_rows))
