"""Quality by a sparse ensemble of rules: tree paths weighted by a lasso logistic regression.

Trees over statistics of the text are grown on a bounded labelled sample; every
path from a root to a node is a rule, a conjunction of bounds on statistics. A
lasso logistic regression on which rules hold keeps few of them, and those are
compiled into one Spark column expression.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlrisk.session import materialize

# Bounds of the fit.
SAMPLE_ROWS = 20_000
TREES = 24
DEPTH = 3


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of one whole text in its own characters, words and lines; an empty text has zeros."""
    words = F.array_remove(F.split(text, r"\s+"), "")
    lines = F.split(text, r"\n")
    n_words = F.greatest(F.size(words), F.lit(1)).cast("double")

    def per_word(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)) / n_words

    return {
        "chars": F.log1p(F.length(text)),
        "words": F.log1p(F.size(words).cast("double")),
        "word_chars": F.length(text) / n_words,
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "distinct_lines": F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1)),
        "line_words": n_words / F.greatest(F.size(lines), F.lit(1)),
        "symbols": per_word(r"[#$%&*|<>{}=~^_\\/+@]+"),
        "marks": per_word(r"[!?]+"),
        "stops": per_word(r"[.!?](?=\s|$)"),
        "digits": per_word(r"[0-9]+"),
        "capitals": per_word(r"\b\p{Lu}{2,}"),
    }


@dataclass(frozen=True)
class Rule:
    """Bounds ``(statistic, above, value)`` that must all hold, and the weight of the rule."""

    bounds: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def holds(self) -> Column:
        return reduce(lambda a, b: a & b, (F.col(c) > v if above else F.col(c) <= v for c, above, v in self.bounds))


@dataclass(frozen=True)
class RuleEnsemble:
    intercept: float
    rules: tuple[Rule, ...]

    def score(self) -> Column:
        """Probability of label 1 over the columns of :func:`with_statistics`."""
        total = F.lit(self.intercept)
        for rule in self.rules:
            total += F.when(rule.holds(), F.lit(rule.weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def with_statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text"))
    return text.select("_id", *(c.cast("double").alias(n) for n, c in statistics(F.col("_text")).items()))


def paths(description: str, names: Sequence[str]) -> set[tuple[tuple[str, bool, float], ...]]:
    """Bounds on the way to every node, from the printed form of the trees of a forest."""
    found, way = set(), []
    for line in description.splitlines():
        if line.lstrip().startswith("Tree "):
            way = []
            continue
        step = re.match(r"\s*(?:If|Else) \(feature (\d+) (<=|>) ([-+.\dEe]+)\)", line)
        if not step:
            continue
        depth = len(line) - len(line.lstrip())
        way = [w for w in way if w[0] < depth]
        way.append((depth, names[int(step[1])], step[2] == ">", float(step[3])))
        found.add(tuple(sorted({w[1:] for w in way})))
    return found


def fit_rules(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
    penalty: float = 0.002,
) -> RuleEnsemble:
    """Grow, weigh and prune rules on at most ``sample_rows`` labelled rows, chosen by hash.

    Null labels and ids are left out, of repeated ids the largest label counts.
    Sampled ids are broadcast; texts are not shuffled. With one class only, or
    none, the ensemble is a constant.
    """
    one = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(
        F.max(F.col(label_col).cast("double")).alias("_label")
    )
    share = int(min(1.0, sample_rows / max(1, one.count())) * 1_000_000)
    sample = F.broadcast(one.filter(F.pmod(F.xxhash64("_id", F.lit("sample")), F.lit(1_000_000)) < share))
    rows = materialize(with_statistics(docs.join(sample.select(F.col("_id").alias(id_col)), id_col, "left_semi"), id_col, text_col).join(sample, "_id"), "quality-sample")
    names = [c for c in rows.columns if c not in ("_id", "_label")]
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("_label").alias("k")).first()
    n, k = seen["n"], seen["k"] or 0.0
    rate = (k + 0.5) / (n + 1)
    constant = RuleEnsemble(math.log(rate / (1 - rate)), ())
    if n < 20 or k in (0.0, float(n)):
        return constant
    data = rows.withColumn("_x", array_to_vector(F.array(*names)))
    forest = RandomForestClassifier(
        featuresCol="_x", labelCol="_label", numTrees=TREES, maxDepth=DEPTH, seed=7, featureSubsetStrategy="onethird",
        subsamplingRate=0.7, minInstancesPerNode=max(5, n // 500),
    ).fit(data)
    candidates = [Rule(bounds) for bounds in sorted(paths(forest.toDebugString, names))]
    if not candidates:
        return constant
    flags = F.array(*(F.when(r.holds(), 1.0).otherwise(0.0) for r in candidates))
    fired = materialize(rows.select("_label", flags.alias("_flags")), "quality-rules")
    lasso = LogisticRegression(
        featuresCol="_x", labelCol="_label", elasticNetParam=1.0, regParam=penalty, maxIter=80, standardization=False
    ).fit(fired.withColumn("_x", array_to_vector("_flags")))
    weights = [float(w) for w in lasso.coefficients]
    kept = tuple(Rule(r.bounds, w) for r, w in zip(candidates, weights, strict=True) if w != 0.0)
    return RuleEnsemble(float(lasso.intercept), kept)


def score_quality(docs: DataFrame, ensemble: RuleEnsemble, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, statistics, score)`` of every whole text; null counts as empty, rows are independent, no shuffle."""
    scored = with_statistics(docs, id_col, text_col).withColumn("score", ensemble.score())
    return scored.withColumnRenamed("_id", id_col)
