"""Toxicity by a classifier chain: each category's model also sees the categories before it.

Categories are judged in a fixed order, the overall label last. A model is a
lasso logistic regression on which words and word beginnings occur, plus the probabilities of all
earlier categories. In training those probabilities come from models fitted on
the other folds, so later models see them as wrong as they will be on new texts.
Texts are then judged where they lie, without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlrisk.llm.arrays import Rolling, mix, slices, text_bytes, words
from urlrisk.session import materialize

# Seed words of the categories: a text with the overall label that has one of
# them is a positive of the category. The models themselves see every word.
CATEGORIES: dict[str, tuple[str, ...]] = {
    "insult": ("idiot", "moron", "stupid", "clown", "loser", "fool", "dumb"),
    "contempt": ("trash", "scum", "worthless", "garbage", "vermin", "pathetic", "disgusting", "despicable", "gross"),
}
OVERALL = "toxic"
# Bounds of the fit: labelled rows, words that the models may use, rows a word must be in.
SAMPLE_ROWS = 12_000
MAX_TERMS = 600
MIN_ROWS = 8
FOLDS = 2
# Lengths of word beginnings that are features beside whole words.
STEMS = (4, 5)


# Letters are a-z, after lower-casing, and everything beyond ASCII.
_NO_LETTER = np.ones(256, bool)
_NO_LETTER[[*range(97, 123), *range(128, 256)]] = False


def word_set(text: Column) -> Column:
    """Distinct lower-case runs of letters; null and empty texts have none."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z\x{80}-\x{10FFFF}]+")
    return F.array_remove(F.array_distinct(parts), "")


def with_stems(words: str) -> Column:
    """The words and, written with a plus, the beginnings of longer words; a beginning may repeat."""
    stems = [
        F.transform(F.filter(words, lambda w: F.length(w) > n), lambda w: F.concat(F.substring(w, 1, n), F.lit("+")))
        for n in STEMS
    ]
    return F.concat(words, *stems)


@dataclass(frozen=True)
class Link:
    """One model of the chain: weights of words, of earlier probabilities, and the intercept."""

    name: str
    intercept: float
    terms: Mapping[str, float]
    earlier: tuple[float, ...]


def sample_labels(labels: DataFrame, id_col: str, label_col: str, bound: int) -> DataFrame:
    """At most about ``bound`` labelled ids, chosen by hash; repeated ids are toxic if any row says so."""
    one = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(
        F.col(id_col).alias("_id")
    ).agg(F.max(F.col(label_col).cast("double")).alias("_label"))
    total = one.count()
    share = int(min(1.0, bound / max(1, total)) * 1_000_000)
    return one.filter(F.pmod(F.xxhash64("_id", F.lit("sample")), F.lit(1_000_000)) < share)


def _fit(rows: DataFrame, label: str) -> LogisticRegression:
    model = LogisticRegression(
        featuresCol="_features", labelCol=label, elasticNetParam=1.0, regParam=0.0007, maxIter=20, standardization=False,
        aggregationDepth=2, maxBlockSizeInMB=4.0
    )
    return model.fit(rows)


def fit_chain(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    categories: Mapping[str, Sequence[str]] = CATEGORIES,
    sample_rows: int = SAMPLE_ROWS,
    max_terms: int = MAX_TERMS,
) -> list[Link]:
    """Fit the chain on at most ``sample_rows`` labelled rows.

    The sampled ids, at most ``sample_rows`` numbers, are broadcast; texts are
    not shuffled. Without labelled rows, or for a category without positives,
    the link is a constant.
    """
    sample = F.broadcast(sample_labels(labels, id_col, label_col, sample_rows))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(sample, "_id")
    rows = rows.select("_id", "_label", word_set(F.col("_text")).alias("_words"))
    for name, seeds in categories.items():
        hit = F.arrays_overlap("_words", F.array(*map(F.lit, seeds))) & (F.col("_label") > 0)
        rows = rows.withColumn(f"_y_{name}", F.when(hit, 1.0).otherwise(0.0))
    rows = rows.withColumn(f"_y_{OVERALL}", F.col("_label")).withColumn("_fold", F.pmod(F.xxhash64("_id"), F.lit(FOLDS)))
    # Written before the words are used several times over, or each use would split the text again.
    rows = materialize(rows, "toxicity-sample").withColumn("_terms", F.array_distinct(with_stems("_words")))
    names = [*categories, OVERALL]
    sums = rows.agg(F.count(F.lit(1)).alias("n"), *(F.sum(f"_y_{c}").alias(c) for c in names)).first()
    n = sums["n"]
    rate = {c: ((sums[c] or 0.0) + 0.5) / (n + 1) for c in names}
    terms = _terms(rows, rate[OVERALL], max_terms)
    if not terms:
        return [Link(c, math.log(rate[c] / (1 - rate[c])), {}, (0.0,) * k) for k, c in enumerate(names)]
    counted = CountVectorizerModel.from_vocabulary(terms, inputCol="_terms", outputCol="_x").setBinary(True)
    kept = ["_id", "_fold", "_x", *(f"_y_{c}" for c in names)]
    data = materialize(counted.transform(rows).select(*kept).coalesce(4), "toxicity-terms")
    chain: list[Link] = []
    for k, name in enumerate(names):
        label = f"_y_{name}"
        earlier = [f"_p_{c}" for c in names[:k]]
        seen = VectorAssembler(inputCols=["_x", *earlier], outputCol="_features").transform(data)
        enough = seen.filter(F.col(label) > 0).groupBy("_fold").count().count() > 1 and sums[name] < n
        if enough:
            model = _fit(seen, label)
            weights = [float(w) for w in model.coefficients]
            chain.append(
                Link(
                    name,
                    float(model.intercept),
                    {t: w for t, w in zip(terms, weights, strict=False) if w != 0.0},
                    tuple(weights[len(terms) :]),
                )
            )
        else:
            chain.append(Link(name, math.log(rate[name] / (1 - rate[name])), {}, (0.0,) * k))
        if k + 1 < len(names):
            guess = F.lit(rate[name])
            if enough:
                parts = []
                for fold in range(FOLDS):
                    fitted = _fit(seen.filter(F.col("_fold") != fold), label).setProbabilityCol("_probability")
                    told = fitted.transform(seen.filter(F.col("_fold") == fold))
                    parts.append(told.withColumn(f"_p_{name}", vector_to_array("_probability")[1]).select(*data.columns, f"_p_{name}"))
                following = parts[0]
                for part in parts[1:]:
                    following = following.unionByName(part)
                following = materialize(following, "toxicity-fold")
            else:
                following = data.withColumn(f"_p_{name}", guess)
            data = following
    return chain


def _terms(rows: DataFrame, rate: float, bound: int) -> list[str]:
    """The words whose rows differ most from the overall rate of the label (chi-square), at most ``bound``."""
    counts = rows.select(F.explode("_terms").alias("term"), f"_y_{OVERALL}").groupBy("term").agg(
        F.count(F.lit(1)).alias("n"), F.sum(f"_y_{OVERALL}").alias("k")
    )
    distance = (F.col("k") - F.col("n") * rate) ** 2 / (F.col("n") * rate * (1 - rate))
    best = counts.filter(F.col("n") >= MIN_ROWS).orderBy(distance.desc(), "term").limit(bound)
    return [r["term"] for r in best.select("term").collect()]


class TermFinder:
    """Finds the terms of a vocabulary in texts by the hashes of words and word beginnings."""

    def __init__(self, vocabulary: Sequence[str]):
        self.tables: dict = {}
        spelled = pa.array([t.rstrip("+") for t in vocabulary], pa.large_string())
        data, at = text_bytes(spelled)
        hashes = self._hash(Rolling(data, tables=self.tables), at[:-1], at[1:])
        kinds = np.array([len(t) - 1 if t.endswith("+") else 0 for t in vocabulary])
        self.kinds = {}
        for kind in (0, *STEMS):
            mine = np.flatnonzero(kinds == kind)
            order = mine[np.argsort(hashes[mine])]
            self.kinds[kind] = hashes[order], order

    @staticmethod
    def _hash(rolling: Rolling, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(rolling.of(start, end) + (end - start).astype(np.uint64))

    def find(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs of text number and term number."""
        data, at = text_bytes(pc.utf8_lower(texts))
        starts, ends, text = words(data, at, _NO_LETTER)
        rolling = Rolling(data, tables=self.tables)
        # Byte at which the n-th character after a word's first one begins.
        chars = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        first = np.searchsorted(chars, starts)
        found = [np.zeros(0, np.int64)]
        for kind, (known, number) in self.kinds.items():
            if not len(known):
                continue
            if kind:
                stop = chars[np.minimum(first + kind, len(chars) - 1)]
                longer = np.flatnonzero(stop < ends)
                hashes, owner = self._hash(rolling, starts[longer], stop[longer]), text[longer]
            else:
                hashes, owner = self._hash(rolling, starts, ends), text
            at_known = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            hit = known[at_known] == hashes
            found.append(owner[hit] * (1 << 32) + number[at_known[hit]])
        pairs = np.sort(np.concatenate(found))
        pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])] if len(pairs) else pairs
        return pairs >> 32, pairs & 0xFFFFFFFF


def score_toxicity(
    docs: DataFrame, chain: Sequence[Link], id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.4
) -> DataFrame:
    """``(id, p_<category> of each link, is_toxic)`` for every row.

    Every whole text is judged by which words and word beginnings it has. Null
    and empty texts get the intercepts. Rows are independent; there is no
    shuffle, and the model is at most a few thousand numbers.
    """
    names = [f"p_{link.name}" for link in chain]
    id_type = docs.schema[id_col].dataType.simpleString()

    def work(batches):
        judge = _judge(chain)
        for batch in slices(batches, "_text"):
            told = judge(batch.column("_text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), *map(pa.array, told), pa.array(told[-1] >= threshold)], ["id", *names, "is_toxic"]
            )

    narrow = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    schema = f"id {id_type}, {', '.join(f'`{n}` double' for n in names)}, is_toxic boolean"
    return narrow.mapInArrow(work, schema).withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, chain: Sequence[Link], text_col: str = "text", threshold: float = 0.4) -> DataFrame:
    """``docs``, all columns, without the rows that :func:`score_toxicity` calls toxic."""

    def work(batches):
        judge = _judge(chain)
        for batch in slices(batches, text_col):
            yield batch.filter(pa.array(judge(batch.column(text_col))[-1] < threshold))

    return docs.mapInArrow(work, docs.schema)


def _judge(chain: Sequence[Link]):
    """Function from texts to the probabilities of each link."""
    vocabulary = sorted({t for link in chain for t in link.terms})
    finder = TermFinder(vocabulary)
    weights = [np.array([link.terms.get(t, 0.0) for t in vocabulary]) for link in chain]

    def judge(texts: pa.Array) -> list[np.ndarray]:
        text, term = finder.find(texts.fill_null(""))
        told: list[np.ndarray] = []
        for link, weight in zip(chain, weights, strict=True):
            total = np.full(len(texts), link.intercept)
            if len(term):
                total += np.bincount(text, weight[term], len(texts))
            for share, p in zip(link.earlier, told, strict=True):
                total += share * p
            told.append(1 / (1 + np.exp(-total)))
        return told

    return judge
