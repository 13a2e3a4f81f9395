"""The language model against plain counts, plain expectation-maximisation and a sum over the vocabulary."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from urlrisk.llm import interpolated_lm as lm
from urlrisk.llm import queries

SCHEMA = "doc_id long, text string, part string, block int, id int"
SPACE = "".join(map(chr, [0x20, *range(9, 14)]))
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens_of(text):
    for c in SPACE[1:]:
        text = (text or "").replace(c, " ")
    return [w.translate(LOWER) for w in text.split(" ") if w] + ["</s>"]


def grams(tokens, k):
    padded = ["<s>"] * (k - 1) + tokens
    return [tuple(padded[i : i + k]) for i in range(len(tokens))]


class Plain:
    def __init__(self, texts, order):
        self.order = order
        self.counts = {k: Counter() for k in range(1, order + 1)}
        self.contexts = {k: Counter() for k in range(1, order + 1)}
        for text in texts:
            for k in self.counts:
                found = grams(tokens_of(text), k)
                self.counts[k].update(found)
                self.contexts[k].update(g[:-1] for g in found)
        self.n = sum(self.counts[1].values())
        self.v = len(self.counts[1])

    def estimates(self, tokens, i, k):
        gram = grams(tokens, k)[i]
        context = self.contexts[k][gram[:-1]]
        return context.bit_length(), (self.counts[k][gram] / context if context else 0.0)

    def chance(self, tokens, i, weights):
        p = weights.lowest * self.counts[1][(tokens[i],)] / self.n + (1 - weights.lowest) / (self.v + 1)
        for k in range(2, self.order + 1):
            bucket, estimate = self.estimates(tokens, i, k)
            w = weights.mixed[k][bucket]
            p = w * estimate + (1 - w) * p
        return p


def corpus_rows():
    pick = random.Random(8)
    names = ["".join(pick.choices("abcde", k=pick.randint(1, 3))) for _ in range(60)]
    rows = []
    for i in range(150):
        words, last = [], 0
        for _ in range(pick.randint(0, 80)):
            last = (last * 7 + pick.choice([1, 1, 1, 2, 5])) % len(names)
            words.append(names[last] if pick.random() < 0.9 else "Rare%d" % pick.randint(0, 10**6))
        rows.append((i, " ".join(words)))
    rows += [(200, None), (201, ""), (202, " \n\t"), (203, "Ab ab AB aB"), (204, "é É " * 30), (205, "x" * 5000), (206, "go " * 20000)]
    rows += [(7, "repeated id"), (None, "no id"), (None, "no id")] + [(300 + i, "the same copy of a text") for i in range(40)]
    thue = "a"
    for _ in range(11):
        thue += thue.translate(str.maketrans("ab", "ba"))
    return rows + [(400, thue), (401, thue.translate(str.maketrans("ab", "ba")))]


def remainder(i):
    return None if i is None else zlib.crc32(str(i).encode()) % 7


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(*row, "x", 1, 2) for row in corpus_rows()], SCHEMA).repartition(4).cache()


LEARN = "NOT pmod(crc32(cast(doc_id AS string)), 7) <=> 2"
HOLD = "pmod(crc32(cast(doc_id AS string)), 7) = 5"


@pytest.mark.parametrize(("order", "bucket_bytes"), [(3, 1 << 22), (2, 4000), (4, 20000)])
def test_scores_and_weights(spark, table, monkeypatch, order, bucket_bytes):
    monkeypatch.setattr(lm, "BUCKET_BYTES", bucket_bytes)
    monkeypatch.setattr(lm, "BLOCK_BYTES", 5000)
    corpus = lm.count_corpus(table, LEARN, HOLD, order=order)
    weights = lm.learn_weights(corpus)
    rows = corpus_rows()
    trained = [t for i, t in rows if remainder(i) != 2]
    full = Plain(trained, order)
    early = Plain([t for i, t in rows if remainder(i) not in (2, 5)], order)
    assert (weights.tokens, weights.types, weights.learned_tokens, weights.learned_types) == (full.n, full.v, early.n, early.v)

    want = []
    for i, text in rows:
        tokens = tokens_of(text)
        known = sum(full.counts[1][(w,)] > 0 for w in tokens)
        base = sum(math.log10((full.counts[1][(w,)] + 1) / (full.n + full.v + 1)) for w in tokens)
        if len(tokens) > 5000:  # the plain form is quadratic
            want.append((-1 if i is None else i, len(tokens), known, round(base, 6), None))
            continue
        score = sum(math.log10(full.chance(tokens, j, weights)) for j in range(len(tokens)))
        want.append((-1 if i is None else i, len(tokens), known, round(base, 6), round(score, 6)))
    got = []
    for r in lm.score_corpus(corpus, weights).collect():
        assert r.train_tokens == full.n and (r.part == lm.ONLY_SCORED) == (remainder(r.doc_id) == 2)
        long = r.n_tokens > 5000
        got.append((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), None if long else round(r.score, 6)))
    assert sorted(got, key=str) == sorted(want, key=str)

    # Plain expectation-maximisation over the held-back tokens themselves.
    events = []
    for i, text in rows:
        if remainder(i) == 5 and len(tokens := tokens_of(text)) < 5000:
            for j in range(len(tokens)):
                one = weights.lowest * early.counts[1][(tokens[j],)] / early.n + (1 - weights.lowest) / (early.v + 1)
                events.append((one, [early.estimates(tokens, j, k) for k in range(2, order + 1)]))

    def likelihood(mixed):
        total = 0.0
        for p, found in events:
            for k, (bucket, estimate) in enumerate(found):
                p = mixed[k][bucket] * estimate + (1 - mixed[k][bucket]) * p
            total += math.log(p)
        return total

    plain = [np.r_[0.0, np.full(64, 0.5)] for _ in range(order - 1)]
    even = likelihood(plain)
    for _ in range(lm.ROUNDS):
        met, kept = [np.zeros(65) for _ in plain], [np.zeros(65) for _ in plain]
        for p, found in events:
            chance = [p]
            for k, (bucket, estimate) in enumerate(found):
                chance.append(plain[k][bucket] * estimate + (1 - plain[k][bucket]) * chance[-1])
            reach = 1.0
            for k in range(order - 2, -1, -1):
                bucket, estimate = found[k]
                stay = reach * plain[k][bucket] * estimate / chance[k + 1]
                met[k][bucket] += reach
                kept[k][bucket] += stay
                reach -= stay
        for k in range(order - 1):
            plain[k] = np.where(met[k] > 0, kept[k] / np.maximum(met[k], 1e-300), plain[k])
            plain[k][0] = 0.0
    learned = likelihood([weights.mixed[k] for k in range(2, order + 1)])
    assert learned > even and abs(learned - likelihood(plain)) < 1e-3 * abs(even)


def test_codes_of_keys_and_counts():
    pick = np.random.default_rng(4)
    for high in (1, 2, 200, 1 << 20, 1 << 45, 1 << 56):
        for n in (1, 7, 8, 1000):
            steps = pick.integers(0, high, n).astype(np.uint64)
            assert (lm._decoded(lm._coded(steps), n) == steps).all()
            counts = pick.choice([0, 1, 254, 255, 256, high], n)
            assert (lm._unpacked(lm._packed(counts), n) == counts).all()


def test_probabilities_sum_to_one(spark, table):
    """Over the vocabulary and one unknown word, in seen and unseen contexts."""
    rows = [t for i, t in corpus_rows() if remainder(i) != 2]
    plain = Plain(rows, 3)
    weights = lm.learn_weights(lm.count_corpus(table, LEARN, HOLD))
    vocabulary = [w for (w,) in plain.counts[1]] + ["never seen"]
    for before in (["the", "same"], ["no", "context"], [], ["ab"]):
        total = sum(plain.chance([*before, w], len(before), weights) for w in vocabulary)
        assert abs(total - 1) < 1e-9


def test_nothing_to_learn_from(spark, table):
    corpus = lm.count_corpus(table.filter("doc_id > 1000"), LEARN, HOLD)
    assert lm.score_corpus(corpus, lm.learn_weights(corpus)).count() == 0
    corpus = lm.count_corpus(table.filter("doc_id < 5"), "false", HOLD)
    scored = lm.score_corpus(corpus, lm.learn_weights(corpus)).collect()
    assert len(scored) == 5 and all(r.score == 0 and r.base_score == 0 and r.n_known == 0 for r in scored)
    corpus = lm.count_corpus(table, "true", "false")
    assert lm.learn_weights(corpus).mixed[3][5] == 0.5


def test_registered_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    frame = queries.op12_interpolated_lm(spark, sf_dir)
    assert frame.dtypes == [
        ("doc_id", "bigint"), ("held_out", "boolean"), ("n_tokens", "bigint"), ("n_known", "bigint"), ("train_tokens", "bigint"),
        ("base_score", "double"), ("score", "double"),
    ]
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    plain = Plain([r.text for r in rows if remainder(r.doc_id) != 2], 1)
    got = {r.doc_id: r for r in frame.collect()}
    assert len(got) == len(rows)
    for r in rows:
        tokens, mine = tokens_of(r.text), got[r.doc_id]
        base = sum(math.log10((plain.counts[1][(w,)] + 1) / (plain.n + plain.v + 1)) for w in tokens)
        assert mine.held_out == (remainder(r.doc_id) == 2) and mine.n_tokens == len(tokens) and mine.train_tokens == plain.n
        assert mine.n_known == sum(plain.counts[1][(w,)] > 0 for w in tokens) and abs(mine.base_score - base) < 1e-6
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
