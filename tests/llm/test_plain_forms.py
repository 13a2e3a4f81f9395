"""Chain probabilities, rules and piecewise fingerprints against plain forms of the same definitions."""

import math
import random
import re

import pyarrow as pa
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from urlrisk.llm import arrays, chain_toxicity, piecewise_hash, rule_quality
from urlrisk.session import new_path

MASK = (1 << 64) - 1


def odd_texts():
    pick = random.Random(21)
    words = ["idiot", "idiotic", "Idi", "trash", "trashy", "été", "étéiste", "a1b", "x", "scum-bag", "GROSS", "日本語です"]
    made = [" ".join(pick.choices(words, k=pick.randint(0, 12))) for _ in range(60)]
    return [*made, None, "", " \t\n", "idiot" * 3000, "trash " * 5000]


def test_chain_probabilities(spark):
    links = [
        chain_toxicity.Link("one", -1.0, {"idiot": 2.0, "idio+": 0.5, "été": -0.7, "étéi+": 1.1}, ()),
        chain_toxicity.Link("two", 0.25, {"trash": -0.5, "trash+": 3.0, "日本語で+": 0.9}, (1.5,)),
        chain_toxicity.Link("toxic", -2.0, {"gross": 4.0}, (3.0, -1.25)),
    ]
    docs = spark.createDataFrame(list(enumerate(odd_texts())), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in chain_toxicity.score_toxicity(docs, links, threshold=0.3).collect()}
    for k, text in enumerate(odd_texts()):
        found = {w for w in re.split(r"[^a-z\x80-\U0010FFFF]+", (text or "").lower()) if w}
        terms = found | {w[:n] + "+" for w in found for n in chain_toxicity.STEMS if len(w) > n}
        told = []
        for link in links:
            total = link.intercept + sum(v for t, v in link.terms.items() if t in terms)
            told.append(1 / (1 + math.exp(-total - sum(a * p for a, p in zip(link.earlier, told)))))
        assert [got[k][f"p_{link.name}"] for link in links] == pytest.approx(told, abs=1e-12)
        assert got[k]["is_toxic"] == (told[-1] >= 0.3)


def test_rules_are_the_paths_of_the_trees_and_score_as_they_say(spark):
    pick = random.Random(5)
    names = ["chars", "words", "lines"]
    rows = [(float(pick.randint(0, 1)), *(pick.choice([pick.random() * 10, float(pick.randint(0, 5))]) for _ in names)) for _ in range(400)]
    data = spark.createDataFrame(rows, "_label double, chars double, words double, lines double").withColumn("_x", array_to_vector(F.array(*names)))
    forest = RandomForestClassifier(featuresCol="_x", labelCol="_label", numTrees=6, maxDepth=4, seed=3).fit(data)
    path = new_path(spark, "rule-trees")
    forest.write().save(path)
    nodes = {(r["treeID"], r["nodeData"]["id"]): r["nodeData"] for r in spark.read.parquet(f"{path}/data").collect()}
    want = set()

    def walk(tree, at, bounds):
        if bounds:
            want.add(tuple(sorted(set(bounds))))
        node = nodes[tree, at]
        if node["leftChild"] >= 0:
            name, threshold = names[node["split"]["featureIndex"]], node["split"]["leftCategoriesOrThreshold"][0]
            walk(tree, node["leftChild"], [*bounds, (name, False, threshold)])
            walk(tree, node["rightChild"], [*bounds, (name, True, threshold)])

    for tree in range(6):
        walk(tree, 0, [])
    assert rule_quality.paths(forest.toDebugString, names) == want and len(want) > 50

    rules = tuple(rule_quality.Rule(bounds, pick.uniform(-2, 2)) for bounds in sorted(want))
    ensemble = rule_quality.RuleEnsemble(0.3, rules)
    for row in data.withColumn("score", ensemble.score()).collect():
        total = 0.3 + sum(r.weight for r in rules if all((row[c] > v) == above for c, above, v in r.bounds))
        assert row["score"] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9)


def plain_mix(x):
    x = (x ^ (x >> 30)) * arrays.MIX_A & MASK
    x = (x ^ (x >> 27)) * arrays.MIX_B & MASK
    return x ^ (x >> 31)


def plain_hash(data):
    return sum(plain_mix((b + 1) * arrays.BASE & MASK) * pow(arrays.BASE, k, 1 << 64) for k, b in enumerate(data)) & MASK


def plain_fingerprint(text):
    data = (text or "").encode()

    def signature(level):
        out, start = "", 0
        for end in range(1, len(data) + 1):
            window = data[end - piecewise_hash.WINDOW : end] if end >= piecewise_hash.WINDOW else b""
            if end == len(data) or window and plain_hash(window) < 1 << (64 - level):
                out += piecewise_hash.ALPHABET[plain_mix(plain_hash(data[start:end])) >> 58]
                start = end
        return out

    level = piecewise_hash.MIN_LEVEL
    while len(signature(level)) > piecewise_hash.MAX_CHUNKS:
        level += 1
    return f"{level}:{signature(level)}:{signature(level + 1)}"


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def plain_likeness(one, other):
    if one == other:
        return 1.0
    (la, *a), (lb, *b) = (f.split(":") for f in (one, other))
    best = 0.0
    for i in (0, 1):
        for j in (0, 1):
            if int(la) + i == int(lb) + j and (a[i] or b[j]):
                best = max(best, 1 - plain_distance(a[i], b[j]) / max(len(a[i]), len(b[j])))
    return best


def test_fingerprints_and_likeness(spark):
    pick = random.Random(8)
    base = "".join(pick.choices("abcdefgh \né", k=1500))
    texts = [None, "", "a", "short", base, base[:700] + "X" + base[700:], base[400:], base * 2, "z" * 900, "ab" * 300, base[:40], base]
    got = piecewise_hash.fingerprints(pa.array(texts, pa.large_string()))
    assert got == [plain_fingerprint(t) for t in texts]
    pairs = [(a, b) for a in got for b in got]
    near = piecewise_hash.likeness([a for a, _ in pairs], [b for _, b in pairs])
    assert near.tolist() == pytest.approx([plain_likeness(a, b) for a, b in pairs], abs=1e-9)
    signatures = ["".join(pick.choices("ABC", k=pick.randint(0, 64))) for _ in range(120)]
    left, right = signatures[:60], signatures[60:]
    assert piecewise_hash.edit_distances(left, right).tolist() == [plain_distance(a, b) for a, b in zip(left, right)]

    docs = spark.createDataFrame([(3 * k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, fingerprint string").repartition(4)
    rows = {r["doc_id"]: r for r in piecewise_hash.fingerprint_edits(docs, n_blocks=3).collect()}
    for k, text in enumerate(texts):
        following = texts[k - 1] or ""
        changed = piecewise_hash.edited(text or "", following)
        row = rows[3 * k]
        assert row["edited_fingerprint"] == plain_fingerprint(changed) and row["fingerprint"] == got[k]
        assert row["near_edited"] == pytest.approx(plain_likeness(got[k], plain_fingerprint(changed)), abs=1e-9)
        assert row["near_next"] == pytest.approx(plain_likeness(got[k], plain_fingerprint(following)), abs=1e-9)
