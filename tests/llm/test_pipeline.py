"""The stages of the corpus pipeline, each on the output of the one before, against brute force; the registered queries."""

import hashlib
import random
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
import tiktoken

from tests.llm.test_operators import brute_components, brute_overlaps, passage
from urlrisk.llm import chain_toxicity, merge_replay, queries

ITEMS = [(1, passage(7001, 15)), (2, passage(7002, 40))]


def texts():
    pick = random.Random(11)
    out = [(k, passage(k, 60)) for k in range(100)]
    out += [(100 + k, passage(1000 + k, 20) + (" you idiot, " if k % 2 else " worthless! ") + passage(1100 + k, 20)) for k in range(40)]
    out += [(200 + k, out[k][1] + " " + passage(2000 + k, 2)) for k in range(8)]
    out += [(300 + k, passage(3000 + k, 30) + " " + passage(77, 60) + " " + passage(3100 + k, 30)) for k in range(4)]
    for k, (_, item) in enumerate(ITEMS * 4):
        words = item.split()
        for place in (1, 4, *pick.sample(range(6, len(words) - 1), len(words) // 5 - 2))[: 3 if len(words) == 15 else 8]:
            words[place] = "changed"
        out.append((400 + k, passage(4000 + 20 * k, 20) + " " + " ".join(words) + " " + passage(4010 + 20 * k, 20)))
    return [*out, (500, None), (501, ""), (502, " \n ")]


def cut(rows):
    """Texts without the strings of 200 bytes that occur twice (ASCII only)."""
    seen = Counter(t[p : p + 200] for _, t in rows for p in range(len(t or "") - 199))
    out = {}
    for i, t in rows:
        gone = {q for p in range(len(t or "") - 199) if seen[t[p : p + 200]] > 1 for q in range(p, p + 200)}
        out[i] = "".join(c for q, c in enumerate(t or "") if q not in gone)
    return out


def test_stages_match_brute_force(spark, tmp_path):
    given = texts()
    rows = [(i, t, "en", "s", len(t or "")) for i, t in given]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(100 <= i < 140)) for i, _ in given[:140]], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeated_passages", "decontaminate", "tokens"]
    before = spark.read.parquet(f"{tmp_path}/documents.parquet")
    chain = chain_toxicity.fit_chain(before, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    toxic = {r["doc_id"] for r in chain_toxicity.score_toxicity(before, chain).collect() if r["is_toxic"]}
    assert toxic >= set(range(100, 140))
    left = [(i, t) for i, t in given if i not in toxic]
    known = tiktoken.Encoding(
        "t", pat_str=public_tokenizers.PATTERN, special_tokens={},
        mergeable_ranks=merge_replay.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")),
    )
    for name, stage in corpus_pipeline.STAGES:
        size = len(left)
        if name == "near_duplicates":
            kept = {i for i, n, least in brute_components(left) if n == 0 or i == least}
            left = [(i, t) for i, t in left if i in kept]
            assert len(left) <= size - 8
        if name == "repeated_passages":
            shorter = cut(left)
            assert sum(map(len, shorter.values())) < sum(len(t or "") for _, t in left)
            left = [(i, shorter[i]) for i, _ in left]
        if name == "decontaminate":
            hit = {row[0] for row in brute_overlaps([(i, t.lower()) for i, t in left], ITEMS, 12, 0.8)}
            assert hit >= set(range(400, 408)) & {i for i, _ in left} and hit
            left = [(i, t) for i, t in left if i not in hit]
        docs = stage(spark, before, str(tmp_path)).localCheckpoint()
        if name == "tokens":
            break
        assert docs.columns == list(corpus_pipeline.COLUMNS) and docs.schema == before.schema, name
        got = docs.collect()
        plain = name in ("toxicity", "near_duplicates")
        assert Counter((r["doc_id"], r["text"] if plain else r["text"] or "") for r in got) == Counter(left), name
        assert all((r["n_chars"] or 0) == len(r["text"] or "") for r in got), name
        before = docs
    want = Counter()
    for i, t in left:
        ids = b"".join(x.to_bytes(4, "little") for x in known.encode_ordinary(t))
        want[i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.encode()).hexdigest()] += 1
    for result in (docs, corpus_pipeline.run(spark, str(tmp_path))):
        assert result.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        assert Counter(tuple(r) for r in result.collect()) == want


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered_queries_run(spark, sf_dir, name):
    assert queries.QUERIES[name](spark, sf_dir).count() > 0
