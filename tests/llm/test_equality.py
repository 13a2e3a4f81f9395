"""Different words count as different, whatever their structure; hot words stay within memory."""

import resource

import numpy as np
import pyarrow as pa
import pytest

from urlrisk.llm import arrays, signature_tree, spaced_seeds

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [64, 1024, 4096])
def test_word_hashes_tell_words_apart(n):
    one, other = thue_morse(n)
    variants = [one, other, one.upper(), one[:-1], one + "a", one[8:] + one[:8], "a" * n, "a" * (n + 1), "\0" * n, "\0" * (n + 1)]
    data = np.frombuffer("".join(variants).encode(), np.uint8)
    ends = np.cumsum([len(v) for v in variants])
    starts = ends - np.array([len(v) for v in variants])
    assert len(set(arrays.word_hashes(data, starts, ends).tolist())) == len(variants)
    folded = arrays.word_hashes(data, starts, ends, fold=True)
    assert folded[0] == folded[2] and len(set(folded.tolist())) == len(variants) - 1
    # The hash of a range depends on its bytes alone.
    again = arrays.word_hashes(data[starts[1] : ends[1]], np.array([0]), np.array([n]))
    assert again[0] == arrays.word_hashes(data, starts, ends)[1]


@pytest.mark.parametrize("n", [1024, 2048])
def test_jaccard_and_benchmark_keep_them_apart(spark, n):
    one, other = thue_morse(n)
    texts = [" ".join([x] * 12) + tail for x in (one, other) for tail in ("", " end")]
    docs = spark.createDataFrame([(k + 1, t, "en", "x", len(t)) for k, t in enumerate(texts)], SCHEMA)
    # Every set of the first word differs from every set of the second in all its shingles.
    got = {r.doc_id: r.component_id for r in signature_tree.components_of(docs).collect()}
    assert got[1] != got[3] and {got[1], got[2]}.isdisjoint({got[3], got[4]})
    assert {r.doc_id for r in signature_tree.keep_one(docs).collect()} >= {1, 3}
    items = spark.createDataFrame([(9, texts[0]), (None, texts[2])], "item_id long, text string")
    found = {r.doc_id: (r.item_ids, r.n_items) for r in spaced_seeds.contaminated(docs, items).collect()}
    assert found == {1: ([9], 1), 2: ([9], 1), 3: ([], 0), 4: ([], 0)}
    assert spaced_seeds.drop_contaminated(docs, items.filter("item_id = 9")).count() == 2


def test_one_word_over_and_over_stays_within_memory():
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    block = spaced_seeds.Benchmark([1], ["word " * 1000])
    hashes, text, _, _ = spaced_seeds.token_hashes(pa.array(["word " * 20_000]))
    rows = block.overlaps(hashes, text, 1, spaced_seeds.MIN_TOKENS, spaced_seeds.MIN_EQUAL)
    assert [r[:4] for r in rows] == [(0, 0, 1000, 1000)]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000
