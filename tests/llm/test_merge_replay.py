"""Byte-level BPE over the corpus: blocks, buckets and pieces of any size give the library's ids."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from urlrisk.llm import merge_replay

RANKS = merge_replay.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
LIBRARY = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def given():
    pick = random.Random(5)
    letters = "abcdeiouxyzäß水0 "
    made = ["".join(pick.choices(letters, k=pick.randint(0, 400))) for _ in range(60)]
    # A word in every text that is no token, a very long one, runs of one letter and of one space.
    made = [f"zqvxkjw {t}" for t in made] + ["zqvxkjw " * 3000, "ab" * 40_000, "x" * 5000, " " * 3000, "", None, "\x00\n\n"]
    rows = [(k, t) for k, t in enumerate(made)]
    return rows + [rows[0], rows[0], (None, "zqvxkjw"), (None, None)]


@pytest.mark.parametrize("block,gathered,bucket", [(6 << 20, 24 << 20, 32 << 20), (1, 1, 1 << 12), (2000, 300, 1 << 14)])
def test_sizes_of_blocks_and_pieces_change_nothing(spark, monkeypatch, block, gathered, bucket):
    monkeypatch.setattr(merge_replay, "SLICE_BYTES", min(block, merge_replay.SLICE_BYTES))
    monkeypatch.setattr(merge_replay, "BLOCK_BYTES", block)
    monkeypatch.setattr(merge_replay, "BUCKET_BYTES", bucket)
    monkeypatch.setattr(merge_replay, "GATHERED_BYTES", gathered)
    # Columns named like those of the blocks are ignored.
    rows = [(i, t, 1, "b", "c") for i, t in given()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block int, docs string, answers string").repartition(4)
    want, digests = Counter(), Counter()
    for i, t in given():
        ids = LIBRARY.encode_ordinary(t or "")
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        want[i, tuple(ids), (t or "").encode()] += 1
        digests[i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    got = merge_replay.encode_documents(docs, RANKS, public_tokenizers.PATTERN).collect()
    assert Counter((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in got) == want
    if block == 2000:
        got = merge_replay.token_digests(docs, RANKS, public_tokenizers.PATTERN).collect()
        assert Counter(tuple(r) for r in got) == digests


def test_a_word_is_replayed_once_per_bucket(monkeypatch):
    replayed = []

    class Counting(merge_replay.MergeReplay):
        def encode_words(self, words):
            replayed.extend(words)
            return super().encode_words(words)

    monkeypatch.setattr(merge_replay, "GATHERED_BYTES", 40)
    requests = [
        {"bucket": bucket, "block": block, "lengths": merge_replay._numbers(merge_replay.np.array([7, 2])), "words": merge_replay._squeezed(b"zqvxkjw" + other)}
        for bucket, other in ((0, b"qq"), (1, b"vv"))
        for block in range(30)
    ]
    replay = Counting(RANKS, *merge_replay.pair_table(RANKS))
    answers = list(merge_replay._answered(iter([pa.RecordBatch.from_pylist(requests, merge_replay.ASKED)]), replay))
    assert [(a["bucket"], a["block"]) for a in answers] == [(r["bucket"], r["block"]) for r in requests]
    assert max(Counter(replayed).values()) <= 2 and Counter(replayed)[b"qq"] == 1
    for answer, other in zip(answers, ["qq"] * 30 + ["vv"] * 30, strict=True):
        ids = [*LIBRARY._encode_single_piece("zqvxkjw"), *LIBRARY._encode_single_piece(other)]
        assert merge_replay._to_numbers(answer["ids"]).tolist() == ids
        assert merge_replay._to_numbers(answer["counts"]).sum() == len(ids)


def test_empty_tables_and_numbers(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert merge_replay.encode_documents(docs, RANKS, public_tokenizers.PATTERN).collect() == []
    for values in ([], [0], [255, 256, 1 << 24, (1 << 32) - 1]):
        assert merge_replay._to_numbers(merge_replay._numbers(merge_replay.np.array(values, "i8"))).tolist() == values
