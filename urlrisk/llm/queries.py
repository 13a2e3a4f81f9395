"""The dealt operators as registered queries: production parameters, whole tables, full results."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlrisk.llm import (
    byte_shards,
    chain_toxicity,
    chat_render,
    host_words,
    interpolated_lm,
    merge_replay,
    piecewise_hash,
    prefix_trie,
    rule_quality,
    signature_tree,
    spaced_seeds,
    suffix_dedup,
    turn_repair,
)
from urlrisk.llm import sqltext as S
from urlrisk.llm.arrays import slices
from urlrisk.session import materialize

N_SHARDS = 40
URL_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
PROBE_CONVERSATION = -1
PROBE_TEXT = "</s>[INST] ok [/INST]"

QUERIES = {}
ORACLES = {}


def query(oracle: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if oracle is not None:
            ORACLES[function.__name__] = oracle
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_toxicity_chain(spark, sf_dir):
    """Every document's category probabilities and whether it is toxic."""
    docs = table(spark, sf_dir, "documents")
    chain = chain_toxicity.fit_chain(docs, table(spark, sf_dir, "labels"))
    return chain_toxicity.score_toxicity(docs, chain)


@query(S.CHAT)
def op2_chat_spans(spark, sf_dir):
    """Digests of turns and loss mask, read back from the formatted conversations."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(
        [(PROBE_CONVERSATION, k, role, PROBE_TEXT) for k, role in enumerate(("user", "assistant"))], rows.schema
    )
    formatted = chat_render.format_conversations(rows.unionByName(probe))

    def plain(piece):
        return F.regexp_replace(piece, r"(?s)\\(.)", "$1")

    def part(turn, start, end):
        return F.substring(F.col("formatted"), turn[start] + 1, turn[end] - turn[start])

    def role_of(turn):
        return plain(F.regexp_extract(part(turn, "start", "text_start"), r"(?s)^<s>\[INST\] (.*) \[/INST\]$", 1))

    def text_of(turn):
        return plain(part(turn, "text_start", "text_end"))

    def digest(text):
        return F.sha2(F.encode(text, "UTF-8"), 256)

    loss = F.concat_ws("", F.transform(F.filter("turns", lambda t: t["loss"]), text_of))
    turns = F.concat_ws("", F.transform("turns", lambda t: F.concat(role_of(t), F.lit("\n"), text_of(t), F.lit("\n"))))
    return formatted.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        digest(turns).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        digest(loss).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query()
def op3_rule_quality(spark, sf_dir):
    """Quality score of every document from rules learned on the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    labels = table(spark, sf_dir, "labels").filter(~held_out)
    ensemble = rule_quality.fit_rules(docs, labels)
    scored = rule_quality.score_quality(docs, ensemble)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


@query()
def op4_benchmark_overlaps(spark, sf_dir):
    """Documents that hold a benchmark passage, with the items and the longest overlap."""
    return spaced_seeds.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op5_url_verdicts(spark, sf_dir):
    """A verdict for every page URL, by rule or by the words of its host and path."""
    return host_words.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


@query()
def op6_byte_shards(spark, sf_dir):
    """All documents in 40 contiguous shards of nearly equal bytes."""
    shards = byte_shards.balanced_shards(table(spark, sf_dir, "documents"), N_SHARDS)
    return shards.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query()
def op7_piecewise_fingerprints(spark, sf_dir):
    """Fingerprints of every document and its edited text, with likenesses."""
    return piecewise_hash.fingerprint_edits(table(spark, sf_dir, "documents"))


@query(S.JACCARD)
def op8_signature_tree(spark, sf_dir):
    """Set size and component of every document under 5-word shingles and a Jaccard of 0.8."""
    return signature_tree.components_of(table(spark, sf_dir, "documents"))


@query(S.REPEATS)
def op9_suffix_repeats(spark, sf_dir):
    """What is left of every document without its repeated 200-byte strings."""
    return suffix_dedup.removal_digests(table(spark, sf_dir, "documents"))


@query()
def op10_bpe_digests(spark, sf_dir):
    """Digests of the byte-level BPE ids and of the decoded bytes of every document."""
    ranks = merge_replay.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return merge_replay.token_digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with a fault in a quarter of the rows; ``there`` is false where the row is dropped."""
    key = F.concat_ws(":", *(F.coalesce(F.col(x).cast("string"), F.lit(" ")) for x in ("conv_id", "turn")))
    fault = F.crc32(key) % 20
    text = F.coalesce("text", F.lit(" "))
    return rows.select("conv_id", "turn", "role", text.alias("text"), fault.alias("fault")).select(
        "conv_id",
        "turn",
        F.when(F.col("fault") == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(F.col("fault").isin(0, 1), "")
        .when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text"))
        .alias("text"),
        (F.col("fault") != 0).alias("there"),
        F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("copy"),
    )


@query()
def op11_turn_repair(spark, sf_dir):
    """Faults, cheapest repair and digest of the repaired turns of every damaged conversation."""
    rows = damaged(table(spark, sf_dir, "conversations"))
    return turn_repair.repair_digests(turn_repair.repair_conversations(rows, there_col="there"))


@query()
def op12_interpolated_lm(spark, sf_dir):
    """Log probability of every document under a model learned without a seventh of them."""
    remainder = "pmod(crc32(cast(doc_id AS string)), 7)"
    corpus = interpolated_lm.count_corpus(table(spark, sf_dir, "documents"), f"NOT {remainder} <=> 2", f"{remainder} = 5")
    scored = interpolated_lm.score_corpus(corpus, interpolated_lm.learn_weights(corpus))
    return scored.select(
        "doc_id", (F.col("part") == interpolated_lm.ONLY_SCORED).alias("held_out"),
        "n_tokens", "n_known", "train_tokens", "base_score", "score",
    )


# A conversation takes over turns of the first of its block of ids.
ID_BLOCK = 20
HEAD_CHOICES = 4


def rebuilt(rows: DataFrame) -> DataFrame:
    """Conversations whose first turns, none to three by a hash of the id, come from the first of their twenty.

    ``(conv_id, turn, role, text, there)``, turns counted from 0; ``there`` is
    false in the one row of a conversation that has no turn left. Rows are taken
    by turn, nulls first, then by role and text.
    """
    narrow = rows.filter("conv_id IS NOT NULL").select(
        (F.col("conv_id") - F.col("conv_id") % ID_BLOCK).alias("_head"),
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    ordered = narrow.repartition("_head").sortWithinPartitions(
        "_head", F.col("conv_id") != F.col("_head"), "conv_id", F.col("turn").asc_nulls_first(), "role", "text"
    )
    schema = pa.schema(
        [("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("there", pa.bool_())]
    )

    def work(batches: Iterator[pa.RecordBatch]):
        block = conv = None
        heads: list[tuple[str, str]] = []
        taken = own = written = 0
        for batch in slices(batches, "text"):
            out = []
            for head, c, role, text in zip(*(batch.column(x).to_pylist() for x in ("_head", "conv_id", "role", "text"))):
                if c != conv:
                    if conv is not None and not written:
                        out.append((conv, None, None, None, False))
                    if head != block:
                        block, heads = head, []
                    conv, own, written = c, 0, 0
                    taken = 0 if c == head else zlib.crc32(str(c).encode()) % HEAD_CHOICES
                    for turn in heads[:taken]:
                        out.append((c, written, *turn, True))
                        written += 1
                if c == head and len(heads) < HEAD_CHOICES - 1:
                    heads.append((role, text))
                own += 1
                if own > taken:
                    out.append((c, written, role, text, True))
                    written += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)
        if conv is not None and not written:
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, "there": False}], schema)

    return ordered.mapInArrow(work, "conv_id long, turn long, role string, text string, there boolean")


@query()
def op13_prefix_trie(spark, sf_dir):
    """Every node of the trie of rebuilt conversations, with totals and the digest of what ends there."""
    rows = rebuilt(table(spark, sf_dir, "conversations"))
    paths = materialize(prefix_trie.conversation_paths(rows, there_col="there"), "trie-paths")
    digests = prefix_trie.ending_digests(prefix_trie.endings(paths))
    none = hashlib.sha256().hexdigest()
    return (
        prefix_trie.trie_nodes(paths)
        .join(digests, "node_id", "left")
        .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(none)))
        .drop("node_id")
    )
