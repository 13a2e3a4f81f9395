"""Context-triggered piecewise hashes: chunk signatures compared by edit distance.

A hash over a sliding window of seven bytes ends a chunk wherever its first
``level`` bits are zero, so chunk ends depend on nearby bytes only.
Each chunk gives one of 64 characters. The level is the lowest at which a text
has at most 64 chunks; a second signature one level up makes fingerprints
comparable with texts of twice or half as many chunks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlrisk.llm.arrays import Rolling, mix, slices, text_bytes

WINDOW = 7
MAX_CHUNKS = 64
MIN_LEVEL = 2
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_LETTERS = np.frombuffer(ALPHABET.encode(), np.uint8)


def fingerprints(texts: pa.Array, tables: dict | None = None) -> list[str]:
    """``level:signature:signature one level up`` for each text; null is empty."""
    data, at = text_bytes(texts)
    n = len(at) - 1
    rolling = Rolling(data, tables=tables)
    ends, value = _cuts(rolling, at)
    owner = np.searchsorted(at, ends - 1, "right") - 1
    level = np.full(n, MIN_LEVEL)
    k, crowded = MIN_LEVEL, np.bincount(owner, minlength=n) > MAX_CHUNKS
    while crowded.any():
        k += 1
        level[crowded] = k
        crowded &= np.bincount(owner[value < 1 << (64 - k)], minlength=n) > MAX_CHUNKS
    first, second = (_signatures(rolling, ends, value, owner, at, level + up) for up in (0, 1))
    return [f"{a}:{b}:{c}" for a, b, c in zip(level.tolist(), first, second, strict=True)]


def _cuts(rolling: Rolling, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where chunks of the lowest level end, with the window hash there; 0 at the end of a text."""
    sums, n = rolling.sums, int(at[-1])
    value = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    if n >= WINDOW:
        value[WINDOW - 1 :] = (sums[WINDOW:] - sums[:-WINDOW]) * rolling.down[: n - WINDOW + 1]
    ends = np.flatnonzero(value < np.uint64(1 << (64 - MIN_LEVEL))) + 1
    # No window spans two texts, so equal texts agree wherever they lie.
    start = at[np.searchsorted(at, ends - 1, "right") - 1]
    ends = ends[ends - start >= WINDOW]
    chosen = np.zeros(n, bool)
    closing = at[1:][np.diff(at) > 0] - 1
    value[closing] = 0
    chosen[ends - 1] = chosen[closing] = True
    ends = np.flatnonzero(chosen) + 1
    return ends, value[ends - 1]


def _signatures(rolling, ends, value, owner, at, level) -> list[str]:
    keep = value < (np.uint64(1) << (np.uint64(64) - level.astype(np.uint64)))[owner]
    stop, owner = ends[keep], owner[keep]
    start = np.zeros(len(stop), np.int64)
    start[1:] = stop[:-1]
    start = np.maximum(start, at[owner])
    chars = _LETTERS[(mix(rolling.of(start, stop)) >> np.uint64(58)).astype(np.int64)].tobytes().decode()
    edges = np.searchsorted(owner, np.arange(len(at))).tolist()
    return [chars[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _matrix(signatures: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(s) for s in signatures], np.int16)
    out = np.zeros((len(signatures), MAX_CHUNKS), np.uint8)
    raw = np.frombuffer("".join(signatures).encode(), np.uint8)
    out[np.arange(MAX_CHUNKS) < lengths[:, None]] = raw
    return out, lengths


def edit_distances(left: list[str], right: list[str]) -> np.ndarray:
    """Levenshtein distance of each pair of signatures, all pairs at once."""
    a, la = _matrix(left)
    b, lb = _matrix(right)
    column = np.arange(MAX_CHUNKS + 1, dtype=np.int16)
    row = np.broadcast_to(column, (len(left), MAX_CHUNKS + 1)).copy()
    out = lb.astype(np.int16).copy()
    pick = np.arange(len(left))
    for i in range(1, int(la.max(initial=0)) + 1):
        new = np.empty_like(row)
        new[:, 0] = i
        np.minimum(row[:, 1:] + 1, row[:, :-1] + (b != a[:, i - 1 : i]), out=new[:, 1:])
        # Insertions run along the row: a running minimum of value minus column.
        row = np.minimum.accumulate(new - column, axis=1) + column
        done = la == i
        out[done] = row[pick[done], lb[done]]
    return out


def likeness(left: list[str], right: list[str]) -> np.ndarray:
    """0 to 1 for each pair: best of the signatures made at the same level, 0 if no level is shared."""
    best = np.zeros(len(left))
    parts = [[(int(f.split(":")[0]), *f.split(":")[1:]) for f in side] for side in (left, right)]
    pairs, owner = [], []
    for k, (x, y) in enumerate(zip(*parts, strict=True)):
        if left[k] == right[k]:
            best[k] = 1.0
            continue
        for i in (0, 1):
            for j in (0, 1):
                if x[0] + i == y[0] + j and (x[1 + i] or y[1 + j]):
                    pairs.append((x[1 + i], y[1 + j]))
                    owner.append(k)
    if pairs:
        a, b = map(list, zip(*pairs, strict=True))
        longest = np.array([max(len(x), len(y)) for x, y in pairs])
        np.maximum.at(best, np.array(owner), 1 - edit_distances(a, b) / longest)
    return best


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fingerprint)`` of every row's whole text; a null text is empty; no shuffle."""

    def work(batches):
        tables: dict = {}
        for batch in slices(batches, "_text"):
            found = fingerprints(batch.column("_text"), tables)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array(found, pa.string())], ["id", "fingerprint"]
            )

    id_type = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return narrow.mapInArrow(work, f"id {id_type}, fingerprint string").withColumnRenamed("id", id_col)


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_id_blocks(docs: DataFrame, id_col: str, text_col: str, n_blocks: int) -> DataFrame:
    """``(_block, _ghost, _id, _text)``: ids in ascending blocks, each led by the last rows of the block before.

    The first block is led by the last rows of all. Cut points are approximate
    quantiles, at most ``n_blocks`` numbers; texts are shuffled once.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text"))
    ids = narrow.select("_id")
    probabilities = [k / n_blocks for k in range(1, n_blocks)]
    cuts = sorted(set(ids.na.drop().approxQuantile("_id", probabilities, 0.2 / n_blocks))) if n_blocks > 1 else []
    # A bucketizer wants one cut at least; without any rows or blocks it may lie anywhere.
    edges = [float("-inf"), *(cuts or [0.0]), float("inf")]
    bucket = Bucketizer(splits=edges, inputCol="_id", outputCol="_bucket", handleInvalid="keep")

    def blocked(df):
        return bucket.transform(df).withColumn("_block", F.coalesce(F.col("_bucket").cast("int"), F.lit(0))).drop("_bucket")

    # Null ids come first in ascending order: Bucketizer files them under an extra bucket.
    def nulls_first(df):
        return df.withColumn("_block", F.when(F.col("_id").isNull(), -1).otherwise(F.col("_block")))

    lasts = {r["_block"]: r["_last"] for r in nulls_first(blocked(ids)).groupBy("_block").agg(F.max("_id").alias("_last")).collect()}
    order = sorted(lasts)
    after = {b: order[(k + 1) % len(order)] for k, b in enumerate(order)}
    placed = nulls_first(blocked(narrow))
    target = F.create_map(*(F.lit(x) for b in order for x in (b, after[b]))) if order else None
    last = F.create_map(*(F.lit(x) for b in order if lasts[b] is not None for x in (b, lasts[b]))) if any(v is not None for v in lasts.values()) else None
    is_last = F.lit(False)
    if order:
        is_last = F.col("_id").isNull() if last is None else F.col("_id").isNull() | (F.col("_id") == F.element_at(last, F.col("_block")))
    copies = F.array(F.struct(F.col("_block").alias("b"), F.lit(1).alias("own")))
    if order:
        ghost = F.array(F.struct(F.element_at(target, F.col("_block")).alias("b"), F.lit(0).alias("own")))
        copies = F.when(is_last, F.concat(copies, ghost)).otherwise(copies)
    return placed.withColumn("_copy", F.explode(copies)).select(
        F.col("_copy.b").alias("_block"), F.col("_copy.own").alias("_own"), "_id", "_text"
    )


RESULT = """doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,
  near_edited double, near_next double"""


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_blocks: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The next document is the one with the next smaller id; after the smallest
    comes the largest. Equal ids are ordered by text, null ids count as smallest.
    Null texts are empty; two empty texts are alike to 1, an empty and another
    to 0. Texts are shuffled once into blocks of ids and streamed through the
    tasks in order, so a task holds one slice and one earlier text.
    """
    blocks = n_blocks or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = (
        in_id_blocks(docs, id_col, text_col, blocks)
        .repartition(blocks, "_block")
        .sortWithinPartitions("_block", "_own", F.col("_id").asc_nulls_first(), "_text")
    )

    def work(batches: Iterator[pa.RecordBatch]):
        tables: dict = {}
        carried = None  # block, text and fingerprint of the row before
        for batch in slices(batches, "_text"):
            block, own, ids, texts = (batch.column(c).to_pylist() for c in ("_block", "_own", "_id", "_text"))
            prints = fingerprints(batch.column("_text"), tables)
            rows, following, following_print = [], [], []
            for k, text in enumerate(texts):
                if own[k]:
                    rows.append(k)
                    following.append(carried[1])
                    following_print.append(carried[2])
                carried = (block[k], text, prints[k])
            if not rows:
                continue
            changed = [edited(texts[k], other) for k, other in zip(rows, following, strict=True)]
            changed_prints = fingerprints(pa.array(changed, pa.large_string()), tables)
            mine = [prints[k] for k in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[k] for k in rows], pa.int64()),
                    pa.array([len(texts[k]) for k in rows], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
                    pa.array(mine),
                    pa.array(changed_prints),
                    pa.array(likeness(mine, changed_prints)),
                    pa.array(likeness(mine, following_print)),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return placed.mapInArrow(work, RESULT)
