"""Benchmark passages in documents, found by spaced seeds that forgive substitutions.

A mask looks at some of the tokens of a window and ignores the rest, so a
changed word under an ignored position does not hide a match. Hashes of the
benchmark windows are joined with hashes of all document windows; around each
hit the two texts are laid side by side and the best stretch with few
differences is measured. The masks are complete: every stretch that the rule
accepts holds all tokens of at least one of them in place, so none is missed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlrisk.llm.arrays import ragged, slices, text_bytes, word_hashes, words

# 1: the token counts, 0: it is ignored. However the differing tokens lie in a stretch of at least MIN_TOKENS with
# MIN_EQUAL equal ones, one of these masks falls on equal tokens only; the tests prove it for all lengths.
MASKS = ("11110111", "110011111", "1110110011", "11110101001", "110010100111", "110100010111")
# A stretch must have this many tokens (a shorter item: all of its tokens), this share of them equal.
MIN_TOKENS = 12
MIN_EQUAL = 0.8
# Benchmark text that is held in memory at once; more is done in further passes over the documents.
BLOCK_BYTES = 8 << 20

# Hits of seeds that are expanded at once.
HITS_AT_ONCE = 1 << 18

# A token is a run of letters, digits and bytes above 127; A-Z count as a-z.
_NO_WORD = np.ones(256, bool)
_NO_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

RESULT = "item_id long, n_tokens int, n_equal int, item_tokens int, start int, end int"


def token_hashes(texts: pa.Array):
    """Hash, text number, start and end byte of all tokens."""
    data, at = text_bytes(texts)
    starts, ends, text = words(data, at, _NO_WORD)
    hashes = word_hashes(data, starts, ends, fold=True)
    return hashes, text, starts - at[:-1][text], ends - at[:-1][text]


def seed_hashes(hashes: np.ndarray, text: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash under the mask and first token of each window inside one text."""
    span = len(mask)
    if len(hashes) < span:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(hashes) - span + 1
    total = np.zeros(n, np.uint64)
    for k, used in enumerate(mask):
        if used == "1":
            total = (total + hashes[k : k + n]) * np.uint64(0xD6E8FEB86659FD93)
            total ^= total >> np.uint64(32)
    inside = np.flatnonzero(text[:n] == text[span - 1 :])
    return total[inside], inside


def stretch_masks(min_tokens: int, min_equal: float) -> tuple[Sequence[str], int]:
    """Masks that hit every accepted stretch, and the fewest tokens of a stretch for which that holds.

    A rule laxer than the module's gets one run of tokens: ``n`` tokens with at
    most ``(1 - share) n`` differing ones have an equal run of this length.
    """
    if min_tokens >= MIN_TOKENS and min_equal >= MIN_EQUAL:
        return MASKS, MIN_TOKENS
    run = math.ceil(min_equal * min_tokens / ((1 - min_equal) * min_tokens + 1) - 1e-9)
    return ("1" * min(max(run, 1), 16),), min_tokens


def item_masks(n: int, min_equal: float) -> list[str]:
    """Masks over a whole item of ``n`` tokens; one has no differing token under a 1 if its ends and the share are equal.

    The inner tokens are cut into more blocks than may hold a differing token;
    each choice of so many ignored blocks is a mask.
    """
    inner = max(n - 2, 0)
    differing = max(k for k in range(n + 1) if n - k >= min_equal * n)
    blocks = min(inner, differing + (2 if differing <= 3 else 1))
    masks = []
    for ignored in combinations(range(blocks), min(differing, blocks)):
        middle = "".join("0" if k * blocks // inner in ignored else "1" for k in range(inner))
        masks.append(("1" + middle + "1")[:n])
    return masks


class Benchmark:
    """Tokens of some items and, per mask, the sorted hashes of their windows."""

    def __init__(self, ids: Sequence[int | None], texts: Sequence[str], min_tokens: int = MIN_TOKENS, min_equal: float = MIN_EQUAL):
        self.ids = list(ids)
        self.hashes, owner, _, _ = token_hashes(pa.array(texts, pa.large_string()))
        self.first = np.searchsorted(owner, np.arange(len(ids) + 1))
        masks, least = stretch_masks(min_tokens, min_equal)
        self.masks = list(masks)
        # A shorter item must be there as a whole and has masks of its own length.
        lengths = np.diff(self.first)
        for n in np.unique(lengths[(lengths > 0) & (lengths < least)]).tolist():
            self.masks.extend(item_masks(n, min_equal))
        self.seeds, self.places, self.sieves = [], [], []
        for k, mask in enumerate(self.masks):
            seeds, places = seed_hashes(self.hashes, owner, mask)
            of = lengths[owner[places]]
            used = of >= least if k < len(masks) else of == len(mask)
            seeds, places = seeds[used], places[used]
            order = np.argsort(seeds, kind="stable")
            self.seeds.append(seeds[order])
            self.places.append(places[order])
            sieve = np.zeros(1 << 20, bool)
            sieve[seeds >> np.uint64(44)] = True
            self.sieves.append(sieve)

    def overlaps(self, hashes: np.ndarray, text: np.ndarray, n_texts: int, min_tokens: int, min_equal: float):
        """``(text, item, n_tokens, n_equal, item tokens, first token, last token)`` of the best stretch per pair."""
        edges = np.searchsorted(text, np.arange(n_texts + 1))
        # One look for each text, item and diagonal; hits are expanded a piece at a time.
        looks: set[tuple] = set()
        for mask, seeds, places, sieve in zip(self.masks, self.seeds, self.places, self.sieves, strict=True):
            own, at = seed_hashes(hashes, text, mask)
            likely = sieve[own >> np.uint64(44)]
            own, at = own[likely], at[likely]
            low = np.searchsorted(seeds, own, "left")
            count = np.searchsorted(seeds, own, "right") - low
            some = count > 0
            at, low, count = at[some], low[some], count[some]
            ends = np.cumsum(count)
            first = 0
            while first < len(at):
                last = max(first + 1, int(np.searchsorted(ends, ends[first] - count[first] + HITS_AT_ONCE, "right")))
                hit = np.repeat(at[first:last], count[first:last])
                place = places[ragged(low[first:last], count[first:last])]
                item = np.searchsorted(self.first, place, "right") - 1
                begin = hit - (place - self.first[item])
                new = np.unique(np.stack([text[hit], item, begin], 1), axis=0)
                looks.update(map(tuple, new.tolist()))
                first = last
        best: dict[tuple[int, int], tuple] = {}
        for doc, which, begin in looks:
            i0, i1 = int(self.first[which]), int(self.first[which + 1])
            low, high = max(begin, int(edges[doc])), min(begin + i1 - i0, int(edges[doc + 1]))
            equal = hashes[low:high] == self.hashes[i0 + low - begin : i0 + high - begin]
            a, b = stretch(equal, min_equal)
            n, m = b - a, int(equal[a:b].sum())
            if n >= min(min_tokens, i1 - i0) and m >= min_equal * n:
                row = (m, n, -(low + a), i1 - i0)
                if best.get((doc, which), row) <= row:
                    best[doc, which] = row
        return [(doc, which, n, m, of, -start, -start + n) for (doc, which), (m, n, start, of) in sorted(best.items())]


def stretch(equal: np.ndarray, min_equal: float) -> tuple[int, int]:
    """The longest stretch that begins and ends with equal tokens and has at least the share of them; first of equals."""
    at = np.flatnonzero(equal)
    if not len(at):
        return 0, 0
    # Equal tokens earn (1 - share), others cost share: a stretch qualifies if its sum is not negative.
    value = np.concatenate([[0.0], np.cumsum(np.where(equal, 1 - min_equal, -min_equal))])
    best = (0, 0)
    for a in at.tolist():
        if at[-1] + 1 - a <= best[1] - best[0]:
            break
        ends = at[(value[at + 1] - value[a] > -1e-9) & (at >= a)]
        if len(ends) and ends[-1] + 1 - a > best[1] - best[0]:
            best = (a, int(ends[-1]) + 1)
    return best


def benchmark_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[tuple[list, list]]:
    """Benchmark items in id order, in blocks that fit in memory; one long item is a block of its own.

    A null text is empty and matches nothing; equal items are all reported.
    """
    sized = items.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text")
    ).orderBy("id", "text")
    ids, texts, size = [], [], 0
    for row in sized.toLocalIterator():
        more = len(row["text"].encode())
        if ids and size + more > block_bytes:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row["id"])
        texts.append(row["text"])
        size += more
    if ids:
        yield ids, texts


def find_overlaps(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    min_tokens: int = MIN_TOKENS,
    min_equal: float = MIN_EQUAL,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``(id, item_id, n_tokens, n_equal, item_tokens, start, end)``: the best overlap of each row and item.

    ``start`` and ``end`` are bytes of the UTF-8 text. Items are taken in blocks
    of bounded size, each held by every task and joined there with all windows of
    all documents; documents are never shuffled. Null and empty texts overlap
    with nothing, repeated rows give repeated results, and an empty benchmark or
    an empty table gives an empty result.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, {RESULT}"
    narrow = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    out = None
    for block in benchmark_blocks(items, item_col, item_text_col, block_bytes):
        shared = spark.sparkContext.broadcast(block)

        def work(batches: Iterator[pa.RecordBatch], shared=shared):
            block = Benchmark(*shared.value, min_tokens, min_equal)
            for batch in slices(batches, "_text"):
                hashes, text, starts, ends = token_hashes(batch.column("_text"))
                rows = block.overlaps(hashes, text, batch.num_rows, min_tokens, min_equal)
                if not rows:
                    continue
                doc, item, n, m, of, first, last = map(list, zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("_id").take(pa.array(doc)),
                        pa.array([block.ids[k] for k in item], pa.int64()),
                        *(pa.array(x, pa.int32()) for x in (n, m, of)),
                        pa.array(starts[np.array(first)].astype(np.int32)),
                        pa.array(ends[np.array(last) - 1].astype(np.int32)),
                    ],
                    ["id", "item_id", "n_tokens", "n_equal", "item_tokens", "start", "end"],
                )

        part = narrow.mapInArrow(work, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], schema)
    return out.withColumnRenamed("id", id_col)


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``(id, item_ids, n_items, longest)``: one row per id that overlaps with the benchmark.

    Rows with equal ids, null ids among them, give one row. An item without an id
    marks the documents that hold it, but is neither listed nor counted.
    """
    found = find_overlaps(docs, items, id_col, **options)
    # At most one row per row and item, and an item list is no longer than the benchmark.
    return found.groupBy(id_col).agg(
        F.sort_array(F.collect_set("item_id")).alias("item_ids"),
        F.countDistinct("item_id").alias("n_items"),
        F.max("n_tokens").alias("longest"),
    )


def drop_contaminated(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    min_tokens: int = MIN_TOKENS,
    min_equal: float = MIN_EQUAL,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs``, all columns, without the rows that overlap with the benchmark; no shuffle."""
    for block in benchmark_blocks(items, item_col, item_text_col, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def work(batches: Iterator[pa.RecordBatch], shared=shared):
            block = Benchmark(*shared.value, min_tokens, min_equal)
            for batch in slices(batches, text_col):
                hashes, text, _, _ = token_hashes(batch.column(text_col))
                rows = block.overlaps(hashes, text, batch.num_rows, min_tokens, min_equal)
                clean = np.ones(batch.num_rows, bool)
                clean[[r[0] for r in rows]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(work, docs.schema)
    return docs
