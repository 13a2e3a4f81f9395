"""Deleted interpolation: an n-gram language model over all documents, and the score of each.

The probability of a word given the words before it mixes maximum-likelihood
estimates of all orders: ``P_k = w * c(context, word) / c(context) + (1 - w) * P_(k-1)``
with a weight ``w`` for each order and bucket of context frequency (powers of
two), down to ``1 / (V + 1)``. Weights are found by expectation-maximisation on
counts of documents that are held back from the estimates meanwhile.

Texts are cut into blocks. A block sends each of its distinct n-grams once, as a
56-bit hash with its count, in packed runs to the buckets of the hash space.
A bucket adds the counts of all blocks and answers each run in its own order,
so that a block gets the corpus counts of everything it holds. Runs and answers
grow with the corpus, nothing of it is sent to the driver or to all tasks. Blocks
and answers are tables bucketed alike, so that scoring joins without a shuffle.

What the driver sees are histograms of a size set by their bins: of the counts of
held-back words, and of the ratios between the estimates of a token.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlrisk.llm.arrays import ASCII_SPACE, BASE, MIX_B, grouped, mix, pack, slices, text_bytes, unpack, word_hashes, words
from urlrisk.llm.blocks import batches_of, save_bucketed

ORDER = 3
# Bytes of text in a block (or one longer text) and, about, in the n-grams of a bucket.
BLOCK_BYTES = 6 << 20
SLICE_BYTES = 1 << 18
BUCKET_BYTES = 4 << 20
# Blocks in one bucket of the tables, at least.
TABLE_BYTES = 32 << 20
KEY_BITS = 56
ORDER_BITS = 2
END, PAD = np.uint64(0xE4D), np.uint64(0x9AD)
# Parts of a document's tokens in the estimates.
LEARNED, HELD_BACK, ONLY_SCORED = 0, 1, 2
# Bins of a ratio per doubling, and of a count beyond EXACT.
RATIO_BINS, COUNT_BINS, EXACT = 2, 16, 64
RATIO_SHIFT = 512
ROUNDS = 60

REQUEST = "bucket int, block long, held boolean, n int, keys binary, counts binary"
ANSWER = "block long, bucket int, counts binary, learned binary, bins array<struct<bin:int,types:long,weight:double,total:double>>"
# Bins of the totals among the bins of counts.
ALL_TOKENS, ALL_TYPES, LEARNED_TOKENS, LEARNED_TYPES = -1, -2, -3, -4


@dataclass
class Weights:
    """What the model needs beside the counts: sizes and mixture weights by order and bucket."""

    order: int
    tokens: int
    types: int
    learned_tokens: int
    learned_types: int
    lowest: float = 0.0
    mixed: dict[int, np.ndarray] = field(default_factory=dict)


@dataclass
class CountedCorpus:
    """Blocks of documents and the corpus counts of their n-grams, as tables bucketed alike."""

    spark: SparkSession
    blocks: str
    answers: str
    order: int
    bits: int
    id_type: str


# ---------------------------------------------------------------- n-grams of a block


class _Tokens:
    """Tokens of texts, each closed by an end token, and their n-gram hashes by order."""

    def __init__(self, texts: pa.Array, order: int):
        data, at = text_bytes(texts)
        starts, ends, of = words(data, at, ASCII_SPACE)
        n = len(texts)
        per_text = np.bincount(of, minlength=n).astype(np.int64) + 1
        self.stop = np.cumsum(per_text)
        self.start = self.stop - per_text
        self.code = np.full(int(per_text.sum()), END, np.uint64)
        self.code[np.arange(len(of)) + of] = word_hashes(data, starts, ends, fold=True)
        gram = mix(self.code + np.uint64(BASE))
        pad = mix(np.array([PAD], np.uint64))
        keys = [self._key(gram, 1)]
        for k in range(2, order + 1):
            # The n-gram of order k - 1 that ends one token before; padding stands before a text.
            before = np.empty_like(gram)
            before[1:] = gram[:-1]
            before[self.start] = pad[0]
            gram = mix(before * np.uint64(MIX_B) + self.code + np.uint64(k))
            pad = mix(pad * np.uint64(MIX_B) + PAD + np.uint64(k))
            keys.append(self._key(gram, k))
        del gram, before
        self.keys = np.concatenate(keys)

    def _key(self, gram: np.ndarray, order: int) -> np.ndarray:
        low = np.uint64((1 << ORDER_BITS) - 1)
        return (gram >> np.uint64(64 - KEY_BITS)) & ~low | np.uint64(order - 1)

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct keys, sorted, and which of them each n-gram is."""
        by_key = np.argsort(self.keys)
        ordered = self.keys[by_key]
        fresh = np.ones(len(ordered), bool)
        fresh[1:] = ordered[1:] != ordered[:-1]
        place = np.empty(len(ordered), np.int64)
        place[by_key] = np.cumsum(fresh) - 1
        return ordered[fresh], place


def _packed(counts: np.ndarray) -> bytes:
    """One byte per count, 255 for one of the wide counts, which follow; few values are frequent, so compressed."""
    wide = counts[counts >= 255]
    raw = np.minimum(counts, 255).astype(np.uint8).tobytes() + wide.astype("<u8").tobytes()
    return len(raw).to_bytes(4, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    raw = pa.decompress(packed[4:], int.from_bytes(packed[:4], "little"), "zstd", asbytes=True)
    counts = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(raw, "<u8", offset=n)
    return counts


def _coded(steps: np.ndarray) -> bytes:
    """Rice code of the distances between sorted keys: their low bits, then the rest in unary."""
    low = max(0, int(float(steps.mean()) * 0.69).bit_length() - 1)
    whole, rest = divmod(low, 8)
    high = (steps >> np.uint64(low)).astype(np.int64)
    ends = np.cumsum(high + 1)
    unary = np.zeros(int(ends[-1]), bool)
    unary[ends - 1] = True
    bits = (steps >> np.uint64(8 * whole))[:, None] >> np.arange(rest, dtype=np.uint64) & np.uint64(1)
    return bytes([low]) + pack(steps, whole).tobytes() + np.packbits(bits.astype(bool)).tobytes() + np.packbits(unary).tobytes()


def _decoded(raw: bytes, n: int) -> np.ndarray:
    whole, rest = divmod(raw[0], 8)
    at, end = 1 + n * whole, 1 + n * whole + (n * rest + 7) // 8
    steps = unpack(raw[1:at], whole) if whole else np.zeros(n, np.uint64)
    bits = np.unpackbits(np.frombuffer(raw[at:end], np.uint8), count=n * rest).reshape(n, rest)
    for k in range(rest):
        steps |= bits[:, k].astype(np.uint64) << np.uint64(8 * whole + k)
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(raw[end:], np.uint8)))[:n]
    high = np.diff(ends, prepend=-1) - 1
    return steps | high.astype(np.uint64) << np.uint64(raw[0])


def _requests(block: int, texts: pa.Array, parts: np.ndarray, order: int, bits: int) -> Iterator[dict]:
    """Runs of distinct keys with their counts in the block, one per bucket."""
    tokens = _Tokens(texts, order)
    keys, place = tokens.places()
    counted = np.repeat(parts != ONLY_SCORED, tokens.stop - tokens.start)
    counts = np.bincount(place[np.tile(counted, order)], minlength=len(keys))
    bucket = (keys >> np.uint64(KEY_BITS - bits)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True):
        step = np.diff(keys[a:b], prepend=np.uint64(int(bucket[a]) << (KEY_BITS - bits)))
        yield {
            "bucket": int(bucket[a]), "block": block, "held": bool(parts[0] == HELD_BACK), "n": int(b - a),
            "keys": _coded(step), "counts": _packed(counts[a:b]),
        }


# ---------------------------------------------------------------- counts of a bucket


def _count_bin(counts: np.ndarray) -> np.ndarray:
    wide = EXACT + np.floor(COUNT_BINS * np.log2(np.maximum(counts, EXACT) / EXACT)).astype(np.int64)
    return np.where(counts < EXACT, counts, wide)


def _answers(runs: pa.Table, bits: int) -> Iterator[dict]:
    """For each run of one bucket the corpus counts of its keys, then the bucket's histogram of word counts."""
    rows = runs.to_pylist()
    bucket = rows[0]["bucket"]
    floor = np.uint64(bucket << (KEY_BITS - bits))
    keys, counts = [], []
    for row in rows:
        keys.append(np.cumsum(_decoded(row["keys"], row["n"]), dtype=np.uint64) + floor)
        counts.append(_unpacked(row["counts"], row["n"]))
    sizes = [row["n"] for row in rows]
    held = np.repeat([row["held"] for row in rows], sizes)
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    by_key = np.argsort(keys)
    ordered = keys[by_key]
    fresh = np.ones(len(ordered), bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    place = np.empty(len(ordered), np.int64)
    place[by_key] = np.cumsum(fresh) - 1
    n = int(fresh.sum())
    back = np.bincount(place[held], counts[held], n).astype(np.int64)
    learned = np.bincount(place[~held], counts[~held], n).astype(np.int64)
    for row, mine in zip(rows, np.split(place, np.cumsum(sizes)[:-1]), strict=True):
        # Counts without the documents held back are of use to these only.
        apart = _packed(learned[mine]) if row["held"] else None
        yield {"block": row["block"], "bucket": bucket, "counts": _packed((learned + back)[mine]), "learned": apart, "bins": None}
    unigram = (ordered[fresh] & np.uint64((1 << ORDER_BITS) - 1)) == 0
    learned, back = learned[unigram], back[unigram]
    bins = [
        {"bin": ALL_TOKENS, "types": 0, "weight": float((learned + back).sum()), "total": 0.0},
        {"bin": ALL_TYPES, "types": int(((learned + back) > 0).sum()), "weight": 0.0, "total": 0.0},
        {"bin": LEARNED_TOKENS, "types": 0, "weight": float(learned.sum()), "total": 0.0},
        {"bin": LEARNED_TYPES, "types": int((learned > 0).sum()), "weight": 0.0, "total": 0.0},
    ]
    seen = back > 0
    found, at = np.unique(_count_bin(learned[seen]), return_inverse=True)
    weight = np.bincount(at, back[seen], len(found))
    total = np.bincount(at, back[seen] * learned[seen], len(found))
    bins += [{"bin": int(b), "types": 0, "weight": float(w), "total": float(t)} for b, w, t in zip(found, weight, total, strict=True)]
    yield {"block": -1 - bucket, "bucket": bucket, "counts": None, "learned": None, "bins": bins}


# ---------------------------------------------------------------- tables


def count_corpus(
    docs: DataFrame, learn: str, hold_back: str, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER
) -> CountedCorpus:
    """Count the n-grams of all documents; ``learn`` and ``hold_back`` are SQL conditions on their columns.

    Tokens are runs other than ASCII white space, A-Z as a-z, and one end token
    per document. Those that ``learn`` names are counted; those of them that
    ``hold_back`` names are kept apart for the weights. An unknown condition counts
    as false. A null text is empty. Order is 2 to 4.
    """
    if not 2 <= order <= 1 << ORDER_BITS:
        raise ValueError("order is 2 to 4")
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = F.coalesce(F.expr(learn), F.lit(False))
    part = F.when(~known, ONLY_SCORED).when(F.coalesce(F.expr(hold_back), F.lit(False)), HELD_BACK).otherwise(LEARNED)
    narrow = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), part.cast("int").alias("part")
    )
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    bits = max(1, (size // BUCKET_BYTES).bit_length())
    buckets = max(parts, size // TABLE_BYTES)
    id_type = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]):
        task, seq = TaskContext.get().partitionId(), 0
        held = {True: [], False: []}  # documents held back have blocks of their own
        sizes = {True: 0, False: 0}

        def block(back):
            nonlocal seq
            rows = pa.Table.from_batches(held[back]).combine_chunks()
            number, seq = (task << 32) + seq, seq + 1
            held[back], sizes[back] = [], 0
            columns = [rows.column(x).combine_chunks() for x in ("id", "part", "text")]
            columns = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in columns]
            offsets = pa.array([0, len(rows)], pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([back]), *(pa.ListArray.from_arrays(offsets, x) for x in columns)],
                ["block", "held", "ids", "parts", "texts"],
            )

        for batch in slices(batches, "text", min(SLICE_BYTES, BLOCK_BYTES)):
            is_back = pc.equal(batch.column("part"), HELD_BACK)
            for back, mask in ((True, is_back), (False, pc.invert(is_back))):
                some = batch.filter(mask)
                if some.num_rows:
                    held[back].append(some)
                    sizes[back] += some.nbytes
                    if sizes[back] >= BLOCK_BYTES:
                        yield block(back)
        for back in (True, False):
            if held[back]:
                yield block(back)

    schema = f"block long, held boolean, ids array<{id_type}>, parts array<int>, texts array<string>"
    blocks = save_bucketed(narrow.mapInArrow(cut, schema), "lm_blocks", buckets, "block")

    def ask(batches: Iterator[pa.RecordBatch]):
        asked = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("held", pa.bool_()), ("n", pa.int32()),
                           ("keys", pa.binary()), ("counts", pa.binary())])
        for batch in batches:
            for k in range(batch.num_rows):
                texts, part = batch.column("texts")[k].values, batch.column("parts")[k].values.to_numpy()
                yield from batches_of(_requests(batch.column("block")[k].as_py(), texts, part, order, bits), asked)

    def answer(batches: Iterator[pa.RecordBatch]):
        a_bin = pa.struct([("bin", pa.int32()), ("types", pa.int64()), ("weight", pa.float64()), ("total", pa.float64())])
        told = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("counts", pa.binary()), ("learned", pa.binary()),
                          ("bins", pa.list_(a_bin))])
        for runs in grouped(batches, "bucket"):
            yield from batches_of(_answers(runs, bits), told)

    asked = spark.table(blocks).select("block", "parts", "texts").mapInArrow(ask, REQUEST)
    told = asked.repartition("bucket").sortWithinPartitions("bucket", "block").mapInArrow(answer, ANSWER)
    # A block has one answer per bucket, together as long as its own n-grams.
    per_block = told.repartition(buckets, "block").groupBy("block").agg(
        F.sort_array(F.collect_list(F.struct("bucket", "counts", "learned"))).alias("answers"),
        F.first("bins", ignorenulls=True).alias("bins"),
    )
    return CountedCorpus(spark, blocks, save_bucketed(per_block, "lm_answers", buckets, "block"), order, bits, id_type)


# ---------------------------------------------------------------- estimates of a block


class _Counted:
    """Corpus counts of each token's n-grams and contexts, from the answers to a block."""

    def __init__(self, texts: pa.Array, space: tuple[int, int], answers: pa.StructArray, learned_only: bool):
        order, bits = space
        self.tokens = _Tokens(texts, order)
        keys, place = self.tokens.places()
        asked, sizes = np.unique(keys >> np.uint64(KEY_BITS - bits), return_counts=True)
        if answers.field("bucket").to_numpy().tolist() != asked.tolist():
            raise ValueError("the answers are not those to this block")
        told = answers.field("learned" if learned_only else "counts").to_pylist()
        of_key = np.concatenate([_unpacked(packed, n) for packed, n in zip(told, sizes.tolist(), strict=True)])
        n = len(self.tokens.code)
        self.grams = [of_key[place[k * n : (k + 1) * n]] for k in range(order)]

    def context(self, order: int) -> np.ndarray:
        """How often the ``order - 1`` tokens before each token were counted."""
        counts = self.grams[order - 2]
        before = np.empty_like(counts)
        before[1:] = counts[:-1]
        # Before a text stands padding, counted as often as texts end.
        before[self.tokens.start] = self.grams[0][self.tokens.stop - 1]
        return before

    def estimates(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """Bucket of each context's frequency, 0 if it was never counted, and the estimate behind it."""
        context = self.context(order)
        return np.frexp(context)[1], self.grams[order - 1] / np.maximum(context, 1)

    def probabilities(self, weights: Weights, learned_only: bool = False, order: int | None = None) -> np.ndarray:
        tokens, types = weights.tokens, weights.types
        if learned_only:
            tokens, types = weights.learned_tokens, weights.learned_types
        chance = weights.lowest * self.grams[0] / max(tokens, 1) + (1 - weights.lowest) / (types + 1)
        for k in range(2, (order or weights.order) + 1):
            bucket, estimate = self.estimates(k)
            weight = weights.mixed[k][bucket]
            chance = weight * estimate + (1 - weight) * chance
        return chance


def _joined(corpus: CountedCorpus, held_only: bool = False) -> DataFrame:
    spark = corpus.spark
    blocks = spark.table(corpus.blocks)
    if held_only:
        blocks = blocks.filter("held")
    return blocks.join(spark.table(corpus.answers).select("block", "answers"), "block")


def _of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield (
                *(batch.column(x)[k].values for x in ("ids", "parts", "texts")),
                batch.column("answers")[k].values,
            )


# ---------------------------------------------------------------- weights


def _climb(weight: np.ndarray, ratio: np.ndarray) -> float:
    """Weight of an estimate against the one below it, ``ratio`` to 1, that makes ``weight`` tokens likeliest."""
    w = 0.5
    for _ in range(ROUNDS):
        share = w * ratio / (w * ratio + 1 - w)
        w = float((weight * share).sum() / weight.sum())
    return w


def learn_weights(corpus: CountedCorpus) -> Weights:
    """Mixture weights by expectation-maximisation on the documents held back.

    Estimates come from the learned documents alone. The weight of the word
    frequencies needs the histogram of their counts; those of the higher orders
    are found together, from the histogram of the tokens by context buckets and
    ratios of the estimates to the word's probability, in halves of a doubling,
    each cell with its mean ratios. Both have as many rows as bins, whatever the
    corpus. A bucket that no held-back token met takes the weight of the nearest
    lower one; without held-back documents all weights are one half, and an
    estimate without a counted context has none.
    """
    spark, order = corpus.spark, corpus.order
    bins = spark.table(corpus.answers).filter("block < 0").select(F.explode("bins").alias("b"))
    rows = bins.groupBy("b.bin").agg(F.sum("b.types").alias("types"), F.sum("b.weight").alias("weight"), F.sum("b.total").alias("total")).collect()
    told = {row["bin"]: row for row in rows}

    def total(key, name):
        return int(told[key][name]) if key in told else 0

    weights = Weights(
        order, total(ALL_TOKENS, "weight"), total(ALL_TYPES, "types"), total(LEARNED_TOKENS, "weight"), total(LEARNED_TYPES, "types")
    )
    counted = [row for row in rows if row["bin"] >= 0]
    weight = np.array([row["weight"] for row in counted])
    mean = np.array([row["total"] / row["weight"] for row in counted])
    weights.lowest = 0.5 if weights.tokens else 0.0
    if len(counted) and weights.learned_tokens:
        weights.lowest = _climb(weight, mean / weights.learned_tokens * (weights.learned_types + 1))
    weights.mixed = {k: np.r_[0.0, np.full(64, 0.5)] for k in range(2, order + 1)}
    if len(counted) and weights.learned_tokens:
        _climb_orders(weights, _cells(corpus, weights))
    return weights


def _cells(corpus: CountedCorpus, weights: Weights) -> np.ndarray:
    """Rows (buckets of orders 2.., mean ratios of orders 2.., tokens) over the documents held back."""
    orders = range(2, corpus.order + 1)
    shared = (corpus.order, corpus.bits)
    n = len(orders)

    def work(batches: Iterator[pa.RecordBatch]):
        for _, _, texts, answers in _of_blocks(batches):
            found = _Counted(texts, shared, answers, learned_only=True)
            chance = found.probabilities(weights, learned_only=True, order=1)
            cell = np.zeros(len(chance), np.int64)
            ratios = []
            for k in orders:
                bucket, estimate = found.estimates(k)
                ratio = estimate / chance
                step = np.floor(RATIO_BINS * np.log2(np.where(ratio > 0, ratio, 1))).astype(np.int64) + RATIO_SHIFT
                cell = (cell << 16) | (bucket.astype(np.int64) << 10) | np.where(ratio > 0, np.clip(step, 1, 1023), 0)
                ratios.append(ratio)
            cells, at, tokens = np.unique(cell, return_inverse=True, return_counts=True)
            sums = [pa.array(np.bincount(at, r, len(cells))) for r in ratios]
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(tokens), *sums], ["cell", "tokens", *(f"r{k}" for k in orders)])

    schema = "cell long, tokens long, " + ", ".join(f"r{k} double" for k in orders)
    sums = [F.sum(f"r{k}").alias(f"r{k}") for k in orders]
    cells = _joined(corpus, held_only=True).mapInArrow(work, schema).groupBy("cell").agg(F.sum("tokens").alias("tokens"), *sums)
    table = cells.orderBy("cell").toPandas()
    cell, tokens = table["cell"].to_numpy(), table["tokens"].to_numpy().astype(float)
    buckets = [(cell >> (16 * (n - 1 - k) + 10)) & 63 for k in range(n)]
    return np.column_stack([*buckets, *(table[f"r{k}"].to_numpy() / tokens for k in orders), tokens])


def _climb_orders(weights: Weights, cells: np.ndarray) -> None:
    n = weights.order - 1
    buckets, ratios, tokens = cells[:, :n].astype(int), cells[:, n : 2 * n], cells[:, -1]
    mixed = [weights.mixed[k] for k in range(2, weights.order + 1)]
    for _ in range(ROUNDS):
        chance = [np.ones(len(cells))]
        for k in range(n):
            w = mixed[k][buckets[:, k]]
            chance.append(w * ratios[:, k] + (1 - w) * chance[-1])
        reach = tokens
        for k in range(n - 1, -1, -1):
            w = mixed[k][buckets[:, k]]
            stay = reach * w * ratios[:, k] / chance[k + 1]
            met = np.bincount(buckets[:, k], reach, len(mixed[k]))
            kept = np.bincount(buckets[:, k], stay, len(mixed[k]))
            mixed[k][met > 0] = kept[met > 0] / met[met > 0]
            reach = reach - stay
    for k in range(n):
        met = np.bincount(buckets[:, k], tokens, len(mixed[k])) > 0
        mixed[k][0], met[0] = 0.0, True
        last = 0.0
        for b in range(1, len(met)):
            last = mixed[k][b] = mixed[k][b] if met[b] else last


# ---------------------------------------------------------------- scores


def score_corpus(corpus: CountedCorpus, weights: Weights, id_col: str = "doc_id") -> DataFrame:
    """Each document's tokens and their log10 probabilities, one row per row of the table counted.

    ``(id, part, n_tokens, n_known, train_tokens, base_score, score)``. Counts are
    those of all learned documents, held back or not. ``base_score`` adds one to
    the count of every word; ``n_known`` tokens have a count. ``part`` is 2 for
    documents that were only scored. An empty text is its end token; rows with
    equal or null ids have scores of their own; an empty table gives no rows. If
    nothing was learned every token has probability 1.
    """
    shared = (corpus.order, corpus.bits)

    def work(batches: Iterator[pa.RecordBatch]):
        for ids, parts, texts, answers in _of_blocks(batches):
            found = _Counted(texts, shared, answers, learned_only=False)
            start = found.tokens.start
            count = found.grams[0]
            base = np.log10((count + 1) / (weights.tokens + weights.types + 1))
            score = np.log10(found.probabilities(weights))
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [
                    ids, parts, pa.array(found.tokens.stop - start), pa.array(np.add.reduceat((count > 0).astype(np.int64), start)),
                    pa.array(np.full(n, weights.tokens, np.int64)), pa.array(np.add.reduceat(base, start)),
                    pa.array(np.add.reduceat(score, start)),
                ],
                ["id", "part", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    schema = f"id {corpus.id_type}, part int, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return _joined(corpus).mapInArrow(work, schema).withColumnRenamed("id", id_col)
