"""Byte-level BPE by replaying merges over the distinct words of the corpus.

A word is one match of the pattern. Texts are cut into blocks; a block keeps the
sequence of its words as numbers and asks the hash buckets of all words for those
that are no token by themselves. A bucket meets every block's wording of a word
but replays it once: words new to it are laid side by side, an inverted index lists
for every rank of a pair of neighbouring tokens the positions among all these words
where the pair stands, and merges are taken in rank order. A merge visits the
positions of its pair only, joins the two tokens and re-indexes the two neighbours
it touched. The bucket answers each request in its own order, so a block gets the
ids of what it holds. Texts are split once and never shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlrisk.llm.arrays import ragged, slices, word_hashes
from urlrisk.llm.blocks import batches_of, save_bucketed

# Bytes of text in a block (or one longer text).
BLOCK_BYTES = 6 << 20
SLICE_BYTES = 1 << 18
# Bytes of text for each bucket of words, and for each bucket of the table of blocks.
BUCKET_BYTES = 32 << 20
TABLE_BYTES = 32 << 20
# Bytes of asked words that one replay takes at most, or one longer request.
GATHERED_BYTES = 24 << 20
# Below this many positions a merge is done one by one.
FEW = 6

ASKED = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("lengths", pa.binary()), ("words", pa.binary())])
TOLD = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("counts", pa.binary()), ("ids", pa.binary())])


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a local file of ``base64 rank`` lines, read on the driver."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


class Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word):
        number = self[word] = len(self)
        return number


def pair_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Every way to split a token into two tokens: sorted pair keys, and the ranks of the tokens."""
    width = max(ranks.values()) + 1
    keys, values = [], []
    for token, rank in ranks.items():
        for k in range(1, len(token)):
            a, b = ranks.get(token[:k]), ranks.get(token[k:])
            if a is not None and b is not None:
                keys.append(a * width + b)
                values.append(rank)
    order = np.argsort(np.array(keys, np.int64))
    return (
        np.append(np.array(keys, np.int64)[order], np.iinfo(np.int64).max),
        np.append(np.array(values, np.int64)[order], -1),
    )


class Decoder:
    """Bytes of ids for one rank table."""

    def __init__(self, ranks: dict[bytes, int]):
        ids = sorted(ranks.values())
        by_id = {rank: token for token, rank in ranks.items()}
        self.width = ids[-1] + 1
        length = np.zeros(self.width + 1, np.int64)
        length[ids] = [len(by_id[i]) for i in ids]
        self.token_length = length
        self.token_start = np.cumsum(length) - length
        self.token_bytes = np.frombuffer(b"".join(by_id[i] for i in ids), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        ids = ids.astype(np.int64)
        return self.token_bytes[ragged(self.token_start[ids], self.token_length[ids])].tobytes()


class MergeReplay:
    """Encoder of words for one rank table and its :func:`pair_table`."""

    def __init__(self, ranks: dict[bytes, int], pair_keys: np.ndarray, pair_ranks: np.ndarray):
        self.ranks = ranks
        self.width = max(ranks.values()) + 1
        self.bytes_to_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.pair_keys, self.pair_ranks = pair_keys, pair_ranks

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that two neighbours make, or -1."""
        keys = left.astype(np.int64) * self.width + right
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1)

    def encode_words(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another and their number in each word."""
        whole = np.array([self.ranks.get(w, -1) for w in words], np.int64)
        parts = [b"" if k >= 0 else w for w, k in zip(words, whole.tolist(), strict=True)]
        length = np.array([len(w) for w in parts], np.int64)
        word = np.repeat(np.arange(len(words), dtype=np.int32), length)
        ids = self.bytes_to_id[np.frombuffer(b"".join(parts), np.uint8)]
        replayed = _Replay(self, ids, word)
        replayed.run()
        alive = replayed.ids[:-1] >= 0
        counts = np.bincount(word[alive], minlength=len(words))
        counts[whole >= 0] = 1
        out = np.empty(int(counts.sum()), np.int32)
        starts = np.cumsum(counts) - counts
        single = np.zeros(len(out), bool)
        single[starts[whole >= 0]] = True
        out[single], out[~single] = whole[whole >= 0], replayed.ids[:-1][alive]
        return out, counts


class _Replay:
    """Tokens of many words as linked lists, and the index from pair rank to positions."""

    def __init__(self, table: MergeReplay, ids: np.ndarray, word: np.ndarray):
        n = len(ids)
        self.table = table
        # One more cell at the end stands for "no neighbour".
        self.ids = np.append(ids, np.int32(-1))
        self.word = np.append(word, np.int32(-1))
        inner = np.zeros(n + 1, bool)
        inner[1:n] = word[1:] == word[:-1]
        place = np.arange(n + 1, dtype=np.int32)
        self.left = np.where(inner, place - 1, np.int32(n))
        self.right = np.full(n + 1, n, np.int32)
        self.right[:-1][inner[1:]] = place[1:][inner[1:]]
        self.pair = np.full(n + 1, -1, np.int32)
        has = np.flatnonzero(self.right < n)
        self.pair[has] = table.ranks_of(self.ids[has], self.ids[has + 1])
        self.none = n
        self.mark = np.zeros(n + 1, bool)
        self.index: dict[int, list[np.ndarray]] = {}
        self.heap: list[int] = []
        self.note(has)

    def note(self, places: np.ndarray) -> None:
        """File positions under the rank of the pair that begins there."""
        rank = self.pair[places]
        places, rank = places[rank >= 0], rank[rank >= 0]
        if not len(places):
            return
        order = np.argsort(rank, kind="stable")
        places, rank = places[order], rank[order]
        cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        first = [0, *cuts.tolist()]
        for a, b, r in zip(first, [*first[1:], len(rank)], rank[first].tolist(), strict=True):
            found = self.index.get(r)
            if found is None:
                self.index[r] = [places[a:b]]
                heapq.heappush(self.heap, r)
            else:
                found.append(places[a:b])

    def run(self) -> None:
        while self.heap:
            rank = heapq.heappop(self.heap)
            chunks = self.index.pop(rank)
            places = np.sort(np.concatenate(chunks)) if len(chunks) > 1 else np.sort(chunks[0])
            places = places[np.append(True, places[1:] != places[:-1]) & (self.pair[places] == rank)]
            if len(places) < FEW or not self.merge_all(rank, places):
                self.merge_each(rank, places)

    def merge_all(self, rank: int, p: np.ndarray) -> bool:
        """Merge all positions at once; refused where the order inside a word could matter."""
        ids, left, right, mark, none = self.ids, self.left, self.right, self.mark, self.none
        q = right[p]
        before, after = left[p], right[q]
        mark[p] = True
        overlap, adjacent = mark[q].any(), mark[after].any()
        mark[p] = False
        if overlap:
            return False
        same = np.full(len(p), rank)
        ahead = np.where(after < none, self.table.ranks_of(same, ids[after]), -1)
        behind = np.where(before < none, self.table.ranks_of(ids[before], same), -1)
        twice = self.table.ranks_of(same[:1], same[:1])
        for new in (ahead, behind, twice) if adjacent else (ahead, behind):
            if ((new >= 0) & (new < rank)).any():
                return False
        ids[p], ids[q] = rank, -1
        right[p] = after
        left[after] = p
        self.pair[q] = -1
        self.pair[p] = ahead
        if adjacent:
            follows = ids[after] == rank
            self.pair[p[follows]] = twice[0]
        # A neighbour before that was merged away has its position among p already.
        outside = ids[before] >= 0
        ahead_of = before[outside]
        self.pair[ahead_of] = behind[outside]
        self.note(np.concatenate([p, ahead_of]))
        return True

    def merge_each(self, rank: int, places: np.ndarray) -> None:
        """Merge from left to right; a word in which a lower rank turns up waits for it."""
        waiting = -1
        for p in places.tolist():
            if self.pair[p] != rank:
                continue
            if self.word[p] == waiting:
                self.note(np.array([p]))
                continue
            q = self.right[p]
            after, before = self.right[q], self.left[p]
            self.ids[p], self.ids[q] = rank, -1
            self.right[p] = after
            self.pair[q] = -1
            if after < self.none:
                self.left[after] = p
            touched = np.array([x for x in (before, p) if x < self.none])
            following = self.right[touched]
            new = np.where(following < self.none, self.table.ranks_of(self.ids[touched], self.ids[following]), -1)
            self.pair[touched] = new
            self.note(touched)
            if ((new >= 0) & (new < rank)).any():
                waiting = self.word[p]


# ---------------------------------------------------------------- packed columns


def _squeezed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _restored(packed: bytes) -> bytes:
    return pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), "zstd", asbytes=True)


def _numbers(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, compressed by byte planes: the high bytes are mostly alike."""
    return _squeezed(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _to_numbers(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(_restored(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


# ---------------------------------------------------------------- blocks, requests, answers


class Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word):
        number = self[word] = len(self)
        return number


def _block(rows: pa.Table, split, ranks: dict[bytes, int], width: int) -> dict:
    """Words of the rows' texts as numbers: ids of words that are tokens, from ``width`` on places among the others."""
    numbers = Numbers()
    place = numbers.__getitem__
    pieces = [np.fromiter(map(place, split(text)), np.int32) for text in rows.column("text").to_pylist()]
    spelt = [word.encode() for word in numbers]
    code = np.array([ranks.get(word, -1) for word in spelt], np.int64)
    others = np.flatnonzero(code < 0)
    code[others] = width + np.arange(len(others))
    asked = [spelt[k] for k in others.tolist()]
    return {
        "sizes": _numbers(np.array([len(x) for x in pieces], np.int64)),
        "codes": _numbers(code[np.concatenate(pieces)]),
        "lengths": _numbers(np.array([len(x) for x in asked], np.int64)),
        "words": _squeezed(b"".join(asked)),
    }


def _by_bucket(lengths: np.ndarray, data: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of words by bucket, and the bucket of each in that order."""
    ends = np.cumsum(lengths)
    bucket = (word_hashes(data, ends - lengths, ends) >> np.uint64(64 - bits)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, bucket[order]


def _requests(block: int, lengths: np.ndarray, data: np.ndarray, bits: int) -> Iterator[dict]:
    order, bucket = _by_bucket(lengths, data, bits)
    starts = np.cumsum(lengths) - lengths
    edges = [*np.flatnonzero(np.diff(bucket, prepend=-1)).tolist(), len(order)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        some = order[a:b]
        spelt = data[ragged(starts[some], lengths[some])].tobytes()
        yield {"bucket": int(bucket[a]), "block": block, "lengths": _numbers(lengths[some]), "words": _squeezed(spelt)}


class _Encoded:
    """Ids of the words met so far; each is replayed once."""

    def __init__(self, replay: MergeReplay):
        self.replay = replay
        self.numbers = Numbers()
        self.ids, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def answers(self, rows: list[dict]) -> Iterator[dict]:
        number, asked = self.numbers.__getitem__, []
        done = len(self.numbers)
        for row in rows:
            ends = np.cumsum(row["sizes"]).tolist()
            raw = row["spelt"]
            asked.append(np.fromiter((number(raw[a:b]) for a, b in zip([0, *ends], ends, strict=False)), np.int64))
        if len(self.numbers) > done:
            ids, counts = self.replay.encode_words(list(self.numbers)[done:])
            self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])
        starts = np.cumsum(self.counts) - self.counts
        for row, mine in zip(rows, asked, strict=True):
            counts = self.counts[mine]
            ids = self.ids[ragged(starts[mine], counts)]
            yield {"block": row["block"], "bucket": row["bucket"], "counts": _numbers(counts), "ids": _numbers(ids)}


def _answered(batches: Iterator[pa.RecordBatch], replay: MergeReplay) -> Iterator[dict]:
    """Answers to requests sorted by bucket.

    Requests are taken up to GATHERED_BYTES at a time. Words are remembered while
    their bucket goes on, so what is held are the distinct words of a bucket and one
    such piece, however many blocks ask for a word.
    """
    known, held, size, last = _Encoded(replay), [], 0, None
    for batch in batches:
        for row in batch.to_pylist():
            row = {
                "bucket": row["bucket"], "block": row["block"],
                "sizes": _to_numbers(row["lengths"]), "spelt": _restored(row["words"]),
            }
            if held and size + len(row["spelt"]) > GATHERED_BYTES:
                if held[0]["bucket"] != last:
                    known = _Encoded(replay)
                yield from known.answers(held)
                held, size, last = [], 0, held[-1]["bucket"]
            held.append(row)
            size += len(row["spelt"]) + 8 * len(row["sizes"])
    if held:
        if held[0]["bucket"] != last:
            known = _Encoded(replay)
        yield from known.answers(held)


def _ids_of(row: dict, width: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a block one after another, and their number in each text."""
    codes, sizes, lengths = (_to_numbers(row[x]) for x in ("codes", "sizes", "lengths"))
    counts, pool = np.zeros(len(lengths), np.int64), np.zeros(0, np.int64)
    starts = np.zeros(len(lengths), np.int64)
    if len(lengths):
        order, _ = _by_bucket(lengths, np.frombuffer(_restored(row["words"]), np.uint8), bits)
        told = np.concatenate([_to_numbers(x["counts"]) for x in row["answers"]])
        pool = np.concatenate([_to_numbers(x["ids"]) for x in row["answers"]])
        counts[order] = told
        starts[order] = np.cumsum(told) - told
    tokens = np.arange(width)
    pool = np.concatenate([tokens, pool])
    starts, counts = np.concatenate([tokens, width + starts]), np.concatenate([np.ones(width, np.int64), counts])
    each = counts[codes]
    ends = np.append(0, np.cumsum(each))[np.append(0, np.cumsum(sizes))]
    return pool[ragged(starts[codes], each)].astype(np.int32), np.diff(ends)


def _mapped(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str, text_col: str, schema: str, row) -> DataFrame:
    """Rows ``(id, *row(decoder, ids of each text))``; the rank table goes to each executor once."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(ranks)
    pairs = spark.sparkContext.broadcast(pair_table(ranks))
    width = max(ranks.values()) + 1
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    id_type = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    size = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(1, (size // BUCKET_BYTES).bit_length())
    buckets = max(parts, size // TABLE_BYTES)

    def cut(batches: Iterator[pa.RecordBatch]):
        split, known = regex.compile(pattern).findall, shared.value
        task, seq = TaskContext.get().partitionId() << 32, 0
        held, size = [], 0

        def block():
            rows = pa.Table.from_batches(held).combine_chunks()
            made = {"block": task + seq, **_block(rows, split, known, width)}
            ids = pa.concat_arrays(rows.column("id").chunks)
            columns = [pa.array([x], pa.int64() if isinstance(x, int) else pa.binary()) for x in made.values()]
            listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            return pa.RecordBatch.from_arrays([*columns, listed], [*made, "docs"])

        for batch in slices(batches, "text", SLICE_BYTES):
            held.append(batch)
            size += batch.nbytes
            if size >= BLOCK_BYTES:
                yield block()
                held, size, seq = [], 0, seq + 1
        if held:
            yield block()

    def ask(batches: Iterator[pa.RecordBatch]):
        def requests():
            for batch in batches:
                for some in batch.to_pylist():
                    spelt = np.frombuffer(_restored(some["words"]), np.uint8)
                    yield from _requests(some["block"], _to_numbers(some["lengths"]), spelt, bits)

        yield from batches_of(requests(), ASKED)

    def answer(batches: Iterator[pa.RecordBatch]):
        first = next(batches, None)
        if first is None:
            return

        def whole():
            yield first
            yield from batches

        yield from batches_of(_answered(whole(), MergeReplay(shared.value, *pairs.value)), TOLD)

    def finish(batches: Iterator[pa.RecordBatch]):
        decoder = None
        for batch in batches:
            for k in range(batch.num_rows):
                decoder = decoder or Decoder(shared.value)
                one = {x: batch.column(x)[k].as_py() for x in ("codes", "sizes", "lengths", "words", "answers")}
                ids, counts = _ids_of(one, width, bits)
                columns = row(decoder, np.split(ids, np.cumsum(counts)[:-1]))
                yield pa.RecordBatch.from_arrays([batch.column("docs")[k].values, *columns.values()], ["id", *columns])

    schema_of_block = f"block long, sizes binary, codes binary, lengths binary, words binary, docs array<{id_type}>"
    name = save_bucketed(narrow.mapInArrow(cut, schema_of_block), "bpe_blocks", buckets, "block")
    blocks = spark.table(name)
    asked = blocks.select("block", "lengths", "words").mapInArrow(ask, "bucket int, block long, lengths binary, words binary")
    told = (
        asked.repartition(parts, "bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(answer, "block long, bucket int, counts binary, ids binary")
    )
    # A block has one answer per bucket, together as long as the ids of its own words.
    per_block = told.repartition(buckets, "block").groupBy("block").agg(
        F.sort_array(F.collect_list(F.struct("bucket", "counts", "ids"))).alias("answers")
    )
    return (
        blocks.join(per_block, "block", "left")
        .select("docs", "codes", "sizes", "lengths", "words", "answers")
        .mapInArrow(finish, f"id {id_type}, {schema}")
        .withColumnRenamed("id", id_col)
    )


def encode_documents(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id, ids array<int>, decoded binary)`` of every whole text, without special tokens.

    Each match of ``pattern`` is encoded by itself. A null text is empty and has
    no ids; rows are independent, so repeated rows give repeated results. ``ranks``
    must hold all 256 single bytes. The rank table and its pairs are as large as the
    vocabulary, 5 MB for 50,000 tokens, and are broadcast. A text of any length is
    split whole; other columns are ignored and their names may clash with any name
    used here; an empty table gives no rows. Blocks are written to the shared folder
    under a name of the session's catalogue when this is called.
    """

    def row(decoder, texts):
        return {
            "ids": pa.array([x.astype(np.int32) for x in texts], pa.list_(pa.int32())),
            "decoded": pa.array([decoder.decode(x) for x in texts], pa.binary()),
        }

    return _mapped(docs, ranks, pattern, id_col, text_col, "ids array<int>, decoded binary", row)


def token_digests(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Count and digests of the ids and of the decoded bytes that :func:`encode_documents` gives."""

    def row(decoder, texts):
        return {
            "n_tokens": pa.array([len(x) for x in texts], pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in texts], pa.string()),
            "decoded_sha256": pa.array([hashlib.sha256(decoder.decode(x)).hexdigest() for x in texts], pa.string()),
        }

    return _mapped(docs, ranks, pattern, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", row)
