"""Removes byte strings that occur more than once, by a sparse suffix array.

Any two equal strings of ``LENGTH`` bytes hold the same smallest k-gram at the
same place, so all string starts with one smallest k-gram form a run and only
runs with equal k-grams need to be compared. Runs are grouped by it:

* a run that is alone in its group has no repeat;
* runs that are equal as a whole repeat entirely;
* where a k-gram has very many other runs, each of their strings is dealt by a
  hash of its bytes, and strings that agree in a second hash too are equal;
* for the rest the starts inside the runs are sorted as suffixes: a mergesort in
  which two suffixes are compared by prefix polynomial hashes and binary search
  for their common extension. Neighbours that agree in ``LENGTH`` bytes are
  verified byte by byte.

Only packed runs, the texts of undecided runs, and the documents themselves are
shuffled; the text of a run that many documents repeat is sent once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlrisk.llm.arrays import (
    BASE,
    BASE_INVERSE,
    MIX_B,
    Rolling,
    byte_codes,
    content_number,
    grouped,
    mix,
    pack,
    powers,
    ragged,
    slices,
    text_bytes,
    unpack,
    word_hashes,
)
from urlrisk.session import materialize

LENGTH = 200
GRAM = 48
# Suffixes start together if this many bytes agree, before they are sorted.
LEAD = 32
CHUNK_BYTES = 8 << 20
CHUNK_ROWS = 1 << 16
KEY_BYTES = 6
# Suffixes that are hashed and that are sorted in one go; groups that may be equal are never split.
HASHED_AT_ONCE = 1 << 18
SORTED_AT_ONCE = 1 << 16
# Undecided runs of one k-gram that are sorted by one task. Of more, the single strings are dealt by their hashes.
HOT_RUNS = 2048
HOT = 256
SECOND_BYTES = 4
NO_ID = -(1 << 63)
_MAX = np.iinfo(np.uint64).max

RUNS = "kind int, chunk long, part int, keys binary, whole binary, docs binary, starts binary, counts binary, ids binary, marks binary"
_RUN_NAMES = [c.split()[0] for c in RUNS.split(", ")]
_RUN_TYPES = (pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 7)


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    n = len(x)
    padded = np.full(-(-n // width) * width, _MAX, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def runs_of(data: np.ndarray, at: np.ndarray, rolling: Rolling):
    """First start, number of starts, smallest k-gram and hash of the whole of every run, and its text number."""
    empty = np.zeros(0, np.int64)
    lengths = np.diff(at)
    n = len(data)
    if n < LENGTH or lengths.max(initial=0) < LENGTH:
        return empty, empty, np.zeros(0, np.uint64), np.zeros(0, np.uint64), empty
    grams = mix((rolling.sums[GRAM:] - rolling.sums[:-GRAM]) * rolling.down[: n - GRAM + 1])
    # k-grams that reach into the next text count for nothing.
    over = np.minimum(lengths, GRAM - 1)
    across = ragged(at[1:] - over, over)
    grams[across[across < len(grams)]] = _MAX
    smallest = sliding_minimum(grams, LENGTH - GRAM + 1)
    starts = np.maximum(lengths - LENGTH + 1, 0)
    valid = ragged(at[:-1][starts > 0], starts[starts > 0])
    own = smallest[valid]
    begins = np.ones(len(valid), bool)
    # A new run where the text changes, the k-gram changes, or its first occurrence was left behind.
    begins[1:] = (valid[1:] != valid[:-1] + 1) | (own[1:] != own[:-1]) | (grams[valid[:-1]] == own[:-1])
    first = np.flatnonzero(begins)
    count = np.diff(np.append(first, len(valid)))
    start = valid[first]
    whole = mix(rolling.of(start, start + count + LENGTH - 1) + count.astype(np.uint64))
    # The smallest of many hashes is a small number; mixed again, its high bits deal the runs evenly.
    return start, count, mix(own[first] ^ np.uint64(MIX_B)), whole, np.searchsorted(at, start, "right") - 1


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r.get(n) for r in rows], t) for n, t in zip(_RUN_NAMES, _RUN_TYPES, strict=True)], _RUN_NAMES
    )


def _longs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(column.buffers()[1], np.int64, len(column), column.offset * 8)


def _pack_runs(parts: int, bits: int):
    """Rows of documents to packed runs by k-gram, and one row per chunk with its documents."""

    def work(batches: Iterator[pa.RecordBatch]):
        tables: dict = {}
        held: list = []
        size = rows = 0

        def flush():
            doc, start, count, gram, whole = (np.concatenate([x[k] for x in held]) for k in range(5))
            ids, marks = (np.concatenate([x[k] for x in held]).tobytes() for k in (5, 6))
            chunk = content_number(ids, marks)
            part = (gram >> np.uint64(64 - bits)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            edges = np.searchsorted(part[order], np.arange(parts + 1))
            keys = pack(gram[order], KEY_BYTES)
            whole = whole[order].astype("<u8")
            doc, start, count = doc[order].astype("<u2"), start[order].astype("<u4"), count[order].astype(np.uint8)
            out = [{"kind": 0, "chunk": chunk, "part": chunk % parts, "ids": ids, "marks": marks}]
            for p in np.flatnonzero(np.diff(edges)).tolist():
                x = slice(edges[p], edges[p + 1])
                out.append(
                    {"kind": 1, "chunk": chunk, "part": p, "keys": keys[x].tobytes(), "whole": whole[x].tobytes(),
                     "docs": doc[x].tobytes(), "starts": start[x].tobytes(), "counts": count[x].tobytes()}
                )
            return _batch(out)

        for batch in slices(batches, "_text"):
            n = batch.num_rows
            if held and (size > CHUNK_BYTES or rows + n > CHUNK_ROWS):
                yield flush()
                held, size, rows = [], 0, 0
            data, at = text_bytes(batch.column("_text"))
            start, count, gram, whole, doc = runs_of(data, at, Rolling(data, tables=tables))
            held.append((doc + rows, start - at[doc], count, gram, whole, _longs(batch.column("_id")), _longs(batch.column("_mark"))))
            size += batch.nbytes
            rows += n
        if held:
            yield flush()

    return work


def _judge_runs(bits: int):
    """Per part: runs that repeat as a whole (mark 1), runs whose text must be looked at (2), whose strings must be (4)."""

    def work(batches: Iterator[pa.RecordBatch]):
        for table in grouped(batches, "part"):
            kinds = table.column("kind").to_numpy()
            yield from (b.select(_RUN_NAMES) for b in table.filter(pa.array(kinds == 0)).to_batches())
            own = table.filter(pa.array(kinds == 1))
            if not own.num_rows:
                continue
            joined = {n: b"".join(own.column(n).to_pylist()) for n in ("keys", "whole", "docs", "starts", "counts")}
            gram = unpack(joined["keys"], KEY_BYTES) & np.uint64((1 << (64 - bits)) - 1)
            whole = np.frombuffer(joined["whole"], "<u8")
            row = np.repeat(np.arange(own.num_rows), [len(x) // KEY_BYTES for x in own.column("keys").to_pylist()])
            # Rows come in the order of their chunks, so ties are broken alike in a repeated task.
            order = np.lexsort((whole, gram))
            g, w = gram[order], whole[order]
            new_g = np.append(True, g[1:] != g[:-1])
            new_w = new_g | np.append(True, w[1:] != w[:-1])
            group = np.cumsum(new_g) - 1
            kind = np.cumsum(new_w) - 1
            in_kind = np.bincount(kind)[kind]
            kinds_in_group = np.bincount(group[new_w])[group]
            undecided = (kinds_in_group > 1) & new_w
            crowded = np.bincount(group[undecided], minlength=int(group[-1]) + 1)[group] > HOT_RUNS
            mark = (in_kind > 1) * 1 + undecided * np.where(crowded, 4, 2)
            marks = np.empty(len(order), np.uint8)
            marks[order] = mark
            keep = marks > 0
            row = row[keep]
            cuts = np.searchsorted(row, np.arange(own.num_rows + 1))
            fields = {
                "keys": pack(gram[keep], KEY_BYTES),
                "docs": np.frombuffer(joined["docs"], "<u2")[keep],
                "starts": np.frombuffer(joined["starts"], "<u4")[keep],
                "counts": np.frombuffer(joined["counts"], np.uint8)[keep],
                "marks": marks[keep],
            }
            chunk, part = own.column("chunk").to_numpy(), own.column("part").to_numpy()
            out = []
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                x = slice(cuts[k], cuts[k + 1])
                out.append({"kind": 1, "chunk": int(chunk[k]), "part": int(part[k]), **{n: f[x].tobytes() for n, f in fields.items()}})
            if out:
                yield _batch(out)

    return work


MARKED = "id long, mark long, cover binary, sent binary"


def _by_document(bits: int):
    """Per chunk: spans of runs that repeat as a whole and runs to be sent, for each document that has any.

    ``cover`` holds pairs of start and end, ``sent`` start, number of starts (and
    ``HOT`` for strings to be dealt) and k-gram, all as little-endian integers.
    """

    def work(batches: Iterator[pa.RecordBatch]):
        for table in grouped(batches, "chunk"):
            kinds = table.column("kind").to_numpy()
            own = table.filter(pa.array(kinds == 1))
            if not own.num_rows:
                continue
            head = table.filter(pa.array(kinds == 0)).slice(0, 1).to_pylist()[0]
            ids, marks = np.frombuffer(head["ids"], np.int64), np.frombuffer(head["marks"], np.int64)
            joined = {n: b"".join(own.column(n).to_pylist()) for n in ("keys", "docs", "starts", "counts", "marks")}
            part = np.repeat(own.column("part").to_numpy().astype(np.uint64), [len(x) for x in own.column("marks").to_pylist()])
            gram = (part << np.uint64(64 - bits)) | unpack(joined["keys"], KEY_BYTES)
            doc = np.frombuffer(joined["docs"], "<u2").astype(np.int64)
            start = np.frombuffer(joined["starts"], "<u4").astype(np.int64)
            count = np.frombuffer(joined["counts"], np.uint8).astype(np.int64)
            mark = np.frombuffer(joined["marks"], np.uint8)
            order = np.lexsort((start, doc))
            doc, start, count, mark, gram = (x[order] for x in (doc, start, count, mark, gram))
            full, sent = (mark & 1) > 0, (mark & 6) > 0
            count = count + HOT * ((mark & 4) > 0)
            spans = np.stack([start[full], start[full] + count[full] % HOT + LENGTH - 1], 1).astype("<u4")
            wanted = np.stack([start[sent].astype("<u8"), count[sent].astype("<u8"), gram[sent]], 1)
            present = np.flatnonzero(np.bincount(doc))
            low, high = np.searchsorted(doc[full], present), np.searchsorted(doc[full], present, "right")
            low2, high2 = np.searchsorted(doc[sent], present), np.searchsorted(doc[sent], present, "right")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[present]),
                    pa.array(marks[present]),
                    pa.array([merged(spans[a:b]).tobytes() for a, b in zip(low, high, strict=True)], pa.binary()),
                    pa.array([wanted[a:b].tobytes() for a, b in zip(low2, high2, strict=True)], pa.binary()),
                ],
                ["id", "mark", "cover", "sent"],
            )

    return work


def merged(spans: np.ndarray) -> np.ndarray:
    """Spans in order, those that touch or overlap joined."""
    if not len(spans):
        return spans.astype("<u4")
    spans = spans[np.argsort(spans[:, 0], kind="stable")].astype(np.int64)
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.flatnonzero(np.append(True, spans[1:, 0] > reach[:-1]))
    return np.stack([spans[first, 0], reach[np.append(first[1:] - 1, len(spans) - 1)]], 1).astype("<u4")


# Kind 2: texts of runs by k-gram. Kind 1: strings by their hash, which is in ``grams``, the second hash in ``counts``.
# Kind 0: ids and marks of the documents that the strings of a chunk lie in.
SENT = "kind int, chunk long, part int, grams binary, counts binary, texts binary, ids binary, marks binary, starts binary, docs binary"
_SENT_NAMES = [c.split()[0] for c in SENT.split(", ")]


def _send_runs(parts: int, bits: int):
    """Texts of undecided runs, packed by k-gram, and hashes of the strings of hot ones, packed by hash."""
    types = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 7]

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        arrays = [pa.array([r.get(n) for r in rows], t) for n, t in zip(_SENT_NAMES, types, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, _SENT_NAMES)

    def work(batches: Iterator[pa.RecordBatch]):
        tables: dict = {}
        for batch in slices(batches, "_text"):
            data, at = text_bytes(batch.column("_text"))
            sent = batch.column("_sent").to_pylist()
            table = np.concatenate([np.zeros((0, 3), "<u8"), *(np.frombuffer(b, "<u8").reshape(-1, 3) for x in sent for b in x)])
            doc = np.repeat(np.arange(batch.num_rows), [sum(len(b) // 24 for b in x) for x in sent])
            # Versions of a repeated row may ask for the same run.
            order = np.lexsort((table[:, 0], doc))
            table, doc = table[order], doc[order]
            fresh = np.append(True, (doc[1:] != doc[:-1]) | (table[1:, 0] != table[:-1, 0])) if len(doc) else np.zeros(0, bool)
            table, doc = table[fresh], doc[fresh]
            hot = table[:, 1] >= HOT
            if hot.any():
                ids, marks = _longs(batch.column("_id")).tobytes(), _longs(batch.column("_mark")).tobytes()
                rolling = Rolling(data, tables=tables)
                yield batch_of(_strings(data, at, rolling, table[hot], doc[hot], ids, marks, parts, bits))
                table, doc = table[~hot], doc[~hot]
            if not len(doc):
                continue
            gram = table[:, 2]
            part = (gram >> np.uint64(64 - bits)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            table, doc, part = table[order], doc[order], part[order]
            start, count = table[:, 0].astype(np.int64), table[:, 1].astype(np.int64)
            ids, marks = _longs(batch.column("_id"))[doc], _longs(batch.column("_mark"))[doc]
            edges = np.searchsorted(part, np.arange(parts + 1))
            out = []
            for p in np.flatnonzero(np.diff(edges)).tolist():
                x = slice(edges[p], edges[p + 1])
                text = data[ragged(at[doc[x]] + start[x], count[x] + LENGTH - 1)]
                out.append(
                    {"kind": 2, "chunk": 0, "part": p, "grams": table[x, 2].tobytes(), "counts": count[x].astype(np.uint8).tobytes(),
                     "texts": text.tobytes(), "ids": ids[x].tobytes(), "marks": marks[x].tobytes(), "starts": start[x].astype("<u4").tobytes()}
                )
            yield batch_of(out)

    return work


def _strings(data, at, rolling: Rolling, table: np.ndarray, doc: np.ndarray, ids: bytes, marks: bytes, parts: int, bits: int) -> list[dict]:
    """Rows of :data:`SENT` for every string of the hot runs of one slice."""
    start, count = table[:, 0].astype(np.int64), table[:, 1].astype(np.int64) - HOT
    inside, owner = ragged(start, count), np.repeat(doc, count)
    place = at[owner] + inside
    key = mix(rolling.of(place, place + LENGTH))
    second = np.empty(len(place), np.uint64)
    for k in range(0, len(place), 1 << 13):
        some = slice(k, k + (1 << 13))
        second[some] = word_hashes(data, place[some], place[some] + LENGTH)
    chunk = content_number(ids, marks, start.tobytes())
    part = (key >> np.uint64(64 - bits)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(parts + 1))
    keys, seconds = pack(key[order], KEY_BYTES), pack(second[order], SECOND_BYTES)
    inside, owner = inside[order].astype("<u4"), owner[order].astype("<u4")
    rows = [{"kind": 0, "chunk": chunk, "part": chunk % parts, "ids": ids, "marks": marks}]
    for p in np.flatnonzero(np.diff(edges)).tolist():
        x = slice(edges[p], edges[p + 1])
        rows.append(
            {"kind": 1, "chunk": chunk, "part": p, "grams": keys[x].tobytes(), "counts": seconds[x].tobytes(),
             "starts": inside[x].tobytes(), "docs": owner[x].tobytes()}
        )
    return rows


class RunHashes:
    """Prefix polynomial hashes of many short runs, exponents counted from the start of each run."""

    def __init__(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray):
        self.up, self.down = powers(LENGTH * 2, BASE), powers(LENGTH * 2, BASE_INVERSE)
        codes = byte_codes()
        self.offset = np.empty(len(data), np.uint16)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        for k in range(0, len(begin), 1 << 10):
            low, lengths = int(begin[k]), length[k : k + (1 << 10)]
            high = low + int(lengths.sum())
            offset = ragged(np.zeros(len(lengths), np.int64), lengths)
            self.offset[low:high] = offset
            np.cumsum(codes[data[low:high]] * self.up[offset], out=self.sums[low + 1 : high + 1])
            self.sums[low + 1 : high + 1] += self.sums[low]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[self.offset[start]]


class Suffixes:
    """Comparison of suffixes, cut at ``LENGTH`` bytes, by prefix hashes."""

    def __init__(self, data: np.ndarray, rolling: RunHashes):
        self.data, self.rolling = data, rolling

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common extension: a binary search, one hash comparison per step."""
        low, high = np.zeros(len(x), np.int64), np.full(len(x), LENGTH)
        while (low < high).any():
            middle = (low + high + 1) >> 1
            same = self.rolling.of(x, x + middle) == self.rolling.of(y, y + middle)
            low = np.where(same, middle, low)
            high = np.where(same, high, middle - 1)
        return low

    def less(self, x: np.ndarray, y: np.ndarray, or_equal: bool) -> np.ndarray:
        agreed = self.common(x, y)
        end = agreed >= LENGTH
        at = np.minimum(agreed, LENGTH - 1)
        smaller = self.data[x + at] < self.data[y + at]
        return np.where(end, or_equal, smaller)

    def sort(self, items: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Mergesort inside every group (``group`` is sorted), all groups side by side."""
        items = items.copy()
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        size = np.diff(np.append(first, len(group)))
        start, size = np.repeat(first, size), np.repeat(size, size)
        rank = np.arange(len(items)) - start
        width = 1
        while True:
            active = np.flatnonzero(size > width)
            if not len(active):
                return items
            s, n, k = start[active], size[active], rank[active]
            pair = k // (2 * width) * (2 * width)
            in_right = k - pair >= width
            # Where the other half of the pair lies, and how many of it come before each item.
            low = np.where(in_right, pair, np.minimum(pair + width, n))
            high = np.where(in_right, pair + width, np.minimum(pair + 2 * width, n))
            base = low.copy()
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                middle = (low[open_] + high[open_]) >> 1
                other, own, right = items[s[open_] + middle], items[active[open_]], in_right[open_]
                before = np.empty(len(open_), bool)
                before[right] = self.less(other[right], own[right], True)
                before[~right] = self.less(other[~right], own[~right], False)
                low[open_] = np.where(before, middle + 1, low[open_])
                high[open_] = np.where(before, high[open_], middle)
            place = s + pair + np.where(in_right, k - pair - width, k - pair) + (low - base)
            moved = items.copy()
            moved[place] = items[active]
            items = moved
            width *= 2


def repeated_starts(data: np.ndarray, positions: np.ndarray, group: np.ndarray, hashes: RunHashes) -> np.ndarray:
    """Which of the strings of ``LENGTH`` bytes at ``positions``, in ascending order, occur at another position too.

    Only strings of one ``group`` are compared.
    """
    out = np.zeros(len(positions), bool)
    # Strings that can be equal have the same group and the same first bytes.
    key = mix(group.astype(np.uint64) + mix(hashes.of(positions, positions + LEAD)))
    order = np.argsort(key, kind="stable")
    key = key[order]
    several = np.zeros(len(order), bool)
    same = key[1:] == key[:-1]
    several[1:] |= same
    several[:-1] |= same
    order, key = order[several], key[several]
    suffixes = Suffixes(data, hashes)
    low = 0
    while low < len(order):
        high = min(low + SORTED_AT_ONCE, len(order))
        high = int(np.searchsorted(key, key[high - 1], "right"))
        items = suffixes.sort(positions[order[low:high]], key[low:high])
        near = np.flatnonzero(key[low + 1 : high] == key[low : high - 1])
        equal = near[suffixes.common(items[near], items[near + 1]) >= LENGTH]
        equal = equal[_same_bytes(data, items[equal], items[equal + 1])]
        for found in (items[equal], items[equal + 1]):
            out[np.searchsorted(positions, found)] = True
        low = high
    return out


def _same_bytes(data: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    span = np.arange(LENGTH)
    for k in range(0, len(x), 1 << 12):
        part = slice(k, k + (1 << 12))
        out[part] = (data[x[part, None] + span] == data[y[part, None] + span]).all(axis=1)
    return out


# Kind 2: a span of repeated strings. Kinds 1 and 0: repeated strings of a chunk and its documents, as in SENT.
DECIDED = "kind int, chunk long, id long, mark long, cover binary, starts binary, docs binary, ids binary, marks binary"
_DECIDED_NAMES = [c.split()[0] for c in DECIDED.split(", ")]
_DECIDED_TYPES = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 5)


def _decided(n: int, **columns: pa.Array) -> pa.RecordBatch:
    arrays = [columns.get(name, pa.nulls(n, t)) for name, t in zip(_DECIDED_NAMES, _DECIDED_TYPES, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, _DECIDED_NAMES)


def _decide(batches: Iterator[pa.RecordBatch]):
    """Per part: sorts its runs, compares the hashes of its strings, hands on the documents of chunks."""
    for table in grouped(batches, "part"):
        kinds = table.column("kind").to_numpy()
        heads, strings, runs = (table.filter(pa.array(kinds == k)) for k in (0, 1, 2))
        del table
        if heads.num_rows:
            names = ("chunk", "ids", "marks")
            columns = {n: heads.column(n).combine_chunks() for n in names}
            columns = {n: c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for n, c in columns.items()}
            yield _decided(heads.num_rows, kind=pa.array([0] * heads.num_rows, pa.int32()), **columns)
        if strings.num_rows:
            yield from _repeated_strings(strings)
        if runs.num_rows:
            for batch in _sort_runs(runs):
                n = batch.num_rows
                yield _decided(n, kind=pa.array([2] * n, pa.int32()), chunk=pa.array([0] * n, pa.int64()),
                               id=batch.column("id"), mark=batch.column("mark"), cover=batch.column("cover"))


def _repeated_strings(table: pa.Table):
    """The strings, of one part, whose two hashes another string has too."""
    joined = {n: b"".join(table.column(n).to_pylist()) for n in ("grams", "counts", "starts", "docs")}
    key, second = unpack(joined["grams"], KEY_BYTES), unpack(joined["counts"], SECOND_BYTES)
    row = np.repeat(np.arange(table.num_rows), [len(x) // KEY_BYTES for x in table.column("grams").to_pylist()])
    order = np.lexsort((second, key))
    same = (key[order][1:] == key[order][:-1]) & (second[order][1:] == second[order][:-1])
    repeats = np.zeros(len(order), bool)
    repeats[order[1:][same]] = repeats[order[:-1][same]] = True
    cuts = np.searchsorted(row[repeats], np.arange(table.num_rows + 1))
    starts, docs = (np.frombuffer(joined[n], "<u4")[repeats] for n in ("starts", "docs"))
    some = np.flatnonzero(np.diff(cuts))
    if len(some):
        chunk = table.column("chunk").to_numpy()[some]
        packed = {n: pa.array([x[cuts[k] : cuts[k + 1]].tobytes() for k in some], pa.binary()) for n, x in (("starts", starts), ("docs", docs))}
        yield _decided(len(some), kind=pa.array([1] * len(some), pa.int32()), chunk=pa.array(chunk, pa.int64()), **packed)


def _cover_strings(batches: Iterator[pa.RecordBatch]):
    """Per chunk: the spans of its repeated strings, for each document that has any."""
    for table in grouped(batches, "chunk"):
        kinds = table.column("kind").to_numpy()
        own = table.filter(pa.array(kinds == 1))
        if not own.num_rows:
            continue
        head = table.filter(pa.array(kinds == 0)).slice(0, 1).to_pylist()[0]
        ids, marks = np.frombuffer(head["ids"], np.int64), np.frombuffer(head["marks"], np.int64)
        start, doc = (np.frombuffer(b"".join(own.column(n).to_pylist()), "<u4").astype(np.int64) for n in ("starts", "docs"))
        order = np.lexsort((start, doc))
        start, doc = start[order], doc[order]
        present = np.flatnonzero(np.bincount(doc))
        low, high = np.searchsorted(doc, present), np.searchsorted(doc, present, "right")
        spans = np.stack([start, start + LENGTH], 1)
        covers = [merged(spans[a:b]).tobytes() for a, b in zip(low, high, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[present]), pa.array(marks[present]), pa.array(covers, pa.binary())], ["id", "mark", "cover"]
        )


def _sort_runs(table: pa.Table):
    """The span of repeated strings in each undecided run of one part, packed per document row."""
    if table.num_rows:
        gram = np.frombuffer(b"".join(table.column("grams").to_pylist()), "<u8")
        count = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.uint8).astype(np.int64)
        order = np.argsort(gram, kind="stable")
        ranked = gram[order]
        texts = b"".join(table.column("texts").to_pylist())
        address = {n: b"".join(table.column(n).to_pylist()) for n in ("ids", "marks", "starts")}
        del table
        length = count + LENGTH - 1
        begin = np.cumsum(length) - length
        reach = np.cumsum(count[order])
        low = 0
        while low < len(order):
            high = int(np.searchsorted(reach, (reach[low - 1] if low else 0) + HASHED_AT_ONCE, "right"))
            high = int(np.searchsorted(ranked, ranked[min(max(high, low + 1), len(order)) - 1], "right"))
            runs = order[low:high]
            low = high
            data = np.frombuffer(b"".join([texts[begin[k] : begin[k] + length[k]] for k in runs.tolist()]), np.uint8)
            lengths, counts = length[runs], count[runs]
            at = np.cumsum(lengths) - lengths
            positions = ragged(at, counts)
            which = np.repeat(np.arange(len(runs)), counts)
            hits = repeated_starts(data, positions, gram[runs][which], RunHashes(data, at, lengths))
            which, inside = which[hits], positions[hits]
            if not len(which):
                continue
            first = np.flatnonzero(np.append(True, which[1:] != which[:-1]))
            last = np.append(first[1:] - 1, len(which) - 1)
            hit = which[first]
            run = runs[hit]
            start = np.frombuffer(address["starts"], "<u4")[run].astype(np.int64) - at[hit]
            # All strings of a run hold the same k-gram, so their union has no gap.
            spans = np.stack([start + inside[first], start + inside[last] + LENGTH], 1).astype("<u4")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.frombuffer(address["ids"], np.int64)[run]),
                    pa.array(np.frombuffer(address["marks"], np.int64)[run]),
                    pa.array([s.tobytes() for s in spans], pa.binary()),
                ],
                ["id", "mark", "cover"],
            )


def _free(name: str, columns: list[str]) -> str:
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def _covers(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, mark, cover array<binary>)``: spans to remove, for every row (id, hash of the text) that has any."""
    spark = docs.sparkSession
    setting = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = min(15, max(4, (4 * setting - 1).bit_length()))
    parts = 1 << bits
    rows = docs.select(*_keyed(id_col, text_col))
    packed = rows.mapInArrow(_pack_runs(parts, bits), RUNS)
    judged = packed.repartition(parts, "part").sortWithinPartitions("part", "chunk").mapInArrow(_judge_runs(bits), RUNS)
    marked = judged.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_by_document(bits), MARKED)
    marked = materialize(marked, "repeat-marks")
    # Rows repeated with id and text differ at most in which copy is sent, so the sets stay small.
    wanted = marked.filter(F.length("sent") > 0).groupBy("id", "mark").agg(F.collect_set("sent").alias("_sent"))
    sending = rows.join(wanted, (rows["_id"] == wanted["id"]) & (rows["_mark"] == wanted["mark"])).select("_id", "_mark", "_text", "_sent")
    sent = sending.mapInArrow(_send_runs(parts, bits), SENT)
    decided = sent.repartition(parts, "part").sortWithinPartitions("part", "kind", "chunk").mapInArrow(_decide, DECIDED)
    decided = materialize(decided, "repeat-spans")
    found = decided.filter("kind = 2").select("id", "mark", "cover")
    strings = decided.filter("kind < 2").repartition("chunk").sortWithinPartitions("chunk")
    dealt = strings.mapInArrow(_cover_strings, "id long, mark long, cover binary")
    whole = marked.filter(F.length("cover") > 0).select("id", "mark", "cover")
    return whole.unionByName(found).unionByName(dealt).groupBy("id", "mark").agg(F.collect_set("cover").alias("cover"))


def _keyed(id_col: str, text_col: str):
    text = F.coalesce(F.col(text_col), F.lit(""))
    return (
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"),
        F.xxhash64(text).alias("_mark"),
        text.alias("_text"),
    )


def _with_covers(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    covers = _covers(docs, id_col, text_col)
    columns = docs.columns
    key, mark, cover = (_free(n, columns) for n in ("repeat_id", "repeat_mark", "repeat_cover"))
    made = _keyed(id_col, text_col)
    left = docs.withColumn(key, made[0]).withColumn(mark, made[1])
    right = covers.select(F.col("id").alias(key), F.col("mark").alias(mark), F.col("cover").alias(cover))
    return left.join(right, [key, mark], "left").select(*(F.col(f"`{c}`") for c in columns), cover), cover


def _spans(cover: list[bytes] | None) -> np.ndarray:
    return merged(np.frombuffer(b"".join(cover or ()), "<u4").reshape(-1, 2))


def whole_characters(data: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Spans narrowed to whole UTF-8 characters; empty ones are gone."""
    out = []
    for start, end in spans.tolist():
        while start < end and (data[start] & 0xC0) == 0x80:
            start += 1
        while end > start and end < len(data) and (data[end] & 0xC0) == 0x80:
            end -= 1
        if start < end:
            out.append((start, end))
    return np.array(out, np.int64).reshape(-1, 2)


def kept_bytes(data: np.ndarray, spans: np.ndarray) -> bytes:
    keep = np.ones(len(data), bool)
    for start, end in spans.tolist():
        keep[start:end] = False
    return data[keep].tobytes()


def removal_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept_sha256)`` for every row.

    Every byte is removed that lies in a string of ``LENGTH`` bytes which starts
    at another place too, in the same text or another row's; strings are judged
    on the whole input and never span two texts. Rows repeated with id and text
    are places of their own. Null and empty texts have no bytes.
    """
    joined, cover = _with_covers(docs.select(id_col, text_col), id_col, text_col)
    id_type = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches, "_text"):
            data, at = text_bytes(batch.column("_text"))
            size, removed, count, digest = [], [], [], []
            for k, cover in enumerate(batch.column("_cover").to_pylist()):
                text, spans = data[at[k] : at[k + 1]], _spans(cover)
                size.append(len(text))
                removed.append(int((spans[:, 1].astype(np.int64) - spans[:, 0]).sum()))
                count.append(len(spans))
                digest.append(hashlib.sha256(kept_bytes(text, spans)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), *(pa.array(x, pa.int64()) for x in (size, removed, count)), pa.array(digest)],
                ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    narrow = joined.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(cover).alias("_cover"))
    schema = f"id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return narrow.mapInArrow(work, schema).withColumnRenamed("id", id_col)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated strings cut out of the texts, all columns and rows kept.

    As :func:`removal_digests`, but all bytes of a character stay of which only
    a part is to go, so texts remain valid. A null text becomes empty.
    """
    joined, cover = _with_covers(docs, id_col, text_col)
    place = joined.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches, text_col):
            data, at = text_bytes(batch.column(text_col))
            texts = []
            for k, spans in enumerate(batch.column(cover).to_pylist()):
                text = data[at[k] : at[k + 1]]
                texts.append(kept_bytes(text, whole_characters(text, _spans(spans))).decode())
            columns = [c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != cover]
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, [n for n in batch.schema.names if n != cover])

    return joined.mapInArrow(work, docs.schema)
