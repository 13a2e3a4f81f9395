"""Jaccard join on word shingles with signature trees.

A signature tree holds sets in its leaves; each node has the OR of the token
bitmaps below it and the range of their sizes. Two trees are walked together,
and a pair of nodes is left out if no two sets below can overlap enough.

What goes into one tree is found first. Texts are cut into shingles in place
and equal sets of a slice are taken once. Shingles are sent in packed groups to
partitions of the shingle space, which report how many sets hold each of them.
A set needs a partner only if its rarest shingles, as many as two similar sets
must share one of, are not all its own; sets that share such a shingle go to the
same tree. Trees that would be too large are cut by size and hash into pieces
whose pairs are walked by different tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlrisk.llm.arrays import (
    ASCII_SPACE,
    content_number,
    distinct_within,
    grouped,
    mix,
    pack,
    shingles,
    slices,
    sums_by,
    text_bytes,
    unpack,
    word_hashes,
    words,
)
from urlrisk.llm.groups import components
from urlrisk.session import materialize

WORDS = 5
# Two sets are linked when PER_CENT * size of union <= 100 * size of intersection.
PER_CENT = 80
# Text whose shingles are packed together; document numbers inside are 16 bits.
CHUNK_BYTES = 8 << 20
CHUNK_ROWS = 1 << 16
TOKEN_BYTES = 6
# Sets in one piece of a tree.
PIECE_SETS = 4096
LEAF = 8
NO_ID = -(1 << 63)


def shingle_sets(texts: pa.Array, size: int = WORDS):
    """Text number and hash of each distinct shingle, sorted by both.

    A-Z count as a-z, words are runs without ASCII white space; a text with
    fewer words than ``size`` has one shingle of all its words, an empty none.
    """
    data, at = text_bytes(texts)
    starts, ends, text = words(data, at, ASCII_SPACE)
    hashes = word_hashes(data, starts, ends, fold=True)
    tokens, owner = shingles(hashes, text, len(at) - 1, size)
    return distinct_within(owner, tokens)


def set_keys(owner: np.ndarray, tokens: np.ndarray, n: int) -> list[bytes]:
    """16 bytes that stand for the whole set of each text."""
    a = sums_by(owner, mix(tokens), n)
    b = sums_by(owner, mix(tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5)), n)
    raw = np.stack([a, b], 1).astype(">u8").tobytes()
    return [raw[16 * k : 16 * k + 16] for k in range(n)]


def overlap_needed(total: int) -> int:
    """Smallest intersection that links two sets with ``total`` elements in both together."""
    return -(-PER_CENT * total // (100 + PER_CENT))


def rare_length(n: np.ndarray) -> np.ndarray:
    """How many of its rarest elements a set needs so that it shares one of them with every partner."""
    return n - (PER_CENT * n + 99) // 100 + 1


PACKED = "kind int, chunk long, part int, tokens binary, docs binary, extra binary, ids binary, keys binary, marks binary"


def _pack_shingles(parts: int, parts_bits: int):
    """Rows of documents to packed shingles by part, and one row per chunk with its documents."""

    def work(batches: Iterator[pa.RecordBatch]):
        names = [c.split()[0] for c in PACKED.split(", ")]
        held: list = []
        size = rows = 0

        def flush():
            owner = np.concatenate([x[0] + x[4] for x in held])
            tokens = np.concatenate([x[1] for x in held])
            keys = [k for x in held for k in x[2]]
            ids = np.concatenate([x[3] for x in held])
            marks = np.concatenate([x[5] for x in held])
            counts = np.bincount(owner, minlength=len(keys))
            # Each distinct set of the chunk is sent once; the first document speaks for it.
            first: dict[bytes, int] = {}
            for k, key in enumerate(keys):
                first.setdefault(key, k)
            speaks = np.zeros(len(keys), bool)
            speaks[list(first.values())] = True
            # Named by content, so a repeated task names it alike; equal chunks share a name.
            chunk = content_number(ids.tobytes(), marks.tobytes(), *keys)
            keep = speaks[owner]
            mine, of = tokens[keep], owner[keep]
            part = (mine >> np.uint64(64 - parts_bits)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            mine, of, part = mine[order], of[order], part[order]
            edges = np.searchsorted(part, np.arange(parts + 1))
            low, numbers = pack(mine, TOKEN_BYTES), of.astype("<u2").view(np.uint8).reshape(-1, 2)
            out = {n: [] for n in names}

            def row(**values):
                for n in names:
                    out[n].append(values.get(n))

            # The row of the chunk itself passes through one of the parts.
            row(kind=0, chunk=chunk, part=chunk % parts, extra=counts.astype("<u4").tobytes(), docs=speaks.tobytes(),
                ids=ids.tobytes(), keys=b"".join(keys), marks=marks.tobytes())
            for p in np.flatnonzero(np.diff(edges)).tolist():
                a, b = edges[p], edges[p + 1]
                row(kind=1, chunk=chunk, part=p, tokens=low[a:b].tobytes(), docs=numbers[a:b].tobytes())
            return pa.RecordBatch.from_arrays(
                [pa.array(out[n], t) for n, t in zip(names, (pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 6), strict=True)], names
            )

        for batch in slices(batches, "_text"):
            n = batch.num_rows
            if held and (size > CHUNK_BYTES or rows + n > CHUNK_ROWS):
                yield flush()
                held, size, rows = [], 0, 0
            owner, tokens = shingle_sets(batch.column("_text"))
            ids = np.frombuffer(batch.column("_id").buffers()[1], np.int64, n, batch.column("_id").offset * 8)
            marks = np.frombuffer(batch.column("_mark").buffers()[1], np.int64, n, batch.column("_mark").offset * 8)
            held.append((owner, tokens, set_keys(owner, tokens, n), ids, rows, marks))
            size += batch.nbytes
            rows += n
        if held:
            yield flush()

    return work


def _count_shared(batches: Iterator[pa.RecordBatch]):
    """Per part: shingles held by two or more sets, back to their chunks with their counts."""
    names = [c.split()[0] for c in PACKED.split(", ")]
    for table in grouped(batches, "part"):
        kinds = table.column("kind").to_numpy()
        for batch in table.filter(pa.array(kinds == 0)).to_batches():
            yield batch.select(names)
        own = table.filter(pa.array(kinds == 1))
        if not own.num_rows:
            continue
        packed = own.column("tokens").to_pylist()
        tokens = unpack(b"".join(packed), TOKEN_BYTES)
        numbers = np.frombuffer(b"".join(own.column("docs").to_pylist()), "<u2")
        row = np.repeat(np.arange(own.num_rows), [len(x) // TOKEN_BYTES for x in packed])
        order = np.argsort(tokens, kind="stable")
        ranked = tokens[order]
        edges = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
        count = np.empty(len(tokens), np.int64)
        run = np.diff(np.append(edges, len(tokens)))
        count[order] = np.repeat(run, run)
        shared = count > 1
        row, tokens, numbers, count = row[shared], tokens[shared], numbers[shared], np.minimum(count[shared], 255)
        cuts = np.searchsorted(row, np.arange(own.num_rows + 1))
        low = pack(tokens, TOKEN_BYTES)
        keep = np.flatnonzero(np.diff(cuts)).tolist()
        chunk, part = own.column("chunk").to_numpy(), own.column("part").to_numpy()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.ones(len(keep), np.int32)),
                pa.array(chunk[keep]),
                pa.array(part[keep]),
                pa.array([low[cuts[k] : cuts[k + 1]].tobytes() for k in keep], pa.binary()),
                pa.array([numbers[cuts[k] : cuts[k + 1]].tobytes() for k in keep], pa.binary()),
                pa.array([count[cuts[k] : cuts[k + 1]].astype(np.uint8).tobytes() for k in keep], pa.binary()),
                *[pa.nulls(len(keep), pa.binary())] * 3,
            ],
            names,
        )


SETS = "kind int, id long, mark long, n int, key binary, rare binary, tokens binary"


def _documents_and_sets(parts_bits: int):
    """Per chunk: a row per document with its set, and a row per set that may have partners."""

    def work(batches: Iterator[pa.RecordBatch]):
        for table in grouped(batches, "chunk"):
            kinds = table.column("kind").to_numpy()
            head = table.filter(pa.array(kinds == 0)).to_pylist()
            keys_raw = head[0]["keys"]
            keys = [keys_raw[k : k + 16] for k in range(0, len(keys_raw), 16)]
            n = np.frombuffer(head[0]["extra"], "<u4").astype(np.int64)
            # A chunk that another one equals in every document arrives as several equal rows.
            copies = len(head)
            for _ in range(copies):
                ids, marks = (np.frombuffer(head[0][c], np.int64) for c in ("ids", "marks"))
                yield _set_batch(0, ids, marks, n, keys, None, None)
            own = table.filter(pa.array(kinds == 1))
            if not own.num_rows:
                continue
            packed = own.column("tokens").to_pylist()
            part = np.repeat(own.column("part").to_numpy().astype(np.uint64), [len(x) // TOKEN_BYTES for x in packed])
            low = unpack(b"".join(packed), TOKEN_BYTES) & np.uint64((1 << (64 - parts_bits)) - 1)
            tokens = (part << np.uint64(64 - parts_bits)) | low
            number = np.frombuffer(b"".join(own.column("docs").to_pylist()), "<u2").astype(np.int64)
            count = np.frombuffer(b"".join(own.column("extra").to_pylist()), np.uint8)
            if copies > 1:
                fresh = np.unique(np.stack([number.astype(np.uint64), tokens], 1), axis=0, return_index=True)[1]
                tokens, number, count = tokens[fresh], number[fresh], count[fresh]
            order = np.lexsort((tokens, count, number))
            tokens, number = tokens[order], number[order]
            shared = np.bincount(number, minlength=len(n))
            edges = np.cumsum(shared) - shared
            # Shingles of this set alone come first and can have no partner.
            rare = rare_length(n) - (n - shared)
            picked = np.flatnonzero((rare > 0) & (shared > 0)).tolist()
            if picked:
                firsts = [tokens[edges[k] : edges[k] + rare[k]].astype("<u8").tobytes() for k in picked]
                whole = [np.sort(tokens[edges[k] : edges[k] + shared[k]]).astype("<u8").tobytes() for k in picked]
                none = np.full(len(picked), -1)
                yield _set_batch(1, none, none, n[picked], [keys[k] for k in picked], firsts, whole)

    return work


def _set_batch(kind, ids, marks, n, keys, rare, tokens):
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(keys), kind, np.int32)),
            pa.array(ids),
            pa.array(marks),
            pa.array(n.astype(np.int32)),
            pa.array(keys, pa.binary()),
            pa.array(rare, pa.binary()) if rare is not None else pa.nulls(len(keys), pa.binary()),
            pa.array(tokens, pa.binary()) if tokens is not None else pa.nulls(len(keys), pa.binary()),
        ],
        [c.split()[0] for c in SETS.split(", ")],
    )


class SignatureTree:
    """Sets in order of size in leaves of eight; every node joins eight nodes below."""

    def __init__(self, sizes: np.ndarray, tokens: list[np.ndarray], bits: int):
        order = np.lexsort(([int(t[0]) if len(t) else 0 for t in tokens], sizes))
        self.sets = order.tolist()
        low_mask = np.uint64(bits - 1)
        bitmaps, spare = [], []
        for k in self.sets:
            field = np.zeros(bits, np.uint8)
            field[(tokens[k] & low_mask).astype(np.int64)] = 1
            bitmaps.append(int.from_bytes(np.packbits(field).tobytes(), "big"))
            # Elements that fell on a bit already set: the bitmap may count that many too few.
            spare.append(len(tokens[k]) - bitmaps[-1].bit_count())
        self.bitmaps, self.spare = bitmaps, spare
        size = sizes[order].tolist()
        level = [
            (self._or(bitmaps[k : k + LEAF]), size[k], size[min(k + LEAF, len(size)) - 1], max(spare[k : k + LEAF]), (k, min(k + LEAF, len(size))), None)
            for k in range(0, len(size), LEAF)
        ]
        while len(level) > 1:
            level = [
                (self._or([x[0] for x in below]), below[0][1], below[-1][2], max(x[3] for x in below), (below[0][4][0], below[-1][4][1]), below)
                for below in (level[k : k + LEAF] for k in range(0, len(level), LEAF))
            ]
        self.root = level[0]
        self.size = size

    @staticmethod
    def _or(maps: list[int]) -> int:
        total = 0
        for m in maps:
            total |= m
        return total


class Forest:
    """Union-find over numbered sets."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def one_root(self, members: list[int]) -> int:
        """The root that all members have, or -1."""
        root = self.find(members[0])
        return root if all(self.find(m) == root for m in members[1:]) else -1


def join_trees(sizes: np.ndarray, tokens: list[np.ndarray], left: np.ndarray, right: np.ndarray | None) -> Forest:
    """Link all similar sets of one tree, or between two, that no links so far connect.

    ``left`` and ``right`` number the sets of the two trees; without ``right``
    the tree is walked against itself.
    """
    longest = max(len(t) for t in tokens)
    bits = 256
    while bits < min(4 * longest, 1 << 13):
        bits *= 2
    trees = [SignatureTree(sizes[x], [tokens[k] for k in x], bits) for x in (left, right) if x is not None]
    a, b = trees[0], trees[-1]
    numbers = [[int(x[k]) for k in t.sets] for x, t in zip((left, right), trees, strict=False)]
    mine, theirs = numbers[0], numbers[-1]
    same = right is None
    forest = Forest(len(tokens))

    def reachable(x, y) -> bool:
        """Whether two sets below nodes (or sets) x and y may be linked."""
        if x[2] * 100 < PER_CENT * y[1] or y[2] * 100 < PER_CENT * x[1]:
            return False
        most = min(x[3], y[3]) + (x[0] & y[0]).bit_count()
        return most >= overlap_needed(x[1] + y[1])

    def linked(i: int, j: int) -> bool:
        p, q = tokens[i], tokens[j]
        both = np.concatenate([p, q])
        both.sort()
        shared = int((both[1:] == both[:-1]).sum())
        return 100 * shared >= PER_CENT * (int(sizes[i]) + int(sizes[j]) - shared)

    def leaves(x, y):
        for i in range(*x[4]):
            si = a.size[i]
            item = (a.bitmaps[i], si, si, a.spare[i])
            for j in range(max(y[4][0], i + 1) if same else y[4][0], y[4][1]):
                ri, rj = forest.find(mine[i]), forest.find(theirs[j])
                if ri != rj and reachable(item, (b.bitmaps[j], b.size[j], b.size[j], b.spare[j])) and linked(mine[i], theirs[j]):
                    forest.parent[max(ri, rj)] = min(ri, rj)

    whole: dict[tuple[int, int, int], int] = {}

    def root_of(side: int, node, members) -> int:
        """The one root below a node; once there is one, any member tells it."""
        key = (side, *node[4])
        if key in whole:
            return forest.find(whole[key])
        found = forest.one_root(members[node[4][0] : node[4][1]])
        if found >= 0:
            whole[key] = found
        return found

    stack = [(a.root, b.root)]
    while stack:
        x, y = stack.pop()
        if same and y[4][1] <= x[4][0]:
            continue
        if not reachable(x, y):
            continue
        root = root_of(0, x, mine)
        if root >= 0 and root == root_of(0 if same else 1, y, theirs):
            continue
        if x[5] is None and y[5] is None:
            leaves(x, y)
        elif y[5] is None or (x[5] is not None and x[4][1] - x[4][0] >= y[4][1] - y[4][0]):
            # Neighbours are taken last, that is, walked first: they link soonest.
            stack.extend(sorted(((c, y) for c in x[5]), key=lambda p: -abs(p[0][4][0] - p[1][4][0])))
        else:
            stack.extend(sorted(((x, c) for c in y[5]), key=lambda p: -abs(p[0][4][0] - p[1][4][0])))
    return forest


def _walk(batches: Iterator[pa.RecordBatch]):
    """Per tree or pair of pieces: a link from every set to the smallest key it is connected with."""
    for table in grouped(batches, "job"):
        side = table.column("side").to_numpy()
        keys = table.column("key").to_pylist()
        # Sets seen in several chunks come several times.
        first: dict[bytes, int] = {}
        for k in np.argsort(side, kind="stable").tolist():
            first.setdefault(keys[k], k)
        rows = sorted(first.values())
        if len(rows) < 2:
            continue
        sizes = table.column("n").to_numpy()[rows].astype(np.int64)
        tokens = [np.frombuffer(t, "<u8") for t in table.column("tokens").take(pa.array(rows)).to_pylist()]
        kept = side[rows]
        left, right = np.flatnonzero(kept == 0), np.flatnonzero(kept == 1)
        if not len(left):
            continue
        forest = join_trees(sizes, tokens, left, right if len(right) else None)
        least: dict[int, bytes] = {}
        roots = [forest.find(k) for k in range(len(rows))]
        for k, root in enumerate(roots):
            key = keys[rows[k]]
            least[root] = min(least.get(root, key), key)
        pairs = [(keys[rows[k]], least[root]) for k, root in enumerate(roots) if least[root] != keys[rows[k]]]
        if pairs:
            a, b = zip(*pairs, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def _row_key(id_col: str, text_col: str):
    """Id as a number (null: ``NO_ID``) and a hash of the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64(text).alias("_mark")


def linked_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", piece_sets: int = PIECE_SETS):
    """``(documents(id, mark, n, key), links(a, b))``: the set of every row, and links between different sets.

    ``mark`` is a hash of the text. ``links`` connect exactly the sets that chains of similar sets connect. Row
    ids must be whole numbers; a null id is kept as the smallest number.
    """
    spark = docs.sparkSession
    setting = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(4, (4 * setting - 1).bit_length())
    parts = 1 << bits
    narrow = docs.select(*_row_key(id_col, text_col), F.col(text_col).alias("_text"))
    packed = narrow.mapInArrow(_pack_shingles(parts, bits), PACKED)
    counted = packed.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_count_shared, PACKED)
    rows = counted.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_documents_and_sets(bits), SETS)
    rows = materialize(rows, "shingle-sets")
    documents = rows.filter("kind = 0").select("id", "mark", "n", "key")
    sets = rows.filter("kind = 1")

    # Sets that share a rare shingle: a star around the smallest key of each.
    rare = sets.select("key", F.explode(F.expr("transform(sequence(1, length(rare), 8), i -> substring(rare, i, 8))")).alias("token"))
    rare = materialize(rare.distinct(), "rare-shingles")
    centre = rare.groupBy("token").agg(F.min("key").alias("b"), F.max("key").alias("_last")).filter("b < _last")
    stars = rare.join(centre.select("token", "b"), "token").filter("key != b").select(F.col("key").alias("a"), "b").distinct()
    groups = components(stars, "shingle-groups")

    # A group is one tree, or pieces by size class (a partner is in the same or the next) and hash.
    ratio = F.lit(100 / PER_CENT)
    grouped_sets = sets.select("key", "n", "tokens").join(groups.withColumnRenamed("node", "key"), "key")
    grouped_sets = grouped_sets.withColumn("_class", F.floor(F.log(F.col("n").cast("double")) / F.log(ratio)).cast("int"))
    total = groups.groupBy("root").agg(F.count(F.lit(1)).alias("_total"))
    classes = grouped_sets.groupBy("root", "_class").agg(F.count(F.lit(1)).alias("_count"))
    plan = classes.join(total, "root").withColumn("_pieces", F.ceil(F.col("_count") / piece_sets).cast("int"))
    following = plan.select("root", (F.col("_class") - 1).alias("_class"), F.col("_pieces").alias("_next"))
    plan = materialize(plan.join(following, ["root", "_class"], "left").select("root", "_class", "_total", "_pieces", F.coalesce("_next", F.lit(0)).alias("_next")), "tree-plan")
    before = plan.select("root", (F.col("_class") + 1).alias("_class"), F.col("_pieces").alias("_prior"))
    plan = plan.join(before, ["root", "_class"], "left").withColumn("_prior", F.coalesce("_prior", F.lit(0)))
    placed = grouped_sets.join(plan, ["root", "_class"]).withColumn(
        "_own", F.pmod(F.xxhash64("key", F.lit("piece")), F.col("_pieces")).cast("int")
    )

    single = F.expr("array(struct(hex(root) AS job, 0 AS side))")
    within = F.expr(
        "concat(transform(sequence(0, _pieces - 1), j -> struct(concat_ws(':', hex(root), _class, least(_own, j), _class, greatest(_own, j)) AS job, "
        "CASE WHEN j < _own THEN 1 ELSE 0 END AS side)))"
    )
    ahead = F.expr(
        "CASE WHEN _next > 0 THEN transform(sequence(0, _next - 1), j -> struct(concat_ws(':', hex(root), _class, _own, _class + 1, j) AS job, 0 AS side)) "
        "ELSE array() END"
    )
    behind = F.expr(
        "CASE WHEN _prior > 0 THEN transform(sequence(0, _prior - 1), j -> struct(concat_ws(':', hex(root), _class - 1, j, _class, _own) AS job, 1 AS side)) "
        "ELSE array() END"
    )
    placed = placed.withColumn("_job", F.explode(F.when(F.col("_total") <= piece_sets, single).otherwise(F.concat(within, ahead, behind))))
    trees = placed.select("key", "n", "tokens", F.xxhash64("_job.job").alias("job"), F.col("_job.side").alias("side"))
    links = trees.repartition("job").sortWithinPartitions("job").mapInArrow(_walk, "a binary, b binary")
    return documents, materialize(links, "similar-sets")


def components_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", piece_sets: int = PIECE_SETS) -> DataFrame:
    """``(id, n_shingles, component_id)``: one row per row of ``docs``.

    ``component_id`` is the smallest id that a chain of links reaches, its own
    included. Rows with equal sets are linked if the sets are not empty; a row
    without words (null, empty or blank text) is linked with nothing. A null id
    is never the smallest of a component that has another. Extra columns are
    ignored, an empty table gives an empty result.
    """
    documents, links = linked_sets(docs, id_col, text_col, piece_sets)
    real = _rooted(documents, links)
    known = F.when(F.col("id") != NO_ID, F.col("id"))
    # A group of copies may hold a third of all rows: its minimum is combined before the shuffle,
    # and every row gets it by a join whose other side has one row per group.
    least = real.groupBy("_root").agg(F.min(known).alias("component_id"))
    named = real.join(least, "_root").select("id", "n", "component_id")
    alone = documents.filter("n = 0").select("id", "n", known.alias("component_id"))
    return named.unionByName(alone).select(
        known.alias(id_col), F.col("n").cast("long").alias("n_shingles"), "component_id"
    )


def _rooted(documents: DataFrame, links: DataFrame) -> DataFrame:
    roots = components(links, "similar")
    real = documents.filter("n > 0").join(roots.withColumnRenamed("node", "key"), "key", "left")
    return real.withColumn("_root", F.coalesce("root", "key"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", piece_sets: int = PIECE_SETS) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id (then hash of the text).

    Rows without words are in no component and all stay as they are, repeated
    ones too; they are never shuffled. All columns are kept.
    """
    documents, links = linked_sets(docs, id_col, text_col, piece_sets)
    chosen = _rooted(documents, links).groupBy("_root").agg(F.min(F.struct("id", "mark")).alias("_row"))
    stay = chosen.select("_row.id", "_row.mark")
    taken = {c.lower() for c in docs.columns}
    names = []
    for name in ("kept_id", "kept_mark"):
        while name in taken:
            name += "_"
        names.append(name)
    keys = _row_key(id_col, text_col)
    # A word is a run of anything but ASCII white space.
    has_words = F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    keyed = docs.filter(has_words).withColumn(names[0], keys[0]).withColumn(names[1], keys[1])
    kept = keyed.join(stay.toDF(*names), names, "left_semi").dropDuplicates(names)
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns)).union(docs.filter(~has_words))
