"""Trie of conversation prefixes by peeling turns from the longest down.

A conversation is a path of chained digests, one per turn: the last digest of
the first d turns is the node that all conversations with these turns share.
Paths are dealt by range, so the conversations below a node lie next to each
other, and a task peels those it was dealt: from the greatest depth it merges
conversations that end there with the nodes that survived from below, closes
every node with all its totals, strips the last turn and groups again.

A node on the first or last path of what was peeled at once may go on in another
task. It stays open: what was found below it becomes an item that ends there,
and the few items left are dealt and peeled again, until one pass takes all.
However many conversations share a turn, no task sees more than its range.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlrisk.session import materialize

ID_BYTES = 16
WORD = r"[^\x20\x09-\x0D]+"
# Items peeled at once in the first round, and their growth from round to round.
CHUNK_ITEMS = 1 << 12
CHUNK_GROWTH = 8
# Parents that children closed in another round are looked up in: up to so many rows are broadcast.
BROADCAST_ROWS = 200_000
OUT_ROWS = 8192

ITEM = "path binary, words binary, convs long, first long, children long, leaves long, saved long"
PEELED = f"open boolean, node_id binary, parent_id binary, depth int, parent_first long, {ITEM}"


def conversation_paths(
    rows: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    there_col: str | None = None,
) -> DataFrame:
    """``(conv_id long, path, words)``: 16 bytes of chained digest and 4 of word count for each turn.

    Turns are taken nulls first, then by role and digest of the text; a null role
    or text is empty. A row whose ``there_col`` is false only names its
    conversation. Rows without an id belong to no conversation and are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    size = F.length(role).cast("string")
    narrow = rows.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("_conv"),
        F.col(turn_col).alias("_turn"),
        role.alias("_role"),
        F.unhex(F.substring(F.sha2(F.concat(size, F.lit(":"), role, text), 256), 1, 2 * ID_BYTES)).alias("_digest"),
        F.regexp_count(text, F.lit(WORD)).alias("_words"),
        (F.lit(True) if there_col is None else F.col(there_col)).alias("_there"),
    )
    ordered = narrow.repartition("_conv").sortWithinPartitions(
        "_conv", F.col("_turn").asc_nulls_first(), "_role", "_digest"
    )

    def work(batches: Iterator[pa.RecordBatch]):
        found: list[tuple] = []
        conv, node, path, words = None, b"", [], []
        size = 0

        def close():
            found.append((conv, b"".join(path), np.array(words, "<u4").tobytes()))

        def take():
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*found), (pa.int64(), pa.binary(), pa.binary()))], ["conv_id", "path", "words"]
            )
            found.clear()

        for batch in batches:
            for c, digest, count, there in zip(*(batch.column(x).to_pylist() for x in ("_conv", "_digest", "_words", "_there"))):
                if c != conv:
                    if conv is not None:
                        close()
                        size += 20 * len(path)
                        if len(found) >= OUT_ROWS or size > 1 << 22:
                            yield from take()
                            size = 0
                    conv, node, path, words = c, b"", [], []
                if there:
                    node = hashlib.blake2b(node + digest, digest_size=ID_BYTES).digest()
                    path.append(node)
                    words.append(count)
        if conv is not None:
            close()
            yield from take()

    return ordered.mapInArrow(work, "conv_id long, path binary, words binary")


class _Node:
    """What is known of a surviving node: the item whose path leads to it, and the totals below it."""

    __slots__ = ("at", "convs", "first", "children", "leaves", "saved", "rows")

    def __init__(self, at: int):
        self.at = at
        self.convs = self.children = self.leaves = self.saved = 0
        self.first = None
        self.rows: list[list] = []

    def add(self, convs, first, children, leaves, saved) -> None:
        self.convs += convs
        self.first = first if self.first is None else min(self.first, first)
        self.children += children
        self.leaves += leaves
        self.saved += saved


def peel(items: list[tuple], alone: bool) -> Iterator[list]:
    """Rows of :data:`PEELED` for items sorted by path; unless ``alone``, nodes on the outer paths stay open."""
    open_nodes: set[bytes] = set()
    if not alone:
        open_nodes.add(b"")
        for path in (items[0][0], items[-1][0]):
            open_nodes.update(path[k : k + ID_BYTES] for k in range(0, len(path), ID_BYTES))
    ended: dict[int, list[int]] = {}
    for at, item in enumerate(items):
        ended.setdefault(len(item[0]) // ID_BYTES, []).append(at)
    survivors: dict[bytes, _Node] = {}
    for depth in range(max(ended), -1, -1):
        for at in ended.pop(depth, ()):
            path = items[at][0]
            node = survivors.setdefault(path[-ID_BYTES:], _Node(at))
            node.add(*items[at][2:])
        stripped: dict[bytes, _Node] = {}
        end = ID_BYTES * depth
        for node_id, node in survivors.items():
            path, words = items[node.at][:2]
            parent_id = path[max(end - 2 * ID_BYTES, 0) : max(end - ID_BYTES, 0)]
            if node_id in open_nodes:
                yield from node.rows
                yield [True, node_id, parent_id, depth, None, path[:end], words[: 4 * depth],
                       node.convs, node.first, node.children, node.leaves, node.saved]
                continue
            for row in node.rows:
                row[4] = node.first
                yield row
            said = int.from_bytes(words[4 * depth - 4 : 4 * depth], "little")
            leaves = node.leaves or 1
            saved = node.saved + (node.convs - 1) * said
            row = [False, node_id, parent_id, depth, None, None, None, node.convs, node.first, node.children, leaves, saved]
            if depth == 0:
                yield row
                continue
            above = stripped.get(parent_id)
            if above is None:
                above = stripped[parent_id] = _Node(node.at)
            above.add(node.convs, node.first, 1, leaves, saved)
            above.rows.append(row)
        survivors = stripped


def _peeled(items: DataFrame, parts: int, chunk: int | None, name: str) -> DataFrame:
    """One round; ``chunk`` None: all items are peeled at once and every node closes."""
    if chunk is None:
        dealt = items.coalesce(1).sortWithinPartitions("path", "first")
    else:
        dealt = items.repartitionByRange(parts, "path", "first").sortWithinPartitions("path", "first")
    names = [field.split(" ")[0] for field in ITEM.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]):
        types = [pa.bool_(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * 5]
        schema = pa.schema(list(zip([field.split(" ")[0] for field in PEELED.split(", ")], types, strict=True)))

        def written(held):
            rows = []
            for row in peel(held, chunk is None):
                rows.append(row)
                if len(rows) >= OUT_ROWS:
                    yield from batch_of(rows)
                    rows = []
            yield from batch_of(rows)

        def batch_of(rows):
            if rows:
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], schema=schema)

        held: list[tuple] = []
        for batch in batches:
            held.extend(zip(*(batch.column(x).to_pylist() for x in names), strict=True))
            while chunk is not None and len(held) >= chunk:
                yield from written(held[:chunk])
                held = held[chunk:]
        if held:
            yield from written(held)

    return materialize(dealt.mapInArrow(work, PEELED), name)


def trie_nodes(paths: DataFrame) -> DataFrame:
    """Every node of the trie of ``paths``, which :func:`conversation_paths` returns and which is read several times.

    ``(node_id, depth, conv_id, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens)``: ``conv_id`` is the smallest conversation below the node, the
    root has depth 0, an empty id and no parent. ``saved_tokens`` sums, over the
    node and all below it, the words of the last text for every conversation but
    one. Conversations without turns end at the root; without any conversation
    there is no node. Equal conversations share all nodes; ids that repeat are
    one conversation.

    A task holds a chunk of items and their paths, 16 bytes a turn. Rounds after
    the first only see what the outer paths of the chunks left open.
    """
    spark = paths.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    none = F.lit(0).cast("long")
    items = paths.select(
        "path", "words", F.lit(1).cast("long").alias("convs"), F.col("conv_id").alias("first"),
        none.alias("children"), none.alias("leaves"), none.alias("saved"),
    )
    left, chunk = items.count(), CHUNK_ITEMS
    rounds = []
    while left > chunk:
        rounds.append(_peeled(items, min(parts, -(-left // chunk) * 4), chunk, "trie-round"))
        items = rounds[-1].filter("open").select(*(field.split(" ")[0] for field in ITEM.split(", ")))
        left, chunk = items.count(), chunk * CHUNK_GROWTH
    rounds.append(_peeled(items, 1, None, "trie-round"))
    first, later = rounds[0].filter("NOT open"), rounds[1:]
    closed = first
    if later:
        late = later[0].filter("NOT open")
        for table in later[1:]:
            late = late.unionByName(table.filter("NOT open"))
        parents = late.select(F.col("node_id").alias("parent_id"), F.col("first").alias("_late"))
        if late.count() <= BROADCAST_ROWS:
            parents = F.broadcast(parents)
        known = first.unionByName(late)
        closed = known.filter("parent_first IS NOT NULL OR depth = 0").unionByName(
            known.filter("parent_first IS NULL AND depth > 0").join(parents, "parent_id", "left")
            .withColumn("parent_first", F.col("_late")).drop("_late")
        )
    return closed.select(
        "node_id",
        F.col("depth").cast("long").alias("depth"),
        F.col("first").alias("conv_id"),
        F.col("parent_first").alias("parent_conv_id"),
        F.col("convs").alias("n_convs"),
        F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
    )


def endings(paths: DataFrame) -> DataFrame:
    """``(node_id, conv_id)``: the node at which each conversation ends."""
    end = F.substring("path", -ID_BYTES, ID_BYTES)
    return paths.select(F.when(F.length("path") > 0, end).otherwise(F.lit(b"")).alias("node_id"), "conv_id")


def ending_digests(ends: DataFrame) -> DataFrame:
    """``(node_id, ends_sha256)`` over the ascending decimal ids of what ends at a node, comma-joined.

    A digest is sequential: one task reads the ids of a node, sorted, one after another.
    """
    ordered = ends.repartition("node_id").sortWithinPartitions("node_id", "conv_id")

    def work(batches: Iterator[pa.RecordBatch]):
        current, digest, found = None, hashlib.sha256(), []
        for batch in batches:
            for node, conv in zip(batch.column("node_id").to_pylist(), batch.column("conv_id").to_pylist()):
                if node != current:
                    if current is not None:
                        found.append((current, digest.hexdigest()))
                    current, digest = node, hashlib.sha256(str(conv).encode())
                else:
                    digest.update(f",{conv}".encode())
            if len(found) >= OUT_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found)], ["node_id", "ends_sha256"])
                found = []
        if current is not None:
            found.append((current, digest.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found)], ["node_id", "ends_sha256"])

    return ordered.mapInArrow(work, "node_id binary, ends_sha256 string")
