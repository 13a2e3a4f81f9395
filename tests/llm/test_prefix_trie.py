"""Prefix trie against a plain trie of nested prefixes, on odd rows and on the given table."""

import hashlib
import random
import re
import zlib

import pytest

from urlrisk.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string, path string, first int"
COLUMNS = ["depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def ordered(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {conv: [turn[2:] for turn in sorted(turns)] for conv, turns in convs.items()}


def rebuilt_plainly(rows):
    convs = ordered(rows)
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        head = c - (c % 20 if c >= 0 else -(-c % 20))  # as SQL takes the remainder
        out[c] = convs.get(head, [])[:h] + own[h:]
    return out


def trie_plainly(convs):
    """Rows of COLUMNS for conversations as lists of (role, text)."""
    members, ends = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    children, leaves, saved = {}, {}, {}
    for node in sorted(members, key=len, reverse=True):
        said = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves[node] = leaves.get(node, 0) if children.get(node) else 1
        saved[node] = saved.get(node, 0) + (len(members[node]) - 1) * said
        if node:
            above = node[:-1]
            children[above] = children.get(above, 0) + 1
            leaves[above] = leaves.get(above, 0) + leaves[node]
            saved[above] = saved.get(above, 0) + saved[node]
    return sorted(
        (
            len(node), min(found), min(members[node[:-1]]) if node else -1, len(found), children.get(node, 0), leaves[node],
            saved[node], hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest(),
        )
        for node, found in members.items()
    )


def found(frame):
    return sorted(tuple(-1 if v is None else v for v in row) for row in frame.select(*COLUMNS).collect())


def built(rows, there_col=None):
    paths = prefix_trie.conversation_paths(rows, there_col=there_col)
    digests = prefix_trie.ending_digests(prefix_trie.endings(paths))
    none = hashlib.sha256().hexdigest()
    return prefix_trie.trie_nodes(paths).join(digests, "node_id", "left").na.fill({"ends_sha256": none})


def odd_rows():
    pick = random.Random(3)
    said = ["a b", "", None, " \t", "one two three", "word " * 2000]
    rows = []
    for conv in range(120):
        turns = [(t, pick.choice(["user", None, "assistant"]), pick.choice(said)) for t in range(pick.choice([1, 1, 2, 3, 4]))]
        rows += [(conv, *turn) for turn in turns]
        if conv % 3 == 0:  # one large group of copies
            rows = [r for r in rows if r[0] != conv] + [(conv, 0, "user", "same"), (conv, 1, "assistant", "as this")]
    # Every prefix of one conversation, a long one, null turns, repeated rows, rows without an id.
    rows += [(200 + n, t, "user", f"turn {t}") for n in range(12) for t in range(n + 1)]
    rows += [(300, t, "user", f"x {t}") for t in range(700)] + [(301, t, "user", f"x {t}") for t in range(650)]
    rows += [(400, None, "user", "b"), (400, None, "user", "a"), (400, 1, "user", "c"), (401, 5, "user", "r"), (401, 5, "user", "r")]
    return rows + [(None, 0, "user", "lost"), (-7, 0, "user", "minus"), (-7, 1, "user", "seven")]


@pytest.mark.parametrize("chunk", [3, 40, 1 << 16])
def test_trie_of_odd_rows(spark, monkeypatch, chunk):
    monkeypatch.setattr(prefix_trie, "CHUNK_ITEMS", chunk)
    rows = odd_rows()
    table = spark.createDataFrame([(*row, "x", 1) for row in rows], SCHEMA).repartition(5)
    # Rows of a conversation that tie by turn and role are ordered by digest, so 400 is left to the rebuilt form.
    plain = [row for row in rows if row[0] != 400]
    assert found(built(table.filter("conv_id IS NULL OR conv_id != 400"))) == trie_plainly(ordered(plain))
    again = queries.rebuilt(table)
    assert found(built(again, "there")) == trie_plainly(rebuilt_plainly(rows))


def test_parents_by_join(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK_ITEMS", 5)
    monkeypatch.setattr(prefix_trie, "BROADCAST_ROWS", 0)
    rows = odd_rows()
    table = spark.createDataFrame([(*row, "x", 1) for row in rows], SCHEMA)
    assert found(built(queries.rebuilt(table), "there")) == trie_plainly(rebuilt_plainly(rows))


def test_empty_tables_and_conversations(spark):
    table = spark.createDataFrame([(1, 0, "user", "a", "x", 1)], SCHEMA)
    assert found(built(table.filter("conv_id > 1"))) == []
    turnless = table.selectExpr("*", "false AS there")
    none = hashlib.sha256(b"1").hexdigest()
    assert found(built(turnless, "there")) == [(0, 1, -1, 1, 0, 1, 0, none)]


def test_registered_query(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK_ITEMS", 30)
    sf_dir = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    frame = queries.op13_prefix_trie(spark, sf_dir)
    assert set(frame.columns) == set(COLUMNS)
    assert {t for c, t in frame.dtypes if c != "ends_sha256"} == {"bigint"}
    assert found(frame) == trie_plainly(rebuilt_plainly(rows))
