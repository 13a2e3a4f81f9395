"""Conversation repair against exhaustive search and a plain recursion, on odd rows and on the given table."""

import hashlib
import random
import re
import sys
import zlib
from functools import lru_cache

import pytest

from urlrisk.llm import queries, turn_repair

SCHEMA = "conv_id long, turn long, role string, text string, id string, _kind int"
sys.setrecursionlimit(max(20_000, sys.getrecursionlimit()))
SPACE = " \t\n\v\f\r"


def exhaustive(kinds):
    """Least (cost, audit) over all edit sequences with at most three turns inserted in a row."""
    found = []

    def extend(k, audit, cost, roles):
        if not re.fullmatch(r"(s?(ua)*u?)?", roles):
            return
        if k == len(kinds) and re.fullmatch(r"(s?(ua)+)?", roles):
            found.append((cost, audit))
        if not audit.endswith("III"):
            for role in "ua":
                extend(k, audit + "I", cost + 3, roles + role)
        if k < len(kinds):
            initial, fault = kinds[k]
            extend(k + 1, audit + "D", cost + 4, roles)
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                extend(k + 1, audit + "K", cost + more, roles + (initial or "?"))
                for role in "ua":
                    extend(k + 1, audit + "R", cost + 3 + more, roles + role)

    extend(0, "", 0, "")
    return min(found)


def searched(kinds, block):
    search, audit = turn_repair.EditSearch(), []

    def put(moves):
        audit.extend("I" * len(move[5]) + move[6] for move in moves)

    for k, kind in enumerate(kinds):
        search.add(*kind)
        if (k + 1) % block == 0:
            put(search.settle())
    moves, inserted, cost = search.finish()
    put(moves)
    return cost, "".join(audit) + "I" * len(inserted)


def some_kinds(pick, n):
    return [(pick.choice("suauax").strip("x"), pick.choice(["", "", "", "blank", "duplicate", "truncated"])) for _ in range(n)]


def test_search_finds_what_exhaustive_search_finds():
    pick = random.Random(5)
    for _ in range(250):
        kinds = some_kinds(pick, pick.randint(0, 5))
        want = exhaustive(kinds)
        assert [searched(kinds, block) for block in (1, 2, 64)] == [want] * 3, kinds


def test_cut_weights_decide_as_whole_ones():
    pick = random.Random(6)
    for _ in range(60):
        kinds = some_kinds(pick, pick.randint(0, 200))
        assert len({searched(kinds, block) for block in (1, 5, 64, 1000)}) == 1
    # A run in which two ways stay open all along.
    kinds = [("a", "")] + [("s", "")] * 500 + [("u", "")]
    assert searched(kinds, 64) == searched(kinds, 10_000)


def repaired_plainly(rows):
    """Report and repaired turns of one conversation by recursion over (row, state)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        said = text.rstrip(SPACE)
        fault = "blank" if not said else "duplicate" if (role, text) in seen else "" if said[-1] in ".!?" else "truncated"
        faults.append(fault)
        seen.add((role, text))

    @lru_cache(maxsize=None)
    def best(k, state, inserted):
        options = [(0, "", ())] if k == len(rows) and state in ("", "a") else []

        def after(letter, cost, turn, k, state, inserted):
            rest = best(k, state, inserted)
            if rest:
                options.append((cost + rest[0], letter + rest[1], turn + rest[2]))

        to = "a" if state == "u" else "u"
        name = {"u": "user", "a": "assistant"}[to]
        if inserted < 3:
            after("I", 3, ((name, ""),), k, to, inserted + 1)
        if k < len(rows):
            _, role, text = rows[k]
            after("D", 4, (), k + 1, state, 0)
            if faults[k] not in ("blank", "duplicate"):
                more = 3 * (faults[k] == "truncated")
                after("R", 3 + more, ((name, text),), k + 1, to, 0)
                if role[:1] == to or (state == "" and role[:1] == "s"):
                    after("K", more, ((role, text),), k + 1, role[:1], 0)
        return min(options) if options else None

    cost, audit, turns = best(0, "", 0)
    known = [turn for turn, _, _ in rows if turn is not None]
    initials = [role[:1] for _, role, _ in rows]
    counts = [faults.count(x) for x in ("blank", "duplicate", "truncated")]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    return (gaps, *counts, illegal, cost, audit), turns


def damaged_plainly(rows):
    convs = {}
    for conv, turn, role, text in rows:
        kept = convs.setdefault(conv, [])
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        kept.extend([(turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1))
    return convs


def digest_of(turns):
    return hashlib.sha256("\n".join(f"{role}:{text}" for role, text in turns).encode()).hexdigest()


def odd_rows():
    pick = random.Random(9)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "uncle"]
    texts = ["Yes.", "No", "Well!\n", "", " \t", None, "é?", "long " * 3000 + ".", "a "]
    rows = []
    for conv in [*range(40), None]:
        for _ in range(pick.choice([1, 1, 2, 3, 5, 7])):
            turn = pick.choice([0, 1, 2, 3, 4, 9, None])
            rows.append((conv, turn, pick.choice(roles), pick.choice(texts)))
    rows += [(70, 3, "user", "Same.")] * 5 + [(71, None, "user", "Here.")] * 2 + [(72, k, "system", "x.") for k in range(300)]
    # A conversation all of whose rows the damage drops.
    dropped = [(c, t) for c in range(100, 200) for t in range(5) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    return rows + [(c, t, "user", "Gone.") for c, t in dropped]


@pytest.mark.parametrize("parts", [1, 7])
def test_repair_of_odd_rows(spark, parts):
    rows = odd_rows()
    table = spark.createDataFrame([(*row, "x", 1) for row in rows], SCHEMA).repartition(parts)
    repaired = turn_repair.repair_conversations(queries.damaged(table), there_col="there")
    got = {}
    for row in repaired.collect():
        turns, reports = got.setdefault(row.conv_id, ([], []))
        if row.report:
            reports.append(tuple(row.report))
        else:
            assert row.position == len(turns) and row.edit in "KRI"
            turns.append((row.role, row.text))
    digests = {row.conv_id: row.repaired_sha256 for row in turn_repair.repair_digests(repaired).collect()}
    want = {conv: repaired_plainly(kept) for conv, kept in damaged_plainly(rows).items()}
    assert set(got) == set(want) == set(digests)
    for conv, (report, turns) in want.items():
        assert got[conv] == (list(turns), [report]), conv
        assert digests[conv] == digest_of(turns)
    assert any(report == (0, 0, 0, 0, 0, 0, "") for report, _ in want.values())


def test_repair_without_damage_and_of_nothing(spark):
    rows = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes.")], "conv_id int, turn int, role string, text string")
    kept = turn_repair.repair_conversations(rows).collect()
    assert [(r.role, r.text, r.edit) for r in kept[:2]] == [("user", "Hi.", "K"), ("assistant", "Yes.", "K")]
    assert kept[2].report.audit == "KK" and kept[2].report.cost == 0
    assert turn_repair.repair_digests(turn_repair.repair_conversations(rows.filter("conv_id > 1"))).count() == 0


def test_registered_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    frame = queries.op11_turn_repair(spark, sf_dir)
    assert frame.columns == names
    want = set()
    for conv, kept in damaged_plainly(rows).items():
        report, turns = repaired_plainly(kept)
        want.add((conv, *report, digest_of(turns)))
    got = [tuple(row) for row in frame.collect()]
    assert set(got) == want and len(got) == len(want)
