"""Cheapest repair of damaged conversations, decided by one integer per path.

A repair keeps, reroles or deletes every row and inserts empty turns so that the
roles read ``(s?(ua)+)?``. The choices form a layered DAG: a layer per row, a
node per state of that pattern. The weight of a path is one whole number: its
high digits are the cost, its low digits the letters of the edits so far, each
in a place of fixed width counted from the left and zeros after the last, so
that ``min`` of two numbers prefers the lower cost and then the audit that comes
first in ASCII order.

Two paths to one node have consumed the same rows, and a letter says what it
costs, so at equal cost neither audit is a prefix of the other. That is why the
numbers may be cut: after ``BLOCK`` rows the letters of each of the four states
give way to one digit, the rank among them, and costs to what they exceed the
least by. Edits that all live paths share are final and leave the search.

Rows of a conversation are walked in order by one task as they come. It holds
the rows whose edit is open yet, never a conversation. Whether a row repeats an
earlier one comes as a sorted mark from an aggregation over row digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlrisk.llm.arrays import slices

BLOCK = 64
BITS = 3
DIGIT = {"D": 1, "I": 2, "K": 3, "R": 4}
COST = {"D": 4, "I": 3, "K": 0, "R": 3}
CUT_SHORT = 3
# Where a path stands in the pattern: nothing yet, after s, after u, after a.
START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {USER: "user", ASSISTANT: "assistant"}
# Turns that may be inserted in one gap, by the states before and behind it. More would only add cost.
GAPS = {
    (START, START): (), (SYSTEM, SYSTEM): (), (USER, USER): (), (ASSISTANT, ASSISTANT): (),
    (START, USER): ("user",), (SYSTEM, USER): ("user",), (ASSISTANT, USER): ("user",), (USER, ASSISTANT): ("assistant",),
    (START, ASSISTANT): ("user", "assistant"), (SYSTEM, ASSISTANT): ("user", "assistant"),
}
# What it costs at most to go on from the first state as any path goes on from the second: an inserted turn, or
# two, or a deleted system row. A path whose cost exceeds another's by more can not become the cheapest.
DETOUR = {
    (ASSISTANT, START): 4, (USER, START): 7, (SYSTEM, START): 6, (ASSISTANT, SYSTEM): 0, (USER, SYSTEM): 3,
    (START, SYSTEM): 0, (ASSISTANT, USER): 3, (USER, ASSISTANT): 3,
}
# Most letters that a row adds: two inserted turns and its own edit.
SLOTS = 3
SPACE = " \t\n\v\f\r"
OUT_ROWS, OUT_CHARS = 4096, 1 << 20

REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
ARROW_REPORT = pa.struct(
    [(name, pa.int64()) for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string())]
)


def _code(letters: str) -> int:
    code = 0
    for letter in letters:
        code = code << BITS | DIGIT[letter]
    return code


def _moves(initial: str, fault: str) -> list[tuple]:
    """(from, to, cost, digits, number of letters, inserted roles, letter) for a row of this initial and fault.

    One move for each two states: what differs between two such moves is theirs
    alone, so the lower cost, then the letters that come first, win in any path.
    """
    found: dict[tuple, tuple] = {}
    for (source, middle), inserted in GAPS.items():
        rows = [("D", middle)]
        if fault not in ("blank", "duplicate"):
            takes = {START: (USER,), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}[middle]
            rows += [("R", to) for to in takes]
            rows += [("K", to) for to in takes if NAMES[to][0] == initial]
            if middle == START and initial == "s":
                rows.append(("K", SYSTEM))
        for letter, target in rows:
            letters = "I" * len(inserted) + letter
            cost = sum(COST[x] for x in letters) + CUT_SHORT * (fault == "truncated" and letter != "D")
            move = source, target, cost, _code(letters), len(letters), inserted, letter
            other = found.setdefault((source, target), move)
            if (cost, letters) < (other[2], "I" * len(other[5]) + other[6]):
                found[source, target] = move
    return list(found.values())


MOVES = {(i, fault): _moves(i, fault) for i in ("s", "u", "a", "") for fault in ("", "blank", "duplicate", "truncated")}


class EditSearch:
    """Cheapest edits of one conversation, row by row."""

    def __init__(self):
        self.live = {START: (0, 0)}  # state: weight, letters in it
        self.width = 0  # bits of the letters in a weight
        self.paid = 0
        self.layers: list[dict] = []  # state: state before, its move

    def add(self, initial: str, fault: str) -> None:
        self.width += SLOTS * BITS
        width = self.width
        before = {state: (weight << SLOTS * BITS, used) for state, (weight, used) in self.live.items()}
        best: dict[int, tuple] = {}
        for move in MOVES[initial, fault]:
            source, target, cost, digits, letters = move[:5]
            if source in before:
                weight, used = before[source]
                used += letters
                weight += (cost << width) + (digits << width - BITS * used)
                if target not in best or weight < best[target][0]:
                    best[target] = weight, used, source, move
        self.live = {state: found[:2] for state, found in best.items()}
        self.layers.append({state: found[2:] for state, found in best.items()})

    def settle(self) -> list[tuple]:
        """Moves that every path which may still win shares; the weights are cut."""
        low = (1 << self.width) - 1
        cost = {state: weight >> self.width for state, (weight, _) in self.live.items()}
        for (state, other), detour in DETOUR.items():
            if state in self.live and other in self.live and cost[state] + detour < cost[other]:
                del self.live[other]
        paid = min(weight >> self.width for weight, _ in self.live.values())
        ranks = {state: k + 1 for k, state in enumerate(sorted(self.live, key=lambda x: self.live[x][0] & low))}
        self.live = {s: ((weight >> self.width) - paid << BITS | ranks[s], 1) for s, (weight, _) in self.live.items()}
        self.paid += paid
        self.width = BITS
        states = set(self.live)
        for k in range(len(self.layers) - 1, -1, -1):
            if len(states) == 1:
                done = self._path(k, next(iter(states)))
                del self.layers[: k + 1]
                return done
            states = {self.layers[k][state][0] for state in states}
        return []

    def finish(self) -> tuple[list[tuple], tuple[str, ...], int]:
        """The remaining moves, the turns inserted at the end, the cost of everything."""
        width = self.width + 2 * BITS
        ends = []
        for state, (weight, used) in self.live.items():
            for target in (START, ASSISTANT):
                inserted = GAPS.get((state, target))
                if inserted is not None:
                    letters = "I" * len(inserted)
                    cost, place = COST["I"] * len(inserted), width - BITS * (used + len(inserted))
                    ends.append(((weight << 2 * BITS) + (cost << width) + (_code(letters) << place), state, inserted))
        weight, state, inserted = min(ends)
        return self._path(len(self.layers) - 1, state), inserted, self.paid + (weight >> width)

    def _path(self, layer: int, state: int) -> list[tuple]:
        moves = []
        for k in range(layer, -1, -1):
            state, move = self.layers[k][state]
            moves.append(move)
        return moves[::-1]


class _Conversation:
    """Faults of the rows of one conversation and the repaired turns, as they become final."""

    def __init__(self, put):
        self.put = put  # takes position, role, text, letter
        self.search = EditSearch()
        self.open: list[tuple[str, str]] = []
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.first = self.last = self.initial = None
        self.turns = 0
        self.audit: list[str] = []
        self.position = 0

    def add(self, turn, role: str, text: str, repeated: bool) -> None:
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.turns += turn != self.last
            self.last = turn
        initial = role[:1]
        if self.initial is not None:
            self.counts["illegal"] += self.initial + initial not in ("su", "ua", "au")
        self.initial = initial
        said = text.rstrip(SPACE)
        fault = "blank" if not said else "duplicate" if repeated else "" if said[-1] in ".!?" else "truncated"
        if fault:
            self.counts[fault] += 1
        self.search.add(initial if initial in ("s", "u", "a") else "", fault)
        # A row that must go is not needed any more.
        self.open.append(("", "") if fault in ("blank", "duplicate") else (role, text))
        if len(self.open) % BLOCK == 0:
            self.write(self.search.settle())

    def write(self, moves: list[tuple]) -> None:
        for (role, text), (_, target, _, _, _, inserted, letter) in zip(self.open, moves, strict=False):
            self.insert(inserted)
            self.audit.append(letter)
            if letter != "D":
                self.put(self.position, NAMES[target] if letter == "R" else role, text, letter)
                self.position += 1
        del self.open[: len(moves)]

    def insert(self, roles: tuple[str, ...]) -> None:
        for role in roles:
            self.audit.append("I")
            self.put(self.position, role, "", "I")
            self.position += 1

    def report(self) -> dict:
        moves, inserted, cost = self.search.finish()
        self.write(moves)
        self.insert(inserted)
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return {"gaps": gaps, **self.counts, "cost": cost, "audit": "".join(self.audit)}


class _Output:
    def __init__(self, schema: pa.Schema):
        self.schema = schema
        self.rows: list[tuple] = []
        self.chars = 0

    def add(self, *row) -> None:
        self.rows.append(row)
        self.chars += len(row[3] or "")

    def full(self) -> bool:
        return len(self.rows) >= OUT_ROWS or self.chars >= OUT_CHARS

    def take(self) -> Iterator[pa.RecordBatch]:
        columns = list(zip(*self.rows, strict=True))
        self.rows, self.chars = [], 0
        if columns:
            arrays = [pa.array(column, field.type) for column, field in zip(columns, self.schema, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=self.schema)


def repair_conversations(
    rows: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    there_col: str | None = None,
) -> DataFrame:
    """``(id, position, role, text, edit, report)``: repaired turns in order, then a report per conversation.

    Rows of a conversation lie next to each other in one partition, positions
    from 0 with a null report, at the end one row with a report and nothing else.
    ``edit`` is K, R or I; deleted rows only show in ``report.audit``. Faults in
    the report are those of the given rows, each row's first one only.

    Rows are taken by turn, nulls first, then by role and text. A null role or
    text is one space, a text without other than ASCII white space is blank.
    Rows of a null id are one conversation of that id. A row whose ``there_col``
    is false only names its conversation: one without other rows gives a report
    of zeros and an empty audit. Repeated rows are faults of the second kind. An
    empty table gives no rows; other columns are ignored. A hot conversation is
    walked by one task; its memory grows with the length of the audit and, while
    two ways to repair it stay equally open, with the rows in between.
    """
    narrow = rows.select(
        F.col(conv_col).alias("_conv"),
        F.col(turn_col).alias("_turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("_role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("_text"),
        (F.lit(True) if there_col is None else F.col(there_col)).alias("_there"),
    )
    size = F.length("_role").cast("string")
    facts = narrow.withColumn("_hash", F.unhex(F.substring(F.sha2(F.concat(size, F.lit(":"), "_role", "_text"), 256), 1, 32)))
    earliest = (
        facts.filter("_there")
        .groupBy("_conv", "_hash")
        .agg(F.min(F.struct(F.col("_turn").isNotNull().alias("known"), "_turn")).alias("_at"))
        .select("_conv", F.col("_at._turn").alias("_turn"), F.lit(None).cast("string").alias("_role"),
                F.lit(None).cast("string").alias("_text"), F.lit(True).alias("_there"), "_hash")
    )
    # Kind 0 names a conversation, 1 says at which turn a row comes first, 2 is a row.
    kind = F.when(~F.col("_there"), 0).when(F.col("_role").isNull(), 1).otherwise(2)
    ordered = (
        facts.unionByName(earliest)
        .withColumn("_kind", kind)
        .repartition("_conv")
        .sortWithinPartitions("_conv", F.col("_turn").asc_nulls_first(), "_kind", "_role", "_text")
    )
    types = rows.select(conv_col).schema[0].dataType.simpleString()
    report = ", ".join(field.replace(" ", ": ") for field in REPORT.split(", "))
    schema = f"id {types}, position long, role string, text string, edit string, report struct<{report}>"

    def work(batches: Iterator[pa.RecordBatch]):
        out = now = None
        current = object()
        firsts: set[bytes] = set()
        at: object = None
        for batch in slices(batches, "_text"):
            if out is None:
                out = _Output(pa.schema([
                    ("id", batch.schema.field("_conv").type), ("position", pa.int64()), ("role", pa.string()),
                    ("text", pa.string()), ("edit", pa.string()), ("report", ARROW_REPORT),
                ]))
            for row in zip(*(batch.column(x).to_pylist() for x in ("_conv", "_turn", "_kind", "_role", "_text", "_hash")), strict=True):
                conv, turn, kind, role, text, digest = row
                if now is None or conv != current:
                    if now is not None:
                        out.add(current, None, None, None, None, now.report())
                    current, at = conv, None
                    firsts.clear()
                    now = _Conversation(lambda *turn, conv=conv: out.add(conv, *turn, None))
                if turn != at:
                    firsts.clear()
                    at = turn
                if kind == 1:
                    firsts.add(digest)
                elif kind == 2:
                    now.add(turn, role, text, digest not in firsts)
                    firsts.discard(digest)
                if out.full():
                    yield from out.take()
        if now is not None:
            out.add(current, None, None, None, None, now.report())
            yield from out.take()

    return ordered.mapInArrow(work, schema).withColumnRenamed("id", conv_col)


def repair_digests(repaired: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """``(id, report fields, repaired_sha256)`` of what :func:`repair_conversations` returns, row by row.

    The digest is over ``role:text`` of the repaired turns, joined by newlines. The
    rows must come as they were returned: filters and shuffles would part them.
    """
    types = repaired.schema[conv_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]):
        digest = hashlib.sha256()
        for batch in batches:
            found = []
            columns = (batch.column(x).to_pylist() for x in (conv_col, "position", "role", "text", "report"))
            for conv, position, role, text, report in zip(*columns, strict=True):
                if report is None:
                    digest.update(f"{chr(10) if position else ''}{role}:{text}".encode())
                else:
                    found.append({"id": conv, **report, "repaired_sha256": digest.hexdigest()})
                    digest = hashlib.sha256()
            if found:
                fields = [("id", batch.schema.field(conv_col).type), *ARROW_REPORT, ("repaired_sha256", pa.string())]
                yield pa.RecordBatch.from_pylist(found, pa.schema(fields))

    return repaired.mapInArrow(work, f"id {types}, {REPORT}, repaired_sha256 string").withColumnRenamed("id", conv_col)
