"""Chat formatting with an unknown template: spans come from rendering prefixes.

A template is any function from a list of ``(role, text)`` turns to a string.
It is rendered for 1, 2, ... n turns; comparing consecutive outputs shows where
a turn begins and ends, and rendering the turn with two probe texts shows where
its text lies. A template whose longer output does not begin with the shorter
one (a closing tail aside) rewrites history and is reported, not trusted.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turns = Sequence[tuple[str, str]]
Template = Callable[[Turns], str]

# Strings that mark turns; they never occur unescaped inside a text.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
_CONTROL = re.compile("|".join(f"({re.escape(c[0])})({re.escape(c[1:])})" for c in CONTROLS))
_PROBES = ("a", "b")

SCHEMA = """formatted string, rewrites_at int,
  turns array<struct<role string, start int, end int, text_start int, text_end int, loss boolean>>"""


def escape(text: str) -> str:
    """A backslash is doubled; a control string gets one after its first character."""
    doubled = text.replace("\\", "\\\\")
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], doubled)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


class MarkedTemplate:
    """``<s>[INST] role [/INST]text</s>`` for each turn, role and text escaped.

    The output of the turns before the last of the latest call is kept, so that
    prefixes asked for one after another cost their new turns only.
    """

    def __init__(self):
        self.known: list[tuple[str, str]] = []
        self.output = ""

    def __call__(self, turns: Turns) -> str:
        turns = list(turns)
        if turns[: len(self.known)] != self.known:
            self.known, self.output = [], ""
        pieces = [f"<s>[INST] {escape(role)} [/INST]{escape(text)}</s>" for role, text in turns[len(self.known) :]]
        if len(pieces) > 1:
            self.known, self.output = turns[:-1], "".join([self.output, *pieces[:-1]])
        return self.output + (pieces[-1] if pieces else "")


marked_template = MarkedTemplate()


def _common(a: str, b: str) -> int:
    """Length of the shared beginning, by binary search over what is not yet known to be equal."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _common_end(a: str, b: str) -> int:
    """Length of the shared end; short ones are found without looking at the rest."""
    width, longest = 64, min(len(a), len(b))
    while width < longest and a[-width:] == b[-width:]:
        width *= 2
    width = min(width, longest)
    return _common(a[len(a) - width :][::-1], b[len(b) - width :][::-1])


def locate(render: Template, turns: Turns) -> tuple[str, int | None, list[tuple[int, int, int, int]]]:
    """Output, index of the first turn at which history was rewritten, and spans of the turns.

    A span is ``(start, end, text_start, text_end)`` in the full output. A tail
    that every output repeats after the last turn (a closing mark) belongs to
    no turn but the last. With rewritten history there are no spans.
    """
    full = render(turns)
    # What the shorter output has beyond the shared beginning must be a tail that the longer one ends with.
    # Two neighbouring outputs are held at a time, so memory grows with the conversation and not with its square.
    starts, spans, differs = [], [], None
    shorter = render(turns[:0])
    for k, (role, _) in enumerate(turns):
        longer = render(turns[: k + 1]) if k + 1 < len(turns) else full
        same = len(shorter) if longer.startswith(shorter) else _common(shorter, longer)
        tail = shorter[same:]
        if (tail and not longer.endswith(tail)) or (starts and same < starts[-1]):
            return full, k, []
        # The output that ended with the turn before must agree with the full one up to here.
        if differs is None and not full.startswith(shorter[:same]):
            differs = max(k - 1, 0)
        starts.append(same)
        probe = [render([*turns[:k], (role, text)]) for text in _PROBES]
        after = _common_end(*probe)
        spans.append((_common(*probe), len(longer) - after))
        shorter = longer
    if differs is not None:
        return full, differs, []
    ends = [*starts[1:], len(full)]
    spans = [(start, end, *text) for start, end, text in zip(starts, ends, spans, strict=False)]
    return full, None, spans


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple[str, str]]]]:
    """Turns of one conversation after another from rows sorted by conversation and turn."""
    key, turns, begun = None, [], False
    for batch in batches:
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("_conv", "_role", "_text")), strict=True):
            if begun and conv != key:
                yield key, turns
                turns = []
            key, begun = conv, True
            turns.append((role, text))
    if begun:
        yield key, turns


def format_conversations(
    rows: DataFrame,
    template: Template = marked_template,
    loss_roles: Sequence[str] = ("assistant",),
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per conversation: ``formatted``, ``rewrites_at`` and a span per turn.

    ``turns`` has role, span, text span (code points in ``formatted``) and
    whether the text is under the loss mask. ``rewrites_at`` is the index of the
    first turn at which the template changed earlier output, else null; then
    ``turns`` is empty. Rows with equal turn numbers are ordered by role and
    text, repeated rows are repeated turns, a null role or text is empty, rows
    with a null conversation form one conversation. Extra columns are ignored.

    A conversation is the unit of work and is held whole by one task, as
    rendering needs it; conversations are streamed one after another.
    """
    conv_type = rows.schema[conv_col].dataType.simpleString()
    loss = frozenset(loss_roles)
    narrow = rows.select(
        F.col(conv_col).alias("_conv"),
        F.col(turn_col).alias("_turn"),
        F.coalesce(role_col, F.lit("")).alias("_role"),
        F.coalesce(text_col, F.lit("")).alias("_text"),
    )
    placed = narrow.repartition("_conv").sortWithinPartitions("_conv", "_turn", "_role", "_text")
    out_type = pa.struct(
        [("role", pa.string()), *((c, pa.int32()) for c in ("start", "end", "text_start", "text_end")), ("loss", pa.bool_())]
    )

    def work(batches):
        keys, texts, rewritten, turns_out = [], [], [], []

        def flush():
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, key_type),
                    pa.array(texts, pa.string()),
                    pa.array(rewritten, pa.int32()),
                    pa.array(turns_out, pa.list_(out_type)),
                ],
                ["conv", "formatted", "rewrites_at", "turns"],
            )

        key_type, held = None, 0

        def noted(source):
            nonlocal key_type
            for batch in source:
                key_type = batch.column("_conv").type
                yield batch

        for key, turns in _conversations(noted(batches)):
            formatted, broken, spans = locate(template, turns)
            keys.append(key)
            texts.append(formatted)
            rewritten.append(broken)
            turns_out.append(
                [
                    {"role": role, "start": s[0], "end": s[1], "text_start": s[2], "text_end": s[3], "loss": role in loss}
                    for (role, _), s in zip(turns, spans, strict=False)
                ]
            )
            held += len(formatted)
            if held > 1 << 22:
                yield flush()
                keys, texts, rewritten, turns_out, held = [], [], [], [], 0
        if keys:
            yield flush()

    done = placed.mapInArrow(work, f"conv {conv_type}, {SCHEMA}")
    return done.withColumnRenamed("conv", conv_col) if conv_col != "conv" else done
