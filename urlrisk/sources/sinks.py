"""Outputs: versioned tables, idempotent appends, text logs.

A table is a list of segments in a manifest (:mod:`urlrisk.sources.manifest`). A
job never overwrites what it reads: a rewrite makes a new version, an addition a
new segment, and a reader sees one state of the list. A segment has a number
and, where several jobs write to one table, the name of its writer, so a
repeated batch replaces its own earlier attempt and nothing else. Small segments
are merged as they gather, ``FAN`` of a level into one of the next, so the list
stays short and a micro-batch costs the same after any number of others.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlrisk.sources import manifest

# Segments of one level that are merged into one of the next.
FAN = 32
_OWN = ("_segment", "_writer")


def versions(spark: SparkSession, root: str) -> list[int]:
    """Finished versions."""
    return manifest.load(spark, root)[1].get("versions", [])


def _stamped(df: DataFrame, number: int, writer: str) -> DataFrame:
    return df.withColumn("_segment", F.lit(number)).withColumn("_writer", F.lit(writer))


def _covered(ranges: list[list[int]], number: int) -> bool:
    return any(low <= number <= high for low, high in ranges)


def _absorb(state: dict, entries: list[dict]) -> None:
    """Note the numbers of entries that are no longer listed as such, as ranges per writer."""
    for entry in entries:
        if entry["level"]:
            continue
        ranges = sorted([*state["absorbed"].get(entry["writer"], []), [entry["number"], entry["number"]]])
        merged = [ranges[0]]
        for low, high in ranges[1:]:
            if low <= merged[-1][1] + 1:
                merged[-1][1] = max(merged[-1][1], high)
            else:
                merged.append([low, high])
        state["absorbed"][entry["writer"]] = merged


def _filled(state: dict) -> dict:
    return {"versions": [], "segments": [], "absorbed": {}} | state


def write_version(df: DataFrame, root: str) -> str:
    """Write ``df`` as the next version of the table; readers of older ones go on.

    A batch that an earlier version has taken in is not added again to this one.
    """
    path = f"{root}/data/{uuid.uuid4().hex}"
    _stamped(df, 0, "").write.parquet(path)

    def change(state: dict) -> dict:
        state = _filled(state)
        _absorb(state, state["segments"])
        state["versions"].append(state["versions"][-1] + 1 if state["versions"] else 0)
        state["segments"] = [{"number": 0, "writer": "", "path": path[len(root) + 1 :], "level": 0}]
        return state

    manifest.commit(df.sparkSession, root, change)
    return path


def append_segment(
    df: DataFrame, root: str, segment: int | None = None, writer: str = "", combine: Callable[[DataFrame], DataFrame] | None = None
) -> str:
    """Add rows to the current version as segment number ``segment`` of ``writer``, or the next free number.

    Segments are merged as they are, or by ``combine``, see :func:`merge_segments`. Only the same number of the same writer is replaced; one that has been merged
    or rewritten since is in the table already and is left as it is. Returns where
    the rows were written.
    """
    spark = df.sparkSession
    while True:
        number = _next_number(_filled(manifest.load(spark, root)[1])) if segment is None else segment
        path = f"{root}/data/{uuid.uuid4().hex}"
        _stamped(df, number, writer).write.parquet(path)
        taken = False

        def change(state: dict, number=number, path=path) -> dict | None:
            nonlocal taken
            state = _filled(state)
            taken = segment is None and number < _next_number(state)
            if taken or segment is not None and _covered(state["absorbed"].get(writer, []), number):
                return None
            state["versions"] = state["versions"] or [0]
            state["segments"] = [x for x in state["segments"] if x["level"] or (x["number"], x["writer"]) != (number, writer)]
            state["segments"].append({"number": number, "writer": writer, "path": path[len(root) + 1 :], "level": 0})
            return state

        manifest.commit(spark, root, change)
        if not taken:
            merge_segments(spark, root, combine=combine)
            return path


def _next_number(state: dict) -> int:
    listed = [entry["number"] for entry in state["segments"]]
    gone = [high for ranges in state["absorbed"].values() for _, high in ranges]
    return max([*listed, *gone], default=-1) + 1


def merge_segments(
    spark: SparkSession, root: str, fan: int | None = None, combine: Callable[[DataFrame], DataFrame] | None = None
) -> bool:
    """Merge the oldest segments of a level that has ``fan`` of them; whether there was one.

    The files are read and written without a shuffle; a scan packs small ones into
    one task, so that is also how large the new ones are. ``combine`` turns the
    rows of some segments into fewer that stand for them, such as their sums; it
    must not matter which segments are combined first, and the numbers of the
    segments are lost.
    """
    fan = fan or FAN
    state = _filled(manifest.load(spark, root)[1])
    by_level: dict[int, list[dict]] = {}
    for entry in state["segments"]:
        by_level.setdefault(entry["level"], []).append(entry)
    for level, entries in sorted(by_level.items()):
        if len(entries) < fan:
            continue
        merged = entries[:fan]
        path = f"{root}/data/{uuid.uuid4().hex}"
        rows = spark.read.parquet(*(f"{root}/{entry['path']}" for entry in merged))
        if combine is not None:
            rows = _stamped(combine(rows.drop(*_OWN)), merged[-1]["number"], "")
        rows.write.parquet(path)

        def change(state: dict) -> dict | None:
            state = _filled(state)
            if any(entry not in state["segments"] for entry in merged):
                return None  # another writer replaced or merged some of them
            _absorb(state, merged)
            new = {"number": merged[-1]["number"], "writer": "", "path": path[len(root) + 1 :], "level": level + 1}
            rest = [entry for entry in state["segments"] if entry not in merged]
            state["segments"] = [new, *rest]
            return state

        manifest.commit(spark, root, change)
        return True
    return False


def read_table(
    spark: SparkSession, root: str, below_segment: int | None = None, with_segment: bool = False, writer: str = ""
) -> DataFrame | None:
    """The current version, or None before the first one.

    ``below_segment`` leaves out that segment of ``writer`` and its later ones:
    what a repeated batch has written itself. ``with_segment`` adds the segment number.
    """
    entries = manifest.load(spark, root)[1].get("segments", [])
    if below_segment is not None:
        entries = [x for x in entries if x["level"] or x["writer"] != writer or x["number"] < below_segment]
    if not entries:
        return None
    table = spark.read.parquet(*(f"{root}/{entry['path']}" for entry in entries))
    if below_segment is not None and any(entry["level"] for entry in entries):
        table = table.filter((F.col("_writer") != writer) | (F.col("_segment") < below_segment))
    if with_segment:
        table = table.withColumn("segment", F.col("_segment"))
    return table.drop(*_OWN)


def result_lines(results: DataFrame, ts: str = "ts") -> DataFrame:
    """``url - prediction - time`` as one text column."""
    return results.select(
        F.concat_ws(" - ", "url", "prediction", F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).alias("value")
    )


def write_result_log(results: DataFrame, path: str, ts: str = "ts") -> None:
    """Append result lines; nothing is written for an empty result."""
    lines = result_lines(results, ts)
    if not lines.isEmpty():
        lines.write.mode("append").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)
