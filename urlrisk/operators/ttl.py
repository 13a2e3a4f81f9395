"""Anchored time-to-live: which requests are first sights, which reuse an answer.

The first request of a URL is fresh. A later one is fresh if it comes at least
``ttl`` after the last fresh one; the ones in between neither count nor extend
the time.

A request that comes ``ttl`` or more after the one before it is fresh whatever
the anchor was, so such gaps cut the requests of a URL into independent runs.
Only the requests of a run that lie ``ttl`` or more behind its first one depend
on a chain of anchors, which is followed in one of two ways:

* ordinary URLs: each task walks once through its sorted share, holding one anchor;
* hot URLs (see :mod:`urlrisk.operators.skew`): every request gets a pointer to
  the request that would be fresh after it, and the chain is followed with
  pointers of doubling length. The pointer is a search for the next request at
  or after a time: inside a cell of time that holds few requests, else through
  the cells around it, level by level, ``FAN`` cells at a time. No task sees
  more than a few cells of a URL, however densely its requests lie.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urlrisk.operators.dedupe import keep_first
from urlrisk.operators.skew import hot_keys
from urlrisk.schema import CACHE_TTL_SECONDS
from urlrisk.session import materialize

# A URL with more requests than this (and the share of a hot key) is not walked in one task.
# The walk holds one anchor, not the rows, and does about this many in a minute.
WALK_ROWS = 10_000_000
# Distinct times of a hot URL in one cell, unless the cell is a microsecond long.
CELL_ROWS = 50_000
# Cells that make one cell of the next level, as a power of two.
FAN_BITS = 6
# Cells of the top level, all in one window of a URL.
TOP_CELLS = 1 << 14


def first_seen(
    requests: DataFrame, ttl_seconds: int = CACHE_TTL_SECONDS, rows_per_task: int = WALK_ROWS, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """The fresh rows of ``requests(event_id, ts, url, ...)``; ties go to the lower id.

    A row without a URL or a time is never fresh, whatever the number of such rows.
    """
    requests = requests.filter("ts IS NOT NULL AND url IS NOT NULL")
    hot = hot_keys(requests, "url", rows_per_task)
    if hot.isEmpty():
        return _walk(requests, ttl_seconds)
    keyed = requests.withColumn("_key", F.xxhash64("url"))
    hot = F.broadcast(hot.select("_key"))
    cold_rows = keyed.join(hot, "_key", "left_anti").drop("_key")
    hot_rows = keyed.join(hot, "_key", "left_semi").drop("_key")
    return _walk(cold_rows, ttl_seconds).unionByName(_jump(hot_rows, ttl_seconds, cell_rows))


def fresh_positions(times: list[int], ttl: int, anchor: int | None) -> tuple[list[int], int | None]:
    """Where one URL's ascending times are fresh, and the anchor after them.

    Moves from one fresh request to the next by binary search.
    """
    fresh = []
    at = 0 if anchor is None else bisect_left(times, anchor + ttl)
    while at < len(times):
        fresh.append(at)
        anchor = times[at]
        at = bisect_left(times, anchor + ttl, at + 1)
    return fresh, anchor


def runs(requests: DataFrame, ttl_seconds: int = CACHE_TTL_SECONDS) -> DataFrame:
    """``requests`` with ``_micros``, ``_start`` of their run, ``_opens`` it, and ``_chained``: fresh or not by a chain."""
    ttl = ttl_seconds * 1_000_000
    order = Window.partitionBy("url").orderBy("_micros", "event_id")
    before = F.lag("_micros").over(order)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return (
        requests.withColumn("_micros", _micros())
        .withColumn("_opens", before.isNull() | (F.col("_micros") - before >= ttl))
        .withColumn("_start", F.last(F.when(F.col("_opens"), F.col("_micros")), ignorenulls=True).over(upto))
        .withColumn("_chained", ~F.col("_opens") & (F.col("_micros") >= F.col("_start") + ttl))
    )


def _walk(requests: DataFrame, ttl_seconds: int) -> DataFrame:
    ttl = ttl_seconds * 1_000_000
    columns = requests.columns
    cut = runs(requests, ttl_seconds)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The rows come sorted by URL and time, as the windows leave them.
        last, anchor = None, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            urls, starts = batch.column("url"), batch.column("_start").to_numpy()
            times = batch.column("_micros").to_pylist()
            changes = pc.not_equal(urls.slice(1), urls.slice(0, len(urls) - 1)).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(changes | (starts[1:] != starts[:-1])) + 1).tolist()]
            kept = []
            for begin, end in zip(edges, [*edges[1:], len(times)]):
                run = urls[begin].as_py(), int(starts[begin])
                fresh, anchor = fresh_positions(times[begin:end], ttl, anchor if run == last else run[1])
                kept.extend(begin + position for position in fresh)
                last = run
            yield batch.take(pa.array(kept, pa.int64())).select(columns)

    chained = cut.filter("_chained").sortWithinPartitions("url", "_micros", "event_id").mapInArrow(walk, requests.schema)
    return cut.filter("_opens").select(*columns).unionByName(chained)


def _micros():
    return F.unix_micros(F.col("ts").cast("timestamp"))


def _jump(requests: DataFrame, ttl_seconds: int, cell_rows: int) -> DataFrame:
    ttl = ttl_seconds * 1_000_000
    events = materialize(
        keep_first(requests.withColumn("_at", _micros()), key=("url", "_at"), order=("event_id",)), "hot-requests"
    )
    span = events.agg(F.min("_at"), F.max("_at")).first()
    width = cell_width(events, ttl, cell_rows)
    # Levels above the finest until the cells of a URL fit in one window.
    spare_bits = ((span[1] - span[0]) // width).bit_length() - (TOP_CELLS.bit_length() - 1) if span[0] is not None else 0
    top = max(0, -(-spare_bits // FAN_BITS))
    hops = materialize(_next_fresh(events.select("url", "_at"), ttl, width, top), "hops")
    longest_chain = (span[1] - span[0]) // ttl + 1 if span[0] is not None else 0

    # ``hops`` leads 2**step fresh requests ahead. A request of the chain is either
    # within that distance of the first one, hence in ``reached``, or the end of
    # some hop; all others are dropped, which shortens the table in every round.
    reached = events.groupBy("url").agg(F.min("_at").alias("_at"))
    for step in range(int(longest_chain).bit_length()):
        ahead = reached.join(hops, ["url", "_at"]).select("url", F.col("_next").alias("_at"))
        ends = hops.select("url", F.col("_next").alias("_at")).distinct()
        starts = hops.join(ends.unionByName(reached), ["url", "_at"], "left_semi")
        starts = materialize(starts, f"starts-{step}")
        reached = materialize(reached.unionByName(ahead), f"reached-{step}")
        further = starts.select("url", F.col("_at").alias("_next"), F.col("_next").alias("_next2"))
        hops = materialize(
            starts.join(further, ["url", "_next"]).select("url", "_at", F.col("_next2").alias("_next")),
            f"hops-{step}",
        )
    return events.join(reached, ["url", "_at"], "left_semi").select(*requests.columns)


def cell_width(events: DataFrame, ttl: int, cell_rows: int) -> int:
    """Microseconds of a cell such that none holds more than ``cell_rows`` of the events, or one microsecond."""
    width = ttl
    while width > 1:
        cells = events.groupBy("url", F.floor(F.col("_at") / width)).agg(F.count(F.lit(1)).alias("n"))
        if (cells.agg(F.max("n")).first()[0] or 0) <= cell_rows:
            break
        width = max(1, width >> FAN_BITS)
    return width


def _next_fresh(events: DataFrame, ttl: int, width: int, top: int) -> DataFrame:
    """``(url, _at, _next)``: the first request at or after ``_at + ttl``."""
    cell = F.floor(F.col("_time") / width)
    marks = events.select("url", F.col("_at").alias("_time"), F.lit(0).alias("_probe"))
    probes = events.select("url", (F.col("_at") + ttl).alias("_time"), F.lit(1).alias("_probe"))
    both = marks.unionByName(probes).withColumn("_cell", cell)
    later = Window.partitionBy("url", "_cell").orderBy(F.desc("_time"), "_probe").rowsBetween(Window.unboundedPreceding, 0)
    in_cell = (
        both.withColumn("_next", F.min(F.when(F.col("_probe") == 0, F.col("_time"))).over(later))
        .filter("_probe = 1")
        .select("url", "_cell", (F.col("_time") - ttl).alias("_at"), "_next")
    )
    # Cells by level, the first request in each; one that only probes fall into has none.
    levels = [both.groupBy("url", "_cell").agg(F.min(F.when(F.col("_probe") == 0, F.col("_time"))).alias("_first"))]
    for _ in range(top):
        upper = levels[-1].groupBy("url", F.shiftright("_cell", FAN_BITS).alias("_cell"))
        levels.append(upper.agg(F.min("_first").alias("_first")))

    def following(*group):
        return Window.partitionBy(*group).orderBy("_cell").rowsBetween(1, Window.unboundedFollowing)

    behind = F.first("_first", ignorenulls=True)
    after = levels[-1].select("url", "_cell", behind.over(following("url")).alias("_after"))
    for level in levels[-2::-1]:
        inner = level.withColumn("_upper", F.shiftright("_cell", FAN_BITS))
        inner = inner.withColumn("_beside", behind.over(following("url", "_upper")))
        outer = after.select("url", F.col("_cell").alias("_upper"), "_after")
        after = inner.join(outer, ["url", "_upper"]).select("url", "_cell", F.coalesce("_beside", "_after").alias("_after"))
    return (
        in_cell.join(after, ["url", "_cell"])
        .select("url", "_at", F.coalesce("_next", "_after").alias("_next"))
        .filter("_next IS NOT NULL")
    )
