"""Anchored time-to-live on a stream: the state per URL is one anchor and the answer given then.

Requests are packed before the shuffle: a task sends one row per URL and pack,
whose other columns are lists in order of time. A URL is then walked pack by pack
with binary searches, its requests are never held as rows of their own in Python,
and what depends on the URL alone is computed once per pack.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from urlrisk.schema import CACHE_TTL_SECONDS

# An anchor is kept this long after the last request of its URL has arrived.
KEEP_SECONDS = 24 * 3600
# Rows that never are fresh need no order and no state; they are dealt by event.
_LOOSE_PARTS = 1024
# Requests that a task gathers to pack those of a URL.
PACK_ROWS = 1 << 17


def flag_fresh(
    requests: DataFrame,
    ttl_seconds: int = CACHE_TTL_SECONDS,
    keep_seconds: int = KEEP_SECONDS,
    answer: Sequence[str] = (),
    scored: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Every request with ``fresh``: it is answered and logged, or gets the answer stored for its URL.

    The columns named by ``answer`` hold what the row would be answered with. A
    fresh row keeps them and they are stored with its anchor; every other row gets
    the stored ones, those of the request it repeats, whatever has changed since:
    a new model answers only what is fresh. A row that is late and older than the
    anchor gets the anchor's answer too. Rows that never are fresh keep their own.
    Where the answer follows from the URL alone, ``scored`` adds its columns to
    rows that have a ``url``, and is asked once for each URL of a pack.

    ``requests`` is a stream without a watermark; a stream may have one only.
    No row is left out, however late: a request older than the anchor counts as
    repeated and does not move it. Rows without a URL or a time are not fresh and
    leave no state. Anchors are forgotten by arrival, not by event time:
    ``keep_seconds`` (at least the time to live) after the last request of the URL.
    The packs of a URL in one micro-batch are held in memory, some bytes a row, so
    the source's ``maxBytesPerTrigger`` bounds them.
    """
    ttl = ttl_seconds * 1_000_000
    keep = max(keep_seconds, ttl_seconds) * 1_000
    answer = list(answer)
    packed, lists = _pack(requests, () if scored else answer)
    if scored:
        packed = scored(packed).select(*packed.columns, *answer)
    # The watermark is on the arrival, which no row can be late for.
    keyed = (
        packed.withColumn("_arrived", F.current_timestamp())
        .withWatermark("_arrived", "1 second")
        .withColumn("_arrived_ms", F.unix_millis("_arrived"))
    )
    answers = [packed.schema[name] for name in answer]
    names = ["url", *lists, "_fresh", "_unanswered", *answer]
    flags = [T.StructField("_fresh", T.ArrayType(T.BooleanType())), T.StructField("_unanswered", T.ArrayType(T.LongType()))]
    listed = [T.StructField(field.name, T.ArrayType(field.dataType)) for field in answers]
    out = T.StructType([packed.schema["url"], *(packed.schema[name] for name in lists), *flags, *listed])
    stored = T.StructType([T.StructField("anchor", T.LongType()), *answers])
    plain = [_plain(field.dataType) for field in answers]
    no_id = 1 << requests.columns.index("event_id")

    def answered(packs: dict, held: list[tuple], spans: list[np.ndarray], fresh: list[tuple[int, int]]) -> pd.DataFrame:
        """The packs with the answers held at each of their rows, by number."""
        flagged = [np.zeros(len(span), bool) for span in spans]
        for pack, at in fresh:
            flagged[pack][at] = True
        missing = np.array([sum((v is None) << k for k, v in enumerate(values)) for values in held], np.int64)
        columns = {name: packs[name] for name in ("url", *lists)}
        columns |= {"_fresh": flagged, "_unanswered": [missing[span] for span in spans]}
        for name, make, column in zip(answer, plain, zip(*held, strict=True), strict=True):
            # Lists of numbers have no nulls in Python.
            kind = make if make in (int, float, bool) else object
            values = np.array([make() if v is None and kind is not object else v for v in column], kind)
            columns[name] = [values[span] for span in spans]
        return pd.DataFrame({name: pd.Series(values, dtype=object) for name, values in columns.items()})[names]

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        if key[1] >= 0:
            for batch in batches:
                packs, given = _columns([batch], answer, plain)
                yield answered(packs, given, [np.full(len(t), k) for k, t in enumerate(packs["_micros"])], [])
            return
        packs, given = _columns(batches, answer, plain)
        times = packs["_micros"]
        anchor = state.get[0] if state.exists else None
        last = tuple(state.get[1:]) if state.exists else (None,) * len(answer)
        fresh = fresh_in_packs(times, packs["event_id"], [n & no_id for n in packs["_nulls"]], ttl, anchor)
        # From each fresh request to the next its answer holds; before the first one, the stored answer.
        begins = np.array([times[pack][at] for pack, at in fresh], np.int64)
        held = [last, *(given[pack] for pack, _ in fresh)]
        state.update((int(begins[-1]) if fresh else anchor, *held[-1]))
        expiry = int(max(packs["_arrived_ms"])) + keep
        state.setTimeoutTimestamp(max(expiry, state.getCurrentWatermarkMs() + 1))
        yield answered(packs, held, [np.searchsorted(begins, t, "right") for t in times], fresh)

    flagged = keyed.groupBy("url", "_part").applyInPandasWithState(
        update, out, stored, "append", GroupStateTimeout.EventTimeTimeout
    )
    flat = flagged.select("url", F.inline(F.arrays_zip(*lists, "_fresh", "_unanswered", *answer)))
    kept = [name if name in ("url", *answer) else _restored(requests, name) for name in requests.columns]
    for k, name in enumerate(answer):
        flat = flat.withColumn(name, F.when(F.col("_unanswered").bitwiseAND(F.lit(1 << k)) == 0, F.col(name)))
    return flat.select(*kept, *(answer if scored else []), F.col("_fresh").alias("fresh"))


def _columns(batches: Iterable[pd.DataFrame], answer: Sequence[str], plain: Sequence[Callable]) -> tuple[dict, list[tuple]]:
    """The columns of some packs as lists, and what each pack would be answered with."""
    columns: dict[str, list] = {}
    for batch in batches:
        for name in batch.columns:
            columns.setdefault(name, []).extend(batch[name].tolist())
    given = [
        tuple(None if pd.isna(v) else make(v) for v, make in zip(values, plain, strict=True))
        for values in zip(*(columns[name] for name in answer), strict=True)
    ]
    return columns, given or [()] * len(columns["_micros"])


def fresh_in_packs(
    times: Sequence[np.ndarray], ids: Sequence[np.ndarray], no_ids: Sequence[np.ndarray], ttl: int, anchor: int | None
) -> list[tuple[int, int]]:
    """Pack and position of each fresh request of a URL, in order, by binary search in all packs.

    A pack is in order of time, then id, requests without an id last; the next
    fresh request is the first of all packs at or after the end of the time to live.
    """
    heads: list[tuple] = []

    def push(pack: int, at: int) -> None:
        if at < len(times[pack]):
            heapq.heappush(heads, (int(times[pack][at]), bool(no_ids[pack][at]), ids[pack][at], pack, at))

    def ahead(pack: int, at: int) -> int:
        return at + int(np.searchsorted(times[pack][at:], until))

    until = None if anchor is None else anchor + ttl
    for pack in range(len(times)):
        push(pack, 0 if until is None else ahead(pack, 0))
    fresh = []
    while heads:
        time, _, _, pack, at = heapq.heappop(heads)
        if until is None or time >= until:
            fresh.append((pack, at))
            until = time + ttl
            at += 1
        push(pack, ahead(pack, at))
    return fresh


def _pack(requests: DataFrame, with_key: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Requests as one row per URL and pack, and the names of the lists in it; rows of a pack agree in ``with_key``."""
    usable = F.col("ts").isNotNull() & (F.coalesce("url", F.lit("")) != "")
    keys = ["url", "_part", *with_key]
    payload = [name for name in requests.columns if name not in ("url", "ts", *with_key)]
    # Lists of numbers have no nulls in Python: bit k of a row is set where its column k is null.
    bits = [F.when(F.col(name).isNull(), 1 << k).otherwise(0).cast("long") for k, name in enumerate(requests.columns)]
    coded = requests.select(
        "url",
        F.when(usable, -1).otherwise(F.pmod(F.xxhash64("event_id"), F.lit(_LOOSE_PARTS))).cast("long").alias("_part"),
        *with_key,
        F.coalesce(F.unix_micros("ts"), F.lit(0)).alias("_micros"),
        sum(bits[1:], bits[0]).alias("_nulls"),
        *[_coded(requests, name).alias(name) for name in payload],
    )
    lists = ["_micros", "_nulls", *payload]
    schema = T.StructType(
        [coded.schema[name] if name in keys else T.StructField(name, T.ArrayType(coded.schema[name].dataType)) for name in [*keys, *lists]]
    )
    no_id, most = 1 << requests.columns.index("event_id"), PACK_ROWS

    def packs(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        order = {}
        for name in keys:
            codes = rows.column(name).combine_chunks().dictionary_encode().indices.fill_null(-1)
            order[f"_code_{name}"] = codes
        order["_micros"] = rows.column("_micros")
        order["_no_id"] = pc.bit_wise_and(rows.column("_nulls"), no_id)
        order["event_id"] = rows.column("event_id")
        order = pa.table(order)
        indices = pc.sort_indices(order, sort_keys=[(name, "ascending") for name in order.column_names])
        rows = rows.take(indices).combine_chunks()
        changes = np.zeros(len(rows) - 1, bool)
        for name in keys:
            codes = order.column(f"_code_{name}").take(indices).to_numpy()
            changes |= codes[1:] != codes[:-1]
        begins = np.concatenate([[0], np.flatnonzero(changes) + 1])
        offsets = pa.array(np.append(begins, len(rows)), pa.int32())
        firsts = rows.select(keys).take(pa.array(begins))
        columns = [firsts.column(name).combine_chunks() for name in keys]
        columns += [pa.ListArray.from_arrays(offsets, rows.column(name).combine_chunks()) for name in lists]
        return pa.RecordBatch.from_arrays(columns, [*keys, *lists])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= most:
                yield packs(held)
                held, n = [], 0
        if held:
            yield packs(held)

    return coded.mapInArrow(pack, schema), lists


def _coded(requests: DataFrame, name: str) -> Column:
    """A column without nulls, where its type has a value to stand for them."""
    kind, column = requests.schema[name].dataType, F.col(name)
    if isinstance(kind, T.TimestampType):
        return F.coalesce(F.unix_micros(column), F.lit(0))
    if isinstance(kind, (T.NumericType, T.BooleanType)) and not isinstance(kind, T.DecimalType):
        return F.coalesce(column, F.lit(0).cast(kind))
    return F.coalesce(column, F.lit("")) if isinstance(kind, T.StringType) else column


def _restored(requests: DataFrame, name: str) -> Column:
    value = F.col("_micros" if name == "ts" else name)
    if isinstance(requests.schema[name].dataType, T.TimestampType):
        value = F.timestamp_micros(value)
    bit = F.lit(1 << requests.columns.index(name))
    return F.when(F.col("_nulls").bitwiseAND(bit) == 0, value).alias(name)


def _plain(kind: T.DataType) -> Callable:
    """What makes a value of pandas one of Python again; a column of integers with nulls holds floats there."""
    if isinstance(kind, T.IntegralType):
        return int
    return {T.DoubleType(): float, T.FloatType(): float, T.BooleanType(): bool}.get(kind, lambda value: value)
