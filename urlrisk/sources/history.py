"""Sets of keys that only grow, bucketed by key: joins read them without a shuffle.

A history holds one row per key, with the run that added it. Its files are
bucketed and sorted by the key, so an anti or semi join against it shuffles the
new keys alone, however long the history is. A run adds the keys the history
lacks; repeated it adds nothing. ``compact`` rewrites the files of many runs as
one per bucket, as a new version behind a manifest.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlrisk.sources import manifest

# Runs whose files lie side by side in a bucket before they are merged.
RUNS = 50


class History:
    """The history at ``root``. A new one gets ``buckets``, about one per 128 MB of keys, or else the shuffle partitions."""

    def __init__(self, spark: SparkSession, root: str, key: str, buckets: int | None = None):
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.spark, self.root, self.key = spark, root.rstrip("/"), key
        self.new = {"key": key, "buckets": buckets, "folder": f"data/{uuid.uuid4().hex}", "runs": []}

    def _state(self) -> dict:
        state = manifest.load(self.spark, self.root)[1]
        if state and state["key"] != self.key:
            raise ValueError(f"{self.root} is a history of {state['key']}")
        return state

    def _table(self, state: dict, folder: str) -> str:
        """Name of a session table over the files of one version."""
        name = f"history_{uuid.uuid4().hex}"
        self.spark.sql(
            f"CREATE TABLE {name} ({self.key} STRING, run STRING) USING parquet "
            f"CLUSTERED BY ({self.key}) SORTED BY ({self.key}) INTO {state['buckets']} BUCKETS "
            f"LOCATION '{self.root}/{folder}'"
        )
        return name

    def exists(self) -> bool:
        return bool(self._state())

    def read(self) -> DataFrame:
        """``(key, run)``: every key and the run that added it."""
        state = self._state()
        if not state:
            return self.spark.createDataFrame([], f"{self.key} string, run string")
        return self.spark.table(self._table(state, state["folder"]))

    def lacking(self, keys: DataFrame) -> DataFrame:
        """Rows of ``keys`` whose key the history does not hold."""
        return keys.join(self.read().select(self.key), self.key, "left_anti")

    def add(self, keys: DataFrame, run: str) -> None:
        """Add the distinct keys that are not there yet, as found by ``run``; null is no key.

        One job at a time adds to a history. A run that was lost half way leaves
        nothing; one that is repeated adds what it has not added.
        """
        state = self._state() or manifest.commit(self.spark, self.root, lambda state: state or self.new)
        fresh = self.lacking(keys.select(self.key).filter(F.col(self.key).isNotNull()).distinct())
        rows = fresh.select(self.key, F.lit(run).alias("run")).repartition(state["buckets"], self.key)
        rows.write.insertInto(self._table(state, state["folder"]))

        def note(state: dict) -> dict:
            state["runs"].append(run)
            return state

        if len(manifest.commit(self.spark, self.root, note)["runs"]) >= RUNS:
            self.compact()

    def compact(self) -> None:
        """One file per bucket again."""
        state = self._state()
        folder = f"data/{uuid.uuid4().hex}"
        rows = self.read().repartition(state["buckets"], self.key)
        rows.write.insertInto(self._table(state, folder))

        def swap(now: dict) -> dict | None:
            return None if now["folder"] != state["folder"] else {**now, "folder": folder, "runs": now["runs"][-1:]}

        manifest.commit(self.spark, self.root, swap)
