"""The state of a table as numbered files, each replaced by the next in one conditional step.

Writing is optimistic: a change is made to the state last seen and committed
under the next number, which succeeds for one writer only; the others see the
new state and make their change again. Reading and committing look at a handful
of files however long the table has lived.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

FOLDER = "_manifests"
# Earlier states that are kept for readers which began with them.
KEPT = 20
TRIES = 50


def _hadoop(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def load(spark: SparkSession, root: str) -> tuple[int, dict]:
    """Number and content of the latest state; ``(-1, {})`` before the first commit."""
    folder, files = _hadoop(spark, f"{root}/{FOLDER}")
    while files.exists(folder):
        names = [status.getPath().getName() for status in files.listStatus(folder)]
        numbers = [int(name.removesuffix(".json")) for name in names if name.endswith(".json") and name[0] != "."]
        if not numbers:
            break
        path, _ = _hadoop(spark, f"{root}/{FOLDER}/{max(numbers):012d}.json")
        if not files.exists(path):
            continue  # replaced and cleared meanwhile
        stream = files.open(path)
        try:
            text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return max(numbers), json.loads(text)
    return -1, {}


def _publish(spark: SparkSession, root: str, number: int, state: dict) -> bool:
    """Write state ``number`` unless there is one; whether it was this call that did."""
    draft, files = _hadoop(spark, f"{root}/{FOLDER}/.{uuid.uuid4().hex}")
    final, _ = _hadoop(spark, f"{root}/{FOLDER}/{number:012d}.json")
    stream = files.create(draft, False)
    try:
        stream.write(bytearray(json.dumps(state).encode()))
    finally:
        stream.close()
    jvm = spark._jvm
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(files.makeQualified(draft), files.makeQualified(final), how)
    except Exception as error:
        if not files.exists(final):
            raise
        del error
        files.delete(draft, False)
        return False
    old, _ = _hadoop(spark, f"{root}/{FOLDER}/{number - KEPT:012d}.json")
    if number >= KEPT and files.exists(old):
        files.delete(old, False)
    return True


def commit(spark: SparkSession, root: str, change: Callable[[dict], dict | None]) -> dict:
    """Apply ``change`` to the latest state and publish the result; None leaves the state as it is."""
    for _ in range(TRIES):
        number, state = load(spark, root)
        changed = change(json.loads(json.dumps(state)))
        if changed is None:
            return state
        if _publish(spark, root, number + 1, changed):
            return changed
    raise RuntimeError(f"{root}: {TRIES} commits by other writers in a row")
