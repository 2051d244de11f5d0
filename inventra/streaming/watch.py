"""Watching trees: changes are held until a file is quiet, then only what changed
is scanned anew and compared with what its files held before.

A change is a row (root, path, mtime, content); null content is a deletion, and a
row without path a heartbeat that only moves time on.  State per file is what was
last told and what waits; a timer on event time lets it go.  The inventory is a log
of components by batch, in which a file's last batch counts; a batch that runs
twice writes the same, and every so often the log is written together and what it
replaces is removed."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inventra.functions.text import short_hash
from inventra.operators.compare import diff
from inventra.tables import removed

CHANGES = "root string, path string, mtime timestamp, content string"
_STATE = "mtime long, told string, waiting boolean, content string, ord long"
_HELD = "root string, path string, name string, component_type string, line int"


def read_changes(spark: SparkSession, folder: str, schema: str = CHANGES, most: int = 1000) -> DataFrame:
    """A stream of JSON lines with files that changed."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most).json(folder)


def latest(files: DataFrame) -> DataFrame:
    """The last version of each file."""
    return files.groupBy("root", "path").agg(F.max_by("content", "mtime").alias("content"), F.max("mtime").alias("mtime"))


def _digest(content: str | None) -> str:
    return "" if content is None else hashlib.sha256(content.encode()).hexdigest()


def _micros(t: pd.Timestamp) -> int:
    return t.value // 1000


def settled(changes: DataFrame, quiet: float = 0.5, late: float = 2.0) -> DataFrame:
    """The last version of each file that then stayed as it was for ``quiet``
    seconds, as rows of CHANGES.  Changes up to ``late`` seconds behind the newest
    are waited for; one that is older than its file's last is dropped, and so is a
    version that was told already.  Of equal times the one
    with the least ``ord`` counts where changes have that column, else the longest
    content, then the greatest, a deletion last."""
    wait = int(quiet * 1000)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        root, path = key
        mtime, told, waiting, content, ord_ = state.get if state.exists else (-(2**62), "none", False, None, None)
        if state.hasTimedOut:
            if waiting:
                yield pd.DataFrame({"root": [root], "path": [path], "mtime": [pd.Timestamp(mtime, unit="us")], "content": [content]})
                told = _digest(content)
            state.update((mtime, told, False, None, None))
            return
        for frame in frames:
            for at, new, n in zip(frame["mtime"], frame["content"], frame["ord"], strict=True):
                if path is None or pd.isna(at):
                    continue
                new = None if new is None or new is pd.NA else new
                n = None if pd.isna(n) else int(n)
                rank = lambda c, o: (o is not None, -(o or 0), c is not None, len(c or ""), c or "")
                if _micros(at) > mtime or (_micros(at) == mtime and waiting and rank(new, n) > rank(content, ord_)):
                    mtime, content, waiting, ord_ = _micros(at), new, _digest(new) != told, n
        if path is None or mtime == -(2**62):
            return
        state.update((mtime, told, waiting, content if waiting else None, ord_ if waiting else None))
        if waiting:
            state.setTimeoutTimestamp(max(mtime // 1000 + wait, state.getCurrentWatermarkMs() + 1))

    order = F.col("ord").cast("long") if "ord" in changes.columns else F.lit(None).cast("long").alias("ord")
    timed = changes.select("root", "path", "mtime", "content", order).withWatermark("mtime", f"{int(late * 1000)} milliseconds")
    return timed.groupBy("root", "path").applyInPandasWithState(run, CHANGES, _STATE, "append", "EventTimeTimeout")


class Inventory:
    """Components by file in the folder ``path``: one part for each batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _parts(self, before: int) -> list[tuple[int, str]]:
        """Batches whose part is whole, and its folder, from the last one on that
        holds all before it."""
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return []
        found = []
        for entry in files.listStatus(folder):
            kind, _, n = entry.getPath().getName().partition("-")
            if kind in ("log", "all") and int(n) < before and files.exists(jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS")):
                found.append((int(n), kind, entry.getPath().toString()))
        start = max((n for n, kind, _ in found if kind == "all"), default=-1)
        return [(n, place) for n, kind, place in sorted(found) if n > start or (n == start and kind == "all")]

    def current(self, before: int = 2**31) -> DataFrame:
        """root, path, name, component_type, line: what the last batch of each file
        before this one told."""
        rows = self.spark.createDataFrame([], f"{_HELD}, batch int")
        for n, place in self._parts(before):
            rows = rows.unionByName(self.spark.read.schema(_HELD).parquet(place).withColumn("batch", F.lit(n)))
        last = rows.groupBy("root", "path").agg(F.max("batch").alias("batch"))
        return rows.join(last, ["root", "path", "batch"]).drop("batch").where("name is not null")

    def add(self, changed: DataFrame, components: DataFrame, batch: int) -> DataFrame:
        """Keeps the components of the files that changed and gives what was added
        or removed in them."""
        files = changed.select("root", "path").distinct()
        empty = files.select("root", "path", *(F.lit(None).cast(kind).alias(c) for c, kind in (x.split() for x in _HELD.split(", ")[2:])))
        place = f"{self.path}/log-{batch}"
        components.select("root", "path", "name", "component_type", F.col("line").cast("int").alias("line")).unionByName(empty).write.mode("overwrite").parquet(place)
        old = self.current(batch).join(files, ["root", "path"], "left_semi")
        new = self.spark.read.schema(_HELD).parquet(place).where("name is not null")
        shape = lambda df: df.withColumn("ord", F.col("line"))
        return diff(shape(old), shape(new), ["root", "path", "name", "component_type"], ["line"]).where("change in ('added', 'removed')")

    def compact(self, batch: int) -> None:
        """Writes all parts up to a batch together and removes them."""
        parts = self._parts(batch + 1)
        self.current(batch + 1).write.mode("overwrite").parquet(f"{self.path}/all-{batch}")
        for _, place in parts:
            removed(self.spark, place)


def watch(changes: DataFrame, state: str, scan: Callable[[DataFrame], DataFrame], told: Callable[[DataFrame, int], None], checkpoint: str, quiet: float | None = None, late: float = 2.0, every: int = 20):
    """Scans files that changed, hands ``told(changes, batch)`` the components that
    were added or removed, and keeps the inventory in ``state``.  With ``quiet`` a
    file is scanned once it has settled, else in the batch that brings it."""

    def batch(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        place = f"{state}/changed"
        df.write.mode("overwrite").parquet(place)
        changed = latest(spark.read.schema(df.schema).parquet(place).where("path is not null"))
        if changed.isEmpty():
            return
        inventory = Inventory(spark, f"{state}/components")
        told(inventory.add(changed, scan(changed.where("content is not null")), n), n)
        if n and n % every == 0:
            inventory.compact(n)

    rows = changes if quiet is None else settled(changes, quiet, late)
    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def misses(repos: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Repositories whose head isn't in the snapshot table; without a head
    (no version control) a repository is always scanned again."""
    keyed = repos.withColumn("key", short_hash(F.col("path"), 24))
    return keyed.join(snapshots.select("key", "sha").distinct(), ["key", "sha"], "left_anti")


def scan_key(path, sha, mtimes, settings):
    """The cache key of a scan: version or times of change, and settings."""
    return short_hash(F.concat_ws("|", path, F.coalesce(sha, mtimes), settings), 32)
