"""All-or-nothing publishing: versions of a table, each a small manifest.

Rows lie in date folders that are written once and never changed.  A manifest names the folder
that holds each date.  It is written aside and then renamed to its version's number, which
succeeds for one writer only, so readers see all of a version or none of it.  A writer that finds
its number taken looks at what came in between: if others changed other dates it goes on from
theirs, else it merges its batch again.  The file system's rename of a folder must be atomic, as
it is on HDFS and on POSIX file systems.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.buckets import as_list
from ..operators.patch import collapse_batch
from ..session import materialize
from ..sources.store import DATE
from ..sources.tables import nan_to_null
from .store import UpsertResult, upsert_frame

WIDTH = 12  # digits of a version in its file name
ATTEMPTS = 50


class Conflict(RuntimeError):
    """Another writer changed the same dates too often."""


@dataclass(frozen=True)
class Version:
    number: int
    dates: dict[str, str] = field(default_factory=dict)  # date -> commit that holds it
    parent: int = 0
    batches: dict[str, int] = field(default_factory=dict)  # stream -> its last batch in here

    def text(self) -> str:
        return json.dumps({"dates": self.dates, "parent": self.parent, "batches": self.batches})


def _folder(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    return fs, path


def _text(spark: SparkSession, fs, path) -> str:
    stream = fs.open(path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _take(spark: SparkSession, folder: str, name: str, text: str) -> bool:
    """Puts `text` at folder/name, whole and only if nobody else has: a folder that holds it is
    renamed, which leaves a folder of that name as it is; what lies there then tells who was first."""
    fs, path = _folder(spark, folder)
    aside, place = path.suffix(f"/_{uuid.uuid4().hex}"), path.suffix(f"/{name}")
    if fs.exists(place):
        return False
    owner = aside.getName()
    out = fs.create(aside.suffix("/text"), False)
    out.writeBytes(f"{owner}\n{text}")
    out.close()
    try:
        fs.rename(aside, place)
    except Py4JJavaError:  # some file systems refuse, others move the folder into the other one
        if not fs.exists(place):
            raise
    return _text(spark, fs, place.suffix("/text")).startswith(owner)


def claim_number(spark: SparkSession, folder: str, least: int = 1) -> int:
    """A number from `least` on that no other call has got or will get."""
    number = least
    while not _take(spark, folder, str(number), ""):
        number += 1
    return number


class VersionedTable:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _numbers(self) -> list[int]:
        fs, path = _folder(self.spark, f"{self.root}/versions")
        names = [f.getPath().getName() for f in fs.listStatus(path)]
        return sorted((int(n) for n in names if n.isdigit()), reverse=True)

    def _load(self, number: int) -> Version:
        fs, path = _folder(self.spark, f"{self.root}/versions")
        found = json.loads(_text(self.spark, fs, path.suffix(f"/{number:0{WIDTH}d}/text")).split("\n", 1)[1])
        return Version(number, found["dates"], found["parent"], found["batches"])

    def version(self, number: int | None = None) -> Version:
        """The latest version, or the one of that number; 0 is the empty table."""
        numbers = self._numbers()
        if number in numbers or number is None and numbers:
            return self._load(numbers[0] if number is None else number)
        if number:
            raise ValueError(f"no version {number}")
        return Version(0)

    def read(self, version: Version | int | None = None) -> DataFrame | None:
        """The rows of a version with their date; None for an empty table.  Columns that only later
        commits have are null in earlier rows."""
        at = version if isinstance(version, Version) else self.version(version)
        return self._rows(at, at.dates)

    def _rows(self, at: Version, dates) -> DataFrame | None:
        paths = [f"{self.root}/data/commit={at.dates[d]}/{DATE}={d}" for d in dates if d in at.dates]
        if not paths:
            return None
        rows = self.spark.read.option("basePath", f"{self.root}/data").option("mergeSchema", "true").parquet(*paths)
        return nan_to_null(rows.drop("commit")).withColumn(DATE, F.col(DATE).cast("date"))

    def _publish(self, made: Version) -> bool:
        """Whether the manifest got its number."""
        return _take(self.spark, f"{self.root}/versions", f"{made.number:0{WIDTH}d}", made.text())

    def upsert(
        self,
        batch: DataFrame,
        keys: str | Sequence[str] = "ts",
        *,
        ts: str = "ts",
        order: str | None = None,
        null_policy: str = "skip",
        default=None,
        stream: str | None = None,
        batch_id: int | None = None,
    ) -> UpsertResult:
        """Merge a batch (see `store.upsert`) as one new version.

        With `stream` and `batch_id` a batch that a version already holds is not merged again, so a
        replayed micro-batch changes nothing, whatever its null policy.
        """
        keys = as_list(keys)
        if ts not in keys:
            raise ValueError("the time stamp decides the date, so it belongs to the keys")
        batch = materialize(collapse_batch(batch, keys, order, null_policy).withColumn(DATE, F.to_date(ts)), "batch")
        touched = sorted(str(r[DATE]) for r in batch.select(DATE).distinct().collect())  # bounded by the calendar
        if not touched:
            return UpsertResult(0, 0)
        merged_from: Version | None = None
        commit = counts = None
        for _ in range(ATTEMPTS):
            at = self.version()
            if stream is not None and at.batches.get(stream, -1) >= batch_id:
                return UpsertResult(0, 0)
            if merged_from is None or any(at.dates.get(d) != merged_from.dates.get(d) for d in touched):
                commit, counts = self._merge(at, batch, touched, keys, ts, null_policy, default)
                merged_from = at
            batches = at.batches if stream is None else {**at.batches, stream: batch_id}
            made = Version(at.number + 1, {**at.dates, **dict.fromkeys(touched, commit)}, at.number, batches)
            if self._publish(made):
                return UpsertResult(counts.get("inserted", 0), counts.get("updated", 0))
        raise Conflict(f"{len(touched)} dates of {self.root} kept changing")

    def _merge(self, at: Version, batch: DataFrame, touched: list[str], keys: list[str], ts: str, null_policy: str, default) -> tuple[str, dict[str, int]]:
        """Writes the touched dates with the batch applied; nothing refers to them yet."""
        old = self._rows(at, touched)
        if old is None:
            old = self.spark.createDataFrame([], batch.schema)
        merged = upsert_frame(old.drop(DATE), batch.drop(DATE), keys, null_policy=null_policy, default=default)
        merged = merged.withColumn(DATE, F.to_date(ts))
        commit = uuid.uuid4().hex
        spread = F.pmod(F.xxhash64(*keys), F.lit(4))
        path = f"{self.root}/data/commit={commit}"
        staged = materialize(merged, "version")
        staged.drop("_change").withColumn("_spread", spread).hint("rebalance", DATE, "_spread").drop("_spread").write.mode("error").partitionBy(DATE).parquet(path)
        return commit, {r["_change"]: r["n"] for r in staged.groupBy("_change").agg(F.count(F.lit(1)).alias("n")).collect()}
