"""The archive on storage.

Three folders under one root.  A snapshot writes its prediction rows first and its run row
last; readers join through the runs, so an unfinished snapshot is invisible.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import check_identifier
from ..operators.archive import SCHEMA_VERSION, actual_rows, manifest, schema_gap
from ..operators.quality import QualityError, require_columns, require_empty, require_storable, snapshot_violations
from ..session import materialize
from .store import _exists, upsert
from .versions import claim_number

RUNS_SCHEMA = "run_id long, run_datetime timestamp, schema_version int, columns_json string"


class Archive:
    def __init__(self, spark: SparkSession, root: str, price: str = "actual", predicted: str = "predicted"):
        self.spark, self.root = spark, root.rstrip("/")
        self.price, self.predicted = price, predicted

    def _path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def runs(self) -> DataFrame:
        if not _exists(self.spark, self._path("runs")):
            return self.spark.createDataFrame([], RUNS_SCHEMA)
        return self.spark.read.schema(RUNS_SCHEMA).parquet(self._path("runs")).drop("run")

    def predictions(self) -> DataFrame:
        """Rows of published runs; columns added by later runs are null in earlier ones."""
        rows = self.spark.read.option("mergeSchema", "true").parquet(self._path("predictions"))
        rows = rows.withColumn("run_id", F.col("run_id").cast("long"))
        return rows.join(self.runs().select("run_id"), "run_id", "left_semi")

    def actuals(self) -> DataFrame:
        return self.spark.read.parquet(self._path("actuals")).drop("date")

    def insert_snapshot(self, df: DataFrame, run_datetime: datetime | None = None, ts: str = "ts") -> int:
        """Archive one run; returns its id.  Refuses empty snapshots, missing timestamps or
        predictions, repeated timestamps and nested columns, before anything is written."""
        require_columns(df, [ts, self.predicted])
        require_storable(df)
        for c in df.columns:
            check_identifier(c)
        staged = materialize(df, "snapshot")
        require_empty(snapshot_violations(staged, ts, [self.predicted]), "invalid snapshot")
        expected = staged.count()
        at = (run_datetime or datetime.now(timezone.utc)).astimezone(timezone.utc).replace(tzinfo=None)
        # Two writers never get one id; one that is left by a failed snapshot stays unused.
        least = 1 + max(self.runs().agg(F.max("run_id")).first()[0] or 0, self._last_folder())
        run_id = claim_number(self.spark, self._path("claims"), least)
        # A folder of its own: jobs that write under one root would clear each other's temporary files.
        staged.write.mode("error").parquet(f"{self._path('predictions')}/run_id={run_id}")
        written = self.spark.read.parquet(f"{self._path('predictions')}/run_id={run_id}").count()
        if written != expected:
            raise QualityError(f"archived {written} of {expected} rows")
        if self.price in staged.columns:
            self._upsert_actuals(actual_rows(staged, self.price, F.lit(at).cast("timestamp"), f"run {run_id}", ts))
        run = self.spark.createDataFrame([(run_id, at, SCHEMA_VERSION, manifest(df.columns))], "run_id long, run_datetime timestamp_ntz, schema_version int, columns_json string")
        run.withColumn("run_datetime", F.col("run_datetime").cast("timestamp")).write.mode("error").parquet(f"{self._path('runs')}/run={run_id}")
        return run_id

    def _last_folder(self) -> int:
        """Largest run number among the folders of predictions; no rows are read."""
        if not _exists(self.spark, self._path("predictions")):
            return 0
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path("predictions"))
        listed = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path)
        names = [f.getPath().getName() for f in listed]
        return max((int(n.removeprefix("run_id=")) for n in names if n.startswith("run_id=")), default=0)

    def _upsert_actuals(self, rows: DataFrame) -> None:
        upsert(self.spark, self._path("actuals"), rows, "ts")

    def sync_actuals(self, store: DataFrame, price: str, updated_at: datetime, source: str = "store", ts: str = "ts") -> None:
        """Canonical prices from the store; a failure here leaves the runs as they are."""
        self._upsert_actuals(actual_rows(store, price, F.lit(updated_at).cast("timestamp"), source, ts))

    def migrate(self, source: DataFrame, columns: Sequence[str] | None = None, *, dry_run: bool = False) -> dict:
        """Report, and add, columns the archive lacks.  Adding is an empty append in the
        wider schema; merged reads then show the column.  Repeating it changes nothing."""
        rows = self.spark.read.option("mergeSchema", "true").parquet(self._path("predictions"))
        wanted = source.select(*columns) if columns else source
        gap = schema_gap(rows, require_storable(wanted))
        report = {"dry_run": dry_run, "missing_columns": sorted(gap), "rows_before": rows.count()}
        if dry_run:
            return report
        if gap:
            fields = ", ".join(f"`{check_identifier(c)}` {t}" for c, t in gap.items())
            empty = self.spark.createDataFrame([], f"run_id long, {fields}")
            empty.drop("run_id").write.mode("append").parquet(f"{self._path('predictions')}/run_id=0")
        report["added_columns"] = sorted(gap)
        report["rows_after"] = self.spark.read.parquet(self._path("predictions")).count()
        return report
