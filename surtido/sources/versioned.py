"""Tables of committed folders: what a table holds is what its commit records say.

Rows are written to folders that no earlier write has used, and then one record, a
single small file, names the folder. A reader takes the folders of the records, so a write that
fails leaves nothing to see, there is no moment without a table, nothing is renamed or copied,
and the log of loads is the table's own history. Good for object stores, where a rename is a copy.

One writer a table at a time; readers at any time.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

RECORD = ("version long, kind string, folder string, batch long, buckets array<int>, rows long, "
          "first timestamp, last timestamp, executed timestamp, state string")
REPLACE, APPEND, BUCKETS = "replace", "append", "buckets"
BUCKET = "_bucket"


class CommitConflict(RuntimeError):
    """Another writer has committed the same version."""


@dataclass(frozen=True)
class VersionedTable:
    """``root`` holds ``data/<folder>`` and ``commits``; ``keys`` and ``buckets`` make it a keyed snapshot."""

    spark: SparkSession
    root: str
    schema: StructType
    keys: Sequence[str] = ()
    buckets: int = 1

    # --- history ---

    def commits(self) -> DataFrame:
        """The commit records, a row a write."""
        try:
            return self.spark.read.schema(RECORD).json(f"{self.root}/commits")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], RECORD)

    def history(self) -> list[Row]:
        """The records in order; one a write, which ``compact`` keeps few."""
        return self.commits().orderBy("version", "folder").collect()

    def log(self) -> DataFrame:
        """The load log: a row a load that was appended."""
        return self.commits().where(F.col("kind") == APPEND).select(
            F.col("executed").alias("fecha_ejecucion"), F.col("first").alias("fecha_desde"),
            F.col("last").alias("fecha_hasta"), F.col("rows").alias("transacciones"), F.col("state").alias("estado"))

    # --- reading ---

    def _paths(self, history: Iterable[Row], only: set[int] | None = None) -> list[str]:
        """Folders of the current version; with ``only``, those of these buckets."""
        whole: dict[str, None] = {}
        newest: dict[int, str] = {}
        through = None
        for record in history:
            path = f"{self.root}/data/{record['folder']}"
            if record["kind"] == REPLACE:
                whole, newest, through = {path: None}, {}, record["batch"]
                if record["buckets"] is not None:
                    whole, newest = {}, dict.fromkeys(record["buckets"], path)
            elif record["kind"] == BUCKETS:
                newest |= dict.fromkeys(record["buckets"], path)
            elif through is None or record["batch"] is None or record["batch"] > through:
                whole[path] = None  # a batch that is repeated has one folder
        return [*whole, *(f"{path}/{BUCKET}={b}" for b, path in sorted(newest.items()) if only is None or b in only)]

    def read(self) -> DataFrame:
        """The committed rows; an empty frame before the first commit."""
        return self._read(self._paths(self.history()))

    def _read(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    # --- writing ---

    def _commit(self, history: list[Row], kind: str, folder: str, executed: dt.datetime, *, batch: int | None = None,
                buckets: list[int] | None = None, rows: int = 0, first=None, last=None, state: str = "exitoso") -> None:
        version = 1 + max((r["version"] for r in history), default=0)
        record = self.spark.createDataFrame(
            [(version, kind, folder, batch, buckets, rows, first, last, executed, state)], RECORD)
        record.coalesce(1).write.mode("append").json(f"{self.root}/commits")
        if any(r["folder"] != folder for r in self.history() if r["version"] == version):
            raise CommitConflict(f"{self.root}: version {version} has two writers")

    def _write(self, df: DataFrame, folder: str, ts: str | None = None) -> dict:
        """Write a folder; the write job itself counts the rows and finds their first and last time."""
        seen = Observation()
        measures = [F.count(F.lit(1)).alias("rows")]
        if ts is not None:
            measures += [F.min(ts).alias("first"), F.max(ts).alias("last")]
        out = df.select(*self.schema.names)
        if self.keys:
            out = out.withColumn(BUCKET, self._bucket()).repartition(BUCKET)
        writer = out.observe(seen, *measures).write.mode("overwrite")
        (writer.partitionBy(BUCKET) if self.keys else writer).parquet(f"{self.root}/data/{folder}")
        return seen.get

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def replace(self, df: DataFrame, executed: dt.datetime) -> int:
        """Make ``df`` the table; it may read the rows it replaces. Returns the number of rows."""
        history, folder = self.history(), uuid.uuid4().hex
        got = self._write(df, folder)
        made = None
        if self.keys:
            made = [r[BUCKET] for r in self.spark.read.parquet(f"{self.root}/data/{folder}")
                    .select(BUCKET).distinct().collect()] if got["rows"] else []
        self._commit(history, REPLACE, folder, executed, buckets=made, rows=got["rows"])
        return got["rows"]

    def append(self, df: DataFrame, executed: dt.datetime, ts: str | None = None, batch: int | None = None) -> int:
        """Add rows. A ``batch`` that is written again takes the place of its first try."""
        history = self.history()
        folder = uuid.uuid4().hex if batch is None else f"batch-{batch}"
        if batch is not None and any(r["kind"] == APPEND and r["folder"] == folder for r in history):
            return 0  # committed before a restart
        got = self._write(df, folder, ts)
        self._commit(history, APPEND, folder, executed, batch=batch, rows=got["rows"],
                     first=got.get("first"), last=got.get("last"))
        return got["rows"]

    def load_later(self, incoming: DataFrame, executed: dt.datetime, ts: str = "transaction_date",
                   since: dt.datetime | None = None) -> int:
        """Append the rows after the high-water mark, which is that of the committed loads.

        Rows, mark and log are one commit: a load that failed half-way is not seen and is
        done again as a whole. A load without rows is not logged.
        """
        history = self.history()
        mark = max((r["last"] for r in history if r["last"] is not None), default=None)
        if mark is None and history:  # rows that came by ``replace``
            mark = self._read(self._paths(history)).agg(F.max(ts)).first()[0]
        mark = mark or since
        later = incoming if mark is None else incoming.where(F.col(ts) > F.lit(mark))
        folder = uuid.uuid4().hex
        got = self._write(later, folder, ts)
        if got["rows"]:
            self._commit(history, APPEND, folder, executed, rows=got["rows"], first=mark or got["first"], last=got["last"])
        return got["rows"]

    def update(self, changes: DataFrame, merge, executed: dt.datetime) -> int:
        """Rewrite the buckets that hold keys of ``changes`` as ``merge(rows, changes)``; the rest stays.

        Returns how many buckets were written. The merge must keep each row's key.
        """
        history = self.history()
        touched = {r[0] for r in changes.select(self._bucket()).distinct().collect()}  # one row a bucket
        paths = [p for p in self._paths(history, touched) if f"/{BUCKET}=" in p]
        if not paths:
            return 0
        folder = uuid.uuid4().hex
        got = self._write(merge(self._read(paths), changes), folder)
        held = sorted(int(p.rpartition("=")[2]) for p in paths)
        self._commit(history, BUCKETS, folder, executed, buckets=held, rows=got["rows"])
        return len(held)

    def compact(self, executed: dt.datetime, merge=lambda rows: rows) -> None:
        """Gather all committed folders in one. Batches that it holds count no more, also if they are written again."""
        history = self.history()
        batches = [r["batch"] for r in history if r["batch"] is not None]
        folder = uuid.uuid4().hex
        got = self._write(merge(self._read(self._paths(history))), folder)
        last = max((r["last"] for r in history if r["last"] is not None), default=None)
        self._commit(history, REPLACE, folder, executed, batch=max(batches, default=None), rows=got["rows"], last=last)

    def release(self) -> int:
        """Empty the data folders that the current version does not read; returns how many.

        For when no reader is left on an older version. The records stay.
        """
        history = self.history()
        used = {p.split("/data/")[1].split("/")[0] for p in self._paths(history)}
        old = {r["folder"] for r in history} - used
        for folder in old:
            self.spark.createDataFrame([], self.schema).write.mode("overwrite").parquet(f"{self.root}/data/{folder}")
        return len(old)
