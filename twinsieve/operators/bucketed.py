"""Parquet tables in buckets that grow by appended files and are read by joins without a shuffle of theirs."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from twinsieve.operators.metrics import observed
from twinsieve.session import folders

ROWS_PER_BUCKET = 2_000_000
MERGE_AFTER = 8


class BucketedTable:
    """Rows in buckets of ``keys``, below a path of its own, one writer at a time.

    Rows that are placed() meet the table bucket by bucket: only they are shuffled. The number of
    buckets follows from the number of rows, at least one per core. An append only adds files; after
    MERGE_AFTER of them, or when buckets hold four times ROWS_PER_BUCKET, the table is laid out anew in
    a folder beside the old one, which readers keep until then. So each row is rewritten a number of
    times that grows as the logarithm of the table. An append that failed may leave some of its rows;
    where that matters, rows are repeated by the caller and read as a set. Files are sorted by the keys unless
    in_order is false: then rows are only parted by bucket, for tables that are read in full.
    """

    def __init__(self, spark: SparkSession, path: str, columns: str, keys: Sequence[str], rows_per_bucket: int = ROWS_PER_BUCKET, merge_after: int = MERGE_AFTER, in_order: bool = True):
        self.spark, self.path, self.columns, self.keys = spark, path.rstrip("/"), columns, list(keys)
        self.rows_per_bucket, self.merge_after, self.in_order = rows_per_bucket, merge_after, in_order
        self.name: str | None = None
        self.rows, self.buckets, self.appends = 0, 0, 0
        found = folders(spark, f"{self.path}/layouts", "layout-")
        self.layout = len(found)
        if found:
            self.layout = int(found[-1].rpartition("-")[2]) + 1
            state = spark.read.parquet(found[-1]).first()
            self._attach(state["folder"], state["buckets"])
            self.rows = self.read().count()

    def _attach(self, folder: str, buckets: int) -> None:
        self.drop()
        self.name, self.buckets = f"twinsieve_{uuid.uuid4().hex}", buckets
        by = ", ".join(f"`{k}`" for k in self.keys)
        ordered = f"SORTED BY ({by}) " if self.in_order else ""
        self.spark.sql(
            f"CREATE TABLE {self.name} ({self.columns}) USING parquet OPTIONS (compression 'zstd') CLUSTERED BY ({by}) {ordered}INTO {buckets} BUCKETS LOCATION '{self.path}/{folder}'"
        )

    def _lay_out(self, rows: DataFrame, count: int) -> None:
        buckets = max(self.spark.sparkContext.defaultParallelism, -(-count // self.rows_per_bucket))
        folder = f"rows-{self.layout:06d}"
        old = self.name
        self.name = None  # the old table is read while the new one is written
        self._attach(folder, buckets)
        rows.repartition(buckets, *self.keys).write.insertInto(self.name)
        # One small folder with a success mark makes the new layout the one that counts.
        self.spark.createDataFrame([(folder, buckets)], "folder string, buckets int").coalesce(1).write.parquet(f"{self.path}/layouts/layout-{self.layout:06d}")
        if old:
            self.spark.sql(f"DROP TABLE IF EXISTS {old}")
            self._delete(f"{self.path}/rows-{self.layout - 1:06d}")
        self.layout += 1
        self.rows, self.appends = count, 0

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def append(self, rows: DataFrame, count: int | None = None) -> None:
        """Adds rows, and lays the table out anew where it is due. ``count`` is their number where it is known.

        The first rows decide on the buckets; they should be a written table.
        """
        rows = rows.select(*[c.split()[0] for c in self.columns.split(", ")])
        if not self.name:
            self._lay_out(rows, rows.count() if count is None else count)
            return
        rows, seen = observed(rows, f"append-{uuid.uuid4().hex}")
        self.placed(rows).write.insertInto(self.name)
        self.rows, self.appends = self.rows + (seen.get["rows"] if count is None else count), self.appends + 1
        if self.appends >= self.merge_after or self.rows > 4 * self.rows_per_bucket * self.buckets:
            self._lay_out(self.read(), self.rows)

    def placed(self, rows: DataFrame, *keys: str) -> DataFrame:
        """Rows dealt to the buckets of the table, by columns that are called as its keys or named here."""
        return rows.repartition(self.buckets, *[F.col(k) for k in (keys or self.keys)])

    def held(self, rows: DataFrame, count: int | None) -> DataFrame:
        """Placed rows, for a join that holds them in memory and so sorts nothing of the table, where they are known to be few enough.

        That is rows_per_bucket for each bucket; no key may have most of them. More rows, and rows whose number
        is not known, are joined as Spark plans it, by sorting both sides.
        """
        return rows.hint("shuffle_hash") if count is not None and count <= self.rows_per_bucket * self.buckets else rows

    def read(self) -> DataFrame:
        if not self.name:
            return self.spark.createDataFrame([], self.columns)
        return self.spark.read.table(self.name)

    def drop(self) -> None:
        """Takes the table out of the session's catalog; its files stay."""
        if self.name:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
            self.name = None
