"""Session helpers: shared checkpoint folder, written intermediate tables, shipping of the package."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

BROADCAST_AT_ONCE = "1m"
_WRITTEN: list[tuple[SparkSession, str]] = []
_SHIPPED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    It is ``spark.checkpoint.dir`` of the session. Only where that is unset (tests, one machine) a
    temporary folder is made and set as the checkpoint folder of the context.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        found = sc.getCheckpointDir()
        if not found:
            if not sc.master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="twinsieve-"))
            found = sc.getCheckpointDir()
    return found


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, removed when the driver ends or by clear_written()."""
    path = f"{shared_dir(spark).rstrip('/')}/twinsieve/{label}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """Cuts the lineage of df with a Parquet table in the shared folder; it survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def counted(df: DataFrame, label: str, what: Column | None = None) -> tuple[DataFrame, int]:
    """written() with the number of rows, or another aggregate of them, taken while they are written."""
    seen = Observation(f"{label}-{uuid.uuid4().hex}")
    out = written(df.observe(seen, (F.count(F.lit(1)) if what is None else what).alias("rows")), label)
    return out, seen.get["rows"] or 0


def release(spark: SparkSession) -> None:
    """Lets go of what finished queries left on the driver, and with that of their shuffle files and broadcasts.

    Spark cleans up after a query when its objects on the driver are collected, which a driver that runs batch
    after batch otherwise does only when its memory is full.
    """
    gc.collect()
    spark._jvm.java.lang.System.gc()


@contextmanager
def in_one_go(spark: SparkSession, rows: int, few: int) -> Iterator[None]:
    """Plans queries as a whole, with fewer partitions, where the rows are known to be at most ``few``.

    Adaptive execution runs every exchange as a job of its own; with few rows that is most of the time, and
    there is no skew to find. Broadcasts, which pass the driver and are many here, are kept small. More rows
    keep the settings of the session.
    """
    settings = {}
    if rows <= few:
        usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
        settings = {
            "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": str(max(1, min(usual, -(-rows // 512)))),
            "spark.sql.autoBroadcastJoinThreshold": BROADCAST_AT_ONCE,
        }
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@contextmanager
def scope(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes the intermediate tables written within it at its end, but those written() ones that the given function is called with.

    Only for work that is done when the scope ends: nothing that is still to run may read what it wrote.
    """
    before, kept = len(_WRITTEN), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._written_to)
        return df

    yield keep
    mine, _WRITTEN[before:] = _WRITTEN[before:], []
    for owner, path in mine:
        if path in kept:
            _WRITTEN.append((owner, path))
        else:
            _delete(owner, path)


def folders(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """Complete (successfully written) folders below path whose names begin with prefix, in order."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jpath):
        return []
    found = [f.getPath().toString() for f in fs.listStatus(jpath) if f.isDirectory() and f.getPath().getName().startswith(prefix)]
    return sorted(f for f in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{f}/_SUCCESS")))


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
    except Exception:  # the JVM may be gone already
        pass


def clear_written() -> None:
    """Deletes all intermediate tables that this driver wrote."""
    while _WRITTEN:
        _delete(*_WRITTEN.pop())


atexit.register(clear_written)


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers, wherever the driver runs from; once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    fd, name = tempfile.mkstemp(prefix="twinsieve-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(name)  # executors fetch it from the driver when they start, so it stays until the end
    atexit.register(lambda: os.path.exists(name) and os.unlink(name))
    _SHIPPED.add(sc.applicationId)


def spread(scan: DataFrame) -> DataFrame:
    """A scan for costly Python work: one that has fewer splits than there are cores is dealt out anew.

    Large inputs have more splits than cores and pass unchanged. Only for scans, since planning must
    not run anything.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def distinct_by(rows: DataFrame, key: str) -> DataFrame:
    """One row per key, in as many partitions as a shuffle has even where the rows are few.

    For rows that costly Python work follows on; the rows of a key are equal or any of them will do.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key).dropDuplicates([key])
