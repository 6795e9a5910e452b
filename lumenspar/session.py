"""Session settings and the shared folder for cut lineage."""

from __future__ import annotations

import atexit
import os
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str, int]] = []  # with the thread that wrote it
_registered = False

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.executorEnv.OMP_NUM_THREADS": "1",  # one thread per task; tasks fill the cores
}


def local_session(cores: str | int = "*", memory: str = "8g", **conf: str) -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    b = SparkSession.builder.master(f"local[{cores}]").appName("lumenspar").config("spark.driver.memory", memory)
    for k, v in (DEFAULTS | {"spark.sql.shuffle.partitions": "8"} | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, else, on one machine only, a new temporary one."""
    sc = spark.sparkContext
    told = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if told:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(told)
        return told
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lumenspar-"))
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the session's process ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    global _registered
    if not _registered:
        atexit.register(_remove)
        _registered = True
    _written.append((spark, path, threading.get_ident()))
    return path


def mark() -> int:
    """Where the list of cuts stands now, for drop_since."""
    return len(_written)


def drop_since(at: int) -> None:
    """Removes the tables this thread has cut since mark(); for callers that are done with them, such as a stream's batch."""
    _remove([x for x in _written[at:] if x[2] == threading.get_ident()])


def _remove(entries: list | None = None) -> None:
    for x in list(_written) if entries is None else entries:
        _written.remove(x)
        spark, path, _ = x
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  # the session may be gone; the folder's owner clears it then
            return


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """df written as a table in the shared folder and read again: no lineage, and the loss of executors costs nothing.

    A written table is columnar and compressed, so what reads it again reads only the columns it needs.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df in at least two partitions per core, for Python work that is heavy for the bytes it reads: a scan makes as few
    partitions as its bytes need. For scans and projections; df is shuffled only if it has fewer."""
    n = 2 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df
