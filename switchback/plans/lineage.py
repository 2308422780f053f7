"""Cutting lineage in a folder that every executor shares.

Iterative operators would otherwise drag an ever longer plan along, and a lost
executor would recompute all rounds.  Tables are written as parquet (columnar,
compressed) under ``spark.checkpoint.dir``; only where that setting is unset (tests,
local mode) a folder of this process is used instead.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
#: Tables of this process that no :func:`forget` has deleted.
_TABLES: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``, or one of our own in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = tempfile.mkdtemp(prefix="switchback-")
        atexit.register(shutil.rmtree, _LOCAL["dir"], ignore_errors=True)
    return "file://" + _LOCAL["dir"]


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and return it as a scan of that table."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/switchback/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _TABLES.add(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def forget(df: DataFrame) -> None:
    """Delete the table behind a frame made by :func:`written` (a round's superseded state)."""
    for name in df.inputFiles()[:1]:
        folder = name.rpartition("/")[0]
        _delete(df.sparkSession, folder)
        _TABLES.difference_update([p for p in _TABLES if p.rpartition("/")[2] == folder.rpartition("/")[2]])


def sweep(spark: SparkSession) -> int:
    """Delete all intermediate tables of this process; to be called when its results are stored.  Returns how many there were."""
    n = 0
    while _TABLES:
        _delete(spark, _TABLES.pop())
        n += 1
    return n
