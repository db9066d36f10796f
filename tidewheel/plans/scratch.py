"""Tables written to the folder all executors share, to cut lineage and to reuse a result."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"
_own: dict[str, str] = {}
_paths: dict[int, str] = {}


def root(spark: SparkSession) -> str:
    """The shared folder: what the session names in spark.checkpoint.dir, or (only where that is unset and all runs in one process, as in tests) a folder of our own."""
    named = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError(f"{KEY} must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="tidewheel-")
    return _own[app]


def materialize(df: DataFrame, label: str = "t") -> DataFrame:
    """Write df as Parquet under root() and read it back. The copy survives lost executors; nothing upstream runs again."""
    spark = df.sparkSession
    path = f"{root(spark)}/tidewheel/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = path
    weakref.finalize(out, _paths.pop, id(out), None)
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that materialize() returned and that nothing will read again."""
    for df in tables:
        if path := _paths.get(id(df)):
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def purge(spark: SparkSession) -> None:
    """Delete every table materialize() has written under root(). Only when no result that reads them is needed any more."""
    _delete(spark, f"{root(spark)}/tidewheel")
