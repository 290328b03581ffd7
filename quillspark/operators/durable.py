"""Materialise intermediate tables where every executor can read them again.

An iterative job must not depend on one executor's disk: each round is written
as Parquet below the folder that the cluster names in ``spark.checkpoint.dir``,
so its lineage ends there and a lost executor costs only its running tasks.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_default: list[str] = []
_swept: set[str] = set()


def scratch_root(spark: SparkSession) -> str:
    """The shared scratch folder of this session; a temporary one only where there is no cluster.

    On a cluster each executor would write to its own disk, so there the setting is required.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _local_default:
            _local_default.append(tempfile.mkdtemp(prefix="quillspark-"))
        named = _local_default[0]
    return f"{named.rstrip('/')}/quillspark-{spark.sparkContext.applicationId}"


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared scratch folder and return the written table."""
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    if app not in _swept:
        _swept.add(app)
        atexit.register(_sweep, spark)
    path = f"{scratch_root(spark)}/{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillspark_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete a table that ``durable`` wrote, once nothing will read it again."""
    path = getattr(df, "_quillspark_path", None)
    if path:
        _delete(df.sparkSession, path)


def owns(df: DataFrame, table: DataFrame) -> DataFrame:
    """``df``, which reads a table that ``durable`` wrote; releasing ``df`` releases that table."""
    df._quillspark_path = getattr(table, "_quillspark_path", None)
    return df


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _sweep(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the session may be gone at exit; nothing to clean then
        _delete(spark, scratch_root(spark))
