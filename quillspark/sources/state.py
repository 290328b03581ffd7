"""The snapshot state as a Parquet table of flat rows, partitioned by date: a day is written, found and read alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quillspark import schema
from quillspark.sources.snapshots import Folder

def read_state(spark: SparkSession, path: str, status: str | None = None) -> DataFrame:
    """All flat rows; empty where nothing was written. A filter on ``date`` leaves only those days' files to read.

    With a status, the table has that as its outer partition, and only its rows are read.
    """
    if not Folder(spark, path).exists():
        return spark.createDataFrame([], schema.STATE)
    rows = spark.read.schema(schema.STATE if status is None else StructType([*schema.STATE.fields, StructField("status", StringType())])).parquet(path)
    return (rows if status is None else rows.where(F.col("status") == status)).select(*schema.STATE.names)


def write_days(rows: DataFrame, path: str, by: tuple[str, ...] = ("date",)) -> None:
    """Replace the partitions that ``rows`` belong to; others stay. A retry writes the same partitions again.

    The mode is set on the writer: the default static mode would empty the table.
    """
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def earlier_day(spark: SparkSession, path: str, date: str, repository: str | None = None) -> str | None:
    """The newest day before ``date``: from the names of partitions, or for one repository from its snapshot rows of earlier days.

    A day has one snapshot, and its capture time begins with it, so the newest day is the newest capture.
    """
    if repository is None:
        days = Folder(spark, path).partitions("date")
        return max((d for d in days if d < date), default=None)
    own = read_state(spark, path).where((F.col("date") < date) & (F.col("kind") == "snapshot") & (F.col("repository") == repository))
    return own.agg(F.max("date")).first()[0]


def read_day(spark: SparkSession, path: str, date: str | None) -> DataFrame:
    """The flat rows of one day; none for no day."""
    return read_state(spark, path).where(F.col("date") == date) if date else spark.createDataFrame([], schema.STATE)
