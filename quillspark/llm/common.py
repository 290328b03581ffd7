"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(text: str) -> Column:
    """The text as bytes, so that Arrow hands Python the buffer undecoded; null gives empty bytes."""
    return F.coalesce(F.col(text).cast("binary"), F.lit(b""))


def id_remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id's text modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def fresh(name: str, df: DataFrame) -> str:
    """A column name that the table does not have yet."""
    while name in df.columns:
        name += "_"
    return name


def arrow_type(df: DataFrame, column: str) -> pa.DataType:
    return to_arrow_type(df.schema[column].dataType)
