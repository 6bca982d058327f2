"""Readers and writers: the tables of a scale folder, files of other formats, and event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

__all__ = ["table", "read", "read_stream", "write", "FORMATS"]

FORMATS = ("parquet", "orc", "json", "csv")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the folder ``sf_dir`` (a file or a folder of parts)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _known(fmt: str, schema: T.StructType | str | None) -> None:
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    if fmt in ("json", "csv") and schema is None:
        raise ValueError("text formats need a schema: inferring one reads the data twice")


def read(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | str | None = None, **options) -> DataFrame:
    """Files of one format. Text formats need a schema; a malformed row is an error unless ``mode`` says otherwise."""
    _known(fmt, schema)
    reader = spark.read.format(fmt).options(**({"mode": "FAILFAST"} if fmt in ("json", "csv") else {}) | options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def read_stream(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet", *, files_per_batch: int | None = None, **options) -> DataFrame:
    """New files of a folder as a stream; ``files_per_batch`` limits the rate, it drops nothing."""
    _known(fmt, schema)
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(path)


def write(df: DataFrame, path: str, fmt: str = "parquet", *, mode: str = "error", partition_by: tuple[str, ...] = (), **options) -> None:
    """Files of one format; with ``partition_by`` rows are gathered by partition first, large partitions split, so that there are few files."""
    _known(fmt, "given")
    out = df.hint("rebalance", *partition_by) if partition_by else df
    out.write.format(fmt).mode(mode).options(**options).partitionBy(*partition_by).save(path)
