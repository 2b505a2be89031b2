"""Tables in total order: sorted files of disjoint ranges with a manifest, read back by slices of time.

A writer deals rows by ranges of the keys and sorts within a range, so the files are runs of one total order and never one
task holds them all. The manifest has each file's first and last key; a reader opens only the files a slice can lie in.
"""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.sinks import tables

KEYS = ("date_utc", "market")


def write_sorted(rows: DataFrame, folder: str, files: int | None = None, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Writes rows in the order of keys to at most `files` files (by default as many as a shuffle has); the manifest: file,
    first, last (keys), rows."""
    dealt = rows.repartitionByRange(files, *keys) if files else rows.repartitionByRange(*keys)
    dealt.sortWithinPartitions(*keys).write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/data")
    key = F.struct(*keys)
    written = rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/data").select(F.col("_metadata.file_name").alias("file"), key.alias("_key"))
    manifest = written.groupBy("file").agg(F.min("_key").alias("first"), F.max("_key").alias("last"), F.count("*").alias("rows"))
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest")  # one row a file
    return read_manifest(rows.sparkSession, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/manifest")


def files_of(spark: SparkSession, folder: str, begins: datetime.datetime | None = None, ends: datetime.datetime | None = None) -> list[str]:
    """The files, in order, that can hold rows of [begins, ends)."""
    manifest, at = read_manifest(spark, folder), "timestamp_ntz"
    if begins is not None:
        manifest = manifest.where(F.col("last.date_utc") >= F.lit(begins).cast(at))
    if ends is not None:
        manifest = manifest.where(F.col("first.date_utc") < F.lit(ends).cast(at))
    return [r["file"] for r in manifest.orderBy("first").select("file").collect()]  # names of files


def read_slice(spark: SparkSession, folder: str, begins: datetime.datetime | None = None, ends: datetime.datetime | None = None) -> DataFrame:
    """The rows of [begins, ends), from the files that can hold some."""
    files = files_of(spark, folder, begins, ends)
    whole = spark.read.parquet(f"{folder}/data")
    if not files:
        return whole.where("false")
    rows = spark.read.schema(whole.schema).parquet(*[f"{folder}/data/{name}" for name in files])
    if begins is not None:
        rows = rows.where(F.col("date_utc") >= F.lit(begins).cast("timestamp_ntz"))
    return rows if ends is None else rows.where(F.col("date_utc") < F.lit(ends).cast("timestamp_ntz"))


def merge_sorted(sources: list[DataFrame], folder: str, files: int | None = None, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Many sources, such as a file a market, as one table in order; the manifest. Of rows with equal keys all stay."""
    return write_sorted(reduce(DataFrame.unionByName, sources), folder, files, keys)


def write_features(df: DataFrame, folder: str, features: list[str], files: int | None = None) -> DataFrame:
    """A table of features in order, and of each: feature, rows with a value, first and last bar with one."""
    write_sorted(df.select(*KEYS, *features), folder, files)
    frame = df.sparkSession.read.parquet(f"{folder}/data")
    told = [F.struct(F.lit(f).alias("feature"), F.count(f"`{f}`").alias("rows"), *[how(F.when(F.col(f"`{f}`").isNotNull(), F.col("date_utc"))).alias(n) for n, how in (("first", F.min), ("last", F.max))]) for f in features]
    frame.agg(F.array(*told).alias("all")).select(F.inline("all")).write.mode("overwrite").parquet(f"{folder}/features")  # one row a feature
    return df.sparkSession.read.parquet(f"{folder}/features")


def drop(spark: SparkSession, folder: str) -> None:
    tables.delete(spark, folder)
