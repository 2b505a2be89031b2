"""Tables by format, wide caches of one value a file, storage that is merged into, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tesserae.operators import shared, studies


def write_table(df: DataFrame, path: str) -> None:
    """CSV with a header where the path ends in .csv, else Parquet."""
    if path.endswith(".csv"):
        df.write.mode("overwrite").option("header", True).csv(path)
    else:
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table of either format with every column as a string."""
    df = spark.read.option("header", True).csv(path) if path.endswith(".csv") else spark.read.parquet(path)
    return df.select(*[F.col(f"`{c}`").cast(StringType()).alias(c) for c in df.columns])


def widened(rows: DataFrame, value: str, markets: list[str], how: str = "first") -> DataFrame:
    """One row a bar and one column a market, of cells that repeat the first or the sum. Markets are given: a column list is a
    driver's matter, and so is its size."""
    if how not in ("first", "sum"):
        raise ValueError(f"cells are first or sum, not {how}")
    return rows.groupBy("date_utc").pivot("market", markets).agg({"first": F.first, "sum": F.sum}[how](value))


def narrowed(wide: DataFrame, value: str, markets: list[str] | None = None) -> DataFrame:
    """date_utc, market, value of a wide table, without the cells that are null; markets it does not have have none."""
    present = [c for c in wide.columns if c != "date_utc" and (markets is None or c in markets)]
    return wide.select("date_utc", *[F.col(f"`{c}`") for c in present]).unpivot(["date_utc"], [F.col(f"`{c}`") for c in present], "market", value).where(F.col(value).isNotNull())


def write_wide_cache(rows: DataFrame, folder: str, values: list[str], markets: list[str]) -> None:
    """One Parquet table for each value, and the markets' first names and warnings."""
    for value in values:
        write_table(widened(rows, value, markets), f"{folder}/{value}.parquet")
    write_table(studies.first_seen(rows, *[c for c in ("korean_name", "english_name", "market_warning") if c in rows.columns]), f"{folder}/market_meta.parquet")


def read_wide_cache(spark: SparkSession, folder: str, values: list[str], markets: list[str] | None = None, last: int | None = None) -> DataFrame:
    """The long panel of a wide cache; with `last`, each market's last bars by the first value."""
    out = None
    for value in values:
        part = narrowed(spark.read.parquet(f"{folder}/{value}.parquet"), value, markets)
        out = part if out is None else out.join(part, ["date_utc", "market"], "full")
    meta = spark.read.parquet(f"{folder}/market_meta.parquet")
    if "market_warning" in meta.columns:
        meta = meta.withColumn("market_warning", F.coalesce("market_warning", F.lit("NONE")))
    out = out.join(meta, "market", "left")
    return out if last is None else studies.tail(out, last, values[0])


def merge_into(new: DataFrame, folder: str, replace_from_first: bool = False) -> DataFrame:
    """Bars merged into a stored panel that is partitioned by month: of a bar that both have the new one, or nothing stored
    from the first new bar on. Only months that change are written, from a checkpoint of the merged rows, so that an
    executor lost meanwhile does not need what is being overwritten; months that no longer have rows go."""
    spark = new.sparkSession
    month = F.date_format("date_utc", "yyyy-MM").alias("month")
    new = new.select("*", month)
    if not exists(spark, folder):
        new.write.partitionBy("month").parquet(folder)
        return spark.read.parquet(folder)
    old = spark.read.parquet(folder).select(*new.columns)
    first = new.agg(F.min("month")).first()[0]
    if first is None:
        return old
    old = old.where(F.col("month") >= first)
    merged = studies.recalculated(old, new) if replace_from_first else studies.upserted(old, new)
    merged = shared.materialised(merged.select(*new.columns))
    gone = old.select("month").distinct().join(merged.select("month").distinct(), "month", "left_anti").collect()  # months
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(folder)
    for r in gone:
        delete(spark, f"{folder}/month={r['month']}")
    return spark.read.parquet(folder)


def _path(spark: SparkSession, name: str, act):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return act(path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path)


def delete(spark: SparkSession, folder: str) -> None:
    _path(spark, folder, lambda files, path: files.delete(path, True))


def exists(spark: SparkSession, folder: str) -> bool:
    """Whether there is a file or folder, in whatever store."""
    return _path(spark, folder, lambda files, path: files.exists(path))


def markdown(df: DataFrame, columns: list[str], group: str | None = None, most: int = 1000) -> str:
    """A table, or one under a heading for each group; bars in values are escaped. More than `most` rows are no report."""
    rows = [r.asDict() for r in df.limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")

    def table(rows: list[dict]) -> str:
        cells = [[("" if r[c] is None else str(r[c])).replace("|", "\\|") for c in columns] for r in rows]
        return "\n".join("| " + " | ".join(line) + " |" for line in [columns, ["---"] * len(columns), *cells])

    if group is None:
        return table(rows)
    names = list(dict.fromkeys(r[group] for r in rows if r[group] not in (None, "")))
    return "\n\n".join(f"## {name}\n\n{table([r for r in rows if r[group] == name])}" for name in names)
