"""Summaries of runs from a tree of CSV files, whatever columns each file has.

Grid summaries have a header and a row for each run; backtest summaries have a row for each figure, its name and its value.
Files are read line by line with their paths and may be cut between lines, so that a large one is several tasks' work and
never one row: a file's header is joined to its rows, and a row becomes a map from names to values. A field in quotes may
hold commas, but no line break.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators import shared

#: A field after its comma: in quotes, which are doubled inside, or bare.
_FIELD = r',("[^"]*(?:""[^"]*)*"|[^,]*)'


def _lines(spark: SparkSession, root: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Of the files of a name below a folder, without blank lines: summary_path and header (a file's first line), and summary_path, place (in
    order within a file) and line of the others. A mark at the start is cut off."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).option("lineSep", "\n").text(root)
    line = F.regexp_replace(F.regexp_replace("value", "\r$", ""), "^\uFEFF", "")
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    lines = shared.materialised(files.select(F.col("_metadata.file_path").alias("summary_path"), place.alias("place"), line.alias("line")).where(F.trim("line") != ""))
    first = lines.groupBy("summary_path").agg(F.min(F.struct("place", "line")).alias("first"))
    headers = first.select("summary_path", F.col("first.line").alias("header"), F.col("first.place").alias("head"))
    return headers.select("summary_path", "header"), lines.join(headers.select("summary_path", "head"), "summary_path").where("place > head").drop("head")


def _fields(line: Column) -> Column:
    """The fields of a line, null where one is empty."""

    def bare(field: Column) -> Column:
        inside = F.replace(F.substring(field, F.lit(2), F.length(field) - 2), F.lit('""'), F.lit('"'))
        return F.nullif(F.when(field.startswith('"'), inside).otherwise(F.trim(field)), F.lit(""))

    return F.transform(F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_FIELD), F.lit(1)), bare)


def _folder(path: str = "summary_path", up: int = 0) -> Column:
    """The name of the folder a file lies in, or of one further up."""
    return F.element_at(F.split(path, "/"), -2 - up)


def grid_summaries(spark: SparkSession, root: str, name: str = "summary_results.csv") -> DataFrame:
    """summary_path, source_dir and figures (a map of strings) of every row of every grid summary. Of names that a header
    repeats the last counts."""
    headers, lines = _lines(spark, root, name)
    again = lambda n, i: F.coalesce(F.array_contains(F.slice("names", i + 2, F.size("names")), n), F.lit(False))
    headers = headers.select("summary_path", _fields(F.col("header")).alias("names")).withColumn("names", F.transform("names", lambda n, i: F.when(~again(n, i), n)))
    rows = lines.join(headers, "summary_path").select("summary_path", "names", _fields(F.col("line")).alias("values"))
    figures = F.map_from_entries(F.filter(F.arrays_zip("names", "values"), lambda p: p["names"].isNotNull()))
    return rows.select("summary_path", _folder().alias("source_dir"), figures.alias("figures"))


def backtest_summaries(spark: SparkSession, root: str, name: str = "summary.csv") -> DataFrame:
    """summary_path, source_dir and figures of every backtest summary: its first line is a header, the others are figures."""
    rows = _lines(spark, root, name)[1].withColumn("fields", _fields(F.col("line")))
    told = rows.select("summary_path", "place", F.get("fields", F.lit(0)).alias("key"), F.get("fields", F.lit(1)).alias("value")).where("key IS NOT NULL AND value IS NOT NULL")
    last = told.groupBy("summary_path", "key").agg(F.max_by("value", "place").alias("value"))
    figures = F.map_from_entries(F.collect_list(F.struct("key", "value")))
    return last.groupBy("summary_path").agg(figures.alias("figures")).select("summary_path", _folder().alias("source_dir"), "figures")


def columns_of(summaries: DataFrame) -> list[str]:
    """The names that any summary has, in order: a bounded list."""
    return [r[0] for r in summaries.select(F.explode(F.map_keys("figures")).alias("name")).distinct().orderBy("name").collect()]


def widened(summaries: DataFrame, names: list[str] | None = None) -> DataFrame:
    """summary_path, source_dir and one column for each name; null where a summary has none."""
    names = columns_of(summaries) if names is None else names
    return summaries.select("summary_path", "source_dir", *[F.try_element_at("figures", F.lit(n)).alias(n) for n in names if n not in ("summary_path", "source_dir")])
