"""Rolling medians and percentiles: order statistics of windows of bars.

A window function would hold a list of the window for every row. Here a market's bars are cut into blocks, each block gets the
bars just before it that its first windows reach back to, and within a block one sorted structure follows the window: a
row enters and a row leaves it, which takes the logarithm of the window's length. A block bounds the memory of a task, and a
market's blocks go to many tasks.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tesserae.functions import series

#: Bars of a block, if windows are no longer.
BLOCK = 8192

KINDS = ("percentile", "median")


def rolled(df: DataFrame, column: str, n: int, names: dict[str, str], nulls: str = "skip", block: int = BLOCK) -> DataFrame:
    """Adds columns of the kinds that names gives them, over n bars of a column.

    percentile: the share of the window at or below the last value, ties count half; median: the mean of the middle two.
    As in series, nulls (and NaN) are skipped, or with nulls="strict" a window that holds one has no figure; a window that
    is not full has none.
    """
    if unknown := set(names.values()) - set(KINDS):
        raise ValueError(f"unknown order statistics {sorted(unknown)}")
    skip = series.counted(F.col(f"`{column}`"), nulls) is not None
    size = max(block, n)
    x = F.nanvl(F.col(f"`{column}`").cast("double"), F.lit(None).cast("double"))
    counts = x.isNotNull() if skip else F.lit(True)
    base = df.drop(*names)
    rows = base.withColumn("_x", x).withColumn("_number", F.sum(F.when(counts, 1).otherwise(0)).over(series.along().rowsBetween(Window.unboundedPreceding, 0)))
    place = F.greatest(F.col("_number") - 1, F.lit(0))
    rows = rows.withColumn("_own", F.floor(place / size)).withColumn("_reaches", counts & (place % size >= size - (n - 1)))
    # The last bars of a block go to the next one as well.
    rows = rows.withColumn("_block", F.explode(F.when(F.col("_reaches"), F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own"))))
    rows = rows.withColumn("_halo", F.col("_block") > F.col("_own")).drop("_number", "_own", "_reaches")
    schema = StructType([*base.schema.fields, *[StructField(name, DoubleType()) for name in names]])
    columns, kinds = base.columns, dict(names)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("date_utc")
        values = table["_x"].to_pandas()
        window = (values.dropna() if skip else values).rolling(n)
        out = table.select(columns)
        for name, kind in kinds.items():
            figures = (window.rank() / n if kind == "percentile" else window.median()).reindex(values.index)
            out = out.append_column(name, pa.array(figures, type=pa.float64(), from_pandas=True))
        return out.filter(pa.compute.invert(table["_halo"]))

    return rows.groupBy("market", "_block").applyInArrow(run, schema)


def consistency(df: DataFrame, column: str, n: int, name: str, least: float = 1e-12) -> DataFrame:
    """Adds the median return over the size of the mean return, over n bars without a null."""
    out = rolled(df, column, n, {"_median": "median"}, "strict")
    mean = F.abs(F.avg(column).over(series.trailing(n)))
    return out.withColumn(name, F.when(mean > least, F.col("_median") / mean)).drop("_median")
