"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Each source's documents stand in a fixed shuffled order (by md5 of a seed and doc_id) and may be repeated a few times.
A copy's virtual finish time is the number of its source's words up to its end, divided by the source's target: every
source reaches time 1 at its target, so serving copies in order of finish time keeps the sources in proportion at every
moment. The mix is the head of that global order that fits the total budget.

Running sums never gather a source or the corpus in one task. The order is cut into about sqrt(rows) ranges (of the hash
within a source, of finish time for all), ranges are summed by partial aggregation, and only rows of one range are sorted
together. The global cut-off is one row: the last copy that fits.

Defined results: a null or empty text has size 0 and takes 0 words; a null source is a source of its own, after all
others; rows repeated exactly stand at the same place of the order and enter or stay out together; an empty table gives
an empty result; other columns are ignored. A source of size 0 has target 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.llm import common

WEIGHTS = (1, 2, 3)
REPEATS = 3
SEED = "mix-1"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """source, source_size, weight, target from one row per source (source, source_size).

    Sources capped at `repeats` times their size are those with the least room per weight: going up in that order, a
    source is capped while the rest, sharing what the ones before left, would give it more than it has.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight.cast("double")).withColumn("cap", (repeats * F.col("source_size")).cast("double"))
    by_room = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, after = by_room.rowsBetween(Window.unboundedPreceding, -1), by_room.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("total", F.sum("source_size").over(everything).cast("double"))
    rows = rows.withColumn("place", F.row_number().over(by_room)).withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    free = F.col("cap") > F.col("level") * F.col("weight")
    rows = rows.withColumn("first_free", F.min(F.when(free, F.col("place"))).over(everything))
    rows = rows.withColumn("level", F.max(F.when(F.col("place") == F.col("first_free"), F.col("level"))).over(everything))
    target = F.when(F.col("first_free").isNull() | (F.col("place") < F.col("first_free")), F.col("cap")).otherwise(F.col("level") * F.col("weight"))
    return rows.select("source", "source_size", "weight", target.alias("target"))


def _ranges(rows: int) -> int:
    """The power of two from the square root of the rows."""
    return 1 << max(0, math.ceil(math.log2(max(1, rows)) / 2))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, seed: str = SEED, *keep: Column) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken, and the columns `keep`, one row per row of docs."""
    size = F.coalesce(F.regexp_count("text", F.lit(common.WORD_PATTERN)), F.lit(0)).cast("bigint")
    place = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = common.stored(docs.select("doc_id", "source", size.alias("size"), place.alias("place"), *keep), "sizes")
    sources = common.stored(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, repeats), "sources")
    count, budget = sized.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = _ranges(count)

    # Running sums within a source: sums of hash ranges, then sums within a range.
    at = F.shiftright(F.conv(F.substring("place", 1, 8), 16, 10).cast("bigint"), 32 - int(math.log2(ranges))).alias("range")
    ranged = sized.select("*", at)
    sums = ranged.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    sums = sums.select("source", "range", (F.sum("range_size").over(Window.partitionBy("source").orderBy("range")) - F.col("range_size")).alias("before"))
    sums = sums.join(sources, sums["source"].eqNullSafe(sources["source"])).select(sums["source"], "range", "before", "source_size", "target")
    joined = ranged.alias("d").join(sums.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.range") == F.col("s.range")))
    joined = joined.select("d.*", "s.before", "s.source_size", "s.target")
    within = Window.partitionBy("source", "range").orderBy("place", "doc_id", "size")
    queued = common.stored(joined.withColumn("upto", F.col("before") + F.sum("size").over(within)).drop("before", "range"), "queued")

    common.drop_stored(sized, sources)

    def copy(n: int) -> Column:
        finish = F.try_divide((F.lit(n) * F.col("source_size") + F.col("upto")).cast("double"), F.col("target"))
        return F.struct(finish.alias("finish"), F.col("place").alias("place"), F.col("doc_id").alias("doc_id"), F.col("size").alias("size"), F.lit(n).alias("copy"))

    # The global order: sums of ranges of finish time, then the one range in which the budget ends.
    copies = queued.where("size > 0").select(F.explode(F.array(*[copy(n) for n in range(repeats)])).alias("c")).select("c.*")
    copies = copies.withColumn("slot", F.least(F.floor(F.col("finish") * ranges), F.lit(4 * ranges)).cast("bigint"))
    slots = copies.groupBy("slot").agg(F.sum("size").alias("slot_size"))
    slots = slots.withColumn("through", F.sum("slot_size").over(Window.orderBy("slot")))
    full = slots.where(F.col("through") <= budget).agg(F.max("slot"), F.coalesce(F.max("through"), F.lit(0))).first()
    last_full, used = (-1 if full[0] is None else full[0]), full[1]
    next_slot = slots.where(F.col("slot") > last_full).agg(F.min("slot")).first()[0]
    order = Window.orderBy("finish", "place", "doc_id", "size", "copy").rowsBetween(Window.unboundedPreceding, 0)
    edge = copies.where(F.col("slot") == F.lit(next_slot)).withColumn("through", F.lit(used) + F.sum("size").over(order)).where(F.col("through") <= budget)
    cut = edge.agg(F.max(F.struct("finish", "place", "doc_id", "size", "copy"))).first()[0]
    if cut is None:  # no copy of the range at the edge fits
        cut = copies.where(F.col("slot") == F.lit(last_full)).agg(F.max(F.struct("finish", "place", "doc_id", "size", "copy"))).first()[0]
    if cut is None:
        taken = F.lit(0)
    else:
        edge_copy = F.struct(*[F.lit(cut[k]).cast(t).alias(k) for k, t in (("finish", "double"), ("place", "string"), ("doc_id", "bigint"), ("size", "bigint"), ("copy", "int"))])
        taken = sum((F.when((F.col("size") > 0) & (copy(n) <= edge_copy), 1).otherwise(0) for n in range(repeats)), F.lit(0))
    out = queued.withColumn("copies", taken.cast("int")).withColumn("taken", F.col("copies") * F.col("size"))
    return out.drop("upto", "place")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, seed: str = SEED) -> DataFrame:
    """The documents the mix takes, each as often as it is taken, with the columns of docs, whatever their names. Documents
    without words have size 0 and are not taken."""
    row = F.struct(*docs.columns).alias("row")
    keyed = docs.select("doc_id", "source", "text", row)
    taken = mix(keyed, weights, repeats, seed, F.md5("text").alias("text_key"))
    taken = taken.where("copies > 0").groupBy("doc_id", "source", "text_key").agg(F.max("copies").alias("copies"))
    left = docs.select("doc_id", "source", F.md5("text").alias("text_key"), row).alias("d")
    on = F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")) & F.col("d.source").eqNullSafe(F.col("t.source")) & (F.col("d.text_key") == F.col("t.text_key"))
    joined = left.join(taken.alias("t"), on).select("d.row", F.explode(F.sequence(F.lit(1), F.col("t.copies"))).alias("copy_number"))
    return joined.select("row.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1:' || COALESCE(doc_id::VARCHAR, '')) AS place
  FROM documents),
by_source AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, ((row_number() OVER (ORDER BY source COLLATE "binary" ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight,
         (3 * source_size)::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE AS total FROM by_source),
levels AS (
  SELECT *, row_number() OVER by_room AS rn,
         (total - COALESCE(sum(cap) OVER (by_room ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
           / sum(weight) OVER (by_room ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl
  FROM weighed WINDOW by_room AS (ORDER BY cap / weight, source COLLATE "binary" NULLS LAST)),
first_free AS (SELECT min(rn) AS rn FROM levels WHERE cap > lvl * weight),
targets AS (
  SELECT l.source, l.source_size,
         CASE WHEN f.rn IS NULL OR l.rn < f.rn THEN l.cap ELSE (SELECT lvl FROM levels WHERE rn = f.rn) * l.weight END AS target
  FROM levels l, first_free f),
queued AS (
  SELECT s.doc_id, s.source, s.size, s.place, t.source_size, t.target,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.place, s.doc_id, s.size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT q.*, n.n AS copy, (n.n * source_size + upto)::DOUBLE / target AS finish
  FROM queued q, (VALUES (0), (1), (2)) n(n) WHERE size > 0),
served AS (
  SELECT *, sum(size) OVER (ORDER BY finish, place, doc_id, size, copy ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS through FROM copies),
taken AS (
  SELECT doc_id, source, size, place, sum(size)::BIGINT AS taken FROM served
  WHERE through <= (SELECT sum(size) FROM sized) GROUP BY ALL)
SELECT q.doc_id, q.size, q.source_size, q.target, COALESCE(t.taken, 0)::BIGINT AS taken
FROM queued q LEFT JOIN taken t ON q.doc_id IS NOT DISTINCT FROM t.doc_id AND q.source IS NOT DISTINCT FROM t.source AND q.place = t.place AND q.size = t.size
"""
