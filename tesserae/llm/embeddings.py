"""Embedding near-dedup by collision-counting projections.

Vectors are projected on many random lines. On each line the vectors are sorted, and a window centred on every vector
collects the ones near it; pairs are verified only if they collide on enough lines. The count asked for is the lower
tail quantile of the binomial that a pair just at the threshold follows, so calibrated recall is a parameter.

Counting collisions between all pairs of a corpus is quadratic however narrow the windows are, so counting is confined
to cells: TABLES times over, a vector's cell is the signs of some projections. The number of signs follows the logarithm
of the number of vectors, and the number of tables follows from it and the recall. A pair is handled in the first table
in which it shares a cell only, which the task finds from the vectors themselves. Cells of any size are handled
whole: large ones are split into blocks, and a task gets two blocks. There the collision counts say which pairs are
verified; no cosine is computed for others. A task returns, for each of its vectors, the number
of links it found and one link to the smallest vector of its part, never a list of pairs. Equal vectors count as one with
a multiplicity; they are told apart by 128 bits of hash.

The links are cosines of 0.9 or more in double precision, and no pair below is linked; recall (of the two filters
together) is 0.96 or more for pairs at 0.9 and rises quickly above.

Defined results: vectors that are null, zero, or have null or non-finite components have no links and are their own
component; vectors of different length never link; rows that repeat a vec_id count as separate vectors; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import common

THRESHOLD = 0.9
#: Of the tables and of the collision count, for pairs just at the threshold.
CELL_RECALL, COUNT_RECALL = 0.98, 0.995
LINES = 32
#: Half the window, in chord lengths of a pair at the threshold.
HALF_WINDOW = 1.0
#: Vectors of a cell on average, and vectors of a block.
CELL, BLOCK = 128, 512
#: Pairs that are verified at once.
PAIRS = 20_000
SEED = 20_24


def calibrated_count(lines: int = LINES, half_window: float = HALF_WINDOW, recall: float = COUNT_RECALL) -> int:
    """The largest count that a pair at the threshold reaches with probability `recall`: on one line its difference is
    normal with the chord as standard deviation."""
    p = math.erf(half_window / math.sqrt(2))
    below = 0.0
    for count in range(lines + 1):
        below += math.comb(lines, count) * p**count * (1 - p) ** (lines - count)
        if below > 1 - recall:
            return count
    return lines


def shape(vectors: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """Signs of a cell, and tables."""
    signs = max(2, round(math.log2(max(1, vectors) / CELL)))
    together = (1 - math.acos(threshold) / math.pi) ** signs
    return signs, math.ceil(math.log(1 - CELL_RECALL) / math.log(1 - together))


def cells(x: np.ndarray, signs: int, tables: int) -> np.ndarray:
    """(vectors, tables) cell numbers."""
    planes = np.random.default_rng([SEED, x.shape[1], 1]).standard_normal((x.shape[1], tables * signs))
    bits = (x @ planes > 0).reshape(len(x), tables, signs)
    return bits @ (1 << np.arange(signs, dtype=np.int64))


def collisions(x: np.ndarray, y: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """For every pair of x and y, on how many lines y is in the window centred on x."""
    half = HALF_WINDOW * math.sqrt(2 - 2 * threshold)
    lines = np.random.default_rng([SEED, x.shape[1], 2]).standard_normal((x.shape[1], LINES))
    out = np.zeros((len(x), len(y)), dtype=np.uint8)
    for a, b in zip((x @ lines).T, (y @ lines).T, strict=True):
        order = np.argsort(b, kind="stable")
        rank = np.empty(len(b), dtype=np.int32)
        rank[order] = np.arange(len(b), dtype=np.int32)
        ordered = b[order]
        low, high = np.searchsorted(ordered, a - half, "left"), np.searchsorted(ordered, a + half, "right")
        out += (rank[None, :] >= low[:, None]) & (rank[None, :] < high[:, None])
    return out


def unit(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), dtype=kind).reshape(len(raw), -1).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _block_links(x: np.ndarray, y: np.ndarray, same: bool, table: int, signs: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    near = collisions(x, y) >= calibrated_count()
    if same:
        near = np.triu(near, 1)
    i, j = np.nonzero(near)
    keep = np.zeros(len(i), dtype=bool)
    for at in range(0, len(i), PAIRS):  # only pairs with the count are verified
        part = slice(at, at + PAIRS)
        keep[part] = np.einsum("kd,kd->k", x[i[part]], y[j[part]]) >= THRESHOLD
    i, j = i[keep], j[keep]
    if table and len(i):
        mine = cells(x, signs, tables)[:, :table]
        others = mine if same else cells(y, signs, tables)[:, :table]
        for at in range(0, len(i), 100_000):
            part = slice(at, at + 100_000)
            keep[: len(i)][part] = ~(mine[i[part]] == others[j[part]]).any(axis=1)
        i, j = i[keep[: len(i)]], j[keep[: len(j)]]
    return i, j


def _group_rows(table: int, first: int, second: int, nodes: list[int], counts: list[int], blocks: list[int], raw: list[bytes], signs: int, tables: int, kind: str):
    """(node, links, peer) of the vectors of one pair of blocks."""
    for size in sorted({len(v) for v in raw}):
        own = [k for k, v in enumerate(raw) if len(v) == size]
        x = unit([raw[k] for k in own], kind)
        count, block = (np.array([values[k] for k in own], dtype=np.int64) for values in (counts, blocks))
        left, right = (np.arange(len(own)),) * 2 if first == second else (np.flatnonzero(block == first), np.flatnonzero(block == second))
        if not len(left) or not len(right):
            continue
        i, j = _block_links(x[left], x[right], first == second, table, signs, tables)
        if not len(i):
            continue
        i, j = left[i], right[j]
        links = np.bincount(i, count[j], len(own)) + np.bincount(j, count[i], len(own))
        ranked = sorted(range(len(own)), key=lambda k: nodes[own[k]])
        peer = np.empty(len(own), dtype=np.int64)
        peer[ranked] = np.arange(len(own))
        while True:
            least = peer.copy()
            np.minimum.at(least, i, peer[j])
            np.minimum.at(least, j, peer[i])
            if (least == peer).all():
                break
            peer = least
        for k in np.flatnonzero(links):
            yield nodes[own[k]], int(links[k]), nodes[own[ranked[peer[k]]]]


def _link_rows(signs: int, tables: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, ([], [], [], [])
        done: list[tuple] = []

        def finish():
            if group is not None and len(held[0]) > 1:
                done.extend(_group_rows(group[0], group[2], group[3], *held, signs, tables, kind))

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["node", "links", "peer"])

        for batch in batches:
            for *key, node, count, block, vector in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != group:
                    finish()
                    group, held = key, ([], [], [], [])
                for column, value in zip(held, (node, count, block, vector), strict=True):
                    column.append(value)
            if len(done) > 10_000:
                yield batch_of(done)
                done = []
        finish()
        yield batch_of(done)

    return run


def near_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of (vec_id, embedding)."""
    spark = vectors.sparkSession
    single = vectors.schema["embedding"].dataType.elementType.simpleString() == "float"
    kind = "<f4" if single else "<f8"  # vectors move as they are given; cosines are in double precision
    wide = vectors.select("vec_id", F.col("embedding").cast("array<float>" if single else "array<double>").alias("v"))
    fine = F.coalesce((F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0), F.lit(False))
    wide = wide.withColumn("key", F.when(fine, F.unhex(F.md5(F.col("v").cast("string")))))

    nodes = wide.where("key is not null").groupBy("key").agg(F.count("*").alias("count"), F.min("vec_id").alias("vec_id"), F.first("v").alias("v"))
    nodes = common.stored(nodes.withColumn("node", F.monotonically_increasing_id()), "vectors")  # numbers that stay, as they are written
    signs, tables = shape(nodes.count())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [np.array(v, dtype=kind).tobytes() for v in batch.column(2).to_pylist()]
            found: list = [None] * len(raw)
            for size in {len(v) for v in raw}:
                own = [k for k, v in enumerate(raw) if len(v) == size]
                # Vectors of different length do not meet.
                for k, row in zip(own, cells(unit([raw[k] for k in own], kind), signs, tables) + (size << 40), strict=True):
                    found[k] = row.tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(raw, pa.binary()), pa.array(found, pa.list_(pa.int64()))], ["node", "count", "vector", "cells"])

    placed = common.stored(nodes.select("node", "count", "v").mapInArrow(place, "node bigint, count bigint, vector binary, cells array<bigint>"), "cells")
    sizes = placed.select(F.posexplode("cells").alias("table", "cell")).groupBy("table", "cell").agg(F.count("*").alias("n")).where("n > 1")
    blocks = sizes.select("table", "cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    rows = placed.select("node", "count", "vector", F.posexplode("cells").alias("table", "cell")).join(blocks, ["table", "cell"])
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node", "table"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("table", "cell", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "node", "count", "block", "vector")
    rows = rows.repartition("table", "cell", "first", "second").sortWithinPartitions("table", "cell", "first", "second")
    found = common.stored(rows.mapInArrow(_link_rows(signs, tables, kind), "node bigint, links bigint, peer bigint"), "vector-links")
    common.drop_stored(placed)
    common.release(spark)

    component = common.connected_components(found.select(F.col("node").alias("a"), F.col("peer").alias("b")).where("a <> b"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    table = nodes.select("key", "node", "count", "vec_id").join(links, "node", "left").join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    table = common.stored(table, "vector-classes")
    least = common.stored(table.groupBy("component").agg(F.min("vec_id").alias("component_id")), "vector-least")
    table = common.stored(table.join(least, "component").select("key", (F.coalesce("links", F.lit(0)) + F.col("count") - 1).alias("n_links"), "component_id"), "vector-table")
    out = wide.select("vec_id", "key").join(table, "key", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(common.read(spark, sf_dir, "embeddings", "vec_id", "embedding"))
