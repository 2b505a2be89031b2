"""MinHash near-dedup by ProbMinHash, banding and verification.

A document is a set of shingles of five words, each of weight 1 however often it occurs. Each shingle starts a
Poisson process whose rate is its weight; every arrival goes to one of the registers, and a register keeps the shingle
that reached it first. Two documents agree in a register with their probability Jaccard similarity, which at equal
weights is the Jaccard similarity of their sets, the measure of a link. Arrivals of a shingle
that come later than the latest register cannot matter, so most shingles stop after an arrival or two.

Bands of registers put documents into buckets. In a bucket, pairs are never emitted as such: members are verified against
one leader, the linked are joined into components, and only members still apart are taken further - to other leaders, and
in the end to every member of another component they share a bucket with, so no link is left out because of a leader. In
that last step a task holds one block of a bucket, and another block goes by it a member at a time; pairs whose registers
agree often enough are verified, and links that join components are returned. The largest component of a bucket goes by the
others' blocks and is not compared with itself, so a bucket that is one large class and a few others costs a pass. A link
is a Jaccard similarity of shingle sets of 0.8 or more, counted on the texts: a change of one word takes five shingles, so copies with many
scattered changes are below it and stay apart. Exact copies count as one text throughout.
Leaders with many members are salted.

Defined results: null texts and texts without words are alone in their class; texts of one to four words have one shingle, all their words;
rows that repeat a doc_id with another text are separate documents; a null doc_id is a document whose class is null
unless others are in it; other columns are ignored; an empty table gives an empty result. class_id is the smallest doc_id
of the class, and kept marks the rows that have it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import common

SHINGLE = 5
SIMILARITY = 0.8
#: At similarity 0.8, 1 - (1 - 0.8**6)**20 = 0.998 of pairs share a bucket.
BANDS, ROWS = 20, 6
#: Bands whose buckets get leaders, one turn after the other, before members still apart are compared with all of their
#: bucket. Early turns take few bands: most copies then join a component at the cost of one comparison.
TURNS = ((0, 1), tuple(range(2, BANDS)))
#: Members of a bucket in one block and bytes of their texts, as a mean (a task holds one block), and registers of 120 that must agree for two members still apart to be verified: a
#: pair at similarity 0.8 has fewer with probability 2e-5.
BLOCK, BLOCK_BYTES, AGREE = 4096, 8 << 20, 78
#: Members that one task compares with a leader.
SALT = 512


def shingles(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles and their counts."""
    starts, ends = common.word_edges(data)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    grams = common.Grams(common.word_hashes(data, starts, ends))
    found = grams.all(SHINGLE) if grams.n >= SHINGLE else grams.runs(np.array([0]), np.array([grams.n]))
    return np.unique(found, return_counts=True)


def prob_min_hash(elements: np.ndarray, weights: np.ndarray, registers: int) -> np.ndarray:
    """For each register the element that arrives first."""
    first = np.full(registers, np.inf)
    owner = np.zeros(registers, dtype=np.uint64)
    time, seen = np.zeros(len(elements)), 0
    while len(elements):
        at_once = max(1, registers // len(elements))
        numbers = np.arange(seen + 1, seen + at_once + 1, dtype=np.uint64)
        draws = common.mix(elements[:, None] + numbers[None, :] * np.uint64(0x9E3779B97F4A7C15))
        gaps = -np.log(((draws >> np.uint64(11)).astype(np.float64) + 0.5) / 9007199254740992.0) / weights[:, None]
        arrivals = time[:, None] + np.cumsum(gaps, axis=1)
        places = (common.mix(draws) % np.uint64(registers)).astype(np.int64)
        early = arrivals < first[places]
        when, where, who = arrivals[early], places[early], np.broadcast_to(elements[:, None], arrivals.shape)[early]
        order = np.argsort(-when, kind="stable")  # of several writes to a register the last one, the earliest arrival, stays
        first[where[order]] = when[order]
        owner[where[order]] = who[order]
        time, seen = arrivals[:, -1], seen + at_once
        going = time < first.max()
        elements, weights, time = elements[going], weights[going], time[going]
    return owner


def bands(data: bytes) -> tuple[np.ndarray, bytes] | None:
    """The hash of each band of registers, and a byte of each register; None for a text without words."""
    elements, _ = shingles(data)
    if not len(elements):
        return None
    owner = prob_min_hash(elements, np.ones(len(elements)), BANDS * ROWS).reshape(BANDS, ROWS)
    out = np.zeros(BANDS, dtype=np.uint64)
    for column in owner.T:
        out = common.mix(out * np.uint64(0x9E3779B97F4A7C15) + column)
    return out, (owner.ravel() & np.uint64(255)).astype(np.uint8).tobytes()


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [bands(data) for data in common.text_bytes(batch)]
        lists = pa.array([None if b is None else common.signed(b[0]) for b in found], pa.list_(pa.int64()))
        sketches = pa.array([None if b is None else b[1] for b in found], pa.binary())
        sizes = batch.column(batch.schema.get_field_index("size"))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sizes, lists, sketches], ["doc_id", "key", "size", "bands", "sketch"])


class Held:
    """Members of a block of a bucket, with the texts or, once they are needed, their shingles. Others are compared with them one by
    one, so of those there is one text at a time."""

    def __init__(self, band: int):
        self.band, self.nodes, self.kept = band, [], []
        self.part = np.zeros(64, dtype=np.int64)  # components as far as they are known here
        self.registers, self.earlier = np.zeros((64, BANDS * ROWS), dtype=np.uint8), np.zeros((64, band), dtype=np.int64)
        self.merged: dict[int, int] = {}

    def part_of(self, component: int) -> int:
        while component in self.merged:
            component = self.merged[component]
        return component

    def shingles_of(self, place: int) -> np.ndarray:
        if isinstance(self.kept[place], bytes):
            self.kept[place] = shingles(self.kept[place])[0]
        return self.kept[place]

    def add(self, node: int, component: int, sketch: bytes, own: list, text: bytes) -> None:
        n = len(self.nodes)
        if n == len(self.part):
            self.part, self.registers, self.earlier = (np.concatenate([x, np.zeros_like(x)]) for x in (self.part, self.registers, self.earlier))
        self.part[n], self.registers[n], self.earlier[n] = self.part_of(component), np.frombuffer(sketch, dtype=np.uint8), own[: self.band]
        self.nodes.append(node)
        self.kept.append(text)

    def links(self, node: int, component: int, sketch: bytes, own: list, text: bytes) -> Iterator[tuple[int, int]]:
        """Links that join the member's component to others, of pairs that share no earlier band."""
        n, part = len(self.nodes), self.part_of(component)
        agree = np.count_nonzero(self.registers[:n] == np.frombuffer(sketch, dtype=np.uint8), axis=1)
        near = np.flatnonzero((agree >= AGREE) & (self.part[:n] != part))
        near = near[~(self.earlier[near] == np.array(own[: self.band], dtype=np.int64)).any(axis=1)]
        if not len(near):
            return
        mine = shingles(text)[0]
        for at in range(0, len(near), 64):
            some = near[at : at + 64]
            some = some[self.part[some] != part]
            sizes = np.array([len(self.shingles_of(y)) for y in some.tolist()], dtype=np.int64)
            fits = 5 * np.minimum(sizes, len(mine)) >= 4 * np.maximum(sizes, len(mine))
            some, sizes = some[fits], sizes[fits]
            if not len(some):
                continue
            theirs = np.concatenate([self.shingles_of(y) for y in some.tolist()])
            found = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
            both = np.add.reduceat(found.astype(np.int64), np.cumsum(sizes) - sizes)
            for y in some[both >= SIMILARITY * (len(mine) + sizes - both)].tolist():
                other = int(self.part[y])
                if other != part:
                    low, high = min(part, other), max(part, other)
                    self.merged[high] = low
                    self.part[:n][self.part[:n] == high] = low
                    part = low
                    yield self.nodes[y], node


def _apart_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (band, value, first, second, place) to links that join components. Members of the first block are held, those of
    the second go by; where both are one block, each member goes by those before it and is held."""
    group, held = None, Held(0)
    for batch in batches:
        out: tuple[list, list] = ([], [])
        *keys, places, nodes, components, sketches, bands_of = (c.to_pylist() for c in batch.columns[:-1])
        for *key, place, node, component, sketch, own, text in zip(*keys, places, nodes, components, sketches, bands_of, common.text_bytes(batch), strict=True):
            if key != group:
                group, held = key, Held(key[0])
            member = node, component, sketch, own, text
            if place or key[2] == key[3]:
                for a, b in held.links(*member):
                    out[0].append(a)
                    out[1].append(b)
            if not place:
                held.add(*member)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b"])


def in_blocks(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """band, value, first, second, place, node, component: members of buckets with several components, once for each pair of
    blocks they are in. The component of a bucket with most bytes has blocks of its own that meet the other blocks only.
    Also the stored table of buckets, to be dropped."""
    parts = labelled.groupBy("band", "value", "component").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    top = F.max(F.struct("bytes", "component", "n"))
    buckets = parts.groupBy("band", "value").agg(F.count("*").alias("parts"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), top.alias("top")).where("parts > 1")

    def blocks(n: Column, size: Column) -> Column:
        return F.ceil(F.greatest(n / BLOCK, size / BLOCK_BYTES)).cast("int")

    top_n, top_bytes = F.col("top.n"), F.col("top.bytes")
    buckets = common.stored(buckets.select("band", "value", F.col("top.component").alias("top"), blocks(top_n, top_bytes).alias("large"), blocks(F.col("n") - top_n, F.col("bytes") - top_bytes).alias("small")), "blocks")
    here = labelled.join(buckets, ["band", "value"])
    large, place = F.col("component") == F.col("top"), F.xxhash64("node", "band")
    here = here.withColumn("block", F.when(large, F.col("small") + F.pmod(place, F.col("large"))).otherwise(F.pmod(place, F.col("small"))).cast("int"))
    here = here.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("small") - 1 + F.when(large, 0).otherwise(F.col("large")))))
    first = F.least("block", "other")
    return here.select("band", "value", first.alias("first"), F.greatest("block", "other").alias("second"), (F.col("block") > first).cast("int").alias("place"), "node", "component"), buckets


def _verify_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (a, salt, leader first) to the pairs that are similar."""
    group = leader = None
    for batch in batches:
        out: tuple[list, list] = ([], [])
        for a, salt, b, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), common.text_bytes(batch), strict=True):
            if (a, salt) != group:
                group, leader = (a, salt), shingles(data)[0]
                if a == b:
                    continue
            mine = shingles(data)[0]
            both = len(np.intersect1d(leader, mine, assume_unique=True))
            if both >= SIMILARITY * (len(leader) + len(mine) - both):
                out[0].append(a)
                out[1].append(b)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b"])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are similar; a's text goes once to each group of its members."""
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT).cast("int").alias("salts"))
    members = pairs.join(salts, "a").select("a", F.pmod(F.hash("b"), F.col("salts")).alias("salt"), "b", F.lit(1).alias("place"))
    leaders = salts.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("a").alias("b"), F.lit(0).alias("place"))
    rows = members.unionByName(leaders).join(texts, F.col("b") == F.col("node")).select("a", "salt", "b", "text", "place")
    rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "place").drop("place")
    return rows.mapInArrow(common.lean(_verify_rows), "a bigint, b bigint")


def text_key(text: str = "text") -> Column:
    """128 bits that stand for a text."""
    return F.unhex(F.md5(text))


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, component) of all texts that are linked to others, and (doc_id, key, node) of all rows; a node numbers a text
    with words, a component is the smallest node in it."""
    spark = docs.sparkSession
    rows = common.stored(docs.select("doc_id", text_key().alias("key"), F.octet_length("text").cast("bigint").alias("size"), "text").mapInArrow(common.lean(_band_rows), "doc_id bigint, key binary, size bigint, bands array<bigint>, sketch binary"), "bands")
    nodes = rows.where("bands is not null").groupBy("key").agg(F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("size").alias("size"), F.min("doc_id").alias("doc_id"))
    nodes = common.stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")  # numbers that stay, as they are written
    buckets = nodes.select("node", "size", F.posexplode("bands").alias("band", "value"))
    full = common.stored(buckets.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1").select("band", "value"), "full")
    buckets = common.stored(buckets.join(full, ["band", "value"]), "buckets")
    # One row of each text that meets another; texts themselves move once.
    chosen = nodes.join(buckets.select("node").distinct(), "node", "left_semi").select("key", "node", "doc_id")
    texts = docs.where("text is not null").select(text_key().alias("key"), "doc_id", "text").alias("t").join(chosen.alias("c"), (F.col("t.key") == F.col("c.key")) & F.col("t.doc_id").eqNullSafe(F.col("c.doc_id")))
    texts = common.stored(texts.select("c.node", "t.text").dropDuplicates(["node"]), "texts")
    common.release(spark)

    links, tested, component = None, None, None
    made = [full, buckets, texts, rows, nodes]  # tables that go at the end
    for turn, used in enumerate((*TURNS, ())):
        labelled = buckets if component is None else buckets.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
        if component is None:
            labelled = labelled.withColumn("component", F.col("node"))
        if used:
            labelled = labelled.where(F.col("band").isin(*used))
            # A leader of each bucket: the member with the least hash, another one every turn.
            order = F.struct(F.xxhash64("node", F.lit(turn)), F.col("node"), F.col("component"))
            leader = labelled.groupBy("band", "value").agg(F.min(order).alias("l"), F.min("component").alias("c"), F.max("component").alias("d")).where("c < d")
            pairs = labelled.join(leader.select("band", "value", F.col("l.node").alias("a"), F.col("l.component").alias("ca")), ["band", "value"])
            pairs = pairs.where("component <> ca").select("a", F.col("node").alias("b"))
        else:
            placed, blocks = in_blocks(labelled)
            made.append(blocks)
            order = ["band", "value", "first", "second"]
            sketched = placed.join(nodes.select("node", "sketch", "bands"), "node").join(texts, "node").select(*order, "place", "node", "component", "sketch", "bands", "text")
            sketched = sketched.repartition(*order).sortWithinPartitions(*order, "place")
            found = common.stored(sketched.mapInArrow(common.lean(_apart_rows), "a bigint, b bigint"), "links")
            made.append(found)
            links = found if links is None else links.unionByName(found)
            component = common.connected_components(links)
            break
        pairs = pairs.distinct()
        if tested is not None:
            known = tested.unionByName(tested.select(F.col("b").alias("a"), F.col("a").alias("b")))
            pairs = pairs.join(known, ["a", "b"], "left_anti")
        pairs = common.stored(pairs, "pairs")
        made.append(pairs)
        if pairs.isEmpty():
            continue
        found = common.stored(verified(pairs, texts), "links")
        made.append(found)
        links = found if links is None else links.unionByName(found)
        tested = pairs if tested is None else tested.unionByName(pairs)
        if not found.isEmpty():
            component = common.connected_components(links)
        common.release(spark)
    if component is None:
        component = spark.createDataFrame([], "node bigint, component bigint")
    numbered = common.stored(rows.select("doc_id", "key").join(nodes.select("key", "node"), "key", "left"), "numbered")
    common.drop_stored(*made)
    return component, numbered


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, key, component, class_id, kept of every row; the component is null for a text without words."""
    component, rows = classes(docs)
    labelled = rows.join(component, "node", "left").select("doc_id", "key", F.coalesce("component", "node").alias("component"))
    labelled = common.stored(labelled, "labelled")
    common.drop_stored(rows)
    # Stored, so that the join of a large class is split.
    least = common.stored(labelled.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("class_id")), "classes")
    out = labelled.join(least, "component", "left").select("doc_id", "key", "component", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents that stay: of each class the one with the smallest doc_id. Repeats of its row go too."""
    marked = near_duplicates(docs).where("kept and component is not null")
    first = marked.groupBy("component").agg(F.min(F.struct("doc_id", "key")).alias("f")).select("f.doc_id", "f.key")
    # Texts without words are no copies of one another; they stay.
    worded = F.coalesce(F.col("text"), F.lit("")).rlike(common.WORD_PATTERN)
    keyed = docs.select("doc_id", text_key().alias("key"), worded.alias("worded"), F.struct(*docs.columns).alias("row"))
    single = keyed.where("worded").alias("d").join(first.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.key") == F.col("f.key")), "left_semi")
    return single.dropDuplicates(["doc_id", "key"]).select("row.*").unionByName(docs.where(~worded))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.read(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")
