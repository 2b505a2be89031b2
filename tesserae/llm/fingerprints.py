"""SimHash fingerprints, documents next to each other compared, and search within a Hamming radius; DataFrame operations only.

Terms are words (weight 1) and pairs of neighbouring words (weight 2), as often as they occur. A term's 128 hash bits vote
on the bits of the fingerprint with its weight, for 1 or against it; a bit is 1 if the votes for it are more than half.
Two fingerprints agree in a share of bits that falls with the angle between the weighted terms, so the share is their
likeness. Votes are added where a document's words are: the texts are dealt by row once, and words never are.

A long holds two counters of votes, for two bits 32 apart, so that 64 sums do for 128 bits; a counter holds the votes of
700 million words.

Search: the bits are cut into blocks. Two fingerprints that differ in at most `radius` bits agree in all but `radius`
blocks, so for each choice of the blocks left over there is a table keyed by the bits of those blocks, put in front, and
equal keys meet. A pair counts in the first table in which it meets, so each is found once. Equal fingerprints are one row
with their number.

The next document is the one that follows by doc_id; after the last comes the first. Rows are dealt by ranges of doc_id,
sorted within a range, and a range's last row takes the first of the next range. Only the head that a document takes of
the next one travels, not its text.

Defined results: null texts are empty, and a text without words has a fingerprint of zeros; a null doc_id stands first, rows
that share a doc_id stand by a hash of their text; rows repeated exactly stand in one place and give equal rows; a lone
document is its own next; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.llm import common

BITS, RADIUS, BLOCKS = 128, 3, 5
WORD_WEIGHT, PAIR_WEIGHT = 1, 2
QUERY_EVERY = 50

_LANES = 0x0000000100000001
_LOW = 0xFFFFFFFF


# --------------------------------------------------------------------------- fingerprints


def _halves(term_hash: Column) -> list[Column]:
    """128 bits of a term as two longs."""
    return [term_hash, F.xxhash64(term_hash)]


def fingerprints(texts: DataFrame, key: str | list[str], text: str = "text") -> DataFrame:
    """key, high, low: the fingerprints of texts as two longs each, one for every key (a column or several), whatever the words
    in its rows. Texts that are dealt by a column of the key are summed up where they are."""
    key = [key] if isinstance(key, str) else key
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(common.WORD_PATTERN), F.lit(0))
    zipped = F.transform(F.array(words), lambda w: F.arrays_zip(w.alias("word"), F.slice(w, 2, F.greatest(F.size(w), F.lit(1))).alias("after")))[0]
    pairs = texts.select(*key, F.inline_outer(zipped).alias("word", "after"))
    hashed = pairs.select(
        *key,
        *[h.alias(f"w{i}") for i, h in enumerate(_halves(F.xxhash64("word")))],
        *[h.alias(f"p{i}") for i, h in enumerate(_halves(F.xxhash64("word", "after")))],
        F.when(F.col("word").isNotNull(), WORD_WEIGHT).otherwise(0).cast("bigint").alias("word_weight"),
        F.when(F.col("after").isNotNull(), PAIR_WEIGHT).otherwise(0).cast("bigint").alias("pair_weight"),
    )

    def votes(half: int, bit: int) -> Column:
        one = lambda h: F.shiftright(h, bit).bitwiseAND(F.lit(_LANES))
        return F.sum(one(F.col(f"w{half}")) * F.col("word_weight") + one(F.col(f"p{half}")) * F.col("pair_weight")).alias(f"v{half}_{bit}")

    counted = hashed.groupBy(*key).agg(F.sum(F.col("word_weight") + F.col("pair_weight")).alias("all"), *[votes(half, bit) for half in range(2) for bit in range(32)])

    def bits(half: int) -> Column:
        out = F.lit(0).cast("bigint")
        for bit in range(32):
            packed = F.col(f"v{half}_{bit}")
            for place, count in ((bit, packed.bitwiseAND(F.lit(_LOW))), (bit + 32, F.shiftrightunsigned(packed, 32))):
                out = out.bitwiseOR(F.when(2 * count > F.col("all"), F.lit(1 << place if place < 63 else -1 << 63)).otherwise(F.lit(0)).cast("bigint"))
        return out

    return counted.select(*key, bits(0).alias("high"), bits(1).alias("low"))


def as_text(high: str, low: str) -> Column:
    return F.concat(*[F.lower(F.lpad(F.hex(c), 16, "0")) for c in (high, low)])


def distance(high_a: str, low_a: str, high_b: str, low_b: str) -> Column:
    """The number of bits in which two fingerprints differ."""
    return F.bit_count(F.col(high_a).bitwiseXOR(F.col(high_b))) + F.bit_count(F.col(low_a).bitwiseXOR(F.col(low_b)))


# --------------------------------------------------------------------------- search


def block_masks(radius: int = RADIUS, blocks: int = BLOCKS) -> list[tuple[int, int]]:
    """For each table the bits of its key, as signed longs (high, low)."""
    if not 0 <= radius < blocks:
        raise ValueError("a table needs a block that the differing bits leave equal")
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    out = []
    for chosen in itertools.combinations(range(blocks), blocks - radius):
        mask = sum((1 << edges[i + 1]) - (1 << edges[i]) for i in chosen)
        out.append((signed(mask >> 64), signed(mask & (1 << 64) - 1)))
    return out


def _tabled(prints: DataFrame, masks: list[tuple[int, int]]) -> DataFrame:
    keys = [F.struct(F.lit(i).alias("table"), F.col("high").bitwiseAND(F.lit(h)).alias("key_high"), F.col("low").bitwiseAND(F.lit(lo)).alias("key_low")) for i, (h, lo) in enumerate(masks)]
    return prints.select("*", F.explode(F.array(*keys)).alias("t")).select("*", "t.*").drop("t")


def neighbours(queries: DataFrame, prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """query_high, query_low, high, low, bits: every distinct fingerprint of `prints` within the radius of a distinct one of
    `queries` (both high, low), itself included."""
    masks = block_masks(radius, blocks)
    asked = _tabled(queries.select("high", "low").distinct(), masks).select(F.col("high").alias("query_high"), F.col("low").alias("query_low"), "table", "key_high", "key_low")
    held = _tabled(prints.select("high", "low").distinct(), masks)
    met = asked.join(held, ["table", "key_high", "key_low"]).withColumn("bits", distance("query_high", "query_low", "high", "low")).where(F.col("bits") <= radius)
    high, low = F.col("query_high").bitwiseXOR(F.col("high")), F.col("query_low").bitwiseXOR(F.col("low"))
    equal = [F.when((high.bitwiseAND(F.lit(h)) == 0) & (low.bitwiseAND(F.lit(lo)) == 0), i) for i, (h, lo) in enumerate(masks)]
    return met.where(F.col("table") == F.coalesce(*equal)).select("query_high", "query_low", "high", "low", "bits")


# --------------------------------------------------------------------------- next documents


def next_documents(docs: DataFrame) -> DataFrame:
    """key, doc_id, n_chars, copies, next_key: one row per distinct (doc_id, text), named by a hash of both."""
    n_chars = F.length(F.coalesce("text", F.lit(""))).cast("bigint")
    rows = docs.select("doc_id", _key().alias("key"), n_chars.alias("n_chars")).groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min("n_chars").alias("n_chars"), F.count("*").alias("copies"))
    ranged = rows.repartitionByRange(common.partitions_for(docs.sparkSession), F.col("doc_id").asc_nulls_first(), F.col("key").asc())
    rows = common.stored(ranged.withColumn("span", F.spark_partition_id()), "ordered")
    within, spans = Window.partitionBy("span").orderBy(F.col("doc_id").asc_nulls_first(), "key"), Window.orderBy("span")
    firsts = rows.groupBy("span").agg(F.min(F.struct("doc_id", "key")).alias("first"))  # one row a range
    following = F.coalesce(F.lead("first.key").over(spans), F.first("first.key").over(spans.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    firsts = firsts.select("span", following.alias("following"))
    out = rows.withColumn("next_key", F.lead("key").over(within)).join(firsts, "span").withColumn("next_key", F.coalesce("next_key", "following")).drop("span", "following")
    out = common.stored(out, "next-documents")
    common.drop_stored(rows)
    return out


def _key() -> Column:
    return F.unhex(F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.coalesce("text", F.lit(""))), 256))


def edited_documents(docs: DataFrame, order: DataFrame) -> DataFrame:
    """key, text, edited: the last quarter of each text replaced by the head of the next one, as long or all of it."""
    text = F.coalesce("text", F.lit(""))
    texts = docs.select(_key().alias("key"), text.alias("text")).dropDuplicates(["key"])
    wanted = order.select(F.col("next_key").alias("key"), F.col("key").alias("for_key"), F.floor(F.col("n_chars") / 4).cast("int").alias("quarter"))
    heads = texts.join(wanted, "key").select(F.col("for_key").alias("key"), F.expr("substring(text, 1, quarter)").alias("head"), "quarter")
    return texts.join(heads, "key").select("key", "text", F.concat(F.expr("substring(text, 1, char_length(text) - quarter)"), F.col("head")).alias("edited"))


def document_fingerprints(docs: DataFrame, radius: int = RADIUS, every: int = QUERY_EVERY) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and n_near: of documents whose
    doc_id `every` divides, how many other documents have a fingerprint within the radius (null for the rest)."""
    order = next_documents(docs)
    edited = edited_documents(docs, order)
    both = edited.select("key", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("text")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))).alias("t"))
    prints = fingerprints(both.select("key", "t.kind", "t.text"), ["key", "kind"])  # no shuffle: the texts lie by key
    pick = lambda kind, column: F.max(F.when(F.col("kind") == kind, F.col(column)))
    wide = prints.groupBy("key").agg(*[pick(kind, column).alias(("", "edited_")[kind] + column) for kind in range(2) for column in ("high", "low")])
    told = common.stored(edited.select("key", F.sha2("edited", 256).alias("edited_sha256")).join(wide, "key"), "prints")
    follow = told.select(F.col("key").alias("next_key"), F.col("high").alias("next_high"), F.col("low").alias("next_low"))
    rows = order.join(told, "key").join(follow, "next_key")
    asks = F.col("doc_id") % every == 0
    held = rows.groupBy("high", "low").agg(F.sum("copies").alias("documents"), F.max(asks).alias("asked"))
    near = neighbours(held.where("asked"), held, radius).join(held, ["high", "low"]).groupBy("query_high", "query_low").agg(F.sum("documents").alias("within"))
    near = near.select(F.col("query_high").alias("high"), F.col("query_low").alias("low"), "within")
    like = lambda *columns: 1 - distance("high", "low", *columns) / F.lit(float(BITS))
    rows = rows.join(near, ["high", "low"], "left").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text("high", "low").alias("fingerprint"),
        as_text("edited_high", "edited_low").alias("edited_fingerprint"),
        like("edited_high", "edited_low").alias("near_edited"),
        like("next_high", "next_low").alias("near_next"),
        F.when(asks, F.col("within") - 1).alias("n_near"),
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
    )
    out = common.stored(rows.drop("copy"), "fingerprints")
    common.drop_stored(order, told)
    return out


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fingerprints(common.read(spark, sf_dir, "documents"))
