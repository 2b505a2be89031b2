"""Audit of how the sources of a language differ in their terms, by mergeable radix tries.

Terms are runs of ASCII letters and non-ASCII characters; only A to Z are lower-cased. A language keeps the terms that at
least LEAST_DOCS of its documents hold. With p the smoothed share of a kept term in a group (p of its source, q of another
source or of the whole language, in units of 1e-9), f = floor((p - q)**2 / (p + q)) tells how much the two differ there.

1. Each partition of documents counts its terms in one byte trie per language (term_trie), whose leaves count documents and
   occurrences by source. Texts are cut into terms and counted by numpy and Arrow, CHUNK bytes at once, so that a distinct
   term goes down the trie once for many documents. A trie that grows over HELD leaves is handed on and another begun, so
   memory is bounded.
2. Tries are cut into blocks by prefix. Prefixes with more than MOST leaves are cut one byte deeper, until none is.
3. Blocks are dealt by ranges of prefixes; the blocks of one prefix merge into one trie, and its walk in byte order gives
   the kept terms with their counts. A term's counts meet in one task as one leaf for each trie, however frequent it is.
   Counts are columns by the numbers of the leaves throughout, summed up by numpy.
4. Totals follow by partial sums. The kept terms of a language are dealt by hash to spans of about SPAN terms, so that a
   prefix with very many of them is not one task's. A second walk in byte order, span by span, adds up f for every pair of
   sources and keeps each source's best terms; equal values stand in byte order. Sources are taken in tiles of at most TILE,
   so that a language with very many sources needs no large table in a task.

Counts and shares are whole numbers throughout; shares are divided in three steps of 1000, exact for totals up to 9e15.

Defined results: null text, lang and source are ''; repeated rows count again; a language of one source has no pairs; one
without kept terms has pairs of value 0 and no terms; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.llm import common
from tesserae.llm.term_trie import Counted, blocks, opened, summed

LEAST_DOCS, BEST = 10, 10
#: Leaves a task holds before it hands its tries on; leaves of a prefix that is not cut deeper; bytes of the first cut.
HELD, MOST, DEPTH = 500_000, 200_000, 3
#: Bytes of texts that are counted at once.
CHUNK = 4_000_000
#: Sources compared in one task; terms taken at once; terms of a span, as a mean at most.
TILE, TERMS_AT_ONCE, SPAN = 256, 2048, 2048
SCALE = 1_000_000_000

#: UTF-8 with A to Z in lower case and spaces between terms: all bytes of non-ASCII characters are above 0x7F.
_SPACED = bytes(c if c > 0x7F or chr(c).islower() else ord(chr(c).lower()) if chr(c).isupper() else 0x20 for c in range(256))

_BLOCK = pa.schema([("lang", pa.string()), ("prefix", pa.binary()), ("leaves", pa.int64()), ("sources", pa.list_(pa.string())), ("block", pa.binary())])
_BLOCK_DDL = "lang string, prefix binary, leaves bigint, sources array<string>, block binary"
_KEPT = pa.schema([("lang", pa.string()), ("term", pa.string()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
_KEPT_DDL = "lang string, term string, sources array<string>, counts array<bigint>"
_FOUND = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])
_FOUND_DDL = "lang string, source string, part string, item string, value bigint"


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


# --------------------------------------------------------------------------- counting


def terms(texts: list[bytes]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The terms of texts, one after another, and each one's text."""
    data = b" ".join(texts).translate(_SPACED)
    starts, ends = common.word_edges(data)
    offsets = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data.translate(None, b" "))])
    after = np.cumsum([len(text) + 1 for text in texts])
    return found.dictionary_encode(), np.searchsorted(after, starts, side="right")


def neighbours_share(terms: pa.LargeBinaryArray) -> np.ndarray:
    """The bytes, at most 64, that each of some sorted terms has in common with the one before."""
    offsets, data = (np.frombuffer(b, dtype) for b, dtype in zip(terms.buffers()[1:], (np.int64, np.uint8), strict=True))
    offsets = offsets[terms.offset : terms.offset + len(terms) + 1]
    starts, lengths = offsets[:-1], np.diff(offsets)
    shared = np.zeros(len(terms), dtype=np.int64)
    alike = np.arange(1, len(terms))
    for k in range(64):
        alike = alike[(lengths[alike] > k) & (lengths[alike - 1] > k)]
        alike = alike[data[starts[alike] + k] == data[starts[alike - 1] + k]]
        shared[alike] = k + 1
    return shared


def _blocks(lang: str, leaves: tuple, names: list[str], depth: int) -> Iterator[tuple]:
    """Leaves in byte order as rows of _BLOCK, one for each prefix of `depth` bytes; shorter terms are their own prefix."""
    terms, shared, *_ = leaves
    starts = [i for i, k in enumerate(shared) if k < depth or i == 0]
    for start, end, block in zip(starts, [*starts[1:], len(terms)], blocks(*leaves, names, starts), strict=True):
        yield (lang, terms[start][:depth], end - start, *block)


class Partition:
    """The tries of a partition of documents."""

    def __init__(self):
        self.tries: dict[str, Counted] = {}
        self.groups: dict[tuple[str, str], int] = {}
        self.waiting: list[tuple] = []
        self.pending = 0

    def documents(self, langs: list[str], sources: list[str], texts: list[bytes]) -> None:
        """Count the terms of some texts: distinct terms, and the group, term, occurrences and documents of each pair."""
        found, text = terms(texts)
        n = len(found.dictionary)
        if n:
            word = found.indices.to_numpy().astype(np.int64)
            group = np.array([self.groups.setdefault(g, len(self.groups)) for g in zip(langs, sources, strict=True)], dtype=np.int64)
            pairs, counts = np.unique(group[text] * n + word, return_counts=True)
            once = np.unique(text * n + word, return_counts=True)[0]  # with counts numpy sorts, else it hashes, which takes longer
            docs = np.unique(group[once // n] * n + once % n, return_counts=True)[1]  # of the same pairs
            self.waiting.append((found.dictionary, pairs // n, pairs % n, counts, docs))
            self.pending += len(pairs)

    def settle(self) -> int:
        """Take the waiting counts into the tries; the number of leaves then."""
        if self.waiting:
            words, group, word, counts, docs = zip(*self.waiting, strict=True)
            self.waiting, self.pending = [], 0
            before = np.cumsum([0, *map(len, words)])
            words = pa.concat_arrays(words).dictionary_encode()
            order = pc.array_sort_indices(words.dictionary)
            ranks = np.empty(len(order), dtype=np.int64)
            ranks[order.to_numpy()] = np.arange(len(order))
            rank = ranks[words.indices.to_numpy()[np.concatenate([w + n for w, n in zip(word, before, strict=False)])]]
            in_order, group, counts, docs = words.dictionary.take(order), *map(np.concatenate, (group, counts, docs))
            langs = {lang: i for i, lang in enumerate(dict.fromkeys(lang for lang, _ in self.groups))}
            lang = np.array([langs[lang] for lang, _ in self.groups])[group]
            by_lang = np.argsort(lang, kind="stable")
            ends = np.cumsum(np.bincount(lang, minlength=len(langs)))
            for name, of in zip(langs, np.split(by_lang, ends[:-1]), strict=True):
                if len(of):
                    self._enter(name, in_order, rank[of], group[of], counts[of], docs[of])
        return sum(t.trie.leaves for t in self.tries.values())

    def _enter(self, lang: str, words: pa.LargeBinaryArray, rank: np.ndarray, group: np.ndarray, counts: np.ndarray, docs: np.ndarray) -> None:
        counted = self.tries.setdefault(lang, Counted())
        held, docs = summed(rank, docs)
        words = words.take(pa.array(held))
        leaves = counted.trie.enter(zip(words.to_pylist(), neighbours_share(words).tolist(), strict=True))
        counted.take(leaves, docs, leaves[np.searchsorted(held, rank)], group, counts)

    def blocks(self, depth: int) -> Iterator[tuple]:
        self.settle()
        names = [source for _, source in self.groups]
        while self.tries:
            lang = next(iter(self.tries))
            leaves = self.tries.pop(lang).columns()  # the trie goes before its leaves are packed
            yield from _blocks(lang, leaves, names, depth)
        self.groups = {}


def _sent(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    out = []
    for row in rows:
        out.append(row)
        if len(out) == size:
            yield _rows(out, schema)
            out = []
    if out:
        yield _rows(out, schema)


def _count(held: int, depth: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # tries have no cycles, and are large to go through
        part = Partition()
        for batch in batches:
            langs, sources, texts, size = batch.column(0).to_pylist(), batch.column(1).to_pylist(), [], 0
            for i, text in enumerate(common.text_bytes(batch), 1):
                texts.append(text)
                size += len(text)
                if size >= CHUNK or i == len(batch):
                    part.documents(langs[i - len(texts) : i], sources[i - len(texts) : i], texts)
                    texts, size = [], 0
                    if part.pending > held and part.settle() > held:
                        yield from _sent(part.blocks(depth), _BLOCK)
        yield from _sent(part.blocks(depth), _BLOCK)
        gc.enable()

    return count


def _cut_deeper(depth: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from _sent(_blocks(row["lang"], opened(row["block"]), row["sources"], depth), _BLOCK)

    return cut


def counted(docs: DataFrame, held: int = HELD, most: int = MOST, depth: int = DEPTH) -> tuple[list[DataFrame], list[DataFrame]]:
    """The blocks of all partitions' tries, cut so that no prefix has more than `most` leaves, and the stored tables that
    they are read from. A prefix of one table goes deeper or stays whole, so no two of the tables of blocks share one."""
    texts = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    blocks, done, tables = common.stored(texts.mapInArrow(_count(held, depth), _BLOCK_DDL), "term-blocks"), [], []
    while True:
        tables.append(blocks)
        full = blocks.where(F.octet_length("prefix") == depth).groupBy("lang", "prefix").agg(F.sum("leaves").alias("all")).where(F.col("all") > most)
        heavy = common.stored(full.select("lang", "prefix"), "heavy-prefixes")
        tables.append(heavy)
        if heavy.isEmpty():
            return [*done, blocks], tables
        depth += 1
        deeper = blocks.join(heavy, ["lang", "prefix"], "left_semi").select(*_BLOCK.names).mapInArrow(_cut_deeper(depth), _BLOCK_DDL)
        done.append(blocks.join(heavy, ["lang", "prefix"], "left_anti").select(*_BLOCK.names))
        blocks = common.stored(deeper, "term-blocks")


# --------------------------------------------------------------------------- merging


class Prefix:
    """The blocks of a prefix, merged into one trie."""

    def __init__(self):
        self.counted, self.names, self.parts = Counted(), {}, []

    def block(self, sources: list[str], block: bytes) -> None:
        terms, shared, docs, widths, ids, counts = opened(block)
        leaves = self.counted.trie.enter(zip(terms, shared, strict=True))
        names = np.array([self.names.setdefault(s, len(self.names)) for s in sources], dtype=np.int64)
        self.parts.append((leaves, docs, np.repeat(leaves, widths), names[ids], counts))

    def kept(self, least: int) -> Iterator[tuple[str, list[str], list[int]]]:
        """The terms that enough documents hold, with sources and counts."""
        if self.parts:
            self.counted.take(*map(np.concatenate, zip(*self.parts, strict=True)))
        terms, _, _, widths, ids, counts = self.counted.columns(least)
        names, pair = list(self.names), 0
        sources, counts = [names[i] for i in ids.tolist()], counts.tolist()
        for term, width in zip(terms, widths.tolist(), strict=True):
            yield term.decode(), sources[pair : pair + width], counts[pair : pair + width]
            pair += width


def _merge(least: int):
    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        gc.disable()
        key, prefix = ("", b""), Prefix()
        for batch in batches:
            for row in batch.to_pylist():
                if (row["lang"], row["prefix"]) != key:
                    for kept in prefix.kept(least):
                        yield (key[0], *kept)
                    key, prefix = (row["lang"], row["prefix"]), Prefix()
                prefix.block(row["sources"], row["block"])
        for kept in prefix.kept(least):
            yield (key[0], *kept)
        gc.enable()

    return lambda batches: _sent(merged(batches), _KEPT)


def kept_terms(blocks: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """lang, term, sources, counts of the terms that enough documents hold."""
    dealt = blocks.repartitionByRange(common.partitions_for(blocks.sparkSession), "lang", "prefix").sortWithinPartitions("lang", "prefix")
    return dealt.mapInArrow(_merge(least), _KEPT_DDL)


def in_spans(kept: DataFrame, langs: DataFrame, most: int = SPAN) -> tuple[DataFrame, DataFrame]:
    """The kept terms, each with a span of its language, and all spans. `langs`: lang, kept (its number of kept terms)."""
    sized = langs.select("lang", F.ceil(F.col("kept") / most).alias("spans"))
    terms = kept.join(sized, "lang").withColumn("span", F.pmod(F.xxhash64("term"), "spans")).drop("spans")
    return terms, sized.select("lang", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("spans") - 1)).alias("span"))


# --------------------------------------------------------------------------- shares and differences


def shares(counts: np.ndarray, totals: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * counts / totals), three digits at a time."""
    out, rest = np.divmod(counts, totals)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, totals)
        out = out * 1000 + more
    return out + 1


def differences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


class Tiles:
    """Sums of f for the pairs of two tiles of a language's sources, and the best terms of the sources of one tile."""

    def __init__(self, lang: str, same: bool, best: int):
        self.lang, self.same, self.best = lang, same, best
        self.names: list[list[str]] = [[], []]
        self.ready = False

    def header(self, side: int, names: list[str], totals: list[int], kept: int, lang_total: int) -> None:
        self.names[side] = names
        spread = np.array(totals, dtype=np.int64) + 2 * kept
        if side == 0:
            self.spread = [spread, spread]
            self.lang_spread = lang_total + 2 * kept
            if self.same:
                self.names[1] = names
        else:
            self.spread[1] = spread
        self.at = [{name: i for i, name in enumerate(side)} for side in self.names]
        self.sums = np.zeros((len(self.names[0]), len(self.names[1])), dtype=np.int64)
        self.top: list[list[tuple[int, str]]] = [[] for _ in self.names[0]]
        self.waiting: list[tuple[str, list[str], list[int]]] = []

    def term(self, term: str, sources: list[str], counts: list[int]) -> None:
        self.waiting.append((term, sources, counts))
        if len(self.waiting) == TERMS_AT_ONCE:
            self.take()

    def take(self) -> None:
        rows, self.waiting = self.waiting, []
        if not rows:
            return
        counts = [np.zeros((len(rows), len(names)), dtype=np.int64) for names in self.names]
        for side in (0,) if self.same else (0, 1):
            at, matrix = self.at[side], counts[side]
            for i, (_, sources, held) in enumerate(rows):
                for source, n in zip(sources, held, strict=True):
                    k = at.get(source)
                    if k is not None:
                        matrix[i, k] = n
        p = [shares(c + 2, spread) for c, spread in zip(counts, self.spread, strict=True)]
        if self.same:
            p[1] = p[0]
        for i in range(len(self.names[0])):
            first = i + 1 if self.same else 0
            if first < len(self.names[1]):
                self.sums[i, first:] += differences(p[0][:, i : i + 1], p[1][:, first:]).sum(axis=0)
        if self.same:
            q = shares(np.array([sum(held) for _, _, held in rows], dtype=np.int64) + 2, self.lang_spread)
            for i in range(len(self.names[0])):
                rising = np.flatnonzero((counts[0][:, i] > 0) & (p[0][:, i] > q))
                values = differences(p[0][rising, i], q[rising])
                order = np.argsort(-values, kind="stable")[: self.best]  # terms come in byte order, so ties stay in it
                new = [(-int(values[k]), rows[rising[k]][0]) for k in order]
                if new:
                    self.top[i] = sorted(self.top[i] + new, key=lambda x: (x[0], x[1].encode()))[: self.best]

    def found(self) -> Iterator[tuple]:
        self.take()
        for i, source in enumerate(self.names[0]):
            for j in range(i + 1 if self.same else 0, len(self.names[1])):
                yield (self.lang, source, "pair", self.names[1][j], int(self.sums[i, j]))
                yield (self.lang, self.names[1][j], "pair", source, int(self.sums[i, j]))
            for value, term in self.top[i]:
                yield (self.lang, source, "term", term, -value)


def _compare(best: int):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        key, tiles = None, None
        for batch in batches:
            for row in batch.to_pylist():
                here = (row["lang"], row["a"], row["b"], row["span"])
                if here != key:
                    if tiles:
                        yield from tiles.found()
                    key, tiles = here, Tiles(row["lang"], row["a"] == row["b"], best)
                if row["kind"] < 2:
                    tiles.header(row["kind"], row["sources"], row["counts"], row["kept"], row["lang_total"])
                else:
                    tiles.term(row["term"], row["sources"], row["counts"])
        if tiles:
            yield from tiles.found()

    return lambda batches: _sent(found(batches), _FOUND, 10_000)


def source_divergence(docs: DataFrame, least: int = LEAST_DOCS, best: int = BEST, tile: int = TILE, held: int = HELD, most: int = MOST) -> DataFrame:
    """lang, source, part, item, value, rank: every other source of the language (part pair) and the best terms (part term)."""
    groups = common.stored(docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct(), "groups")
    blocks, tables = counted(docs, held, most)
    kept = common.stored(kept_terms(reduce(DataFrame.unionByName, blocks), least), "kept-terms")
    common.drop_stored(*tables)

    # Totals of groups and languages, and the sources of a language in tiles.
    sums = kept.select("lang", F.explode(F.arrays_zip(F.col("sources").alias("source"), F.col("counts").alias("n"))).alias("c")).groupBy("lang", "c.source").agg(F.sum("c.n").alias("total"))
    langs = sums.groupBy("lang").agg(F.sum("total").alias("lang_total")).join(kept.groupBy("lang").agg(F.count("*").alias("kept")), "lang")
    placed = groups.withColumn("tile", F.floor((F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1) / tile).cast("int"))
    tiled = placed.join(sums, ["lang", "source"], "left").join(langs, "lang")
    tiles = tiled.groupBy("lang", "tile", "kept", "lang_total").agg(F.sort_array(F.collect_list(F.struct("source", F.coalesce("total", F.lit(0)).alias("total")))).alias("held"))
    tiles = common.stored(tiles.select("lang", "tile", "kept", "lang_total", F.col("held.source").alias("sources"), F.col("held.total").alias("counts")), "tiles")

    # Each (language, two tiles, span) gets the tiles' totals, then its terms in byte order.
    pairs = tiles.select("lang", F.col("tile").alias("a")).join(tiles.select("lang", F.col("tile").alias("b")), "lang").where("a <= b")
    spread, spans = in_spans(kept, tiles.where("tile = 0"))
    places = spans.join(pairs, "lang")
    none = F.lit(None).cast("string").alias("term")
    heads = [
        places.join(tiles, (places["lang"] == tiles["lang"]) & (places[side] == tiles["tile"])).where("a < b" if kind else "true").select(places["lang"], "a", "b", "span", F.lit(kind).alias("kind"), none, "sources", "counts", "kept", "lang_total")
        for kind, side in enumerate("ab")
    ]
    rows = spread.join(pairs, "lang").select("lang", "a", "b", "span", F.lit(2).alias("kind"), "term", "sources", "counts", F.lit(0).cast("bigint").alias("kept"), F.lit(0).cast("bigint").alias("lang_total"))
    everything = heads[0].unionByName(heads[1]).unionByName(rows)
    key = ["lang", "a", "b", "span"]
    dealt = everything.repartition(common.partitions_for(docs.sparkSession), *key).sortWithinPartitions(*key, "kind", "term")
    found = dealt.mapInArrow(_compare(best), _FOUND_DDL)

    other = groups.select("lang", F.col("source").alias("item"))
    unequal = groups.join(other, "lang").where("source <> item").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("bigint").alias("value"))
    values = found.unionByName(unequal).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranked = values.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    out = common.stored(ranked.where((F.col("part") == "pair") | (F.col("rank") <= best)), "divergence")
    common.drop_stored(groups, kept, tiles)
    return out


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(common.read(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, COALESCE(lang, '') AS lang, COALESCE(source, '') AS source,
         regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
found AS (SELECT row, lang, source, unnest(words) AS term FROM docs),
kept AS (SELECT lang, term FROM found GROUP BY ALL HAVING count(DISTINCT row) >= 10),
sizes AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM found SEMI JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
totals AS (SELECT lang, source, COALESCE(sum(n), 0)::HUGEINT AS total FROM groups LEFT JOIN counts USING (lang, source) GROUP BY ALL),
whole AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM counts GROUP BY ALL),
lang_totals AS (SELECT lang, sum(n)::HUGEINT AS total FROM whole GROUP BY lang),
p AS (
  SELECT k.lang, t.source, k.term, COALESCE(c.n, 0) AS n, 1 + (1000000000 * (COALESCE(c.n, 0) + 2)) // (t.total + 2 * s.v) AS p
  FROM kept k JOIN totals t USING (lang) JOIN sizes s USING (lang) LEFT JOIN counts c ON c.lang = k.lang AND c.source = t.source AND c.term = k.term),
q AS (
  SELECT w.lang, w.term, 1 + (1000000000 * (w.n + 2)) // (t.total + 2 * s.v) AS q
  FROM whole w JOIN lang_totals t USING (lang) JOIN sizes s USING (lang)),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, COALESCE(s.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
best AS (
  SELECT p.lang, p.source, 'term' AS part, p.term AS item, (((p.p - q.q) * (p.p - q.q)) // (p.p + q.q))::BIGINT AS value
  FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item COLLATE "binary" ASC)::INT AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM best))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
