"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

The terms of a text are its lower-case words. Fitting takes a bounded sample of labelled documents (SAMPLE, those with the
least hash of doc_id). Every term of the sample counts, with weight term frequency (one plus its logarithm) times inverse
document frequency among all documents times relevance: FLOOR plus the cube of the logarithm of the term's smoothed label
rate over the label's rate in the sample, where that is above 0. Sampled texts with the same term counts are one example
with a count of labels.

Examples are kept in a block-max inverted index: they are ordered by their heaviest term and cut into blocks. Postings of
rare terms are added up at once; a common term has, by block, its largest weight and its postings (as columns). What a block's
examples have from rare terms, and query weight times block maximum for the common ones, bound the cosines of the block; blocks are
scored from the largest bound on, and the postings of blocks bounded below the k-th best cosine are never touched. The k nearest are exact. Votes of neighbours are weighted by distance, and the vote is mapped to a probability by
isotonic regression on leave-one-out votes of the sample. The nearest examples' doc_ids are the evidence. The index is
bounded by SAMPLE, and is broadcast.

Labels are taken from rows only whose crc32(doc_id) mod 4 is not 2. Defined results: null and empty texts, and texts with
none of the terms, get the rate of the label among sampled texts without terms; rows of labels with a null are ignored, and
so are doc_ids with both labels; of rows that repeat a labelled doc_id one is an example; of equally near examples those
first in the index are the neighbours; no labels at all give score 0; repeated rows are scored alike; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import common

SAMPLE = 2_048
NEIGHBOURS = 15
CUTOFF = 0.3
#: Examples of a block of the index, blocks scored at first, and queries that go through the index together.
BLOCK, FIRST_BLOCKS, BATCH = 32, 8, 64
#: A term that more than one example in so many has is a column.
COMMON = 16
#: Documents by which a term's label rate is drawn to the label's rate, and the relevance of a term that tells nothing.
PRIOR_DOCUMENTS, FLOOR = 20.0, 0.02
_WORDS = re.compile(r"\w+")

Vector = tuple[np.ndarray, np.ndarray]  # terms, ascending, and their weights


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


def weighted(terms: np.ndarray, counts: np.ndarray, weight: np.ndarray) -> Vector:
    """The unit vector of a text's term counts."""
    raw = (1.0 + np.log(counts)) * weight[terms]
    norm = math.sqrt(float(raw @ raw))
    return (terms, raw / norm) if norm else (terms[:0], raw[:0])


def expanded(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ranges starts[k] .. starts[k] + sizes[k], one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class BlockMaxIndex:
    """Unit vectors in blocks. Terms that more than one vector in COMMON has are columns of a matrix for each block, and each
    block has the largest weight of each; the postings of the other terms are lists shorter than a block's worth of bounds."""

    def __init__(self, vectors: list[Vector], terms: int, block: int = BLOCK):
        self.n, self.block, self.blocks = len(vectors), block, -(-len(vectors) // block)
        #: Positions are numbers in the index; order has the number of the vector at each.
        self.order = np.array(sorted(range(self.n), key=lambda k: (int(vectors[k][0][vectors[k][1].argmax()]), -float(vectors[k][1].max()), k)), dtype=np.int64)
        sizes = [len(vectors[k][0]) for k in self.order]
        term = np.concatenate([np.zeros(0, np.int64), *(vectors[k][0] for k in self.order)])
        weight = np.concatenate([np.zeros(0), *(vectors[k][1] for k in self.order)])
        where = np.repeat(np.arange(self.n), sizes)
        found = np.bincount(term, minlength=terms)
        often = np.flatnonzero(COMMON * found > self.n)
        self.column = np.full(terms, -1, dtype=np.int32)
        self.column[often] = np.arange(len(often))
        common = self.column[term] >= 0
        matrices = np.zeros((self.blocks * block, len(often)))
        matrices[where[common], self.column[term[common]]] = weight[common]
        self.matrices = matrices.reshape(self.blocks, block, len(often)).transpose(0, 2, 1).copy()
        self.tops = self.matrices.max(axis=2).T.copy() if self.blocks else np.zeros((len(often), 0))
        by_term = np.argsort(term[~common], kind="stable")
        self.weight, self.where = weight[~common][by_term], where[~common][by_term].astype(np.int32)
        self.starts = np.searchsorted(term[~common][by_term], np.arange(terms + 1)).astype(np.int32)
        self.scored = self.bounded = 0  # blocks that were, so far

    def nearest(self, queries: list[Vector], k: int) -> list[Vector]:
        """For each query the k vectors of largest cosine above 0, in order, and the cosines."""
        if not self.blocks or not queries:
            return [(np.zeros(0, dtype=np.int64), np.zeros(0)) for _ in queries]
        dense, cosines = np.zeros((len(queries), len(self.tops))), np.zeros((len(queries), self.blocks * self.block))
        for q, (terms, weights) in enumerate(queries):
            column = self.column[terms]
            dense[q, column[column >= 0]] = weights[column >= 0]
            terms, weights = terms[column < 0], weights[column < 0]
            sizes = self.starts[terms + 1] - self.starts[terms]
            postings = expanded(self.starts[terms], sizes)
            cosines[q] = np.bincount(self.where[postings], self.weight[postings] * np.repeat(weights, sizes), cosines.shape[1])
        cosines = cosines.reshape(len(queries), self.blocks, self.block)
        bound = (cosines.max(axis=2) + dense @ self.tops) * (1 + 1e-9)
        first = np.sort(bound, axis=1)[:, -min(FIRST_BLOCKS, self.blocks), None]
        done, now = np.zeros(bound.shape, dtype=bool), bound >= first
        while now.any():
            for block in np.flatnonzero(now.any(axis=0)):
                here = np.flatnonzero(now[:, block])
                cosines[here, block] += dense[here] @ self.matrices[block]
            done |= now
            found = np.where(done[:, :, None], cosines, 0.0).reshape(len(queries), -1)
            least = np.partition(found, max(0, found.shape[1] - k), axis=1)[:, max(0, found.shape[1] - k)]
            now = ~done & (bound >= least[:, None]) & (bound > 0)
        self.scored, self.bounded = self.scored + int(done.sum()), self.bounded + done.size
        out = []
        for row, cut in zip(found, least, strict=True):
            near = np.flatnonzero((row > 0) & (row >= cut))
            near = near[np.argsort(-row[near], kind="stable")[:k]]
            out.append((self.order[near], np.minimum(row[near], 1.0)))
        return out


class Examples:
    """Labelled vectors with counts of labels, and the vote of those near a text."""

    def __init__(self, vectors: list[Vector], terms: int, positive: list[int], total: list[int], doc_ids: list[int], rest: tuple[int, int]):
        self.positive, self.total, self.doc_ids = np.array(positive, dtype=float), np.array(total, dtype=float), doc_ids
        self.rest = rest  # labels of examples without terms
        seen, good = self.total.sum() + rest[1], self.positive.sum() + rest[0]
        self.prior = good / seen if seen else 0.0
        self.index = BlockMaxIndex(vectors, terms)
        self.steps: tuple[np.ndarray, np.ndarray] | None = None

    def near(self, queries: list[Vector]) -> Iterator[Vector]:
        for at in range(0, len(queries), BATCH):
            yield from self.index.nearest(queries[at : at + BATCH], NEIGHBOURS)

    def vote(self, who: np.ndarray, cosine: np.ndarray, without: tuple[int, int] | None = None) -> float:
        """The distance-weighted vote of neighbours; without: (example, label) that is left out."""
        good, total = self.positive[who], self.total[who]
        rest = self.rest
        if without is not None:
            if without[0] < 0:
                rest = rest[0] - without[1], rest[1] - 1
            else:
                own = who == without[0]
                good, total = good - own * without[1], total - own
        if not len(who):
            return (rest[0] + self.prior) / (rest[1] + 1.0)
        weight = cosine / (1.05 - cosine) * (total > 0)
        share = (good + self.prior) / (total + 1.0)
        return float((weight @ share + 0.5 * self.prior) / (weight.sum() + 0.5))

    def calibrate(self, vectors: list[Vector]) -> None:
        """Isotonic regression of labels on leave-one-out votes, by pooling adjacent violators."""
        rows = []  # (vote, label, count)
        none = np.zeros(0, dtype=np.int64), np.zeros(0)
        for n, near in enumerate(self.near([*vectors, none])):
            good, total = (int(self.positive[n]), int(self.total[n])) if n < len(vectors) else self.rest
            for label, count in ((1, good), (0, total - good)):
                if count:
                    rows.append((self.vote(*near, (n if n < len(vectors) else -1, label)), label, count))
        rows.sort()
        pools: list[list[float]] = []  # [sum of labels, count, sum of votes]
        for vote, label, count in rows:
            pools.append([label * count, count, vote * count])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
        self.steps = np.array([p[2] / p[1] for p in pools]), np.array([p[0] / p[1] for p in pools])

    def probability(self, vote: float) -> float:
        """The calibrated rate, smoothed by one more vote of the neighbours: (rate + vote) / 2 keeps order within a step."""
        rate = float(np.interp(vote, *self.steps)) if self.steps is not None and len(self.steps[0]) else vote
        return min(1.0, max(0.0, 0.5 * (rate + vote)))


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The terms of this task's texts."""
    seen: set[str] = set()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            seen.update(words_of(text))
    terms = list(seen)
    for at in range(0, len(terms), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(terms[at : at + 50_000], pa.string())], ["term"])


class Vocabulary:
    """Numbers of the known terms."""

    def __init__(self, terms: list[str]):
        self.number = {t: k for k, t in enumerate(terms)}

    def numbers(self, text: str | None) -> list[int]:
        """The known terms of a text, as often as they occur."""
        return [n for n in map(self.number.get, words_of(text)) if n is not None]

    def counts(self, text: str | None) -> Vector:
        return np.unique(np.array(self.numbers(text), dtype=np.int64), return_counts=True)


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic") -> tuple[list[str], np.ndarray, Examples]:
    """The terms of the sample, their weights, and the examples."""
    spark = docs.sparkSession
    label = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min(column).alias("label"), F.max(column).alias("other"))
    sample = label.where("label = other").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).select("doc_id", "label")
    sample = common.stored(sample, "sample")
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most SAMPLE pairs of numbers
    chosen = common.stored(chosen.groupBy("doc_id").agg(F.first("label").cast("int").alias("label"), F.min(F.coalesce("text", F.lit(""))).alias("text")), "examples")
    terms: list[str] = chosen.select("text").mapInArrow(common.lean(_term_rows), "term string").distinct().toArrow().sort_by("term").column("term").to_pylist()
    shared = spark.sparkContext.broadcast(terms)

    def frequency_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, seen, n = Vocabulary(shared.value), Counter(), 0
        for batch in batches:
            for text in batch.column(0):
                seen.update(set(vocabulary.numbers(text.as_py())))
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([-1, *seen], pa.int64()), pa.array([n, *seen.values()], pa.int64())], ["term", "n"])

    def vector_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(shared.value)
        for batch in batches:
            found = [vocabulary.counts(text.as_py()) for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([f[k].tolist() for f in found], pa.list_(pa.int32())) for k in (0, 1))], ["doc_id", "label", "term", "n"])

    every, frequency = 0, np.zeros(len(terms))
    if terms:
        counts = docs.select("text").mapInArrow(common.lean(frequency_rows), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # at most one row a term
        number, n = (counts.column(c).to_numpy() for c in ("term", "n"))
        every = n[number < 0].sum()
        frequency[number[number >= 0]] = n[number >= 0]
    vectors = chosen.mapInArrow(common.lean(vector_rows), "doc_id bigint, label int, term array<int>, n array<int>")
    vectors = vectors.groupBy("term", "n").agg(F.sum("label").alias("good"), F.count("*").alias("total"), F.min("doc_id").alias("doc_id")).toArrow().sort_by("doc_id")  # at most SAMPLE texts
    empty = pc.equal(pc.list_value_length(vectors.column("term")), 0)
    rest = [(r["good"], r["total"]) for r in vectors.filter(empty).select(["good", "total"]).to_pylist()]
    vectors = vectors.filter(pc.invert(empty))
    good, total, doc_ids = (vectors.column(c).to_pylist() for c in ("good", "total", "doc_id"))
    listed = [(np.array(t.as_py(), dtype=np.int64), np.array(n.as_py(), dtype=np.int64)) for t, n in zip(vectors.column("term"), vectors.column("n"), strict=True)]
    with_label, with_term = np.zeros(len(terms)), np.zeros(len(terms))
    for (t, _), g, n in zip(listed, good, total, strict=True):
        with_label[t] += g
        with_term[t] += n
    rate = sum(good) / sum(total) if sum(good) else 1.0
    relevance = np.maximum(0.0, np.log((with_label + PRIOR_DOCUMENTS * rate) / (with_term + PRIOR_DOCUMENTS) / rate)) ** 3
    weight = (np.log((1 + every) / (1 + frequency)) + 1) * (FLOOR + relevance)
    unit = [weighted(t, n, weight) for t, n in listed]
    examples = Examples(unit, len(terms), good, total, doc_ids, rest[0] if rest else (0, 0))
    examples.calibrate(unit)
    shared.unpersist()
    common.drop_stored(sample, chosen)
    common.release(spark)
    return terms, weight, examples


def score(docs: DataFrame, labels: DataFrame, *keep: Column) -> DataFrame:
    """doc_id, score, evidence, and the columns `keep`, of every row."""
    spark = docs.sparkSession
    fitted = spark.sparkContext.broadcast(fit(docs, labels))
    taken = docs.select("doc_id", "text", *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weight, examples = fitted.value
        vocabulary = Vocabulary(terms)
        known: dict[bytes, tuple[float, list[int]]] = {}
        for batch in batches:
            texts = [text.as_py() or "" for text in batch.column(1)]
            keys = [hashlib.blake2b(text.encode()).digest() for text in texts]
            new = {key: text for key, text in zip(keys, texts, strict=True) if key not in known}
            vectors = [weighted(*vocabulary.counts(text), weight) for text in new.values()]
            for key, near in zip(new, examples.near(vectors), strict=True):
                known[key] = examples.probability(examples.vote(*near)), [examples.doc_ids[w] for w in near[0][:3].tolist()]
            rows = [known[key] for key in keys]
            if len(known) > 20_000:
                known.clear()
            columns = [batch.column(0), pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.list_(pa.int64())), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "evidence", *batch.schema.names[2:]])

    kept = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in taken.schema.fields[2:])
    return taken.mapInArrow(common.lean(run), f"doc_id bigint, score double, evidence array<bigint>{kept}")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents below the cutoff, with the columns of docs, whatever their names."""
    scored = score(docs, labels, F.struct(*docs.columns).alias("row"))
    return scored.where(F.col("score") < CUTOFF).select("row.*")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"), "evidence")
