"""Audit of how quality filters overlap: what each removes in every order, and its Shapley share, from one polynomial.

A document is a mask of the filters it fails. Let filter i be on with probability x_i: the expected number of documents
removed is a multilinear polynomial in x, the multilinear extension of the removal game, and the counts of the masks give
its coefficients. Everything else is read from it:

* at a corner (filters on or off) it is the number removed, so its total less that is the number of survivors;
* the integral of its derivative by x_i along the diagonal from 0 to 1 is filter i's Shapley value, the mean of what it
  removes over all orders. Integrals are exact rationals; times the number of orders they are whole numbers.

Spark works out the masks and counts them by part and mask: at most 32 rows a part, whatever its size. Each part's
polynomials are then evaluated in the task that holds its counts.

Defined results: null texts are empty; a null source is the part ''; of labels that repeat a doc_id the largest counts, and
documents without a label are neither good nor toxic. A document is a copy if any smaller doc_id has its text: rows
that share a doc_id are not copies of each other, and a row without a doc_id is neither a copy nor an original. A part
appears if a row has it; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from fractions import Fraction
from math import factorial

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import common

FILTERS = "ABCDE"
#: Parameters of the filters.
LEAST_WORDS, DISTINCT_SHARE, CAPITAL_SHARE, SYMBOLS = 50, 65, 5, r"[#$%&*|]"

SCHEMA = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"


class Removal:
    """The removal polynomial of one part: `terms` maps a set of filters (as bits) to the coefficient of its monomial."""

    def __init__(self, counts: Sequence[int], filters: int):
        """counts[mask]: documents that fail just the filters of mask. 1 - prod(1 - x_i) over the mask's filters, expanded
        and summed, gives the monomial T the number of documents that fail all of T, with alternating sign."""
        failing = list(counts)
        for i in range(filters):
            for mask in range(len(failing)):
                if not mask >> i & 1:
                    failing[mask] += failing[mask | 1 << i]
        self.filters = filters
        self.terms = {t: n if t.bit_count() % 2 else -n for t, n in enumerate(failing) if t and n}

    def at(self, corner: int) -> int:
        """Removed when just the filters of `corner` are on."""
        return sum(c for t, c in self.terms.items() if t & corner == t)

    def shapley(self, i: int) -> Fraction:
        """The integral over s from 0 to 1 of the derivative by x_i at (s, ..., s): a monomial T with i becomes s**(|T| - 1)."""
        return sum((Fraction(c, t.bit_count()) for t, c in self.terms.items() if t >> i & 1), Fraction(0))


def orders(filters: str = FILTERS) -> list[str]:
    return ["".join(order) for order in itertools.permutations(filters)]


def part_rows(part: str, counts: Sequence[tuple[int, int, int, int]], filters: str = FILTERS) -> list[tuple]:
    """SCHEMA's rows of one part from its (mask, documents, good, toxic)."""
    by_mask = [[0] * (1 << len(filters)) for _ in range(3)]
    for mask, *numbers in counts:
        for column, n in zip(by_mask, numbers, strict=True):
            column[mask] += int(n)
    everyone, good, toxic = (Removal(c, len(filters)) for c in by_mask)
    total, whole = sum(by_mask[0]), (1 << len(filters)) - 1
    removed, good_removed, toxic_removed = ([p.at(corner) for corner in range(whole + 1)] for p in (everyone, good, toxic))
    shares = [everyone.shapley(i) * factorial(len(filters)) for i in range(len(filters))]
    if any(share.denominator != 1 for share in shares):
        raise ArithmeticError("a Shapley share over all orders is no whole number")
    out = []
    for order in orders(filters):
        before = 0
        for step, letter in enumerate(order, 1):
            i = filters.index(letter)
            now = before | 1 << i
            here = removed[now] - removed[before]
            out.append((part, order, step, total - removed[now], here, removed[1 << i] - here, removed[whole] - removed[whole ^ 1 << i],
                        good_removed[now] - good_removed[before], toxic_removed[now] - toxic_removed[before], int(shares[i])))
            before = now
    return out


def _audit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [field.split()[0] for field in SCHEMA.split(", ")]
    for batch in batches:
        for part, counts in zip(batch["part"], batch["counts"], strict=True):
            yield pd.DataFrame(part_rows(part, [(c["mask"], c["n"], c["good"], c["toxic"]) for c in counts]), columns=names)


def own_failures(text: Column) -> Column:
    """The mask of the filters a text fails by itself: all but the last letter, copies."""
    words = F.regexp_extract_all(text, F.lit(common.WORD_PATTERN), F.lit(0))
    n = F.size(words)
    fails = [
        n < LEAST_WORDS,
        100 * F.size(F.array_distinct(words)) < DISTINCT_SHARE * n,
        100 * F.regexp_count(text, F.lit("[A-Z]")) > CAPITAL_SHARE * F.length(text),
        text.rlike(SYMBOLS),
    ]
    return sum((F.when(fail, 1 << i).otherwise(0) for i, fail in enumerate(fails)), F.lit(0))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic. Copies are told by a join on (text, first doc_id), which no group of copies makes hot."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), own_failures(text).alias("mask"))
    rows = common.stored(rows, "masks")
    first = rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("original", F.lit(True))
    marked = labels.groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    copy = F.col("doc_id").isNotNull() & F.col("original").isNull()
    mask = F.col("mask") + F.when(copy, 1 << FILTERS.index("E")).otherwise(0)
    judged = rows.join(first, ["digest", "doc_id"], "left").join(marked, "doc_id", "left").select("part", mask.alias("mask"), "good", "toxic")
    counts = judged.groupBy("part", "mask").agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    out = common.stored(counts, "mask-counts")
    common.drop_stored(rows)
    return out


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """SCHEMA: for every part, order and step, what the step's filter removes and its Shapley share."""
    parts = mask_counts(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))
    return parts.mapInPandas(_audit, SCHEMA)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH marked AS (
  SELECT doc_id, max((quality IS NOT DISTINCT FROM 1)::INT) AS good, max((toxic IS NOT DISTINCT FROM 1)::INT) AS toxic FROM labels GROUP BY doc_id),
docs AS (
  SELECT doc_id, COALESCE(source, '') AS part, COALESCE(text, '') AS text,
         regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
judged AS (
  SELECT doc_id, part,
         (len(words) < 50)::INT AS a,
         (100 * len(list_distinct(words)) < 65 * len(words))::INT AS b,
         (100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text))::INT AS c,
         regexp_matches(text, '[#$%&*|]')::INT AS d,
         COALESCE(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS e FROM docs),
counts AS (
  SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS mask, count(*) AS n, COALESCE(sum(good), 0) AS good, COALESCE(sum(toxic), 0) AS toxic
  FROM judged LEFT JOIN marked USING (doc_id) GROUP BY ALL),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) l(name, bit)),
orders AS (
  SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
steps AS (
  SELECT filter_order, step, bits[step] AS bit, COALESCE(list_sum(bits[:step - 1]), 0)::INT AS earlier FROM orders, generate_series(1, 5) s(step)),
told AS (
  SELECT part, filter_order, step::INT AS step, bit,
         sum(CASE WHEN mask & (earlier | bit) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & earlier = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & earlier > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & earlier = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & earlier = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM told
"""
