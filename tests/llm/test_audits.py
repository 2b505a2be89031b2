"""Source divergence, fingerprints and the filter audit, against brute force on small tables and SQL on whole ones."""

import hashlib
import itertools
import os
import random
import re
import sys
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import pyarrow as pa
import pytest
import xxhash

from tesserae.llm import common, filter_audit, fingerprints, registry, source_divergence
from tesserae.llm.term_trie import TermTrie, packed, unpacked

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, key int, term string, span int, mask int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, rows):
    """Documents with other columns whose names the operators use for their own."""
    return spark.createDataFrame([(*row, None, i, "x", i, i) for i, row in enumerate(rows)], DOCS)


def some_rows(seed=5, n=120):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "béta", "gamma", "ab", "abc", "abd", "Ünder", "x1y", "#tag", "日本", "日", "THE", "the", "a"]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 40, 80])))
        rows.append((i * 7 % 113, text, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", "", None])))
    rows += [(500, None, "en", "s1"), (501, "", "en", "empty"), (502, "only here", "zz", "lone"), (None, "alpha beta", "en", "s1"), (None, "alpha beta", "en", "s1")]
    rows += [(503, "the same text " * 30, "en", "s2")] * 3 + [(504 + i, "the same text " * 30, "en", "s2") for i in range(40)] + [(600, "lang " * 30_000, "fr", "s9")]
    return rows


def matches_sql(spark, name):
    got = registry.queries()[name](spark, SMALL)
    columns = sorted(got.columns)
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert Counter(map(tuple, got.select(*columns).collect())) == Counter(want)


# --------------------------------------------------------------------------- source divergence


def divergence(rows, least, best):
    group, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        group[lang, source].update(found)
        docs[lang].update(set(found))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        whole = sum((group[g] for g in groups if g[0] == lang), Counter())

        def share(counts):
            total = sum(counts[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 2) // total for t in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {g: share(group[g]) for g in groups if g[0] == lang}, share(whole)
        for g in p:
            pairs = [(sum(f(p[g][t], p[o][t]) for t in kept), o[1]) for o in p if o != g]
            best_terms = [(f(p[g][t], q[t]), t) for t in kept if group[g][t] and p[g][t] > q[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", best_terms, best)):
                for rank, (value, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.add((*g, part, item, value, rank))
    return out


@pytest.mark.parametrize("limits", [{}, {"tile": 2, "held": 20, "most": 3}])
def test_divergence_against_brute_force(spark, limits):
    """With small limits tries are handed on, prefixes cut deeper, sources compared in several tiles."""
    rows = some_rows()
    got = source_divergence.source_divergence(table(spark, rows).repartition(5), least=4, best=3, **limits).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == divergence(rows, 4, 3)


def test_divergence_in_several_spans(spark, monkeypatch):
    monkeypatch.setattr(source_divergence.in_spans, "__defaults__", (3,))
    rows = some_rows()
    assert Counter(map(tuple, source_divergence.source_divergence(table(spark, rows).repartition(5), least=4, best=3, tile=2).collect())) == Counter(divergence(rows, 4, 3))


def test_divergence_without_kept_terms(spark):
    rows = [(1, "one", "en", "b"), (2, None, "en", "a"), (3, "", "en", "c")]
    got = {tuple(r) for r in source_divergence.source_divergence(table(spark, rows)).collect()}
    assert got == divergence(rows, 10, 10) and len(got) == 6 and {r[4] for r in got} == {0}
    assert source_divergence.source_divergence(table(spark, [])).collect() == []


def test_divergence_matches_sql(spark):
    matches_sql(spark, "op11_source_divergence")


def test_tries_merge():
    rng = random.Random(3)
    terms = ["".join(rng.choice("abé") for _ in range(rng.randint(1, 6))).encode() for _ in range(400)]
    one, whole = [TermTrie(), TermTrie()], TermTrie()
    for i, term in enumerate(terms):
        one[i % 2].add(term, 1, [f"s{i % 3}"], [i])
        whole.add(term, 1, [f"s{i % 3}"], [i])
    one[0].merge(one[1])
    leaves = [[(t, n.docs, dict(n.counts)) for t, _, n in trie.walk()] for trie in (one[0], whole)]
    assert leaves[0] == leaves[1] and [t for t, *_ in leaves[0]] == sorted(set(terms)) and one[0].leaves == len(set(terms))
    names, block = packed([(t, k, n.docs, n.counts, n.counts.values()) for t, k, n in whole.walk()])
    assert [(t, d, dict(zip(s, n, strict=True))) for t, _, d, s, n in unpacked(names, block)] == leaves[1]
    ordered = [t for t, *_ in leaves[1]]
    assert [k for _, k, _ in whole.walk()] == [0] + [len(os.path.commonprefix(pair)) for pair in itertools.pairwise(ordered)]


def calls_of(work):
    """The result, and the number of function calls, of Python and of C, that it took."""
    calls = Counter()
    sys.setprofile(lambda frame, event, arg: calls.update([event]))
    try:
        out = work()
    finally:
        sys.setprofile(None)
    return out, calls["call"] + calls["c_call"]


def term_rows(batches):
    return {(r["lang"], t, d, tuple(sorted(zip(s, n, strict=True)))) for b in batches for r in b.to_pylist() for t, _, d, s, n in unpacked(r["sources"], r["block"])}


def term_batch(rows):
    return pa.RecordBatch.from_pydict({"lang": [r[0] for r in rows], "source": [r[1] for r in rows], "text": [r[2] for r in rows]})


def test_counts_of_sources_take_no_calls_each():
    """Counting and merging take fewer calls than there are pairs of term and source."""
    words = [a + "xx" + b + c for a in "abcdefghij" for b in "klmnopqrst" for c in "uvwxyz"]
    batch, pairs = term_batch([("en", f"s{i}", " ".join(words)) for i in range(30)]), 30 * len(words)
    count = lambda: list(source_divergence._count(10**6, 3)(iter([batch])))
    count()  # imports
    blocks, calls = calls_of(count)
    assert term_rows(blocks) == {("en", w.encode(), 30, tuple(sorted((f"s{i}", 1) for i in range(30)))) for w in words} and calls < pairs
    rows = sorted((tuple(r.values()) for b in blocks for r in b.to_pylist()), key=lambda r: r[1])
    again = source_divergence._rows([r for r in rows for _ in range(8)], source_divergence._BLOCK)
    kept, calls = calls_of(lambda: list(source_divergence._merge(240)(iter([again]))))
    assert {(r["term"], *sorted(zip(r["sources"], r["counts"], strict=True))) for b in kept for r in b.to_pylist()} == {(w, *sorted((f"s{i}", 8) for i in range(30))) for w in words} and calls < 8 * pairs
    assert not any(len(b) for b in source_divergence._merge(241)(iter([again])))


@pytest.mark.parametrize(("held", "chunk"), [(10**6, 10**6), (10**6, 300), (40, 300), (1, 1)])
def test_tries_of_chunks_add_up(monkeypatch, held, chunk):
    """Terms and their counts are the same however many chunks and tries they come in; long terms and no terms as well."""
    monkeypatch.setattr(source_divergence, "CHUNK", chunk)
    rows = [(lang or "", source or "", text) for _, text, lang, source in some_rows()[:-1]]
    rows += [(f"l{i % 7}", f"s{i % 3}", "x" * (60 + i) + " " + "X" * 64 + "\x7fé\x00e\xa0[Z`z{@") for i in range(20)] + [("none", "s", "123 \n"), ("none", "s", None)]
    batches = list(source_divergence._count(held, 3)(term_batch(rows[i : i + 50]) for i in range(0, len(rows), 50)))
    want, docs = defaultdict(Counter), Counter()
    for lang, source, text in rows:
        found = re.findall(rb"[a-z\x80-\xff]+", (text or "").encode().lower())
        docs.update((lang, t) for t in set(found))
        for t in found:
            want[lang, t][source] += 1
    counts, n_docs = defaultdict(Counter), Counter()
    for b in batches:
        for r in b.to_pylist():
            leaves = list(unpacked(r["sources"], r["block"]))
            assert len(leaves) == r["leaves"] and {t[:3] for t, *_ in leaves} == {r["prefix"]} and [t for t, *_ in leaves] == sorted({t for t, *_ in leaves})
            for t, _, d, s, n in leaves:
                n_docs[r["lang"], t] += d
                counts[r["lang"], t].update(dict(zip(s, n, strict=True)))
    assert counts == want and n_docs == docs


def test_terms_of_one_prefix_are_dealt_to_many_spans(spark):
    kept = spark.createDataFrame([("en", f"abc{i}é", ["s"], [i]) for i in range(3000)] + [("fr", "abc", ["s"], [1])], source_divergence._KEPT_DDL)
    terms, spans = source_divergence.in_spans(kept, spark.createDataFrame([("en", 3000), ("fr", 1)], "lang string, kept bigint"), most=500)
    n = Counter((r.lang, r.span) for r in terms.collect())
    assert sum(n.values()) == 3001 and len(n) == 7 and max(n.values()) < 2 * 500
    assert sorted(map(tuple, spans.collect())) == sorted(n)


def test_shares_of_large_counts():
    import numpy as np

    counts, total = [2, 10**12 + 7, 8 * 10**15 - 1], 9 * 10**15 - 3
    assert source_divergence.shares(np.array(counts), np.int64(total)).tolist() == [1 + 1_000_000_000 * c // total for c in counts]


# --------------------------------------------------------------------------- fingerprints


def print_of(text):
    words, ones, total = [w.encode() for w in WORD.findall(text or "")], [0] * 128, 0
    for i, word in enumerate(words):
        hashes = [(xxhash.xxh64_intdigest(word, seed=42), 1)]
        if i + 1 < len(words):
            hashes.append((xxhash.xxh64_intdigest(words[i + 1], seed=hashes[0][0]), 2))
        for h, weight in hashes:
            total += weight
            for half, value in enumerate((h, xxhash.xxh64_intdigest(h.to_bytes(8, "little"), seed=42))):
                for bit in range(64):
                    ones[64 * half + bit] += weight * (value >> bit & 1)
    return "".join(f"{sum(1 << b for b in range(64) if 2 * ones[64 * half + b] > total):016x}" for half in range(2))


def differing(a, b):
    return (int(a, 16) ^ int(b, 16)).bit_count()


def test_fingerprints_against_brute_force(spark):
    rows = some_rows()[:-1] + [(700, "word " * 20_000, "en", "s1")]
    got = fingerprints.document_fingerprints(table(spark, rows).repartition(5), radius=3, every=10).collect()
    keyed = lambda doc_id, text: hashlib.sha256(f"{'null' if doc_id is None else doc_id}:{text or ''}".encode()).digest()
    order = sorted({(r[0] is not None, r[0] or 0, keyed(r[0], r[1]), r[1] or "") for r in rows})
    copies = Counter((r[0] is not None, r[0] or 0, keyed(r[0], r[1]), r[1] or "") for r in rows)
    prints = {row: print_of(row[3]) for row in order}
    want = Counter()
    for i, row in enumerate(order):
        after, n = order[(i + 1) % len(order)], len(row[3])
        edited = row[3][: n - n // 4] + after[3][: n // 4]
        near = sum(copies[o] for o in order if differing(prints[row], prints[o]) <= 3) - 1 if row[0] and row[1] % 10 == 0 else None
        like = [1 - differing(prints[row], x) / 128 for x in (print_of(edited), prints[after])]
        want[(row[1] if row[0] else None, n, hashlib.sha256(edited.encode()).hexdigest(), prints[row], print_of(edited), *like, near)] += copies[row]
    assert Counter(map(tuple, got)) == want
    assert any(r.n_near for r in got)


def test_fingerprints_are_summed_up_where_texts_lie(spark, monkeypatch):
    dealt = table(spark, [(i, f"a b {i} c d", None, None) for i in range(40)]).selectExpr("doc_id % 9 AS key", "doc_id % 2 AS kind", "text").repartition(4, "key")
    plan = fingerprints.fingerprints(dealt, ["key", "kind"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    plans, stored = [], common.stored
    monkeypatch.setattr(common, "stored", lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or stored(df, name))
    fingerprints.document_fingerprints(table(spark, [(i, f"a b {i} c d", None, None) for i in range(40)])).collect()
    dealt_by = set(re.findall(r"hashpartitioning\(([^)]*)\)", next(plan for name, plan in plans if name == "prints")))
    assert dealt_by and all(re.fullmatch(r"key#\d+, \d+", by) for by in dealt_by)


def test_fingerprints_of_small_tables(spark):
    assert fingerprints.document_fingerprints(table(spark, [])).collect() == []
    lone = fingerprints.document_fingerprints(table(spark, [(3, "a b c d", None, None)])).first()
    assert (lone.n_chars, lone.near_next, lone.edited_sha256) == (7, 1.0, hashlib.sha256(b"a b c a").hexdigest())


def test_tables_find_every_pair_within_the_radius(spark):
    rng = random.Random(9)
    prints = []
    for _ in range(30):
        base = rng.getrandbits(128)
        for k in range(6):
            changed = base
            for bit in rng.sample(range(128), k):
                changed ^= 1 << bit
            prints.append(changed)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(p >> 64), signed(p & (1 << 64) - 1)) for p in prints], "high bigint, low bigint")
    for radius, blocks in ((3, 5), (4, 6), (0, 1)):
        got = [tuple(r) for r in fingerprints.neighbours(df, df, radius, blocks).collect()]
        want = {(signed(a >> 64), signed(a & (1 << 64) - 1), signed(b >> 64), signed(b & (1 << 64) - 1), (a ^ b).bit_count()) for a in prints for b in prints if (a ^ b).bit_count() <= radius}
        assert len(got) == len(set(got)) and set(got) == want
    with pytest.raises(ValueError):
        fingerprints.block_masks(3, 3)


def test_likeness_tells_edited_texts_from_next_ones(spark):
    rows = fingerprints.op12_fingerprints(spark, SMALL).collect()
    assert sum(r.near_edited > r.near_next for r in rows) >= 0.97 * len(rows)


# --------------------------------------------------------------------------- filter audit


def test_audit_against_brute_force(spark):
    rows = some_rows()
    rng = random.Random(1)
    labels = [(d, rng.choice([0, 1, None]), rng.choice([0, 1])) for d in {r[0] for r in rows if r[0] is not None}]
    labels += [(labels[0][0], 1, 1), (None, 1, 1), (10**6, 1, 1)]
    got = filter_audit.filter_audit(table(spark, rows).repartition(5), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()
    good, toxic = ({d for d, *x in labels if d is not None and x[k] == 1} for k in range(2))
    failing = []
    for doc_id, text, _, source in rows:
        text = text or ""
        words = WORD.findall(text)
        copy = doc_id is not None and any(o[0] is not None and o[0] < doc_id and (o[1] or "") == text for o in rows)
        fails = [len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search(r"[#$%&*|]", text)), copy]
        failing.append((doc_id, source or "", {f for f, x in zip("ABCDE", fails, strict=True) if x}))
    want, shapley = {}, Counter()
    for part in {s for _, s, _ in failing}:
        docs = [(d, f) for d, s, f in failing if s == part]
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, letter in enumerate(order, 1):
                gone, left = [x for x in left if letter in x[1]], [x for x in left if letter not in x[1]]
                fails = sum(letter in f for _, f in docs)
                shapley[part, letter] += len(gone)
                want[part, "".join(order), step] = [len(left), len(gone), fails - len(gone), sum(f == {letter} for _, f in docs), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
    assert len(got) == len(want)
    for r in got:
        assert list(r[3:9]) == want[r.part, r.filter_order, r.step] and r.shapley == shapley[r.part, r.filter_order[r.step - 1]]


def test_audit_of_an_empty_table(spark):
    assert filter_audit.filter_audit(table(spark, []), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).collect() == []


def test_removal_polynomial():
    rng = random.Random(2)
    counts = [rng.randint(0, 9) for _ in range(16)]
    removal = filter_audit.Removal(counts, 4)
    for corner in range(16):
        assert removal.at(corner) == sum(n for mask, n in enumerate(counts) if mask & corner)
    for i in range(4):
        assert removal.shapley(i) == sum(Fraction(n, mask.bit_count()) for mask, n in enumerate(counts) if mask >> i & 1)


def test_audit_matches_sql(spark):
    matches_sql(spark, "op13_filter_audit")
