"""Corpus operators against the libraries, brute force, exact round trips or planted cases."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tesserae.llm import byte_bpe, common, embeddings, html_text, minhash, mixing, quality, registry, substring_dedup, token_files, toxicity, word_tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def passage(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    a, b = passage(1, 200), passage(2, 60)
    near = a.split()
    near[100] = "changed"
    return [
        (1, a, "en", "s1", 1),
        (2, a, "en", "s2", 1),  # an exact copy
        (3, " ".join(near), "en", None, 1),  # a near copy
        (4, passage(3, 40) + "\n" + b + " " + passage(4, 40), "en", "s1", 1),
        (5, passage(5, 30) + " " + b, "en", "s1", 1),  # a shared passage
        (6, None, None, None, None),
        (7, "", "en", "s2", 0),
        (8, "short text", "en", "s2", 10),
        (9, passage(9, 20_000), "en", "s3", 1),  # very long
        (10, a, "en", "s2", 1),
        (10, a, "en", "s2", 1),  # a repeated row
        (11, "word " * 80, "en", "s1", 400),
        (None, passage(6, 60), "en", "s1", 1),
        (12, "É́ ß 漢字 <|endoftext|> 's \x1c x \n\n  y", "fr", "s3", 5),
    ]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(texts, SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_workers_give_memory_back_and_drop_what_others_kept(monkeypatch):
    monkeypatch.setattr(common, "_held", {})
    resident = lambda: int(open("/proc/self/statm").read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1e6
    peak = []

    def task(batches):
        small = [bytes(2_000) for _ in range(100_000)]
        kept = [bytes(2_000) for _ in range(10)]  # the heap's end stays in use
        peak.append(resident())
        del small
        yield from batches
        common.held("other")["kept"] = kept

    batch = pa.RecordBatch.from_pydict({"x": [1]})
    common.held("byte_bpe")["table"] = 1
    assert list(common.lean(task, "other")([batch])) == [batch]
    assert list(common._held) == ["other"] and resident() < peak[0] - 150
    assert list(common.lean(iter)([batch])) == [batch] and not common._held


def test_byte_bpe_encodes_missed_pieces_once_and_keeps_shared_prefixes(monkeypatch):
    bpe, done = byte_bpe.ByteBPE(byte_bpe.read_ranks(byte_bpe.vocabulary_path())), []
    extend = bpe.extend
    monkeypatch.setattr(bpe, "extend", lambda data, last, first: (done.append(len(data) - first + 1), extend(data, last, first))[1])
    texts = [" qzxqzxqzx" + "abcdefgh"[i % 8] + " qzxqzxqzxz" * (i % 3) for i in range(200)] + ["", "\u00e9" * 70 + "x"]
    got = bpe.encode_all(texts)
    assert sum(done) < 10 + 2 * 9 + 141 and bpe.encode_all(texts[::-1]) == got[::-1]
    assert [bpe.decode(ids) for ids in got] == [text.encode() for text in texts]
    fresh = byte_bpe.ByteBPE(bpe.ranks)
    assert [np.frombuffer(x, "<u4").tolist() for x in got[:8]] == [[t for piece in byte_bpe._LATIN.findall(text) for t in fresh.encode_piece(piece.encode())] for text in texts[:8]]


def test_byte_bpe_is_the_library(docs, texts):
    import public_tokenizers
    import tiktoken

    bpe = byte_bpe.load(byte_bpe.vocabulary_path())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    ids = {hashlib.sha256(np.array(library.encode_ordinary(t or ""), "<u4").tobytes()).hexdigest() for _, t, *_ in texts}
    rows = byte_bpe.encode_documents(docs).collect()
    assert len(rows) == len(texts) and {r["ids_sha256"] for r in rows} == ids
    assert {r["decoded_sha256"] for r in rows} == {hashlib.sha256((t or "").encode()).hexdigest() for _, t, *_ in texts}
    r = random.Random(5)
    for _ in range(2000):
        t = "".join(r.choices(["a", "e", "th", "ing", " ", "  ", "\n", "1", "'s", "É", "漢", "!!", "\t", "🙂"], k=r.randint(1, 30)))
        assert np.frombuffer(bpe.encode(t), "<u4").tolist() == library.encode_ordinary(t)


def test_prefix_table_appends_and_edits():
    bpe = byte_bpe.load(byte_bpe.vocabulary_path())
    table = byte_bpe.PrefixTable(bpe)
    for part in (b" inter", b"national", b"ization"):
        table.append(part)
    whole = byte_bpe.PrefixTable(bpe)
    whole.append(b" internationalization")
    assert table.tokens() == whole.tokens()
    table.replace(6, 14, b"x")
    again = byte_bpe.PrefixTable(bpe)
    again.append(bytes(table.data))
    assert table.tokens() == again.tokens() and b"".join(bpe.spelled[t] for t in table.tokens()) == bytes(table.data)


def test_edits_are_fresh_encodings():
    bpe = byte_bpe.load(byte_bpe.vocabulary_path())
    r = random.Random(11)
    kinds = [b"a", b"e", b"th", b"ing", b" ", b"  ", b"1", "\u00e9".encode(), b"!!", b"tion"]
    table, calls = byte_bpe.PrefixTable(bpe), 0
    table.append(b"".join(r.choices(kinds, k=2000)))
    for _ in range(200):
        start = r.randrange(len(table.data))
        table.replace(start, min(len(table.data), start + r.randrange(12)), b"".join(r.choices(kinds, k=r.randrange(5))))
        fresh = byte_bpe.PrefixTable(bpe)
        fresh.append(bytes(table.data))
        assert table.last == fresh.last
        calls += 1
    assert calls == 200


def test_token_counts_are_the_library(docs, texts):
    words = word_tokens.load(word_tokens.vocabulary_path())
    expected = sorted(len(words.library.encode(t or "", add_special_tokens=False).ids) for _, t, *_ in texts)
    rows = word_tokens.count_tokens(docs).collect()
    assert sorted(r["n_tokens"] for r in rows) == expected
    assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in rows)


def test_token_files_round_trip(spark, docs, texts, tmp_path):
    manifest = token_files.write_token_files(docs, f"file://{tmp_path}")
    rows = token_files.read_token_files(manifest).orderBy("start").collect()
    words = word_tokens.load(word_tokens.vocabulary_path())
    ordered = sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    start = 0
    for row, (doc_id, text, *_) in zip(rows, ordered, strict=True):
        ids = np.array([*words.library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (row["doc_id"], row["start"], row["n_tokens"], row["ids_crc32"]) == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    path = manifest.where("n_docs > 0").first()["path"]
    reader = token_files.FileReader(path)
    doc_id = next(d for d, _ in reader.frame(0) if d is not None)
    assert len(reader.document(doc_id)) >= 1


def test_substring_dedup_is_brute_force(docs, texts):
    first = {}
    for doc_id, text, *_ in texts:
        if doc_id is not None:
            w = WORD.findall(text or "")
            for k in range(len(w) - 49):
                key = tuple(w[k : k + 50])
                first[key] = min(first.get(key, doc_id), doc_id)
    expected = []
    for doc_id, text, *_ in texts:
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if doc_id is not None and first[tuple(w[k : k + 50])] < doc_id:
                gone[k : k + 50] = [True] * 50
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        expected.append((doc_id or -1, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = [(-1 if r[0] is None else r[0], *r[1:]) for r in substring_dedup.substring_dedup(docs).collect()]
    assert sorted(got) == sorted(expected)


def test_suffix_automaton_matches():
    r = random.Random(3)
    automaton = substring_dedup.SuffixAutomaton()
    held = ["".join(r.choices("ab", k=40)) for _ in range(5)]
    for h in held:
        automaton.add(list(h))
    text = "".join(r.choices("abc", k=300))
    for i, n in enumerate(automaton.matched(list(text)), 1):
        longest = max(k for k in range(i + 1) if any(text[i - k : i] in h for h in held))
        assert n == longest


def test_remove_references(spark, docs):
    rows = substring_dedup.remove_references(docs, spark.createDataFrame([(passage(2, 60),)], "text string")).collect()
    assert {r["doc_id"] for r in rows if r["n_removed"] == 60} == {4, 5}


def test_near_duplicates(docs):
    rows = minhash.near_duplicates(docs).collect()
    assert {r["class_id"] for r in rows if r["doc_id"] in (1, 2, 3, 10)} == {1}
    assert all(r["kept"] for r in rows if r["doc_id"] in (4, 5, 6, 7, 8, 9, 11, 12))
    kept = minhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 4, 5, 6, 7, 8, 9, 11, 12]


def test_prob_min_hash_estimates():
    a, b = (np.random.default_rng(k).integers(1, 1 << 62, 400).astype(np.uint64) for k in (1, 2))
    x, y = np.unique(np.concatenate((a[:300], b[:100]))), np.unique(a[:300])
    one = minhash.prob_min_hash(x, np.ones(len(x)), 4096)
    two = minhash.prob_min_hash(y, np.ones(len(y)), 4096)
    assert abs((one == two).mean() - 300 / 400) < 0.04


def test_embeddings_are_brute_force(spark):
    r = np.random.default_rng(1)
    base = r.standard_normal((40, 16))
    rows = [(i, [float(v) for v in base[i % 40] + 0.05 * r.standard_normal(16)]) for i in range(200)]
    x = np.array([v for _, v in rows], dtype=np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = (x @ x.T >= 0.9).sum(1) - 1
    odd = [(900, None), (901, [0.0] * 16), (902, [float("nan")] + [1.0] * 15), (903, [None] + [1.0] * 15), (904, []), (905, rows[0][1])]
    got = {r["vec_id"]: r for r in embeddings.near_vectors(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")).collect()}
    total = sum(got[i]["n_links"] for i in range(200)) - sum(got[i]["n_links"] > links[i] for i in range(200))
    assert 0.9 * links.sum() <= total <= links.sum()
    assert all(got[k]["n_links"] == 0 and got[k]["kept"] for k in (900, 901, 902, 903, 904))
    assert got[905]["component_id"] == got[0]["component_id"] == 0


def test_html():
    page = """<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href=1>Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
    <article><h1>Head &amp; line</h1><p>First   paragraph with
    some words, long enough to count as content.<br>More.<p>Short.<script>var t="</p>";</script><form><input>Sign up</form></article>
    <aside>Side</aside><section class="comments"><p>Reader says</p></section><footer>&copy; x</footer></body></html>"""
    assert html_text.main_text(page) == "Head & line\n\nFirst paragraph with some words, long enough to count as content. More.\n\nShort."
    assert html_text.main_text("") == ""
    plain = "<body><div id=menu><a href=1>a</a></div><div><p>" + passage(1, 60) + "</p><p>" + passage(2, 60) + "</p></div></body>"
    assert html_text.main_text(plain) == passage(1, 60) + "\n\n" + passage(2, 60)


def test_html_without_article_or_names():
    def p(k, n):
        return f"<p>{passage(k, n)}</p>"

    page = '<body><div><a href=1>Home</a></div><div><h1>Title</h1><div>' + p(1, 300) + p(2, 200) + "</div><div>" + p(3, 60) + "</div></div><div><p>Short side text</p><ul><li><a href=1>x</a><li><a>y</a></ul></div></body>"
    assert html_text.main_text(page) == "\n\n".join(["Title", passage(1, 300), passage(2, 200), passage(3, 60)])
    inside = "<main><div class=post-header><h1>T</h1></div>" + p(1, 50) + '<div class="ad"><p>' + passage(9, 30) + "</p></div><p class=ad>Buy now" + p(2, 60) + "<ul><li>one<li>two</ul>" + p(3, 40) + '<section class="comments">' + p(4, 50) + "</section></main>"
    assert html_text.main_text(inside) == "\n\n".join(["T", passage(1, 50), passage(2, 60), "one", "two", passage(3, 40)])
    assert html_text.main_text("<p>x") == "x"
    assert len(html_text.main_text(f"<article>{p(1, 200_000)}</article>")) == len(passage(1, 200_000))


def test_html_clusters_decide(monkeypatch):
    """Pages of the test data against the text of their article element, which the method does not look for."""
    import duckdb

    rows = duckdb.sql("SELECT html FROM read_parquet('/root/testdata/sf0.01/pages.parquet')").fetchall()

    def article(html):
        from html import unescape

        blocks = re.split(r"</?(?:p|h1)>", html.split("<article>", 1)[1].split("</article>")[0])
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0] == "<br>" else "", b)).split()) for b in blocks]
        return "\n\n".join(b for b in blocks if b)

    assert all(html_text.main_text(h) == article(h) for (h,) in rows)
    monkeypatch.setattr(html_text, "clusters", lambda lines, lowered: ([0.0] * len(lines), 0.0))
    assert sum(html_text.main_text(h) != article(h) for (h,) in rows) > 0.9 * len(rows)


def test_html_odd_rows(spark):
    rows = html_text.extract(spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "<p>x")], "page_id long, url string, html string")).collect()
    assert [(r["text"], r["n_chars"]) for r in rows][:2] == [("", 0), ("", 0)]


def random_vector(r, terms, weight):
    found = np.array(sorted(r.sample(range(terms), r.randint(1, 9))))
    return toxicity.weighted(found, np.array([r.randint(1, 3) for _ in found]), weight)


def test_nearest_is_exact_and_skips_blocks():
    r = random.Random(2)
    weight = np.array([30.0 if t < 12 else 0.5 for t in range(200)])
    vectors = [random_vector(r, 200, weight) for _ in range(1500)]
    vectors += vectors[:40]  # ties
    index = toxicity.BlockMaxIndex(vectors, 200)
    queries = [random_vector(r, 200, weight) for _ in range(70)] + [(np.zeros(0, dtype=np.int64), np.zeros(0))]
    for q, (who, cosines) in zip(queries, index.nearest(queries, 15), strict=True):
        own = dict(zip(q[0].tolist(), q[1].tolist(), strict=True))
        every = [sum(w * own.get(t, 0.0) for t, w in zip(v[0].tolist(), v[1].tolist(), strict=True)) for v in vectors]
        best = sorted((c for c in every if c > 0), reverse=True)[:15]
        assert np.allclose(cosines, best) and np.allclose([every[k] for k in who], cosines)
    assert index.scored < 0.9 * index.bounded


def test_toxicity_held_out(spark):
    df = toxicity.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [(r["score"] >= toxicity.CUTOFF, labels[r["doc_id"]]) for r in df.collect() if r["doc_id"] in labels and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert sum(p == bool(y) for p, y in held) / len(held) > 0.9


def test_toxicity_without_labels(docs, spark):
    rows = toxicity.score(docs, spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert len(rows) == 14 and {r["score"] for r in rows} == {0.0}


def test_quality_base_figures():
    text = "One two | three #4.\nOne two | three #4.\n\na b c d e\nx"
    m = quality.Measured(text.encode())
    assert (m.words, m.word_chars, m.symbols, m.dup_lines, m.repeat_words) == (16, sum(map(len, text.split())), 4, 1, 10)
    assert quality.Measured(b"").words == 0


def test_quality_base_figures_are_brute_force():
    r = random.Random(8)
    for _ in range(200):
        text = "".join(r.choices(["a", "bc", "\u00e9", "#", "|", " ", "\t", "\n", "\n\n", "a bc a bc a ", "\x0b", "\xa0"], k=r.randint(0, 60)))
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        often = {k + i for k, g in enumerate(grams) if grams.count(g) > 1 for i in range(5)}
        m = quality.Measured(text.encode())
        assert (m.words, m.word_chars, m.symbols, m.dup_lines, m.repeat_words) == (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(often))


def test_viterbi_is_the_best_of_all():
    r = np.random.default_rng(4)
    for _ in range(100):
        field = quality.Field(r.standard_normal(quality.FEATURES), 2 * r.standard_normal((2, 2)))
        x = r.standard_normal((r.integers(1, 8), quality.FEATURES))
        emit = x @ field.weights

        def value(y, emit=emit, field=field):
            return sum(e for e, label in zip(emit, y, strict=True) if label) + sum(field.transitions[a, b] for a, b in zip(y, y[1:], strict=False))

        every = [[k >> i & 1 for i in range(len(x))] for k in range(1 << len(x))]
        assert abs(value(field.decode(x)) - max(map(value, every))) < 1e-9


def test_slope_is_the_derivative():
    r = np.random.default_rng(5)
    theta = r.standard_normal(quality.FEATURES + 4)
    x, y = r.standard_normal((1, 5, quality.FEATURES)), np.array([[0, 1, 1, 0, 1]])

    def likelihood(theta):
        w, t = theta[: quality.FEATURES], theta[quality.FEATURES :].reshape(2, 2)
        emit = x[0] @ w

        def value(y):
            return sum(e for e, label in zip(emit, y, strict=True) if label) + sum(t[a, b] for a, b in zip(y, y[1:], strict=False))

        return value(y[0]) - np.logaddexp.reduce([value([k >> i & 1 for i in range(5)]) for k in range(32)])

    slope = quality.Field._slope(theta, x, np.ones((1, 5)), y)
    for k in range(len(theta)):
        step = np.zeros(len(theta))
        step[k] = 1e-6
        assert abs((likelihood(theta + step) - likelihood(theta - step)) / 2e-6 - slope[k]) < 1e-4


def test_field_finds_clean_lines_of_bad_documents():
    """Bad documents have a run of boilerplate between clean lines; labels are of documents only."""
    r = np.random.default_rng(0)

    def lines(kinds):
        return np.hstack([np.array(kinds, dtype=float)[:, None] + 0.2 * r.standard_normal((len(kinds), 1)), np.ones((len(kinds), 1)), 0.1 * r.standard_normal((len(kinds), quality.FEATURES - 2))])

    shapes = [[0] * 8 if k % 2 else [0] * 2 + [1] * 5 + [0] for k in range(60)]
    x = [lines(s) for s in shapes]
    field = quality.Field().fit_hidden(x, [np.ones(8)] * 60, [1 - k % 2 for k in range(60)])
    found = [field.decode(v) for v in x]
    assert sum(a == b for f, s in zip(found, shapes, strict=True) for a, b in zip(f, s, strict=True)) >= 0.97 * 480
    assert sum(0 < sum(f) < 8 for f in found) >= 25
    assert field.transitions[0, 0] + field.transitions[1, 1] > field.transitions[0, 1] + field.transitions[1, 0]


def test_quality_odd_rows(spark, docs, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    rows = {r["doc_id"]: r for r in quality.judge(docs, labels).collect()}
    assert rows[6]["n_words"] == 0 and rows[6]["base_failed"] and not rows[6]["kept"]
    assert rows[9]["kept"] and rows[9]["n_words"] == 20_000 and not rows[11]["kept"]
    assert quality.judge(empty, labels).count() == 0


def test_quality_of_test_data(spark):
    """Held-out labels, and what the chain decides: some documents have lines of both labels."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = quality.judge(docs, labels).collect()
    held = [(int(r["kept"]), known[r["doc_id"]]) for r in rows if r["doc_id"] in known and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert sum(a == b for a, b in held) / len(held) > 0.9
    assert any(0 < r["content_share"] < 1 for r in rows)


def test_mixing(docs):
    rows = mixing.mix(docs).collect()
    total = sum(r["size"] for r in rows)
    assert sum(r["taken"] for r in rows) <= total + 400 and all(r["taken"] <= 3 * r["size"] for r in rows)
    assert abs(sum({r["source"]: r["target"] for r in rows}.values()) - total) < 1e-6
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r["copies"] for r in rows)


def test_mixing_matches_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/sf0.001/documents.parquet')")
    expected = {r[0]: r[1:] for r in con.execute(mixing.OP7_SQL).fetchall()}
    rows = registry.queries()["op7_mixing"](spark, "/root/testdata/sf0.001").collect()
    assert {r[0]: tuple(r[1:]) for r in rows} == expected


def test_empty_tables(spark, empty):
    assert substring_dedup.substring_dedup(empty).count() == 0
    assert minhash.near_duplicates(empty).count() == 0
    assert mixing.mix(empty).count() == 0
    assert byte_bpe.encode_documents(empty).count() == 0
    assert word_tokens.count_tokens(empty).count() == 0
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert toxicity.score(empty, spark.createDataFrame([], "doc_id long, toxic int")).count() == 0
    assert mixing.mixed_documents(empty).count() == 0 and minhash.one_of_each(empty).count() == 0 and substring_dedup.deduplicated_documents(empty).count() == 0


def test_pipeline_is_brute_force(spark, tmp_path):
    """Toxic documents, near copies, shared passages, null and repeated doc_ids through all five stages."""
    import public_tokenizers
    import tiktoken

    import corpus_pipeline

    shared = passage("shared", 55)
    rows = []
    for k in range(60):
        toxic = k % 5 == 0
        rows.append((k, passage(f"doc{k}", 40) + (" vile slur hateful filth" if toxic else " kind word lovely garden") + " " + passage(f"end{k}", 40), "en", f"s{k % 3}", 1))
    rows += [(100, rows[1][1] + " extra", "en", "s0", 1), (101, rows[1][1], "en", "s1", 1)]  # a near copy and an exact one
    rows += [(110 + k, f"{passage(f'x{k}', 30)} {shared} kind garden {passage(f'y{k}', 30)}", "en", "s2", 1) for k in range(3)]
    rows += [(None, passage("none", 50), "en", None, 1), (120, passage("first", 50), "en", "s0", 1), (120, passage("second", 50), "en", "s0", 1), (130, None, None, "s1", None), (131, "", "en", "s1", 0)]
    folder = f"file://{tmp_path}"
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(60)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder).cache()
        kept[name] = [r.asDict() for r in docs.collect()]

    after = sorted((r for r in rows if "vile" not in (r[1] or "")), key=str)
    assert sorted((tuple(r.values()) for r in kept["toxicity"]), key=str) == after
    after = sorted((r for r in after if r[0] not in (100, 101)), key=str)
    assert sorted((tuple(r.values()) for r in kept["minhash_near_dedup"]), key=str) == after
    cut = {(r[0], " ".join(r[1].replace(f"{shared} kind garden", "").split()) if r[0] in (111, 112) else r[1]) for r in after}
    assert {(r["doc_id"], r["text"]) for r in kept["substring_dedup"]} == cut
    taken = {(r["doc_id"], r["text"]) for r in kept["mixing"]}
    assert taken <= {c for c in cut if c[1]} and len(taken) > 0.5 * len(cut)
    counts = {r["doc_id"]: r["copies"] for r in mixing.mix(spark.createDataFrame([tuple(r.values()) for r in kept["substring_dedup"]], SCHEMA)).collect() if r["doc_id"] not in (None, 120)}
    found = [r["doc_id"] for r in kept["mixing"]]
    assert all(found.count(k) == n for k, n in counts.items())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load(byte_bpe.vocabulary_path()).ranks, special_tokens={})
    assert sorted((r["doc_id"] or -1, np.frombuffer(bytes(r["ids"]), "<u4").tolist()) for r in kept["byte_bpe"]) == sorted((r["doc_id"] or -1, library.encode_ordinary(r["text"])) for r in kept["mixing"])
    assert corpus_pipeline.run(spark, folder).count() == len(found)


def test_toxicity_of_few_labels(spark):
    words = [passage(k, 8) for k in range(70)]
    texts = [(k, w + (" vile slur hateful filth" if k % 8 == 0 else " kind word lovely garden"), "en", "s", 1) for k, w in enumerate(words)]
    df = spark.createDataFrame(texts, SCHEMA)
    labels = spark.createDataFrame([(k, int(k % 8 == 0)) for k in range(24)], "doc_id long, toxic int")
    terms, weight, _ = toxicity.fit(df, labels)
    seen = {w for k, text, *_ in texts[:24] if zlib.crc32(str(k).encode()) % 4 != 2 for w in text.split()}
    assert terms == sorted(seen) and (weight > 0).all()  # none is cut
    assert {r["doc_id"] for r in toxicity.score(df, labels).where(f"score >= {toxicity.CUTOFF}").collect()} == set(range(0, 70, 8))
    assert {r["doc_id"] for r in toxicity.accepted(df, labels).collect()} == {k for k in range(70) if k % 8}


def test_every_class_keeps_a_document(spark):
    a, b, c, d = (passage(k, 60) for k in (21, 22, 23, 24))
    texts = [(None, a), (None, a), (None, b), (7, c), (7, d), (8, d)]
    df = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in texts], SCHEMA)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in minhash.one_of_each(df).collect()) == sorted([(0, a), (0, b), (7, c), (7, d)])


def test_copies_that_repeat_a_passage():
    for k in range(40, 50):
        words = passage(k, 300).split()
        one, two = " ".join(words).encode(), " ".join(words + words[:60] * 1000).encode()
        x, y = (set(minhash.shingles(t)[0].tolist()) for t in (one, two))
        assert len(x & y) / len(x | y) > 0.9
        (b1, s1), (b2, s2) = minhash.bands(one), minhash.bands(two)
        assert (b1 == b2).any() and sum(p == q for p, q in zip(s1, s2, strict=True)) >= minhash.AGREE


def test_reader_finds_every_document(tmp_path, monkeypatch):
    """Nulls, negative and repeated doc_ids over many frames."""
    monkeypatch.setattr(token_files, "FRAME_IDS", 6)
    path = f"file://{tmp_path}/tokens.zst"
    held = [(None, 0), (None, 1), (None, 2), (-9, 3), (-9, 4), (-2, 5), (0, 6), (0, 7), (0, 8), (5, 9), (7, 10)]
    writer = token_files.FileWriter(path)
    for doc_id, k in held:
        writer.add(doc_id, np.arange(k, k + 4, dtype="<u2").tobytes())
    writer.close()
    reader = token_files.FileReader(path)
    assert len(reader) > 3 and [(d, int(ids[0])) for k in range(len(reader)) for d, ids in reader.frame(k)] == held
    for doc_id in {d for d, _ in held if d is not None} | {-100, 6, 100}:
        assert [int(ids[0]) for ids in reader.document(doc_id)] == [k for d, k in held if d == doc_id]
