"""Substring dedup against brute force on common passages, and what decides in it."""

import hashlib
import random
import re

import pytest

from tesserae.llm import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string"


def passage(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 9))) for _ in range(n))


def brute(texts):
    first = {}
    for doc_id, text in texts:
        w = WORD.findall(text or "")
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            first[key] = min(first.get(key, doc_id), doc_id)
    out = []
    for doc_id, text in texts:
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < doc_id:
                gone[k : k + 50] = [True] * 50
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((doc_id, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.fixture(scope="module")
def crowd(spark):
    """A passage in 400 documents, each time between other words; pairs of them share more; copies; a short common phrase."""
    common, phrase = passage("common", 70), passage("phrase", 45)
    texts = []
    for k in range(400):
        texts.append((1000 - k, f"{passage(k // 2, 30)} {common} {passage(k, 20)} {phrase} {passage(-k, 12)}"))
    whole = passage("whole", 300)
    texts += [(2000 + k, whole) for k in range(50)] + [(3000, whole + " " + common), (3001, ("tick " * 130).strip()), (3002, "tick " * 60)]
    return texts, spark.createDataFrame(texts, SCHEMA).repartition(16).cache()


def test_common_passages_are_brute_force(crowd):
    texts, df = crowd
    assert sorted(tuple(r) for r in substring_dedup.substring_dedup(df).collect()) == brute(texts)


def test_small_shards_and_salts(crowd, monkeypatch):
    texts, df = crowd
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 60)
    monkeypatch.setattr(substring_dedup, "SALT_BYTES", 2_000)
    assert sorted(tuple(r) for r in substring_dedup.substring_dedup(df).collect()) == brute(texts)


def test_pieces_cover_all_windows():
    runs = [(0, 7), (20, 400), (1000, 1001)]
    windows = [w for _, a, b in substring_dedup.pieces_of(runs, 60) for w in range(a, b)]
    assert windows == [w for a, b in runs for w in range(a, b)]


def test_automata_decide(crowd):
    """Without matches in automata, no word goes: hashes only route."""
    words = passage("x", 60).encode().split()
    shard = substring_dedup.SuffixAutomaton()
    shard.add(words)
    assert substring_dedup.repeated_windows(shard, words, 50) == list(range(11))
    assert substring_dedup.repeated_windows(substring_dedup.SuffixAutomaton(), words, 50) == []
    import pyarrow as pa

    def batch(*rows):
        names = ["reference", "piece", "salt", "other", "doc_id", "key", "start", "words"]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names)

    routed = [(1, 0, 0, False, 1, 9, 0, b" ".join(words)), (1, 0, 0, True, 2, 9, 5, b" ".join(words[:-1] + [b"changed"]))]  # routed here, yet different
    rows = [r for b in substring_dedup._match_rows([batch(*routed)]) for r in b.to_pylist()]
    assert rows == [{"doc_id": 2, "key": 9, "start": 5, "count": 10}]


def test_clashing_columns(spark):
    a = passage("a", 60)
    names = ["key", "spans", "row", "left", "first", "words", "listed", "n_chars"]
    df = spark.createDataFrame([(1, a, "s", *[5] * 8), (2, a + " more", "s", *[6] * 8), (3, None, *[None] * 9)], "doc_id long, text string, source string, " + ", ".join(f"`{n}` long" for n in names))
    out = substring_dedup.deduplicated_documents(df)
    assert out.columns == df.columns
    assert sorted((r[0], r[1], r[3], r[9], r[10]) for r in out.collect()) == [(1, a, 5, 5, 5), (2, "more", 6, 6, 4), (3, None, None, None, None)]
