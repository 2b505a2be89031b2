"""Stages of the pipeline with columns of any name, and near-duplicate classes against an exact join."""

import random

import pytest

from tesserae.llm import common, embeddings, minhash, mixing, toxicity


def passage(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 9))) for _ in range(n))


def with_columns(spark, rows, names):
    """Rows of (doc_id, text, source, n) with n in columns of all the names."""
    return spark.createDataFrame([(*r, *[r[3]] * (len(names) - 1)) for r in rows], "doc_id long, text string, source string, " + ", ".join(f"`{n}` long" for n in names))


def test_clashes_in_near_dedup(spark):
    a, b = passage(1, 60), passage(2, 60)
    df = with_columns(spark, [(1, a, "s", 7), (2, a, "s", 8), (3, b, "s", 9), (4, None, "s", None)], ["node", "component", "f", "d", "worded", "row", "class_id", "bands", "key", "size"])
    out = minhash.one_of_each(df)
    assert out.columns == df.columns and sorted((r[0], r[3] or 0, r[9] or 0) for r in out.collect()) == [(1, 7, 7), (3, 9, 9), (4, 0, 0)]


def test_clashes_in_mixing(spark):
    df = with_columns(spark, [(k, passage(k, 30), f"s{k % 2}", k) for k in range(20)], ["copy_number", "copies", "text_key", "place", "row", "range", "size", "upto"])
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    rows = out.collect()
    assert rows and all(r[0] == r[3] == r[8] for r in rows)


def test_clashes_in_toxicity(spark):
    texts = [(k, passage(k, 8) + (" vile slur hateful" if k % 4 == 0 else " kind lovely garden"), "s", k) for k in range(60)]
    df = with_columns(spark, texts, ["score", "evidence", "_text", "row", "label"])
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(40)], "doc_id long, toxic int")
    out = toxicity.accepted(df, labels)
    assert out.columns == df.columns
    rows = out.collect()
    assert all(r[0] == r[3] == r[5] for r in rows) and {r[0] for r in rows} == {k for k in range(60) if k % 4}


@pytest.mark.parametrize(("block", "turns"), [(minhash.BLOCK, minhash.TURNS), (2, ())])
def test_classes_are_an_exact_join(spark, monkeypatch, block, turns):
    """Copies with 0 to 12 scattered changes of 200 words: similarities from 0.55 to 1, many near the threshold. Leaders are not
    needed for it: blocks of two members, each pair of blocks in a task, find the same links."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "TURNS", turns)
    texts = []
    for family in range(40):
        base = passage(family, 200).split()
        for k in range(8):
            r, words = random.Random(family * 100 + k), list(base)
            for at in r.sample(range(200), r.randint(0, 12)):
                words[at] = f"w{r.random()}"
            texts.append((len(texts), " ".join(words)))
    sets = [set(minhash.shingles(t.encode())[0].tolist()) for _, t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = 0
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                links += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    expected = {k: find(k) for k in range(len(texts))}
    assert links > 100 and sum(got[k] != expected[k] for k in got) <= len(got) // 50
    assert all(expected[got[k]] == expected[k] for k in got)  # no class holds what the join keeps apart


def test_near_dedup_blocks(spark, monkeypatch):
    """Buckets cut into many blocks give the same classes."""
    base = passage(5, 100).split()
    texts = []
    for k in range(60):
        words = list(base)
        words[k] = f"w{k}"
        texts.append((k, " ".join(words)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "TURNS", ((0,),))
    assert {r["class_id"] for r in minhash.near_duplicates(df).collect()} == {0}


def test_held_members_link_in_order():
    """Members that go by join components once, and not those that an earlier band has brought together."""
    one, other = " ".join(f"a{k}" for k in range(300)).encode(), " ".join(f"b{k}" for k in range(300)).encode()
    near = one + b" tail"
    (bands_one, sketch), (bands_near, sketch_near), (bands_other, sketch_other) = minhash.bands(one), minhash.bands(near), minhash.bands(other)
    held = minhash.Held(0)
    held.add(1, 1, sketch, common.signed(bands_one).tolist(), one)
    held.add(2, 2, sketch_other, common.signed(bands_other).tolist(), other)
    held.add(3, 3, sketch, common.signed(bands_one).tolist(), one)
    assert list(held.links(4, 4, sketch_near, common.signed(bands_near).tolist(), near)) == [(1, 4), (3, 4)]
    assert list(held.links(5, 4, sketch_near, common.signed(bands_near).tolist(), near)) == []  # all in one component by now
    later = minhash.Held(minhash.BANDS)
    shared = common.signed(bands_one).tolist()
    later.add(1, 1, sketch, shared, one)
    assert list(later.links(4, 4, sketch, shared, one)) == []


def test_embedding_counts_decide(spark, monkeypatch):
    """Only pairs with enough collisions are verified, and they are few among pairs far apart."""
    import numpy as np

    r = np.random.default_rng(3)
    x = r.standard_normal((300, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = embeddings.collisions(x, x) >= embeddings.calibrated_count()
    assert near.sum() < 0.1 * near.size and near.diagonal().all()
    rows = [(k, v.tolist()) for k, v in enumerate(np.vstack((x[:20], x[:20] + 0.02 * r.standard_normal((20, 64)))))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_vectors(df).collect()}
    assert got == {k: (1, k % 20) for k in range(40)}
    monkeypatch.setattr(embeddings, "calibrated_count", lambda: embeddings.LINES + 1)
    two = np.array([v for _, v in rows])
    assert not len(embeddings._block_links(two / np.linalg.norm(two, axis=1, keepdims=True), two, True, 0, 2, 1)[0])


def test_stored_tables_go(spark):
    follow = common.Stored()
    first = follow.next(spark.range(3), "one")
    common.stored(spark.range(2), "between")
    kept = len(follow.made)
    second = follow.next(first.where("id > 0"), "two")
    assert second.count() == 2 and len(follow.made) == kept - 1


def test_runs_leave_each_others_tables_alone(spark):
    """Two runs in two threads, and a table stored outside of both."""
    import threading

    from tesserae.llm import common

    held = common.stored(spark.range(3).toDF("n"), "held")
    left, right = threading.Event(), threading.Event()
    seen = {}

    def run(name, mine, other):
        follow = common.Stored()
        part = common.stored(spark.range(5).toDF("n"), name)
        mine.set()
        other.wait(60)
        first = follow.next(part.where("n > 0"), f"{name}-first")
        second = follow.next(first.where("n > 1"), f"{name}-second")
        seen[name] = (second.count(), part._tesserae_folder)

    threads = [threading.Thread(target=run, args=(n, a, b)) for n, a, b in (("left", left, right), ("right", right, left))]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert held.count() == 3 and {n: c for n, (c, _) in seen.items()} == {"left": 3, "right": 3}
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for _, folder in seen.values():
        gone = path(folder)
        assert not gone.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(gone)


def test_components_of_a_long_path(spark):
    """A path takes most steps; a star beside it is another component."""
    path = [(k, k + 1) for k in range(100, 300)]
    edges = spark.createDataFrame([*path, *((7, k) for k in range(10, 60)), (8, 8)], "a long, b long")
    got = dict(common.connected_components(edges).collect())
    assert got == {k: 100 for k in range(100, 301)} | {7: 7} | {k: 7 for k in range(10, 60)}


class Unset:
    """A session with no checkpoint folder whose warehouse is on the driver's disk."""

    def __init__(self, master):
        self.master = master
        self.sparkContext = self.conf = self

    def get(self, key, default=None):
        return "file:/warehouse" if key == "spark.sql.warehouse.dir" else default

    def getCheckpointDir(self):
        return None

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_tables_need_a_shared_folder_on_a_cluster():
    assert common.shared_folder(Unset("local[4]")) == "file:/warehouse/tesserae-shared"
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            common.shared_folder(Unset(master))
