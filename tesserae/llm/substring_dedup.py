"""Substring dedup: repeated word passages found by suffix automata over sharded reference passages.

A window is a run of `window` consecutive words of one document. A word goes if it is covered by a window whose words also
start in a document with a smaller doc_id; windows are judged on the input.

One automaton over the corpus does not fit anywhere, and streaming every document past every shard is quadratic, so a
shard is one document's passages, and documents stream past the shards that may hold something of theirs. Hashes route;
automata decide every window.

1. Each window has an anchor: the k-gram with the smallest hash among those inside it. Equal windows have equal anchors,
   so consecutive windows with one anchor form a segment, and segments whose anchors occur in one document only are
   done.
2. Segments equal as a whole (by anchor and segment hash) name the smallest document among them as their reference. Where
   segments that differ share an anchor, one occurrence of each is taken apart, and windows equal by anchor and hash (128 bits)
   name the smallest document among them.
3. A document's segments and windows that name one reference are merged into runs of words. The runs that a reference has
   itself make up its suffix automaton, and the runs of the others stream past it: where the matching statistics
   reach the window length, windows are repeated. Tasks get (reference, piece, salt): a reference of more than SHARD_WORDS words is cut
   into overlapping pieces with an automaton each, and the runs that name a reference are dealt over as many salts as
   their bytes need.

Spans of a document are then merged and cut out of its text. `remove_references` is the plain form of the method for a
reference set of bounded size (a benchmark, say): its shards' automata are broadcast, and documents stream past them.

Rows are told apart by doc_id and a hash of the text, so repeated doc_ids with different texts are separate documents, of
which none is smaller than the other. Defined results: a null text has no words; a null doc_id is neither smaller nor
larger than another, so that row stays as it is; exact repeats of a row get equal results; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tesserae.llm import common

WINDOW = 50
#: Words of an anchor.
ANCHOR = 20
#: Words of a shard's automaton, and shards broadcast at most.
SHARD_WORDS, SHARDS = 200_000, 16
#: Bytes of runs that one task streams past a reference.
SALT_BYTES = 256 << 10


class SuffixAutomaton:
    """Of several passages. States are lists in parallel; a state's transitions are a dictionary."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]

    def add(self, words: list) -> None:
        """A further passage; what it shares with earlier ones adds no state."""
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for w in words:
            to = nxt[last].get(w)
            if to is not None:
                last = to if length[to] == length[last] + 1 else self._split(last, to, w)
                continue
            state = len(nxt)
            nxt.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p != -1 and w not in nxt[p]:
                nxt[p][w] = state
                p = link[p]
            if p != -1:
                to = nxt[p][w]
                link[state] = to if length[to] == length[p] + 1 else self._split(p, to, w)
            last = state

    def _split(self, p: int, to: int, w) -> int:
        """A state for the shorter strings of `to`, those that p reaches by w."""
        nxt, link, length = self.next, self.link, self.length
        state = len(nxt)
        nxt.append(nxt[to].copy())
        link.append(link[to])
        length.append(length[p] + 1)
        link[to] = state
        while p != -1 and nxt[p].get(w) == to:
            nxt[p][w] = state
            p = link[p]
        return state

    def matched(self, words: list) -> Iterator[int]:
        """Matching statistics: at each word, the length of the longest passage ending there that the automaton holds."""
        nxt, link, length = self.next, self.link, self.length
        state = n = 0
        for w in words:
            to = nxt[state].get(w)
            while to is None and state:
                state = link[state]
                n = length[state]
                to = nxt[state].get(w)
            if to is None:
                n = 0
            else:
                state, n = to, n + 1
            yield n


def repeated_windows(automaton: SuffixAutomaton, words: list, window: int) -> list[int]:
    """Starts of the windows that the automaton holds."""
    return [i - window + 1 for i, n in enumerate(automaton.matched(words)) if n >= window]


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` values, the index of its smallest, the first of equals; by doubling."""
    at = np.arange(len(values), dtype=np.int32)
    span = 1
    while span < width:
        step = min(span, width - span)
        left, right = at[:-step], at[step:]
        at = np.where(values[left] <= values[right], left, right)
        span += step
    return at


def segments(data: bytes, window: int = WINDOW, k: int = ANCHOR) -> tuple[np.ndarray, ...] | None:
    """anchor, segment hash, first window and number of windows of each segment of a text."""
    starts, ends = common.word_edges(data)
    if len(starts) < window:
        return None
    grams = common.Grams(common.word_hashes(data, starts, ends))
    hashes = grams.all(k)
    at = smallest(hashes, window - k + 1)
    change = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    count = np.diff(np.concatenate((change, [len(at)])))
    return hashes[at[change]], grams.runs(change, change + count + window - 1), change.astype(np.int32), count.astype(np.int32)


def _segment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "key", "anchor", "segment", "start", "count"]
    for batch in batches:
        ids, keys = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        out: list[list] = [[] for _ in names]
        rows = 0

        def flush(out):
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names)

        for k, data in enumerate(common.text_bytes(batch)):
            found = segments(data)
            if found is None:
                continue
            n = len(found[0])
            for column, x in zip(out, (np.full(n, ids[k]), np.full(n, keys[k]), common.signed(found[0]), common.signed(found[1]), found[2], found[3]), strict=True):
                column.append(x)
            rows += n
            if rows > 200_000:
                yield flush(out)
                out, rows = [[] for _ in names], 0
        if rows:
            yield flush(out)


SEGMENT_ROWS = "doc_id bigint, key bigint, anchor bigint, segment bigint, start int, count int"


def _flushed(out: list[list], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names)


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From documents with lists of segments to a row for each window of them, with its anchor and hash."""
    names, types = ["anchor", "doc_id", "key", "start", "hash"], [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for doc_id, key, data, listed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), common.text_bytes(batch), batch.column(3), strict=True):
            grams = common.Grams(common.word_hashes(data, *common.word_edges(data)))
            for segment in listed.as_py():
                at = np.arange(segment["start"], segment["start"] + segment["count"])
                n = len(at)
                for column, x in zip(out, ([segment["anchor"]] * n, [doc_id] * n, [key] * n, at.tolist(), common.signed(grams.runs(at, at + WINDOW)).tolist()), strict=True):
                    column += x
            if len(out[0]) > 100_000:
                yield _flushed(out, names, types)
                out = [[] for _ in names]
        yield _flushed(out, names, types)


def runs_of(starts: np.ndarray, counts: np.ndarray) -> list[tuple[int, int]]:
    """The maximal runs [from, to) of the windows starts[k] .. starts[k] + counts[k] - 1, of touching windows."""
    order = np.argsort(starts, kind="stable")
    out: list[tuple[int, int]] = []
    for first, end in zip(starts[order].tolist(), (starts + counts)[order].tolist(), strict=True):
        if out and first <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((first, end))
    return out


def pieces_of(runs: list[tuple[int, int]], size: int) -> Iterator[tuple[int, int, int]]:
    """(piece, from, to) of the runs of windows, cut such that the words of a piece are about `size`."""
    piece = held = 0
    for first, end in runs:
        while first < end:
            if held >= size:
                piece, held = piece + 1, 0
            to = min(end, first + size - held)
            yield piece, first, to
            held, first = held + to - first + WINDOW - 1, to


def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From documents with the references that their segments and windows name to the words of runs; a document's runs that
    name itself are its own shard."""
    names = ["reference", "piece", "doc_id", "key", "start", "words"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    for batch in batches:
        out: list[list] = [[] for _ in names]
        held = 0
        for doc_id, key, data, listed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), common.text_bytes(batch), batch.column(3), strict=True):
            starts, ends = common.word_edges(data)
            reference, start, count = (np.array(x, dtype=np.int64) for x in zip(*((s["first"], s["start"], s["count"]) for s in listed.as_py()), strict=True))
            for r in np.unique(reference).tolist():
                runs = runs_of(start[reference == r], count[reference == r])
                for piece, first, to in pieces_of(runs, SHARD_WORDS) if r == doc_id else ((None, *run) for run in runs):
                    words = b" ".join(data[starts[first] : ends[to + WINDOW - 2]].split())
                    held += len(words)
                    for column, x in zip(out, (r, piece, doc_id, key, first, words), strict=True):
                        column.append(x)
            if held > 8 << 20:
                yield _flushed(out, names, types)
                out, held = [[] for _ in names], 0
        yield _flushed(out, names, types)


RUN_ROWS = "reference bigint, piece int, doc_id bigint, key bigint, start int, words binary"


def _match_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs sorted by (reference, piece, salt), the reference's own first, to repeated windows (doc_id, key, start, count)."""
    group, shard = None, SuffixAutomaton()
    names, types = ["doc_id", "key", "start", "count"], [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for *key_of_group, other, doc_id, key, start, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key_of_group != group:
                group, shard = key_of_group, SuffixAutomaton()
            words = data.split(b" ")
            if not other:
                shard.add(words)
                continue
            windows = np.array(repeated_windows(shard, words, WINDOW), dtype=np.int64)
            for first, end in runs_of(windows, np.ones_like(windows)):
                for column, x in zip(out, (doc_id, key, start + first, end - first), strict=True):
                    column.append(x)
        yield _flushed(out, names, types)


def _with_texts(keyed: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    """doc_id, key, text, and the list of what each document has in rows. The lists grow with the corpus, so they are not
    broadcast, however few they are."""
    listed = rows.groupBy("doc_id", "key").agg(F.collect_list(F.struct(*columns)).alias("listed"))
    return keyed.join(listed.hint("merge"), ["doc_id", "key"]).select("doc_id", "key", "text", "listed")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, key, spans: for each document that repeats others, the merged runs of words [from, to) to remove."""
    spark = docs.sparkSession
    keyed = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("key"), "text")
    rows = common.stored(keyed.mapInArrow(common.lean(_segment_rows), SEGMENT_ROWS), "segments")

    # Anchors of two documents or more, and whether their segments differ. Stored, so that a hot anchor of the join is split.
    anchors = rows.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.min("segment").alias("c"), F.max("segment").alias("d"))
    anchors = common.stored(anchors.where("a < b").select("anchor", (F.col("c") < F.col("d")).alias("differ")), "anchors")
    shared = common.stored(rows.join(anchors, "anchor"), "shared")
    common.drop_stored(rows, anchors)
    common.release(spark)

    # Equal segments name their first document.
    first = common.stored(shared.groupBy("anchor", "segment", "differ").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")), "first")
    equal = shared.join(first.where("first < last").select("anchor", "segment", "first"), ["anchor", "segment"]).select("doc_id", "key", "first", "start", "count")

    # Different segments of one anchor: the windows of the first document's occurrence of each.
    chosen = shared.join(first.where("differ").select("anchor", "segment", F.col("first").alias("doc_id")), ["anchor", "segment", "doc_id"])
    windows = common.stored(_with_texts(keyed, chosen, "anchor", "start", "count").mapInArrow(common.lean(_window_rows), "anchor bigint, doc_id bigint, key bigint, start int, hash bigint"), "windows")
    earliest = common.stored(windows.groupBy("anchor", "hash").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last"), "earliest")
    same = windows.join(earliest, ["anchor", "hash"]).select("doc_id", "key", "first", "start", F.lit(1).alias("count"))

    named = _with_texts(keyed, equal.unionByName(same), "first", "start", "count")
    runs = common.stored(named.mapInArrow(common.lean(_run_rows), RUN_ROWS), "runs")
    common.drop_stored(shared, first, windows, earliest)
    common.release(spark)

    # References with more than one piece or salt.
    shards = runs.groupBy("reference").agg((F.coalesce(F.max("piece"), F.lit(0)) + 1).alias("pieces"), F.ceil(F.sum(F.when(F.col("piece").isNull(), F.length("words"))) / SALT_BYTES).cast("int").alias("salts"))
    shards = common.stored(shards.where("pieces > 1 or salts > 1").select("reference", F.sequence(F.lit(0), F.col("pieces") - 1).alias("pieces"), F.sequence(F.lit(0), F.col("salts") - 1).alias("salts")), "shards")
    dealt = runs.join(shards, "reference", "left").withColumn("other", F.col("piece").isNull())
    dealt = dealt.withColumn("salt", F.explode(F.when(F.col("salts").isNull(), F.array(F.lit(0))).when(F.col("other"), F.array(F.pmod(F.hash("doc_id", "key"), F.size("salts")))).otherwise(F.col("salts"))))
    dealt = dealt.withColumn("piece", F.explode(F.when(~F.col("other"), F.array("piece")).when(F.col("pieces").isNull(), F.array(F.lit(0))).otherwise(F.col("pieces"))))
    dealt = dealt.select("reference", "piece", "salt", "other", "doc_id", "key", "start", "words").repartition("reference", "piece", "salt").sortWithinPartitions("reference", "piece", "salt", "other")
    matched = dealt.mapInArrow(common.lean(_match_rows), "doc_id bigint, key bigint, start int, count int")
    spans = matched.groupBy("doc_id", "key").agg(F.collect_list(F.struct(F.col("start").alias("from"), (F.col("start") + F.col("count") + (WINDOW - 1)).alias("to"))).alias("spans"))
    out = common.stored(spans, "spans")
    common.drop_stored(runs, shards)
    common.release(spark)
    return out


def _kept(data: bytes, spans: list[tuple[int, int]] | None) -> tuple[int, int, bytes | None]:
    """Words, words removed, and what is left (None: all, as it was)."""
    starts, ends = common.word_edges(data)
    if not spans:
        return len(starts), 0, None
    marks = np.zeros(len(starts) + 1, dtype=np.int32)
    for a, b in spans:
        marks[a] += 1
        marks[b] -= 1
    keep = np.flatnonzero(np.cumsum(marks[:-1]) == 0)
    return len(starts), len(starts) - len(keep), b" ".join([data[a:b] for a, b in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)])


def _with_spans(docs: DataFrame, *keep: Column) -> DataFrame:
    """text, spans and the columns `keep` of every row."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("key"), "text", *keep)
    return keyed.join(repeated_spans(docs).hint("merge"), ["doc_id", "key"], "left").drop("key")  # spans grow with the corpus


def _span_list(value) -> list[tuple[int, int]] | None:
    return None if value is None else [(s["from"], s["to"]) for s in value]


def substring_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [])
            for data, spans in zip(common.text_bytes(batch), batch.column(2).to_pylist(), strict=True):
                n, gone, left = _kept(data, _span_list(spans))
                out[0].append(n)
                out[1].append(gone)
                out[2].append(hashlib.sha256(_joined(data) if left is None else left).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _with_spans(docs).mapInArrow(common.lean(run), "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def _joined(data: bytes) -> bytes:
    """All words with one space between; bytes.split() cuts at just the characters that separate words."""
    return b" ".join(data.split())


def deduplicated_documents(docs: DataFrame) -> DataFrame:
    """The documents with repeated passages cut out. Texts that lose nothing stay as they are; what is left of others is
    joined by single spaces, with n_chars (if there is such a column) to match; documents that lose every word are
    dropped. Other columns go through unread, whatever their names."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    row = F.struct(*rest, F.lit(True).alias("text"))  # the last field only keeps the struct from being empty

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = [], []
            for k, (data, spans) in enumerate(zip(common.text_bytes(batch), batch.column(3).to_pylist(), strict=True)):
                left = _kept(data, _span_list(spans))[2]
                if left is None or left:
                    keep.append(k)
                    texts.append(None if left is None else left.decode())
            columns = [c.take(pa.array(keep, pa.int32())) for c in (batch.column(0), batch.column(1), batch.column(2))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], ["doc_id", "text", "row", "left"])

    schema = StructType([docs.schema["doc_id"], docs.schema["text"], StructField("row", docs.select(row.alias("row")).schema["row"].dataType), StructField("left", StringType())])
    cut = _with_spans(docs, row.alias("row")).mapInArrow(common.lean(run), schema)
    own = {"doc_id": F.col("doc_id"), "text": F.coalesce("left", "text"), "n_chars": F.when(F.col("left").isNull(), F.col("row.n_chars")).otherwise(F.length("left")) if "n_chars" in rest else None}
    return cut.select(*[own[c].cast(docs.schema[c].dataType).alias(c) if c in own else F.col(f"row.`{c}`") for c in docs.columns])


def remove_references(docs: DataFrame, references: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept: words of docs covered by a window that a text of `references` holds are removed.

    The references go to the driver in shards of about shard_words words, at most SHARDS of them (ValueError beyond), are
    made into automata, broadcast, and the documents stream past each.
    """
    spark = docs.sparkSession
    sizes = references.agg(F.sum(F.regexp_count("text", F.lit(common.WORD_PATTERN)))).first()[0] or 0
    if sizes > shard_words * SHARDS:
        raise ValueError(f"{sizes} reference words are over the bound of {shard_words * SHARDS}")
    shards, held = [SuffixAutomaton()], 0
    for row in references.select("text").toLocalIterator():
        words = (row[0] or "").encode().split()
        if held + len(words) > shard_words and held:
            shards.append(SuffixAutomaton())
            held = 0
        shards[-1].add(words)
        held += len(words)
    shared = [spark.sparkContext.broadcast((s.next, s.link, s.length)) for s in shards]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = []
        for b in shared:
            automata.append(SuffixAutomaton())
            automata[-1].next, automata[-1].link, automata[-1].length = b.value
        for batch in batches:
            out: tuple[list, ...] = ([], [], [])
            for data in common.text_bytes(batch):
                words = data.split()
                spans = [(s, s + window) for a in automata for s in repeated_windows(a, words, window)]
                n, gone, left = _kept(data, spans)
                out[0].append(n)
                out[1].append(gone)
                out[2].append((_joined(data) if left is None else left).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return docs.select("doc_id", "text").mapInArrow(common.lean(run), "doc_id bigint, n_words bigint, n_removed bigint, kept string")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(common.read(spark, sf_dir, "documents"))
