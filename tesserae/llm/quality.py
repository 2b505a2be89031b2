"""Quality rules: a linear-chain conditional random field labels lines as content or boilerplate.

A document is the sequence of its lines with a word. Each line has a short vector of features (signs, capitals, digits,
repeats, length, sentence ends); the field scores a label by these and by the label before it. Labels are known of
documents only, so the labels of a bad document's lines are hidden, and the document's label bounds them: at least half of its word
bytes are boilerplate. A good document is content throughout. Weights are learned by turns, by maximum
likelihood over forward-backward sums: with all lines of a document labelled alike at first (and transitions still 0),
then with the best sequences that keep to the bounds. Clean lines of bad documents so become content, and transitions
learn where runs of boilerplate begin and end. Viterbi decoding then gives the best sequence for every document, and the share of
word bytes in content lines decides: a document is kept if it passes the base rules and at least half of it is content.

The sample of the fit is bounded: FIT_DOCUMENTS labelled documents, those with the least hash of doc_id, and of each the FIT_LINES
consecutive lines from a hashed place on (all of them in shorter documents). Fitting takes labels only from rows whose
crc32(doc_id) mod 4 is not 2, so that accuracy can be measured on the others. The fitted weights are a few dozen numbers;
documents stay in their partitions.

Defined results: a null text has no words and fails the base rules; rows of labels with nulls, and doc_ids with both labels, are ignored;
of rows that repeat a labelled doc_id one is in the sample; without labels of both kinds every line is content; repeated rows are judged
alike; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import common
from tesserae.llm.toxicity import held_out

FIT_DOCUMENTS, FIT_LINES = 4_000, 128
#: Turns of relabelling and fitting after the first.
TURNS = 4
LEAST_WORDS, MOST_REPEATED = 10, 20
LEAST_SHARE = 0.5
WINDOW = 5
FEATURES = 15


def _table(characters: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=np.int32)
    out[list(characters)] = 1
    return out


_SYMBOL = _table(b"#*$%&|<>")
_UPPER = _table(bytes(range(65, 91)))
_LETTER = _table(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(0xC3, 0xF5)))
_DIGIT = _table(bytes(range(48, 58)))
_BANG = _table(b"!")
_STOP = _table(b".,;:?")


class Measured:
    """The base figures of a text and its lines' features."""

    __slots__ = ("dup_lines", "features", "repeat_words", "symbols", "weights", "word_chars", "words")

    def __init__(self, data: bytes):
        a = np.frombuffer(data, dtype=np.uint8)
        starts, ends = common.word_edges(data)
        n = self.words = len(starts)
        gaps = int(((a == 32) | ((a >= 9) & (a <= 13))).sum())
        self.word_chars = int(((a & 0xC0) != 0x80).sum()) - gaps
        self.symbols = int(_SYMBOL[a].sum())
        self.dup_lines = self.repeat_words = 0
        self.features, self.weights = np.zeros((0, FEATURES)), np.zeros(0)
        if not n:
            return
        hashes = common.word_hashes(data, starts, ends)
        repeated = np.zeros(n + 1, dtype=np.int32)
        if n >= WINDOW:
            _, back, count = np.unique(common.Grams(hashes).all(WINDOW), return_inverse=True, return_counts=True)
            at = np.flatnonzero(count[back] > 1)
            np.add.at(repeated, at, 1)
            np.add.at(repeated, at + WINDOW, -1)
        covered = np.cumsum(repeated[:-1]) > 0
        self.repeat_words = int(covered.sum())

        breaks = np.flatnonzero(a == 10)
        first = np.concatenate(([0], np.searchsorted(starts, breaks)))
        last = np.concatenate((first[1:], [n]))
        edges = np.concatenate(([-1], breaks, [len(a)]))
        full = np.flatnonzero(last > first)
        seen: set[bytes] = set()
        same = np.zeros(len(full))
        for k, line in enumerate(full.tolist()):
            text = data[edges[line] + 1 : edges[line + 1]]
            if text in seen:
                same[k] = 1
            seen.add(text)
        self.dup_lines = int(same.sum())

        first, last = first[full], last[full]
        words = (last - first).astype(float)

        def over_words(per_word: np.ndarray) -> np.ndarray:
            return np.add.reduceat(per_word.astype(np.int64), first).astype(float)

        def over_bytes(table: np.ndarray) -> np.ndarray:
            total = np.concatenate(([0], np.cumsum(table[a], dtype=np.int64)))
            return (total[ends[last - 1]] - total[starts[first]]).astype(float)

        size = over_words(ends - starts)
        letters = over_bytes(_LETTER)
        stutter = np.concatenate(([False], hashes[1:] == hashes[:-1]))
        closing = a[ends[last - 1] - 1]
        pipes = (a[starts] == 124) & (ends - starts == 1)
        columns = [
            np.ones(len(full)),
            np.minimum(1, over_bytes(_SYMBOL) / words),
            np.minimum(1, over_bytes(_UPPER) / np.maximum(1, letters)),
            over_bytes(_UPPER) > 0.6 * np.maximum(1, letters),
            np.minimum(1, over_bytes(_DIGIT) / size),
            np.minimum(1, over_bytes(_BANG) / words),
            np.minimum(1, over_words(pipes) / words),
            same,
            over_words(covered) / words,
            np.minimum(1, over_words(stutter) / words),
            words < 3,
            words >= 8,
            np.isin(closing, np.frombuffer(b".!?", dtype=np.uint8)),
            np.minimum(1, over_bytes(_STOP) / words),
            size / words > 12,
        ]
        self.features, self.weights = np.stack([np.asarray(c, dtype=float) for c in columns], axis=1), size


class Field:
    """Label 1 is boilerplate. score(y) = sum of y * features @ weights + transitions[y before, y]."""

    def __init__(self, weights: np.ndarray | None = None, transitions: np.ndarray | None = None):
        self.weights = np.zeros(FEATURES) if weights is None else weights
        self.transitions = np.zeros((2, 2)) if transitions is None else transitions

    def fit(self, sequences: list[np.ndarray], labels: list[np.ndarray], rounds: int = 100, rate: float = 0.1, shrink: float = 1e-5, chain: bool = True) -> Field:
        """Gradient ascent (Adam) on the mean log-likelihood of a line, whose labels are given; sequences of like length go
        together. Without `chain` the transitions stay as they are."""
        groups: dict[int, list[int]] = {}
        for k, s in enumerate(sequences):
            groups.setdefault(1 << (len(s) - 1).bit_length(), []).append(k)
        packed = []
        for steps, members in sorted(groups.items()):
            x, mask, y = np.zeros((len(members), steps, FEATURES)), np.zeros((len(members), steps)), np.zeros((len(members), steps))
            for i, k in enumerate(members):
                n = len(sequences[k])
                x[i, :n], mask[i, :n], y[i, :n] = sequences[k], 1, labels[k]
            packed.append((x, mask, y))
        lines = sum(len(s) for s in sequences)
        theta = np.concatenate((self.weights, self.transitions.ravel()))
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for turn in range(1, rounds + 1):
            slope = -shrink * theta
            for x, mask, y in packed:
                slope += self._slope(theta, x, mask, y) / lines
            if not chain:
                slope[FEATURES:] = 0.0
            m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
            theta = theta + rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8)
        self.weights, self.transitions = theta[:FEATURES], theta[FEATURES:].reshape(2, 2)
        return self

    def fit_hidden(self, sequences: list[np.ndarray], sizes: list[np.ndarray], bad: list[int]) -> Field:
        """From labels of documents; sizes are the word bytes of their lines."""
        labels = [np.full(len(s), y) for s, y in zip(sequences, bad, strict=True)]
        self.fit(sequences, labels, chain=False)
        for _ in range(TURNS):
            labels = [self.bounded(s, size) if y else np.zeros(len(s)) for s, size, y in zip(sequences, sizes, bad, strict=True)]
            self.fit(sequences, labels, rounds=40)
        return self

    def bounded(self, features: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The best sequence in which at least half of the document is boilerplate: with the least bonus for boilerplate
        that a search by halves finds, none if none is needed."""
        low, high, best = 0.0, 64.0, np.ones(len(features))
        for turn in range(9):
            bonus = (low + high) / 2 if turn else 0.0
            found = np.array(self.decode(features, bonus))
            if 2 * sizes[found == 1].sum() >= sizes.sum():
                best, high = found, bonus
                if not turn:
                    break
            else:
                low = bonus
        return best

    @staticmethod
    def _slope(theta: np.ndarray, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> np.ndarray:
        w, t = theta[:FEATURES], theta[FEATURES:].reshape(2, 2)
        n, steps = mask.shape
        emit = np.zeros((n, steps, 2))
        emit[..., 1] = x @ w
        forward, backward = np.zeros((n, steps, 2)), np.zeros((n, steps, 2))
        forward[:, 0] = emit[:, 0]
        for k in range(1, steps):
            step = np.logaddexp(forward[:, k - 1, 0, None] + t[0], forward[:, k - 1, 1, None] + t[1]) + emit[:, k]
            forward[:, k] = np.where(mask[:, k, None] > 0, step, forward[:, k - 1])
        for k in range(steps - 2, -1, -1):
            ahead = emit[:, k + 1] + backward[:, k + 1]
            step = np.logaddexp(t[:, 0] + ahead[:, 0, None], t[:, 1] + ahead[:, 1, None])
            backward[:, k] = np.where(mask[:, k + 1, None] > 0, step, 0)
        total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        on = np.exp(forward[..., 1] + backward[..., 1] - total[:, None]) * mask
        slope_w = np.einsum("nk,nkf->f", y * mask - on, x)
        pairs = mask[:, 1:]
        slope_t = np.zeros((2, 2))
        for a in (0, 1):
            for b in (0, 1):
                seen = ((y[:, :-1] == a) & (y[:, 1:] == b)) * pairs
                slope_t[a, b] = (seen - np.exp(forward[:, :-1, a] + t[a, b] + emit[:, 1:, b] + backward[:, 1:, b] - total[:, None]) * pairs).sum()
        return np.concatenate((slope_w, slope_t.ravel()))

    def decode(self, features: np.ndarray, bonus: float = 0.0) -> list[int]:
        """The best sequence of labels (Viterbi); of equal ones that with content. A bonus goes to each line of boilerplate."""
        (aa, ab), (ba, bb) = self.transitions.tolist()
        emit = (features @ self.weights + bonus).tolist()
        if not emit:
            return []
        a, b, back = 0.0, emit[0], []
        for e in emit[1:]:
            from_a, from_b = a + aa >= b + ba, a + ab >= b + bb
            a, b = (a + aa if from_a else b + ba), (a + ab if from_b else b + bb) + e
            back.append((0 if from_a else 1, 0 if from_b else 1))
        label = 0 if a >= b else 1
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]

    def share(self, measured: Measured) -> float:
        """The share of word bytes in content lines."""
        total = measured.weights.sum()
        return float(measured.weights[np.array(self.decode(measured.features)) == 0].sum() / total) if total else 0.0


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality") -> Field:
    label = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min(column).alias("label"), F.max(column).alias("other"))
    sample = common.stored(label.where("label = other").orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_DOCUMENTS).select("doc_id", "label"), "sample")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, label, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), common.text_bytes(batch), strict=True):
                m = Measured(data)
                n = len(m.features)
                if n:
                    at = zlib.crc32(str(doc_id).encode()) % max(1, n - FIT_LINES + 1)
                    rows.append((doc_id, label, np.column_stack((m.features, m.weights))[at : at + FIT_LINES].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], ["doc_id", "label", "lines"])

    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", F.col("label").cast("int").alias("label")).mapInArrow(run, "doc_id bigint, label int, lines binary")
    rows = sorted(((r[0], r[1], r[2]) for r in rows.groupBy("doc_id").agg(F.min("label"), F.min("lines")).collect()))  # FIT_DOCUMENTS at most
    common.drop_stored(sample)
    field = Field()
    if len({label for _, label, _ in rows}) == 2:
        lines = [np.frombuffer(x).reshape(-1, FEATURES + 1) for _, _, x in rows]
        field.fit_hidden([x[:, :-1] for x in lines], [x[:, -1] for x in lines], [1 - label for _, label, _ in rows])
    return field


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, the base figures, base_failed, content_share, kept of every row."""
    field = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for data in common.text_bytes(batch):
                m = Measured(data)
                failed = m.words < LEAST_WORDS or 100 * m.repeat_words > MOST_REPEATED * m.words
                share = field.share(m)
                rows.append((m.words, m.word_chars, m.symbols, m.dup_lines, m.repeat_words, failed, share, not failed and share >= LEAST_SHARE))
            types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], names)

    schema = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, content_share double, kept boolean"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))
