"""Token counts under a word-level BPE vocabulary, with a whole-token shortcut.

Pre-tokens are tokenised one by one. Once per worker, before any text is read, the library encodes every vocabulary string
that could be a pre-token; those that come back as one token are proven to count as one. In a text, pre-tokens of that set
count 1 without any merging, and only the others are merged, by the library, once for each distinct one within a bounded
cache.

Texts within Latin-1 are cut here, as all libraries agree on its letters, numbers, lower case and composition. Of other
texts each run without white space is treated so if it is within Latin-1, and is otherwise encoded by the library. Special strings in a
text are single tokens to the library wherever they stand; texts that hold one, or a character that is white space to
Python but not to the library, are passed to the library whole. No row leaves its partition.

Defined results: a null text counts as empty, with 0 bytes and 0 tokens; repeated rows are all returned; columns other
than doc_id and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import common

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
CACHE = 1_000_000
_ODD = re.compile("[\x1c-\x1f]")
#: The vocabulary's pre-tokens, within Latin-1.
_CUT = re.compile(rf"[{common.LATIN_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{common.LATIN_NUMBERS}]|[^\s{common.LATIN_LETTERS}{common.LATIN_NUMBERS}]+").findall


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class WordTokens:
    """Ids are kept as little-endian unsigned 16-bit integers, as all of this vocabulary's fit."""

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        vocabulary = self.library.get_vocab()
        if max(vocabulary.values()) > 65_535:
            raise ValueError("ids over 65535")
        self.closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.single = self._prove(vocabulary)
        self.pieces, self.runs = common.Recent(cache, self.single), common.Recent(cache // 4)

    def _prove(self, vocabulary: dict[str, int]) -> dict[str, bytes]:
        """Strings that the library encodes alone as one token, and that token."""
        strings = [text for token in vocabulary if token.endswith("</w>") and (text := token[:-4]).isascii() and text == text.lower() and _CUT(text) == [text]]
        encoded = self.library.encode_batch(strings, add_special_tokens=False)
        return {s: np.array(e.ids, dtype="<u2").tobytes() for s, e in zip(strings, encoded, strict=True) if len(e.ids) == 1}

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u2").tobytes()

    def _merge(self, pieces: list[str]) -> dict[str, bytes]:
        """Pre-tokens that need merging, in one call of the library: the last token of each closes a word."""
        ids = np.array(self.library.encode(" ".join(pieces), add_special_tokens=False).ids, dtype="<u2")
        ends = (2 * (np.flatnonzero(self.closes[ids]) + 1)).tolist()
        data = ids.tobytes()
        encoded = [data[a:b] for a, b in zip([0, *ends], ends, strict=False)] if len(ends) == len(pieces) else map(self.whole, pieces)
        merged = dict(zip(pieces, encoded, strict=True))
        self.pieces.add(merged)
        return merged

    def _run(self, run: str) -> bytes:
        """A run without white space that is not within Latin-1."""
        ids = self.runs.get(run)
        if ids is None:
            ids = self.whole(run)
            self.runs.add({run: ids})
        return ids

    def encode_many(self, texts: list[str]) -> list[bytes]:
        cut: list[list[str] | None] = []
        other: dict[int, list[str]] = {}  # texts not within Latin-1, as runs
        for k, text in enumerate(texts):
            if _ODD.search(text) or any(s in text for s in self.special):
                cut.append(None)
            elif common.is_latin(text):
                cut.append(_CUT(text.lower()))
            else:
                other[k] = text.split()
                cut.append([p for run in other[k] if common.is_latin(run) for p in _CUT(run.lower())])
        found = [None if pieces is None else self.pieces.all(pieces) for pieces in cut]
        missed = list(dict.fromkeys(p for pieces, ids in zip(cut, found, strict=True) if ids is not None and None in ids for p, i in zip(pieces, ids, strict=True) if i is None))
        new = self._merge(missed) if missed else {}
        out = []
        for k, (text, pieces, ids) in enumerate(zip(texts, cut, found, strict=True)):
            if pieces is None:
                out.append(self.whole(text))
                continue
            if None in ids:
                ids = [new[p] if i is None else i for p, i in zip(pieces, ids, strict=True)]
            if k in other:
                at, rest = 0, ids
                ids = []
                for run in other[k]:
                    n = len(_CUT(run.lower())) if common.is_latin(run) else 0
                    ids.append(b"".join(rest[at : at + n]) if n else self._run(run))
                    at += n
            out.append(b"".join(ids))
        return out

    def encode_stream(self, texts: Iterator[str], at_once: int = 1 << 20) -> Iterator[bytes]:
        """Encodes some texts at a time, so that what they miss in the cache is merged together."""
        held: list[str] = []
        size = 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= at_once:
                yield from self.encode_many(held)
                held, size = [], 0
        if held:
            yield from self.encode_many(held)


_loaded: dict[str, WordTokens] = {}


def load(path: str) -> WordTokens:
    if path not in _loaded:
        _loaded[path] = WordTokens(path)
    return _loaded[path]


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = load(path or vocabulary_path())
        for batch in batches:
            counts = [len(ids) // 2 for ids in words.encode_stream(text.as_py() or "" for text in batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    sized = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), "text")
    counted = sized.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(common.read(spark, sf_dir, "documents"))


__all__ = ["LIMIT", "WordTokens", "count_tokens", "load", "op3_token_counts", "vocabulary_path"]
