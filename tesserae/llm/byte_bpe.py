"""Byte-level BPE encoding and decoding by prefix dynamic programming.

A byte string has one valid BPE encoding, and so has each of its prefixes. For every prefix the table stores the last
token of that prefix's encoding; a token that ends at byte i can be that last token only if it may follow the last token
of the prefix before it. The entries for a prefix never depend on what follows, so appending bytes only appends entries.
An edit invalidates entries from the edit on, and only until the entries are again what they were for the length of the longest token.

The text is first cut by the vocabulary's pattern, and each match is encoded separately. Python runs inside tasks over
Arrow batches; no row leaves its partition, so there is no shuffle at all. Per worker, encodings of frequent matches are
kept in a cache of bounded size.

Defined results: a null text is an empty text; an empty text has no tokens; texts of any length are encoded whole;
repeated rows are encoded alike and all returned; columns other than doc_id and text are ignored; an empty table gives an
empty result. Bytes that the vocabulary cannot spell raise ValueError (the shipped vocabularies hold all 256 bytes).
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tesserae.llm import common

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Entries in a worker's cache of encoded pieces, about 0.2 KB each; it stays from task to task.
CACHE = 60_000
#: Characters of the texts whose pieces are encoded together, but for one longer text.
TOGETHER = 2_000_000
#: The vocabulary's pattern within Latin-1, with the alternatives that begin alike first.
_L, _N = common.LATIN_LETTERS, common.LATIN_NUMBERS
_LATIN = re.compile(rf" ?[{_L}]+|'(?:s|t|re|ve|m|ll|d)| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class PrefixTable:
    """The last tokens of all prefixes of a growing byte string."""

    __slots__ = ("bpe", "data", "last")

    def __init__(self, bpe: ByteBPE):
        self.bpe, self.data, self.last = bpe, bytearray(), [-1]

    def append(self, more: bytes) -> None:
        first = len(self.data) + 1
        self.data += more
        self.bpe.extend(self.data, self.last, first)

    def replace(self, start: int, end: int, more: bytes) -> None:
        """Put `more` in place of data[start:end]. Prefixes up to `start` keep their entries. What comes after the edit is
        encoded anew only until as many entries in a row as the longest token has bytes are what they were: entries look no further back."""
        old, shift = self.last[end + 1 :], start + len(more)
        tail = self.data[end:]
        del self.data[start:]
        del self.last[start + 1 :]
        self.append(more)
        same, done, step = 0, 0, 2 * self.bpe.longest
        while done < len(tail) and same < self.bpe.longest:
            self.append(tail[done : done + step])
            for at in range(done, min(done + step, len(tail))):
                same = same + 1 if self.last[shift + at + 1] == old[at] else 0
            done = min(done + step, len(tail))
        self.data += tail[done:]
        self.last += old[done:]

    def tokens(self) -> list[int]:
        return self.bpe.walk_back(self.last)


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], cache: int = CACHE):
        self.ranks = ranks
        self.spelled: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.spelled[rank] = token
        self._spelled = pa.array(self.spelled, pa.binary())
        #: By the last four bytes, or what a shorter prefix has: (size, token) of what may end there, longest first; token is -1 where the size is over four.
        self.endings: dict[bytes, tuple[tuple[int, int], ...]] = {}
        self._follows: dict[int, bool] = {}
        self._pieces = common.Recent(cache)
        self._parents()

    def _parents(self) -> None:
        """The pair each token was merged from, found by running lower-ranked merges over its own bytes; a token that
        such merges do not reach (none does in a trained vocabulary, but single bytes have no pair) gets None."""
        self.parents: dict[int, tuple[int, int] | None] = {}
        self.whole: dict[tuple[int, int], int] = {}
        for token, rank in sorted(self.ranks.items(), key=lambda x: x[1]):
            parts = [self.ranks.get(token[i : i + 1], -1) for i in range(len(token))]
            while len(parts) > 2:
                best = min(((self.whole.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:], strict=False))), default=(1 << 60, 0))
                if best[0] >= rank:
                    break
                parts[best[1] : best[1] + 2] = [best[0]]
            if len(parts) == 2 and -1 not in parts:
                self.parents[rank] = (parts[0], parts[1])
                self.whole[parts[0], parts[1]] = rank
            else:
                self.parents[rank] = None
        self.steps: dict[bytes, int] = {}
        longer: dict[bytes, set[int]] = {}
        for rank, pair in self.parents.items():
            token = self.spelled[rank]
            if pair is not None or len(token) == 1:  # a token that merges do not reach is never the last of a prefix
                self.steps[token] = rank
                sizes = longer.setdefault(token[-4:], set())
                if len(token) > 4:
                    sizes.add(len(token))
        short = {token: (len(token), rank) for token, rank in self.steps.items() if len(token) <= 4}
        unknown = [(size, -1) for size in range(max(map(len, self.steps), default=0) + 1)]
        for tail, sizes in longer.items():
            ends = (tail[i:] for i in range(len(tail)))
            self.endings[tail] = (*(unknown[n] for n in sorted(sizes, reverse=True)), *(short[end] for end in ends if end in short))
        self.longest = max(map(len, self.steps), default=1)

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the encoding of the two tokens' bytes is just these two tokens.

        Merges happen in order of rank. Undoing the later of the two tokens' own last merges step by step gives the pairs
        that met at the boundary while the tokens were formed; one of those pairs merging earlier than what was formed
        next to it would have crossed the boundary.
        """
        known = self._follows.get(left << 32 | right)
        if known is None:
            if len(self._follows) >= 250_000:
                self._follows.clear()
            known = self._follows[left << 32 | right] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        none = 1 << 60
        formed = none  # the rank of the merge that next changes the boundary pair
        while True:
            crossing = self.whole.get((left, right), none)
            if crossing < formed:
                return False
            up, vp = self.parents[left], self.parents[right]
            if up is None and vp is None:
                return True
            # At equal rank the left token is formed first, so the right one is undone first.
            if vp is None or (up is not None and left > right):
                formed, left = left, up[1]
            else:
                # A crossing merge of this very rank, further left, would have come first.
                formed, right = right + 1, vp[0]

    def extend(self, data: bytes | bytearray, last: list[int], first: int) -> None:
        """Append to `last` the last tokens of the prefixes of lengths first..len(data)."""
        ranks, endings, follows, may_follow = self.steps.get, self.endings.get, self._follows.get, self.may_follow
        base = max(0, first - 1 - self.longest)  # no token that ends from here on starts before it
        near = bytes(data[base:]) if base or not isinstance(data, bytes) else data
        for end in range(first - base, len(near) + 1):
            at = end - 4 if end > 4 else 0
            while (ends := endings(near[at:end])) is None and at < end:
                at += 1
            for size, token in ends or ():
                start = end - size
                if token < 0 and (start < 0 or (token := ranks(near[start:end])) is None):
                    continue
                if start + base == 0:
                    last.append(token)
                    break
                before = last[start + base]
                known = follows(before << 32 | token)
                if may_follow(before, token) if known is None else known:
                    last.append(token)
                    break
            else:
                raise ValueError(f"the vocabulary has no token for byte {near[end - 1]}")

    def walk_back(self, last: list[int]) -> list[int]:
        out, at = [], len(last) - 1
        while at > 0:
            out.append(last[at])
            at -= len(self.spelled[last[at]])
        return out[::-1]

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Matches of the pattern in any order, best sorted: the entries for a prefix that a match shares with the one before it
        stay. A match that is itself a token is that token."""
        out, last, before = [], [-1], b""
        for data in pieces:
            whole = self.ranks.get(data)
            if whole is not None:
                out.append([whole])
                continue
            shared = 0
            for x, y in zip(before, data, strict=False):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :]
            self.extend(data, last, shared + 1)
            out.append(self.walk_back(last))
            before = data
        return out

    def encode_piece(self, data: bytes) -> list[int]:
        return self.encode_pieces([data])[0]

    def encode(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. Matches that the memo lacks are encoded once for all texts, in order of their bytes."""
        cut = [(_LATIN if common.is_latin(text) else _pattern()).findall(text) for text in texts]
        found = [self._pieces.all(pieces) for pieces in cut]
        missed = {p for pieces, known in zip(cut, found, strict=True) if None in known for p, ids in zip(pieces, known, strict=True) if ids is None}
        if missed:
            by_bytes = sorted((p.encode("utf-8", "surrogatepass"), p) for p in missed)
            new = {p: array("I", ids).tobytes() for (_, p), ids in zip(by_bytes, self.encode_pieces([b for b, _ in by_bytes]), strict=True)}
            self._pieces.add(new)
            found = [[new[p] if ids is None else ids for p, ids in zip(pieces, known, strict=True)] for pieces, known in zip(cut, found, strict=True)]
        return [b"".join(x) for x in found]

    def decode(self, ids: bytes) -> bytes:
        taken = self._spelled.take(pa.array(np.frombuffer(ids, dtype="<u4")))
        size = int(np.frombuffer(taken.buffers()[1], dtype="<i4", count=len(taken) + 1)[-1]) if len(taken) else 0
        return taken.buffers()[2].slice(0, size).to_pybytes() if size else b""


_compiled = None


def _pattern():
    global _compiled
    if _compiled is None:
        import public_tokenizers
        import regex

        _compiled = regex.compile(public_tokenizers.PATTERN)
    return _compiled


def load(path: str, cache: int = CACHE) -> ByteBPE:
    """The vocabulary, read once in each worker, and again after tasks of other operators."""
    loaded = common.held("byte_bpe")
    if (path, cache) not in loaded:
        loaded[path, cache] = ByteBPE(read_ranks(path), cache)
    return loaded[path, cache]


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _together(column: pa.Array) -> Iterator[list[str]]:
    """The texts of a column (null: empty) in lists of about TOGETHER characters."""
    texts, size = [], 0
    for value in column:
        text = value.as_py() or ""
        texts.append(text)
        size += len(text)
        if size >= TOGETHER:
            yield texts
            texts, size = [], 0
    if texts:
        yield texts


def encode_documents(docs: DataFrame, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit; if asked for), n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path or vocabulary_path())
        for batch in batches:
            done = 0
            for texts in _together(batch.column(1)):
                coded = bpe.encode_all(texts)
                columns = [
                    batch.column(0).slice(done, len(texts)),
                    pa.array(coded if with_ids else [None] * len(texts), pa.binary()),
                    pa.array([len(ids) // 4 for ids in coded], pa.int64()),
                    pa.array([hashlib.sha256(ids).hexdigest() for ids in coded], pa.string()),
                    pa.array([hashlib.sha256(bpe.decode(ids)).hexdigest() for ids in coded], pa.string()),
                ]
                done += len(texts)
                out = pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"])
                yield out if with_ids else out.drop_columns(["ids"])

    ids = "ids binary, " if with_ids else ""
    return docs.select("doc_id", "text").mapInArrow(common.lean(run, "byte_bpe"), f"doc_id bigint, {ids}n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of encoded documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path or vocabulary_path())
        for batch in batches:
            texts = [bpe.decode(x.as_py() or b"").decode("utf-8", "replace") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(common.lean(run, "byte_bpe"), "doc_id bigint, text string")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(common.read(spark, sf_dir, "documents"), with_ids=False)
