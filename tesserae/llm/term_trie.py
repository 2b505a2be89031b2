"""A byte radix trie whose leaves count a term's documents and its occurrences by source; it merges with others of its kind.

Leaves are numbered as they are made. Counts are kept in the nodes (add), or by the numbers of the leaves in columns that
numpy sums up (Counted), which is for many terms at once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np


class Node:
    """`edges` maps the first byte of each label to the child, if there is one; a node that ends a term has a number. `depth`
    is the length of the path to the label's end."""

    __slots__ = ("label", "depth", "edges", "number", "docs", "counts")

    def __init__(self, label: bytes, depth: int):
        self.label, self.depth, self.edges, self.number, self.docs, self.counts = label, depth, None, None, 0, None


class TermTrie:
    """Terms as paths of bytes. Children in byte order give terms in byte order, which for UTF-8 is code point order.

    Terms that come in order start from what they share with the one before, on the path to its leaf.
    """

    def __init__(self):
        self.root, self.leaves = Node(b"", 0), 0

    def leaf(self, term: bytes) -> Node:
        """The node that ends at the term, made where it is not there."""
        (node,) = self._ends([(term, 0)])
        if node.counts is None:
            node.counts = {}
        return node

    def enter(self, terms: Iterable[tuple[bytes, int]]) -> np.ndarray:
        """The numbers of the leaves of (term, length shared with the one before), made where they are not there."""
        return np.array([node.number for node in self._ends(terms)], dtype=np.int64)

    def _ends(self, terms: Iterable[tuple[bytes, int]]) -> list[Node]:
        path, out, leaves = [self.root], [], self.leaves
        for term, shared in terms:
            node, n = path[-1], len(term)
            while node.depth > shared:
                path.pop()
                node = path[-1]
            at = node.depth
            while at < n:
                edges, first = node.edges, term[at]
                if edges is None:
                    edges = node.edges = {}
                if first in edges:
                    child = edges[first]
                    if not term.startswith(child.label, at):
                        child = edges[first] = _cut(child, _shared(child.label, term, at))
                    at = child.depth
                else:
                    child = edges[first] = Node(term[at:], n)
                    at = n
                path.append(child)
                node = child
            if node.number is None:
                node.number = leaves
                leaves += 1
            out.append(node)
        self.leaves = leaves
        return out

    def add(self, term: bytes, docs: int, sources: list, counts: list) -> None:
        node = self.leaf(term)
        node.docs += docs
        held = node.counts
        if held:
            for source, n in zip(sources, counts, strict=True):
                held[source] = held.get(source, 0) + n
        else:
            node.counts = dict(zip(sources, counts, strict=True))

    def merge(self, other: TermTrie) -> None:
        for term, _, node in other.walk():
            self.add(term, node.docs, list(node.counts), list(node.counts.values()))

    def walk(self) -> Iterator[tuple[bytes, int, Node]]:
        """(term, length shared with the term before, node) in byte order. Between two terms the walk goes back to the node
        at which they part, the shortest path it starts from on its way."""
        stack, shared = [(b"", self.root)], 0
        while stack:
            before, node = stack.pop()
            if len(before) < shared:
                shared = len(before)
            term = before + node.label
            if node.number is not None:
                yield term, shared, node
                shared = len(term)
            edges = node.edges
            if edges:
                firsts = sorted(edges, reverse=True) if len(edges) > 1 else edges
                stack.extend([(term, edges[first]) for first in firsts])


def _shared(label: bytes, term: bytes, at: int) -> int:
    most = min(len(label), len(term) - at)
    for i in range(most):
        if label[i] != term[at + i]:
            return i
    return most


def _cut(node: Node, k: int) -> Node:
    """A new node for the first k bytes of the label, over the old one."""
    upper = Node(node.label[:k], node.depth - len(node.label) + k)
    node.label = node.label[k:]
    upper.edges = {node.label[0]: node}
    return upper


class Counted:
    """A trie with columns: documents by number of leaf, and occurrences by leaf and source, whose id is below `SOURCES`."""

    SOURCES = 1 << 31

    def __init__(self):
        self.trie = TermTrie()
        self.docs = np.zeros(0, dtype=np.int64)
        self.pairs = self.counts = np.zeros(0, dtype=np.int64)

    def take(self, leaves: np.ndarray, docs: np.ndarray, of: np.ndarray, sources: np.ndarray, counts: np.ndarray) -> None:
        """Add documents to leaves, and occurrences of sources to the leaves `of` them."""
        self.docs = np.concatenate([self.docs, np.zeros(self.trie.leaves - len(self.docs), dtype=np.int64)])
        np.add.at(self.docs, leaves, docs)
        self.pairs, self.counts = summed(np.concatenate([self.pairs, of * self.SOURCES + sources]), np.concatenate([self.counts, counts]))

    def columns(self, least: int = 1) -> tuple[list[bytes], list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Terms that `least` documents hold, in byte order: (terms, lengths shared with the term before in the trie, docs,
        numbers of sources, sources, counts)."""
        docs = self.docs.tolist()
        terms, shared, numbers = [], [], []
        for term, common, node in self.trie.walk():
            if docs[node.number] >= least:
                terms.append(term)
                shared.append(common)
                numbers.append(node.number)
        ranks = np.full(len(docs), -1, dtype=np.int64)
        ranks[numbers] = np.arange(len(numbers))
        leaf, source = np.divmod(self.pairs, self.SOURCES)
        rank = ranks[leaf]
        order = np.argsort(rank, kind="stable")[np.count_nonzero(rank < 0) :]
        return terms, shared, self.docs[numbers], np.bincount(rank[order], minlength=len(numbers)), source[order], self.counts[order]


def summed(key: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of each column by key."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first], *(np.add.reduceat(c[order], first) if len(first) else c for c in columns)


def packed(leaves: list[tuple]) -> tuple[list[str], bytes]:
    """Neighbouring leaves (term, length shared with the one before, docs, sources, counts) as (sources, block)."""
    terms, shared, docs, sources, counts = zip(*leaves, strict=True)
    names = {s: i for i, s in enumerate(dict.fromkeys(chain.from_iterable(sources)))}
    ids, counts = ([f(x) for x in chain.from_iterable(c)] for f, c in ((names.__getitem__, sources), (int, counts)))
    return next(blocks(list(terms), list(shared), *(np.array(c, dtype=np.int64) for c in (docs, list(map(len, sources)), ids, counts)), list(names), [0]))


def blocks(terms: list[bytes], shared: list[int], docs: np.ndarray, widths: np.ndarray, ids: np.ndarray, counts: np.ndarray, names: list[str], starts: list[int]) -> Iterator[tuple[list[str], bytes]]:
    """Neighbouring leaves as (sources, block), from each of `starts` to the next. `ids` are of `names`, `widths` of them
    for each leaf."""
    common = np.array(shared, dtype="<i4")
    common[starts] = 0  # a block's first term is whole
    rests = [term[k:] for term, k in zip(terms, common.tolist(), strict=True)]
    lengths, pairs = np.array(list(map(len, rests)), dtype="<i4"), [0, *np.cumsum(widths).tolist()]
    docs, widths, counts = docs.astype("<i8"), widths.astype("<i4"), counts.astype("<i8")
    for a, b in zip(starts, [*starts[1:], len(terms)], strict=True):
        some = slice(pairs[a], pairs[b])
        own, local = np.unique(ids[some], return_inverse=True)
        sizes = np.array([b - a, pairs[b] - pairs[a]], dtype="<i8")
        columns = (sizes, docs[a:b], counts[some], common[a:b], lengths[a:b], widths[a:b], local.astype("<i4"))
        yield [names[i] for i in own.tolist()], b"".join([c.tobytes() for c in columns] + rests[a:b])


def opened(block: bytes) -> tuple[list[bytes], list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The leaves of a block: (terms, lengths shared with the one before, docs, widths, ids, counts)."""
    n, m = map(int, np.frombuffer(block, "<i8", 2))
    at, columns = 16, []
    for dtype, size in (("<i8", n), ("<i8", m), ("<i4", n), ("<i4", n), ("<i4", n), ("<i4", m)):
        columns.append(np.frombuffer(block, dtype, size, at))
        at += size * int(dtype[-1])
    docs, counts, shared, lengths, widths, ids = columns
    terms, term, shared = [], b"", shared.tolist()
    for common, length in zip(shared, lengths.tolist(), strict=True):
        term = term[:common] + block[at : at + length]
        at += length
        terms.append(term)
    return terms, shared, docs, widths, ids, counts


def unpacked(names: list[str], block: bytes) -> Iterator[tuple[bytes, int, int, list[str], list[int]]]:
    """(term, length shared with the one before, docs, sources, counts) of each leaf of a block, in order."""
    terms, shared, docs, widths, ids, counts = opened(block)
    sources, counts, pair = [names[k] for k in ids.tolist()], counts.tolist(), 0
    for term, common, n_docs, width in zip(terms, shared, docs.tolist(), widths.tolist(), strict=True):
        yield term, common, n_docs, sources[pair : pair + width], counts[pair : pair + width]
        pair += width
