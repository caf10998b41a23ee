"""Weighted acyclic automata over words: n-grams with counts, built from sorted input, united by adding weights.

A path of up to DEPTH words is one n-gram, its weight how often it occurs. The weight of a prefix is the sum over the paths
through it. The last level is shared: states with the same arcs and weights are kept once (a register of states, as in the
incremental construction from sorted input), which makes shards of mostly rare n-grams small.
"""

from __future__ import annotations

import numpy as np

from .blobs import pack, unpack

#: Words on a path; word number 0 stands for the end of a shorter path.
DEPTH = 3
_BITS = 21


def heads(*sorted_keys: np.ndarray) -> np.ndarray:
    """Places where a run of equal keys begins."""
    begins = np.ones(len(sorted_keys[0]), bool)
    begins[1:] = False
    for key in sorted_keys:
        begins[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(begins)


def summed(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-grams (rows of DEPTH word numbers) and the sums of their counts."""
    if not len(grams):
        return grams, counts
    if int(grams.max()) < 1 << _BITS:
        packed = grams[:, 0].astype(np.int64)
        for k in range(1, DEPTH):
            packed <<= _BITS
            packed |= grams[:, k]
        order = np.argsort(packed, kind="stable")
        del packed
    else:
        order = np.lexsort(grams.T[::-1])
    grams, counts = grams[order], counts[order]
    begins = heads(*grams.T)
    return grams[begins], np.add.reduceat(counts, begins)


class CountAutomaton:
    """Sorted distinct words (number 0 is the end mark, b"") and the sorted n-grams over their numbers with weights."""

    def __init__(self, words: list[bytes], grams: np.ndarray, counts: np.ndarray):
        self.words, self.grams, self.counts = words, grams, counts

    @classmethod
    def of(cls, words: list[bytes], grams: np.ndarray, counts: np.ndarray) -> CountAutomaton:
        """From any n-grams over the numbers of `words`: only used words stay, in byte order."""
        used, numbers = np.unique(np.append(grams.ravel(), 0), return_inverse=True)
        kept = [words[i] for i in used.tolist()]
        order = sorted(range(len(kept)), key=kept.__getitem__)
        rank = np.empty(len(kept), np.int32)
        rank[order] = np.arange(len(kept))
        return cls([kept[i] for i in order], *summed(rank[numbers[:-1]].reshape(-1, DEPTH), counts))

    @classmethod
    def union(cls, parts: list[CountAutomaton]) -> CountAutomaton:
        """One automaton with the weights of all added up."""
        words = sorted(set().union(*(p.words for p in parts), {b""}))
        number = {w: i for i, w in enumerate(words)}
        counts, grams = np.concatenate([p.counts for p in parts]), np.empty((sum(len(p.grams) for p in parts), DEPTH), np.int32)
        at = 0
        for p in parts:
            grams[at : at + len(p.grams)] = np.fromiter(map(number.__getitem__, p.words), np.int32, len(p.words))[p.grams]
            at += len(p.grams)
            p.grams = grams[:0]  # its numbers are in the whole now
        return cls(words, *summed(grams, counts))

    def prefixes(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted prefixes of exactly `length` words and their weights: sums over the paths through them."""
        begins = heads(*self.grams.T[:length]) if len(self.grams) else np.zeros(0, np.int64)
        weights = np.add.reduceat(self.counts, begins) if len(begins) else self.counts
        full = self.grams[begins][:, length - 1] > 0
        return self.grams[begins[full]][:, :length], weights[full]

    def to_bytes(self) -> bytes:
        """Levels of arcs: first words, second words with the state they lead to, and the shared states of third words."""
        g, c = self.grams, self.counts
        first, second = heads(*g.T[:1]), heads(*g.T[:2])
        degree = np.diff(np.append(second, len(g)))
        state = np.empty(len(second), np.int64)
        owners: list[int] = []
        register: dict[tuple[int, ...], int] = {}
        third, weight, starts, sizes = g[:, 2].tolist(), c.tolist(), second.tolist(), degree.tolist()
        for s, (a, n) in enumerate(zip(starts, sizes, strict=True)):
            arcs = (third[a], weight[a]) if n == 1 else (*third[a : a + n], *weight[a : a + n])
            at = register.get(arcs)
            if at is None:
                at = register[arcs] = len(owners)
                owners.append(s)
            state[s] = at
        owner = np.array(owners, np.int64)
        inside = np.concatenate([np.arange(starts[s], starts[s] + sizes[s]) for s in owners]) if owners else np.zeros(0, np.int64)
        parts = [g[first, 0], np.diff(np.append(np.searchsorted(second, first), len(second))), g[second, 1], state, degree[owner], g[inside, 2], c[inside]]
        return pack(parts, b"\n".join(self.words))

    @classmethod
    def from_bytes(cls, data: bytes) -> CountAutomaton:
        columns, text = unpack(data)
        words, parts = text.split(b"\n"), [c.astype(np.int64) for c in columns]
        del columns
        first, fan, second, state, degree, third, weight = parts
        begin = np.cumsum(degree) - degree
        sizes = degree[state]
        ends = np.cumsum(sizes)
        inside = np.repeat(begin[state] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
        grams = np.empty((len(inside), DEPTH), np.int32)
        for k, column in enumerate((np.repeat(np.repeat(first, fan), sizes), np.repeat(second, sizes), third[inside])):
            grams[:, k] = column
        return cls(words, grams, weight[inside])
