"""BK-tree under the Levenshtein metric, searched for many queries at once.

A node's distance to all active queries is computed bit-parallel: the words of
a query's column of the edit matrix hold 64 entry characters each, so entries
may have any length and any script.  The triangle inequality then decides, per
query, which children can hold an entry within its radius, so every entry
within the radius is reached.
"""

from __future__ import annotations

import numpy as np

_WORD = 64
_ONE, _TOP = np.uint64(1), np.uint64(_WORD - 1)


class Alphabet:
    """Numbers for the characters of the entries; every other character is 0."""

    def __init__(self, entries: list[str]) -> None:
        self.code = {c: i + 1 for i, c in enumerate(sorted(set("".join(entries))))}

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Matrix of character numbers and the lengths."""
        size = np.array([len(t) for t in texts], np.int64)
        codes = np.zeros((len(texts), int(size.max()) if len(texts) else 0), np.uint32)
        for i, t in enumerate(texts):
            codes[i, :len(t)] = [self.code.get(c, 0) for c in t]
        return codes, size

    def masks(self, entry: str) -> np.ndarray:
        """For each word of the column and each character, where the entry has it."""
        peq = np.zeros((max(1, -(-len(entry) // _WORD)), len(self.code) + 1), np.uint64)
        for i, c in enumerate(entry):
            peq[i // _WORD, self.code[c]] |= np.uint64(1 << (i % _WORD))
        return peq


def distances(entry: str, peq: np.ndarray, codes: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Levenshtein distance of one entry to every query; queries sorted by falling length."""
    m = len(entry)
    if m == 0:
        return size.copy()
    n, words = len(size), len(peq)
    last = np.uint64((m - 1) % _WORD)
    vp, vn = np.full((words, n), ~np.uint64(0)), np.zeros((words, n), np.uint64)
    score = np.full(n, m, np.int64)
    longest = int(size[0]) if n else 0
    active = np.searchsorted(-size, -np.arange(1, longest + 1), side="right")
    for j in range(longest):
        k = int(active[j])
        up, down = np.full(k, _ONE), np.zeros(k, np.uint64)  # the column's top grows by one a step
        for w in range(words):
            p, q = vp[w, :k], vn[w, :k]
            eq = peq[w][codes[:k, j]]
            x = eq | q
            eq = eq | down
            d0 = ((p + (eq & p)) ^ p) | eq
            hn = p & d0
            hp = q | ~(p | d0)
            top = last if w == words - 1 else _TOP
            out_up, out_down = (hp >> top) & _ONE, (hn >> top) & _ONE
            hp, hn = (hp << _ONE) | up, (hn << _ONE) | down
            vn[w, :k] = hp & x
            vp[w, :k] = hn | ~(x | hp)
            up, down = out_up, out_down
        score[:k] += up.astype(np.int64) - down.astype(np.int64)
    return score


class BkTree:
    def __init__(self, entries: list[str]) -> None:
        self.entries = sorted(set(entries))
        self.alphabet = Alphabet(self.entries)
        self.masks = [self.alphabet.masks(e) for e in self.entries]
        self.children: list[dict[int, int]] = [{} for _ in self.entries]
        # all entries under a node go to its children at once, by their distance to it
        todo = [(0, list(range(1, len(self.entries))))] if self.entries else []
        while todo:
            node, below = todo.pop()
            if not below:
                continue
            below.sort(key=lambda i: -len(self.entries[i]))
            codes, size = self.alphabet.encode([self.entries[i] for i in below])
            by: dict[int, list[int]] = {}
            for i, d in zip(below, distances(self.entries[node], self.masks[node], codes, size).tolist()):
                by.setdefault(d, []).append(i)
            for d, group in by.items():
                self.children[node][d] = group[0]
                todo.append((group[0], group[1:]))

    def within(self, queries: list[str], radius: np.ndarray) -> list[tuple[int, int, int]]:
        """Every (query, entry, distance) with a distance up to the query's radius."""
        n, hits = len(queries), []
        if not n or not self.entries:
            return hits
        order = np.argsort([-len(q) for q in queries], kind="stable")
        codes, size = self.alphabet.encode([queries[i] for i in order])
        r = np.asarray(radius, np.int64)[order]
        stack = [(0, np.arange(n))]
        while stack:
            node, act = stack.pop()
            d = distances(self.entries[node], self.masks[node], codes[act], size[act])
            hit = d <= r[act]
            hits.extend((int(order[a]), node, int(x)) for a, x in zip(act[hit], d[hit]))
            for c, child in self.children[node].items():
                reach = act[np.abs(d - c) <= r[act]]
                if len(reach):
                    stack.append((child, reach))
        return hits


def typing_distance(a: str, b: str) -> int:
    """Damerau-Levenshtein distance, the metric in which a swap of neighbours is one edit."""
    last: dict[str, int] = {}
    top = len(a) + len(b)
    h = [[top] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        h[i + 1][1] = i
    for j in range(len(b) + 1):
        h[1][j + 1] = j
    for i in range(1, len(a) + 1):
        seen = 0
        for j in range(1, len(b) + 1):
            k, m = last.get(b[j - 1], 0), seen
            if a[i - 1] == b[j - 1]:
                seen = j
            h[i + 1][j + 1] = min(h[i][j] + (a[i - 1] != b[j - 1]), h[i + 1][j] + 1, h[i][j + 1] + 1,
                                  h[k][m] + (i - k - 1) + 1 + (j - m - 1))
        last[a[i - 1]] = i
    return h[-1][-1]
