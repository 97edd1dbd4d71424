"""Byte-level BPE of a whole corpus (problem 8).

A partition's texts are split by the vocabulary's public pattern, and each
distinct piece is encoded once.  The distinct pieces of a batch are laid side
by side in one symbol array; an index maps every mergeable pair to all its
positions; ranks are applied in ascending order, each to all of its positions
at once, and only the lists of pairs beside a merge are updated.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folder of the public vocabulary files.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
# Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct pieces kept per worker before the cache starts afresh (bounds memory).
CACHE_PIECES = 200_000


def vocabulary_file(folder: str, vocabulary: str) -> str:
    """The rank file in its folder, or where an executor has no such folder the copy the driver sent."""
    path = f"{folder}/{vocabulary}.tiktoken"
    return path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))


def send(spark: SparkSession, folder: str, vocabulary: str) -> None:
    """Send the rank file to the executors; the same file again is no work."""
    path = f"{folder}/{vocabulary}.tiktoken"
    if os.path.exists(path):
        spark.sparkContext.addFile(path)


class Bpe:
    """Vocabulary of one rank file with its pair table."""

    def __init__(self, folder: str, vocabulary: str) -> None:
        with open(vocabulary_file(folder, vocabulary), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        codes, ids = [], []
        for token, i in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    codes.append(a << 20 | b)
                    ids.append(i)
        order = np.argsort(np.array(codes, np.int64))
        self.codes = np.array(codes, np.int64)[order]
        self.ids = np.array(ids, np.int64)[order]
        self.split = regex.compile(PATTERN).findall
        self.cache: dict[str, np.ndarray] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of each merged pair, -1 where the vocabulary has none."""
        code = left << 20 | right
        at = np.searchsorted(self.codes, code)
        at[at == len(self.codes)] = 0
        return np.where(self.codes[at] == code, self.ids[at], -1)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in one array, and where each piece ends in it."""
        size = np.array([len(p) for p in pieces], np.int64)
        total = int(size.sum())
        if not total:
            return np.zeros(0, np.int64), np.cumsum(size)
        sym = np.append(self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)], -1)
        piece = np.append(np.repeat(np.arange(len(pieces)), size), -1)
        nxt = np.arange(1, total + 2)
        prv = np.arange(-1, total)
        alive = np.ones(total + 1, bool)
        alive[total] = False
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(pos: np.ndarray) -> None:
            """Put the pairs that begin at pos into the index."""
            pos = pos[(pos >= 0)]
            pos = pos[piece[pos] == piece[nxt[pos]]]
            if not len(pos):
                return
            rank = self._rank(sym[pos], sym[nxt[pos]])
            keep = rank >= 0
            pos, rank = pos[keep], rank[keep]
            if not len(pos):
                return
            order = np.argsort(rank, kind="stable")
            pos, rank = pos[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, part in zip(rank[np.r_[0, cuts]].tolist(), np.split(pos, cuts)):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(heap, r)

        add(np.arange(total))
        while heap:
            rank = heapq.heappop(heap)
            parts = index.pop(rank)
            pos = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            if len(pos) > 1 and len(parts) == 1:
                pos = np.sort(pos)
            # entries may be stale: the pair must still stand there
            pos = pos[alive[pos]]
            pos = pos[piece[pos] == piece[nxt[pos]]]
            if not len(pos):
                continue
            pos = pos[self._rank(sym[pos], sym[nxt[pos]]) == rank]
            if not len(pos):
                continue
            right = nxt[pos]
            if len(pos) > 1 and (right[:-1] == pos[1:]).any():
                # a run such as "aaa": take positions from the left, none twice
                taken, last = [], -1
                for p, q in zip(pos.tolist(), right.tolist()):
                    if p != last:
                        taken.append(p)
                        last = q
                pos = np.array(taken, np.int64)
                right = nxt[pos]
            sym[pos] = rank
            alive[right] = False
            after = nxt[right]
            nxt[pos] = after
            inside = after <= total
            prv[after[inside]] = pos[inside]
            before = prv[pos]
            add(np.unique(np.concatenate([before[before >= 0], pos])))
        out = sym[alive]
        return out, np.cumsum(np.bincount(piece[alive], minlength=len(pieces)))

    def learn(self, texts: list[list[str]]) -> None:
        """Encode the pieces of texts that the cache lacks."""
        new = {p for t in texts for p in t}.difference(self.cache)
        if len(self.cache) + len(new) > CACHE_PIECES:
            self.cache = {}
            new = {p for t in texts for p in t}
        if new:
            words = list(new)
            ids, ends = self.encode_pieces([w.encode("utf-8", "surrogatepass") for w in words])
            flat, b = ids.tolist(), 0
            for w, e in zip(words, ends.tolist()):
                self.cache[w] = flat[b:e]
                b = e

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        pieces = [self.split(t) if t else [] for t in texts]
        self.learn(pieces)
        get = self.cache.__getitem__
        return [[i for ids in map(get, p) for i in ids] for p in pieces]

    def count_batch(self, texts: list[str | None]) -> list[int]:
        pieces = [self.split(t) if t else [] for t in texts]
        self.learn(pieces)
        get = self.cache.__getitem__
        return [sum(map(len, map(get, p))) for p in pieces]


@lru_cache(maxsize=2)
def load(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> Bpe:
    return Bpe(folder, vocabulary)


#: Characters encoded at once; texts are never cut.
CHUNK_CHARS = 4_000_000


def _chunks(texts: list[str | None]) -> Iterator[list[str | None]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size >= CHUNK_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode(documents: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, ids``: token ids of every text, special-token strings taken as ordinary text.

    An empty text and a null text give the empty list; a repeated row gives a
    repeated row.  Narrow: no shuffle, each partition is read once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(folder, vocabulary)
        for batch in batches:
            texts, at = batch.column(1).to_pylist(), 0
            for part in _chunks(texts):
                lists = bpe.encode_batch(part)
                ends = np.cumsum([0] + [len(x) for x in lists]).astype(np.int32)
                flat = np.fromiter((i for x in lists for i in x), np.int32, int(ends[-1]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_id", "ids"])
                at += len(part)

    send(documents.sparkSession, folder, vocabulary)
    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def count_tokens(documents: DataFrame, *keep: str, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """The kept columns with ``n_tokens`` of the text; 0 for empty and null texts."""
    src = documents.select(*keep, "text")
    out = T.StructType([src.schema[c] for c in keep] + [T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(folder, vocabulary)
        for batch in batches:
            counts = [n for part in _chunks(batch.column(len(keep)).to_pylist()) for n in bpe.count_batch(part)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(counts, pa.int64())], names=[*keep, "n_tokens"])

    send(documents.sparkSession, folder, vocabulary)
    return src.mapInArrow(run, out)


def token_share(documents: DataFrame) -> DataFrame:
    """Tokens by source, a small report on the encoding."""
    return (count_tokens(documents, "source").groupBy("source")
            .agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")))
