"""Documents of several sources mixed to target shares (problem 9).

Each source's documents stand in pseudorandom order as one stream of tokens,
packed into blocks of exactly BLOCK_TOKENS tokens (the last is short).  The
mix has a number of block slots per source; every output shard draws how many
of its slots each source gets, a multinomial draw given the totals.  A
source's slots go pass after pass through its blocks, each pass by a keyed
pseudorandom permutation of the block indexes, and blocks are joined by index.
Documents stay whole: a document is used as often as the block of its first
token.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm import bpe
from ledgerloom.session import cut

BLOCK_TOKENS = 256
SHARD_SLOTS = 4096
#: Shards that one task draws at a time.
CHUNK_SHARDS = 256
#: Shards whose counts are drawn from common totals; larger mixes give each such group its exact proportion.
GROUP_SHARDS = 1 << 17
#: Least rows of one bucket of a prefix sum; buckets grow with the root of the rows, so neither level of the sum is large.
BUCKET_ROWS = 2000
#: More targets than this are refused: the plan of the mix is made on the driver.
MAX_SOURCES = 10_000
SEED = 9


def sized(documents: DataFrame) -> DataFrame:
    """``doc_id, source, n_tokens`` of documents with tokens and a source, repeated rows once."""
    n = bpe.count_tokens(documents.where("doc_id is not null and source is not null"), "doc_id", "source").where("n_tokens > 0")
    return n.groupBy("doc_id").agg(F.max(F.struct("source", "n_tokens")).alias("d")).select("doc_id", "d.source", "d.n_tokens")


# ---- keyed permutations of 0..n-1

def _rounds(left: np.ndarray, right: np.ndarray, half: np.ndarray, key: np.ndarray, order: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    mask = (np.uint64(1) << half) - np.uint64(1)
    for r in order:
        x = right + key + np.uint64((0x9E3779B97F4A7C15 * (r + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        left, right = right, left ^ ((x ^ (x >> np.uint64(31))) & mask)
    return left, right


def permuted(x: np.ndarray, n: np.ndarray, key: np.ndarray, inverse: bool = False) -> np.ndarray:
    """Image of x under the permutation of 0..n-1 that belongs to a key, or its inverse.

    A balanced Feistel network over the next even number of bits; values that
    leave the range walk on along their cycle until they are in it again.
    """
    x, n, key = (np.ascontiguousarray(a).astype(np.uint64) for a in np.broadcast_arrays(x, n, key))
    bits = np.ceil(np.log2(np.maximum(n, 2).astype(float))).astype(np.uint64)
    half = (bits + np.uint64(1)) >> np.uint64(1)
    out, todo = x.copy(), np.arange(len(x))
    with np.errstate(over="ignore"):
        while len(todo):
            h, v = half[todo], out[todo]
            a, b = v >> h, v & ((np.uint64(1) << h) - np.uint64(1))
            if inverse:  # the same network with its rounds and halves turned round
                b, a = _rounds(b, a, h, key[todo], (3, 2, 1, 0))
            else:
                a, b = _rounds(a, b, h, key[todo], (0, 1, 2, 3))
            out[todo] = (a << h) | b
            todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def pass_key(source: str, turn: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{SEED} {turn} {source}".encode(), digest_size=7).digest(), "big")


@F.arrow_udf(T.LongType())
def _turned_back(x: pa.Array, n: pa.Array, key: pa.Array) -> pa.Array:
    return pa.array(permuted(x.to_numpy(zero_copy_only=False), n.to_numpy(zero_copy_only=False), key.to_numpy(zero_copy_only=False), inverse=True), pa.int64())


# ---- plan

class Plan:
    """Passes, blocks and slots of every source; one small row per source on the driver."""

    def __init__(self, sizes: DataFrame, targets: DataFrame) -> None:
        spark = sizes.sparkSession
        t = (targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source")
             .agg(F.sum("target_share").alias("share"), F.min("max_repeats").alias("cap")))
        have = sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
        rows = t.join(have, "source").orderBy("source").limit(MAX_SOURCES + 1).collect()  # one row per target
        if len(rows) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources have targets")
        #: Largest total at which every source that has documents reaches its share.
        self.total = min((r.cap * r.tokens / r.share for r in rows), default=0.0)
        out = []
        for r in rows:
            quota = self.total * r.share
            passes = min(int(quota // r.tokens + 1e-9), r.cap)
            rest = quota - passes * r.tokens if passes < r.cap else 0.0
            out.append((r.source, math.ceil(r.tokens / BLOCK_TOKENS), passes, float(rest), pass_key(r.source, passes), max(BUCKET_ROWS, math.isqrt(r.docs))))
        names = "source string, blocks bigint, passes int, rest double, rest_key bigint, bucket_rows bigint"
        #: At most MAX_SOURCES rows, so it may be broadcast.
        self.table = F.broadcast(spark.createDataFrame([(*o, max(1, r.docs // o[5])) for o, r in zip(out, rows)], names + ", buckets bigint"))
        self.placed = cut(_placed(sizes, self.table))
        last = {r.source: r.blocks_used for r in _cut_off(self.placed).collect()}  # one row per target at most
        #: ``(source, blocks, slots)`` of every source with slots.
        self.sources = [(s, b, p * b + last.get(s, 0)) for s, b, p, *_ in out if p * b + last.get(s, 0) > 0]
        self.slots = sum(n for _, _, n in self.sources)


def _prefix(df: DataFrame, keys: list[str], bucket: str, order: list[str], value: str) -> DataFrame:
    """Adds ``before``, the sum of value over the rows of the keys that stand before, in two levels."""
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("in_bucket"))
    ahead = sums.withColumn("ahead", F.sum("in_bucket").over(Window.partitionBy(*keys).orderBy(bucket)) - F.col("in_bucket")).drop("in_bucket")
    w = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = df.withColumn("inside", F.coalesce(F.sum(value).over(w), F.lit(0)))
    return inside.join(ahead.hint("merge"), [*keys, bucket]).withColumn("before", F.col("ahead") + F.col("inside")).drop("ahead", "inside", bucket)


def _placed(sizes: DataFrame, table: DataFrame) -> DataFrame:
    """``doc_id, source, n_tokens, start, block, turn``: place in the stream, block of the first token, its place in the last, partial pass."""
    d = sizes.join(table.select("source", "buckets"), "source").withColumn("h", F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("order")), 1))
    # buckets in the order of the hash itself, so the stream runs through them in turn
    d = d.withColumn("bucket", F.expr("shiftright(shiftright(h, 31) * buckets, 32)")).drop("buckets")
    at = _prefix(d, ["source"], "bucket", ["h", "doc_id"], "n_tokens").select("doc_id", "source", "n_tokens", F.col("before").alias("start"))
    at = at.withColumn("block", F.expr(f"start div {BLOCK_TOKENS}"))
    return at.join(table.select("source", "blocks", "rest", "rest_key", "bucket_rows"), "source").withColumn("turn", _turned_back("block", "blocks", "rest_key"))


def _cut_off(placed: DataFrame) -> DataFrame:
    """``source, blocks_used``: how many blocks of the partial pass fill what is missing, to the nearest document."""
    d = placed.where("rest > 0").groupBy("source", "turn", "rest", "bucket_rows").agg(F.sum("n_tokens").alias("n_tokens"))
    d = _prefix(d.withColumn("bucket", F.expr("turn div bucket_rows")), ["source"], "bucket", ["turn"], "n_tokens")
    # a block is taken if most of its documents' tokens are still missing
    return d.where(F.col("before") + F.col("n_tokens") / 2 <= F.col("rest")).groupBy("source").agg((F.max("turn") + 1).alias("blocks_used"))


# ---- drawing

def _draw(colors: np.ndarray, n: int, lo: int, hi: int) -> np.ndarray:
    """Source counts of the first n of all slots of shards lo..hi: a multinomial draw given the totals."""
    rng = np.random.Generator(np.random.Philox(key=[SEED, lo ^ (hi << 32)]))
    return rng.multivariate_hypergeometric(colors, n, method="marginals")


def drawn(lo: int, hi: int, first: int, last: int, colors: np.ndarray, offset: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(shard, counts, offsets)`` of the shards first..last-1 out of lo..hi-1, which hold colors together.

    The range is halved down to single shards; every halving has a random
    stream of its own, so any task draws the same counts for a shard.
    """
    if hi <= first or lo >= last:
        return
    if hi - lo == 1:
        yield lo, colors, offset
        return
    mid = (lo + hi) // 2
    left = _draw(colors, (mid - lo) * SHARD_SLOTS, lo, hi)
    yield from drawn(lo, mid, first, last, left, offset)
    yield from drawn(mid, hi, first, last, colors - left, offset + left)


def _groups(totals: np.ndarray, slots: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """``(counts, offsets)`` of each group of GROUP_SHARDS shards: exact proportions by largest remainders."""
    out, left, offset = [], totals.copy(), np.zeros_like(totals)
    while (rest := int(left.sum())) > 0:
        size = min(GROUP_SHARDS * SHARD_SLOTS, rest)
        exact = [int(x) * size for x in left]
        take = np.array([e // rest for e in exact], np.int64)
        short = size - int(take.sum())
        for i in sorted(range(len(exact)), key=lambda i: -(exact[i] % rest))[:short]:
            take[i] += 1
        out.append((take, offset.copy()))
        left, offset = left - take, offset + take
    return out


def _shards(plan: Plan, expand: bool) -> DataFrame:
    """Counts by shard and source, or with expand one row per slot, drawn in chunks spread over the cluster."""
    spark = plan.table.sparkSession
    names = [s for s, _, _ in plan.sources]
    blocks = np.array([b for _, b, _ in plan.sources], np.int64)
    groups = _groups(np.array([n for _, _, n in plan.sources], np.int64), plan.slots)
    shards = -(-plan.slots // SHARD_SLOTS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for chunk in b["id"]:
                first, last = int(chunk) * CHUNK_SHARDS, min((int(chunk) + 1) * CHUNK_SHARDS, shards)
                for g in range(first // GROUP_SHARDS, (last - 1) // GROUP_SHARDS + 1):
                    lo, hi = g * GROUP_SHARDS, min((g + 1) * GROUP_SHARDS, shards)
                    for shard, counts, offset in drawn(lo, hi, first, last, *groups[g]):
                        if not expand:
                            yield pd.DataFrame({"shard": shard, "source": names, "n_slots": counts})
                            continue
                        of = np.repeat(np.arange(len(names)), counts)
                        j = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts) + offset[of]
                        turn, x = j // blocks[of], j % blocks[of]
                        both, which = np.unique(np.stack([of, turn]), axis=1, return_inverse=True)
                        key = np.array([pass_key(names[s], t) for s, t in both.T.tolist()], np.uint64)[which.reshape(-1)]
                        place = permuted(np.arange(len(of)), np.full(len(of), len(of)), np.full(len(of), shard))
                        yield pd.DataFrame({"shard": shard, "slot": shard * SHARD_SLOTS + place, "source": np.array(names, object)[of],
                                            "turn": turn, "block": permuted(x, blocks[of], key)})

    schema = "shard bigint, slot bigint, source string, turn bigint, block bigint" if expand else "shard bigint, source string, n_slots bigint"
    chunks = -(-shards // CHUNK_SHARDS)
    return spark.range(0, chunks, 1, max(1, chunks)).mapInPandas(run, schema)


def slots(plan: Plan) -> DataFrame:
    """``shard, slot, source, turn, block``: one row per block slot of the mix."""
    return _shards(plan, True)


def packed(plan: Plan) -> DataFrame:
    """``source, block, doc_id, from_token, to_token``: the tokens each block is made of, in all BLOCK_TOKENS of them but in a source's last block."""
    first, last = F.col("block"), F.expr(f"(start + n_tokens - 1) div {BLOCK_TOKENS}")
    p = plan.placed.select("source", "doc_id", "start", "n_tokens", F.explode(F.sequence(first, last)).alias("block"))
    return p.select("source", "block", "doc_id", F.expr(f"greatest(block * {BLOCK_TOKENS} - start, 0)").alias("from_token"),
                    F.expr(f"least((block + 1) * {BLOCK_TOKENS} - start, n_tokens)").alias("to_token"))


def mix(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """``doc_id, source, n_tokens, copies`` of the chosen documents.

    The total is the largest at which every source reaches its share within
    its cap; the last, partial pass of a source ends at the document nearest to
    its share.  Sources without tokens or targets, targets of zero and empty
    documents take no part.  No document is used more than max_repeats times.
    """
    plan = Plan(cut(sized(documents)), targets)
    used = slots(plan).groupBy("source", "block").agg(F.count("*").alias("copies"))
    docs = plan.placed.select("doc_id", "source", "n_tokens", "block")
    return docs.join(used.hint("merge"), ["source", "block"]).select("doc_id", "source", "n_tokens", "copies")


def shares(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target_share, actual_share, n_docs, n_tokens`` of every target, 0 where nothing was chosen."""
    m = mix(documents, targets).groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.col("n_tokens") * F.col("copies")).alias("n_tokens"))
    t = targets.where("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"))
    all_ = t.join(m, "source", "left").fillna(0, ["n_docs", "n_tokens"])
    total = all_.agg(F.sum("n_tokens").alias("total"))
    return all_.crossJoin(F.broadcast(total)).select("source", "target_share", F.expr("coalesce(try_divide(n_tokens, total), 0)").alias("actual_share"), "n_docs", "n_tokens")


def shard_counts(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """``shard, source, n_slots``: the source counts drawn for each output shard."""
    return _shards(Plan(cut(sized(documents)), targets), False).where("n_slots > 0")
