"""Freely typed names to a canonical list (problem 7).

Every name is searched for in a BK-tree over the reference entries: as typed
and with abbreviations written out, with and without framing words, first for
entries at distance 0, then with its words in sorted order in a second tree of
the entries' sorted words, then turned word by word within the allowed typing
edits.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.bktree import BkTree, typing_distance
from ledgerloom.session import cut

UNMATCHED = "unmatched"
#: Reference lists up to this many entries travel with the task; longer ones are sharded, with the same results.
MAX_BROADCAST_TERMS = 5_000
#: Rows gathered before their distinct names are searched together.
CHUNK_ROWS = 250_000
#: Allowed typing edits: none in very short names, one in short ones, else two.
SHORT, LONG = 5, 8
#: Names remembered per task before the memory starts afresh.
MEMORY = 500_000


@dataclass(frozen=True)
class Spelling:
    """What is known of the way names are typed; another corpus brings its own."""

    # Usual abbreviations in names of organisations and measures.
    abbreviations: dict[str, str] = field(default_factory=lambda: {
        "ltd": "limited", "lmtd": "limited", "ind": "industries", "inds": "industries", "hldgs": "holdings",
        "hldg": "holdings", "corp": "corporation", "pvt": "private", "comm": "commission", "stats": "statistics",
        "min": "ministry", "gr": "gross", "cap": "capital", "o/s": "outstanding", "bal": "balances",
        "emp": "employee", "op": "operating", "oper": "operating", "fgn": "foreign", "inv": "inventory",
        "avg": "average", "co": "company", "govt": "government", "dept": "department", "natl": "national",
        "intl": "international", "mfg": "manufacturing", "exp": "expenditure", "auth": "authority",
    })
    # Words and phrases around a name that are no part of it.
    before: tuple[str, ...] = ("the", "m/s", "reported", "total", "group")
    after: tuple[str, ...] = ("overall", "consolidated", "audited", "unaudited", "total", "and subsidiaries")


SPELLING = Spelling()
_BRACKETS = regex.compile(r"[(\[][^)\]]*[)\]]?")
_WORD = regex.compile(r"[\p{L}\p{N}][\p{L}\p{M}\p{N}]*(?:/[a-z](?![a-z]))?")


def words(name: str) -> list[str]:
    """Words of a name in any script: no case, punctuation, text in brackets or accents of Latin letters."""
    s = unicodedata.normalize("NFKD", name).casefold()
    s = "".join(c for c in s if not 0x300 <= ord(c) <= 0x36F)
    s = s.replace("(p)", " private ")
    bare = _BRACKETS.sub(" ", s)
    return _WORD.findall(bare) or _WORD.findall(s)


def normal(name: str, spelling: Spelling = SPELLING) -> str:
    return " ".join(spelling.abbreviations.get(t, t) for t in words(name))


def allowed(n_chars: int) -> int:
    return 0 if n_chars < SHORT else 1 if n_chars < LONG else 2


@lru_cache(maxsize=100_000)
def _near(a: str, b: str) -> bool:
    return a == b or (abs(len(a) - len(b)) <= 2 and len(b) > 2 and typing_distance(a, b) <= max(1, allowed(len(b))))


def _framed(w: list[str], phrase: list[str]) -> bool:
    return len(w) > len(phrase) and all(map(_near, w[-len(phrase):], phrase))


def variants(name: str, spelling: Spelling = SPELLING) -> list[list[str]]:
    """Word lists of a name: as typed and with abbreviations written out, each as it stands and without framing words before or after it."""
    typed = words(name)
    out: list[list[str]] = []
    for w in (typed, [spelling.abbreviations.get(t, t) for t in typed]):
        if w in out:
            continue
        cut_off = [w[:-len(p)] for p in (x.split() for x in spelling.after) if _framed(w, p)][:1]
        out += [w, *cut_off]
        if len(w) > 1 and any(_near(w[0], x) for x in spelling.before):
            out += [v[1:] for v in (w, *cut_off) if len(v) > 1]
    return [v for v in out if v]


def queries(name: str, spelling: Spelling) -> list[str]:
    """What is searched within the allowed edits: every variant, turned to start at each of its words."""
    return [" ".join(v[k:] + v[:k]) for v in variants(name, spelling) for k in range(len(v))]


class Matcher:
    """Names of one kind against its reference entries ``[(raw, canon_id)]``, or a shard of them."""

    def __init__(self, terms: list[tuple[str, str]], spelling: Spelling = SPELLING) -> None:
        self.spelling = spelling
        self.literal = {raw for raw, _ in terms}
        self.ids: dict[str, str] = {}
        self.sorted_ids: dict[str, set[str]] = {}
        for raw, cid in terms:
            n = normal(raw, spelling)
            if n:  # an entry without letters and digits means nothing
                self.ids[n] = min(cid, self.ids.get(n, cid))
                self.sorted_ids.setdefault(" ".join(sorted(n.split())), set()).add(cid)
        self.tree, self.sorted_tree = BkTree(list(self.ids)), BkTree(list(self.sorted_ids))
        self.longest = max((len(e) for e in self.tree.entries), default=0)
        self.memory: dict[str, str] = {}

    def _search(self, asked: list[tuple[str, str]], tree: BkTree, edits: bool) -> Iterator[tuple[str, int, str]]:
        """``(name, typing distance, entry)`` of all entries allowed, for (name, query) pairs."""
        # farther from every entry than any radius
        asked = [(n, q) for n, q in asked if len(q) <= self.longest + 2 * allowed(LONG)]
        # a swap is two edits of the tree's metric, so twice the allowed edits reach every candidate
        radius = np.array([2 * allowed(len(q)) if edits else 0 for _, q in asked])
        for i, e, d in tree.within([q for _, q in asked], radius):
            name, text = asked[i]
            most, entry = allowed(len(text)) if edits else 0, tree.entries[e]
            if d > most:
                d = typing_distance(text, entry)
            if d <= most:
                yield name, d, entry

    def candidates(self, names: list[str], whole: bool = True) -> dict[str, tuple]:
        """``name -> (exact id, least and greatest id of the same words, (typing distance, id))``, None where there is none.

        With ``whole`` the list is complete, so names that are settled are not
        searched further; a shard cannot know and searches on.
        """
        forms = {n: variants(n, self.spelling) for n in names}
        exact: dict[str, str] = {}
        for name, _, entry in self._search([(n, " ".join(v)) for n in names for v in forms[n]], self.tree, False):
            exact[name] = min(self.ids[entry], exact.get(name, self.ids[entry]))
        rest = [n for n in names if n not in exact]
        bags: dict[str, set[str]] = {}
        for name, _, entry in self._search([(n, " ".join(sorted(v))) for n in rest for v in forms[n]], self.sorted_tree, False):
            bags.setdefault(name, set()).update(self.sorted_ids[entry])
        if whole:
            rest = [n for n in rest if len(bags.get(n, ())) != 1]
        near: dict[str, tuple[int, str]] = {}
        for name, d, entry in self._search([(n, q) for n in rest for q in queries(n, self.spelling)], self.tree, True):
            near[name] = min((d, self.ids[entry]), near.get(name, (d, self.ids[entry])))
        return {n: (exact.get(n), min(bags[n]) if n in bags else None, max(bags[n]) if n in bags else None, near.get(n))
                for n in names if n in exact or n in bags or n in near}

    def match(self, names: list[str]) -> None:
        """Bring every name into memory with its canon_id or UNMATCHED."""
        if len(self.memory) + len(names) > MEMORY:
            self.memory = {}
        new = [n for n in names if n not in self.memory]
        found = self.candidates(new)
        for n in new:
            exact, least, greatest, near = found.get(n, (None, None, None, None))
            self.memory[n] = exact or (least if least == greatest and least else near[1] if near else UNMATCHED)


def _rows(batches: list[pa.RecordBatch], matchers: dict[str, Matcher]) -> Iterator[pa.RecordBatch]:
    for k, kind in enumerate(("subject", "metric"), 1):
        m = matchers[kind]
        for_kind = []
        for b in batches:
            d = b.column(k).dictionary_encode()
            names = d.dictionary.to_pylist()
            for_kind.append((b.column(0), d, names))
        m.match(sorted({n for _, _, ns in for_kind for n in ns} - m.literal))
        for ids, d, names in for_kind:
            cid = pa.array([None if n in m.literal else m.memory[n] for n in names], pa.string()).take(d.indices)
            t = pa.RecordBatch.from_arrays([ids, pa.array([kind] * len(ids), pa.string()), cid], names=["fact_id", "kind", "canon_id"])
            yield t.filter(cid.is_valid())


def map_names(facts: DataFrame, terms: DataFrame, max_broadcast: int = MAX_BROADCAST_TERMS, spelling: Spelling = SPELLING) -> DataFrame:
    """``fact_id, kind, canon_id``: one row for each name that is not literally in the list.

    canon_id is the entry of the kind with the same words, else the one with
    the same words in another order if only one canon_id has them, else the
    nearest within two typing edits (one in short names, none in very short
    ones), after case, accents, punctuation, abbreviations and framing words
    are laid aside; else ``unmatched``.  Null names are no names and give no
    row; empty ones and those without letters and digits are unmatched; of
    entries equally near the first canon_id wins.  The facts stay where they
    are; a reference list over ``max_broadcast`` entries is sharded instead of
    travelling with the tasks, with the same results.
    """
    t = terms.where("raw is not null and canon_id is not null and kind in ('subject', 'metric')").select("kind", "raw", "canon_id")
    f = facts.select(F.col("id").alias("fact_id"), "subject", "metric")
    if t.limit(max_broadcast + 1).count() > max_broadcast:
        return _sharded(f, t, max_broadcast, spelling)
    rows = t.collect()  # at most max_broadcast rows
    by_kind = {k: [(r.raw, r.canon_id) for r in rows if r.kind == k] for k in ("subject", "metric")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers = {k: Matcher(v, spelling) for k, v in by_kind.items()}
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= CHUNK_ROWS:
                yield from _rows(held, matchers)
                held, n = [], 0
        if held:
            yield from _rows(held, matchers)

    return f.mapInArrow(run, "fact_id bigint, kind string, canon_id string")


def _bands(lengths: list[tuple[int, int]], shard_terms: int) -> list[tuple[int, int, int, int]]:
    """``(shortest, longest, first shard, shards)``: lengths joined to bands of about shard_terms entries, a fuller length split."""
    out: list[tuple[int, int, int, int]] = []
    held, low, shard = 0, None, 0
    for length, n in sorted(lengths):
        low = length if low is None else low
        held += n
        if held >= shard_terms:
            parts = -(-held // shard_terms)
            out.append((low, length, shard, parts))
            held, low, shard = 0, None, shard + parts
    if held:
        out.append((low, max(x for x, _ in lengths), shard, 1))
    return out


def _sharded(f: DataFrame, terms: DataFrame, shard_terms: int, spelling: Spelling, salt_names: int = 200_000) -> DataFrame:
    """Distinct names meet the shards whose entries are near them in length; the shards' winners are merged.

    A task holds about ``shard_terms`` entries and ``salt_names`` names.
    """
    long = f.select("fact_id", F.explode(F.array(
        F.struct(F.lit("subject").alias("kind"), F.col("subject").alias("name")),
        F.struct(F.lit("metric").alias("kind"), F.col("metric").alias("name")))).alias("x")).select("fact_id", "x.*").where("name is not null")
    literal = terms.select("kind", F.col("raw").alias("name")).distinct()
    open_ = long.join(literal, ["kind", "name"], "left_anti")
    names = cut(open_.select("kind", "name").distinct())

    @F.pandas_udf("int")
    def length(raw: pd.Series) -> pd.Series:
        return raw.map(lambda r: len(normal(r, spelling)))

    sized = cut(terms.withColumn("length", length("raw")).where("length > 0"))
    bands = _bands([(r.length, r.n) for r in sized.groupBy("length").agg(F.count("*").alias("n")).collect()], shard_terms)  # one row a length
    reach = 2 * allowed(LONG)

    @F.pandas_udf("array<int>")
    def shards_of(name: pd.Series) -> pd.Series:
        def one(n: str) -> list[int]:
            size = {len(" ".join(v)) for v in variants(n, spelling)}
            return [k for lo, hi, first, parts in bands if any(lo - reach <= x <= hi + reach for x in size) for k in range(first, first + parts)]

        return name.map(one)

    place = F.lit(None).cast("int")
    for lo, hi, first, parts in bands:
        place = F.when(F.col("length").between(lo, hi), F.lit(first) + F.pmod(F.xxhash64("raw"), F.lit(parts)).cast("int")).otherwise(place)
    salts = names.count() // salt_names + 1
    asked = names.withColumn("salt", F.pmod(F.xxhash64("name"), F.lit(salts)).cast("int")).withColumn("shard", F.explode(shards_of("name")))
    held = sized.withColumn("shard", place).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for kind, part in left.groupby("kind"):
            own = right[right["kind"] == kind]
            m = Matcher(list(zip(own["raw"], own["canon_id"])), spelling)
            for n, (exact, least, greatest, near) in m.candidates(part["name"].tolist(), whole=False).items():
                out.append((kind, n, exact, least, greatest, *(near or (None, None))))
        return pd.DataFrame(out, columns=["kind", "name", "exact", "least", "greatest", "dist", "near"]).astype({"dist": "Int32"})

    won = (asked.groupBy("shard", "salt").cogroup(held.groupBy("shard", "salt"))
           .applyInPandas(run, "kind string, name string, exact string, least string, greatest string, dist int, near string")
           .groupBy("kind", "name").agg(F.min("exact").alias("exact"), F.min("least").alias("least"), F.max("greatest").alias("greatest"),
                                        F.min_by("near", F.when(F.col("near").isNotNull(), F.struct("dist", "near"))).alias("near")))
    cid = F.coalesce("exact", F.when(F.col("least") == F.col("greatest"), F.col("least")), "near", F.lit(UNMATCHED))
    return open_.join(won, ["kind", "name"], "left").select("fact_id", "kind", cid.alias("canon_id"))
