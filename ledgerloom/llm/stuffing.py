"""Keyword-stuffed and link-list pages (problem 10).

A page's own text, without its title and its site's repeated lines, is laid
out as words.  The suffix automaton of every page, in array form, gives the
repeated maximal phrases and the characters they cover; pages whose words
stand outside clauses and are covered by repeated phrases or links are cases,
and so is prose in which one short phrase makes up much of the page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ledgerloom.llm.keys import hash128, line_key
from ledgerloom.llm.site_lines import BROADCAST_BYTES, MIN_SHARE, keyed_text, text_lines
from ledgerloom.session import cut

# Parameters of the decision.
CLAUSE_POOR = 0.3         # share of words in sentences, below which a page is a list
SENTENCE_WORDS = 4
MAX_NUMBERS = 0.3         # lists with more numbers are tables of figures
COVERED = 0.25            # share of characters in phrases that stand three times or more
LINKED = 0.15             # share of characters in links and tags
PHRASE = 0.45             # share of words in one phrase
MAX_PHRASE = 4            # words of a phrase that counts as one
PHRASE_TIMES = 5          # how often a phrase stands that is repeated for its own sake; a sentence may be said thrice
REPEATS = 3
#: Site lines, here, stand in at least this share of a source's distinct texts; below problem 1's share a page is judged with and without them.
SITE_SHARE = 0.05
SITE_DOCS = 3
#: A page of which problem 1's lines leave less than this share of the characters is judged on all of it.
LEFT = 0.1
#: A first line of up to so many characters is the title where none is given.
TITLE_CHARS = 150
#: Characters of the pages that are read and sorted together; a longer page is read by itself.
BATCH_CHARS = 2_000_000

_LINK = regex.compile(r"(?:https?://|www\.)\S+|<a\s[^>]*>|</a>|(?<=\])\([^)\s]*\)")
_TAG = regex.compile(r"(#[\p{L}\p{M}_]{2,})\p{N}*")
_LETTERS, _NUMBERS = regex.compile(r"[\p{L}\p{M}]+"), regex.compile(r"\p{N}+")
_LINES = re.compile(r"\r\n|\r|\n")

# Kinds of characters, as bits.
_LETTER, _NUMBER, _DIGIT, _SPACE, _END, _CLOSER, _APOSTROPHE = (1 << i for i in range(7))
_SIGNS = {".": _END, "!": _END, "?": _END, "।": _END, '"': _CLOSER, "”": _CLOSER, ")": _CLOSER, "’": _CLOSER | _APOSTROPHE, "'": _APOSTROPHE}
#: Word keys are polynomials modulo 2 ** 64 of this base; it is odd, so it has an inverse.
_BASE = 0x9E3779B97F4A7C15
#: Characters whose keys are made together; their powers stay in the cache.
_BLOCK = 1 << 16


class Suffixes:
    """Suffix automata of many pages at once, in array form.

    The suffixes of all pages are sorted and the common prefixes of neighbours
    measured.  Suffixes that stand together with a common prefix are one state
    of the automaton of the page read backwards: its phrases are the prefixes
    longer than what it shares with further neighbours, its count is their
    number.  Sorting doubles the compared length and goes on only among
    suffixes that ``times`` or more share, so phrases that stand that often
    are exact, whatever their length; rarer ones are not told apart.
    """

    def __init__(self, pages: list[np.ndarray], times: int) -> None:
        self.size = np.array([len(p) for p in pages], np.int64)
        self.start = np.r_[0, np.cumsum(self.size + 1)]
        n, self.times = int(self.start[-1]), times
        symbols = max((int(p.max()) for p in pages if len(p)), default=0) + 1
        # a word counts within its page; the end of a page is a symbol of its own
        seq = np.repeat(np.arange(len(pages)), self.size + 1) * symbols
        inner = np.ones(n, bool)
        inner[self.start[1:] - 1] = False
        seq[inner] += np.concatenate(pages) if pages else 0
        seq[~inner] = -1 - np.arange(len(pages))
        self.inner = inner
        sa = np.argsort(seq).astype(np.int32)
        rank = np.empty(n, np.int32)
        index = np.arange(n, dtype=np.int32)
        rank[sa], live = self._buckets(index, seq[sa][1:] != seq[sa][:-1] if n else np.zeros(0, bool))
        levels, h = [rank.copy()], 1
        while len(live):
            at = sa[live]
            second = rank[at + h]
            order = np.lexsort((second, rank[at]))
            at, second = at[order], second[order]
            own = rank[at]
            start, keep = self._buckets(live, (own[1:] != own[:-1]) | (second[1:] != second[:-1]))
            sa[live] = at
            rank[at] = start
            live = keep
            levels.append(rank.copy())
            h *= 2
        # common prefixes of neighbours that begin alike, from the greatest power of two down
        alike = np.flatnonzero(levels[0][sa[:-1]] == levels[0][sa[1:]])
        a, b = sa[alike].astype(np.int64), sa[alike + 1].astype(np.int64)
        common = np.zeros(len(alike), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            equal = levels[k][np.minimum(a + common, n - 1)] == levels[k][np.minimum(b + common, n - 1)]
            common += equal.astype(np.int64) << k
        lcp = np.zeros(max(n - 1, 0), np.int64)
        lcp[alike] = common
        self.sa, self.lcp = sa, lcp

    def _buckets(self, index: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bucket starts of sorted suffixes, and the places of those in buckets worth sorting on."""
        if not len(index):
            return index, index
        first = np.flatnonzero(np.r_[True, edge])
        size = np.diff(np.r_[first, len(index)])
        return np.repeat(index[first], size), index[np.repeat(size >= self.times, size)]

    def lengths(self) -> np.ndarray:
        """For each place the length of the longest phrase starting there that stands often enough in its page; 0 at the ends of pages."""
        n, t = len(self.sa), self.times
        out = np.zeros(n, np.int64)
        if n >= t:
            low = self.lcp[:n - t + 1].copy()
            for k in range(1, t - 1):
                np.minimum(low, self.lcp[k:n - t + 1 + k], out=low)
            for k in range(t):
                out[k:n - t + 1 + k] = np.maximum(out[k:n - t + 1 + k], low)
        by_place = np.zeros(n, np.int64)
        by_place[self.sa] = out
        return by_place

    def longest(self) -> list[np.ndarray]:
        """The lengths of each page by itself."""
        by_place = self.lengths()
        return [by_place[s:s + m] for s, m in zip(self.start[:-1], self.size)]

    def heaviest(self, most: int, times: int) -> np.ndarray:
        """For each page the words in the phrase of two to ``most`` words, ``times`` or more of it, that takes up the most of them."""
        best = np.zeros(len(self.size), np.int64)
        if not len(self.lcp):
            return best
        for k in range(2, most + 1):
            first = np.flatnonzero(np.r_[True, self.lcp < k])
            count = np.diff(np.r_[first, len(self.sa)])
            often = count >= max(times, self.times)
            page = np.searchsorted(self.start, self.sa[first[often]], side="right") - 1
            np.maximum.at(best, page, k * count[often])
        return best


@lru_cache(17)
def _kinds(planes: int) -> np.ndarray:
    """The kind of every character of the first so many planes of 65,536."""
    chars = "".join(map(chr, range(planes << 16)))
    kinds = np.zeros(len(chars), np.uint8)
    for found, bit in ((_LETTERS, _LETTER), (_NUMBERS, _NUMBER)):
        for m in found.finditer(chars):
            kinds[m.start():m.end()] |= bit
    kinds[[i for i, c in enumerate(chars) if c.isspace()]] |= _SPACE
    kinds[[i for i in np.flatnonzero(kinds & _NUMBER).tolist() if chars[i].isdigit()]] |= _DIGIT
    for c, bits in _SIGNS.items():
        kinds[ord(c)] |= bits
    return kinds


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    return tuple(np.cumprod(np.r_[np.uint64(1), np.full(n - 1, b, np.uint64)]) for b in (_BASE, pow(_BASE, -1, 1 << 64)))


def _word_keys(codes: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit keys of the words at these places."""
    keys, i = np.empty(len(first), np.uint64), 0
    while i < len(first):
        s = first[i]
        j = max(i + 1, int(np.searchsorted(end, s + _BLOCK, side="right")))
        size = int(end[j - 1] - s)
        up, down = _powers(_BLOCK) if size <= _BLOCK else _powers.__wrapped__(size)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(codes[s:s + size] * up[:size], out=sums[1:])
        at = first[i:j] - s
        keys[i:j] = (sums[end[i:j] - s] - sums[at]) * down[at]
        i = j
    return keys


def _bare(body: str) -> tuple[str, float]:
    """A page's own text without links, in one case, and the share of its characters in links and tags."""
    bare, linked = body, 0.0
    if "://" in body or "www." in body or "<" in body or "](" in body or "#" in body:
        bare = _LINK.sub(" ", body)
        tagged = sum(len(t) for t in _TAG.findall(bare))
        linked = 1 - (len(bare.replace(" ", "")) - tagged) / max(1, len(body.replace(" ", "")))
        bare = _TAG.sub(r"\1", bare)  # a number at the end of a tag is no number of the text
    return bare.casefold(), linked


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(words per page, key, characters, is a number, stands in a clause)``: all words of the pages in order.

    A word is a run of letters, two of which an apostrophe may join, or a run of
    numbers.  A sentence ends with white space behind an end mark, which
    quotation marks and brackets may follow, or with the line; with an end mark
    and enough words it is a clause.
    """
    codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), np.uint32)
    kind = _kinds((int(codes.max()) >> 16) + 1)[codes]
    run = kind & (_LETTER | _NUMBER)
    edge = np.r_[0, np.flatnonzero(run[1:] != run[:-1]) + 1, len(run)]
    of = run[edge[:-1]]
    first, end, of = (x[of > 0] for x in (edge[:-1], edge[1:], of))
    # of neighbours in a row that apostrophes join, each second one is joined to the one before it
    near = np.flatnonzero((first[1:] - end[:-1] == 1) & (of[1:] == _LETTER) & (of[:-1] == _LETTER))
    near = near[kind[end[near]] & _APOSTROPHE > 0] + 1
    if len(near):
        place = np.arange(len(near))
        row = np.maximum.accumulate(np.where(np.r_[True, np.diff(near) > 1], place, 0))
        near = near[(place - row) % 2 == 0]
        end[near - 1] = end[near]
        first, end, of = (np.delete(x, near) for x in (first, end, of))
    # sentence ends
    space = np.flatnonzero(kind & _SPACE)
    before = space[space > 0] - 1
    ended = np.zeros(len(space), bool)
    ended[len(space) - len(before):] = kind[before] & _END > 0
    closers = np.flatnonzero(kind & _CLOSER)
    if len(closers):
        opens = np.maximum.accumulate(np.where(np.r_[True, np.diff(closers) > 1], closers, 0))  # where their row begins
        last = np.flatnonzero(kind[closers + 1] & _SPACE)  # a line end follows every page
        last = last[opens[last] > 0]
        last = last[kind[opens[last] - 1] & _END > 0]
        ended[np.searchsorted(space, closers[last] + 1)] = True
    stop = ended | (codes[space] == 10)
    space, ended = space[stop], ended[stop]
    sentence = np.searchsorted(space, first)
    clause = (ended & (np.bincount(sentence, minlength=len(space)) >= SENTENCE_WORDS))[sentence]
    sizes = np.diff(np.searchsorted(first, np.cumsum([0, *(len(t) + 1 for t in texts)])))
    return sizes, _word_keys(codes, first, end), end - first, kind[first] & _DIGIT > 0, clause


def measure(bodies: list[str]) -> list[tuple[int, float, float, float, float, float]]:
    """``(words, clause share, number share, link share, covered share, phrase share)`` of each page's own text."""
    out: list[tuple[int, float, float, float, float, float]] = []
    held: list[tuple[str, float]] = []

    def flush() -> None:
        sizes, keys, chars, number, clause = _words([t for t, _ in held])
        ids = np.unique(keys, return_inverse=True)[1]
        s = Suffixes(np.split(ids, np.cumsum(sizes)[:-1]), REPEATS)
        long = s.lengths()[s.inner]
        hit = np.flatnonzero((long >= 2) | (long == 1) & (chars >= 8))
        open_ = np.bincount(hit, minlength=len(long) + 1) - np.bincount(hit + long[hit], minlength=len(long) + 1)
        inside = np.cumsum(open_)[:-1] > 0
        at = np.r_[0, np.cumsum(sizes)]
        sums = [np.diff(np.r_[0, np.cumsum(x)][at]).tolist() for x in (clause, number, chars, chars * inside)]
        for n, (_, linked), heavy, c, d, size, covered in zip(sizes.tolist(), held, s.heaviest(MAX_PHRASE, PHRASE_TIMES).tolist(), *sums):
            out.append((n, c / n, d / n, linked, covered / size, min(1.0, heavy / n)) if n else (0, 0.0, 0.0, linked, 0.0, 0.0))
        held.clear()

    size = 0
    for body in bodies:
        if held and size + len(body) > BATCH_CHARS:
            flush()
            size = 0
        held.append(_bare(body))
        size += len(body)
    if held:
        flush()
    return out


def is_case(m: tuple[int, float, float, float, float, float]) -> bool:
    n, clause, numbers, linked, covered, phrase = m
    if not n:
        return linked >= 0.5
    if clause < CLAUSE_POOR and numbers < MAX_NUMBERS and (covered >= COVERED or linked >= LINKED):
        return True
    return phrase >= PHRASE


def pages_of(documents: DataFrame) -> DataFrame:
    """``doc_id, source, text, h1, h2, key_text, title``: pages with a text, with the keys of its lines in their places, and of their title."""
    h1, h2 = hash128(F.col("text"))
    return documents.where("text is not null").select("doc_id", "source", "text", h1.alias("h1"), h2.alias("h2"), keyed_text(F.col("text")).alias("key_text"),
                                                      F.nullif(line_key(F.col("title")), F.lit("")).alias("title"))


def lines_of(pages: DataFrame) -> DataFrame:
    """``source, h1, h2, k1, k2``: each line of each text of a source; copies of a text give the same rows."""
    k1, k2 = hash128(F.col("key"))
    lines = pages.where("source is not null").select("source", "h1", "h2", F.explode(F.array_distinct(text_lines(F.col("key_text")))).alias("key"))
    return lines.where("key != ''").select("source", "h1", "h2", k1.alias("k1"), k2.alias("k2"))


def site_lines(pages: DataFrame) -> DataFrame:
    """``source, k1, k2, common``: lines in SITE_SHARE of a source's distinct texts; common: in problem 1's share.

    Copies of a text count as one.
    """
    lines = cut(lines_of(pages).distinct())
    per = lines.select("source", "h1", "h2").distinct().groupBy("source").agg(F.count("*").alias("texts"))
    n = lines.groupBy("source", "k1", "k2").agg(F.count("*").alias("n")).where(F.col("n") >= SITE_DOCS)
    share = lambda s: F.col("n") >= F.ceil(F.col("texts") * F.lit(s) - 1e-9)
    return n.join(per, "source").where(share(SITE_SHARE)).select("source", "k1", "k2", share(MIN_SHARE).alias("common"))


def _hashes(key: str) -> tuple[int, int]:
    """The two hashes of a line's key as Spark makes them: 64-bit xxHash, seed 42, chained over the columns."""
    k = key.encode()
    second = xxh64_intdigest(b"loom", xxh64_intdigest(k, xxh64_intdigest(b"ledger", 42)))
    return tuple(h - (1 << 64) if h >> 63 else h for h in (xxh64_intdigest(k, 42), second))


def own_text(text: str, key_text: str, title: str | None, site: dict[tuple[int, int], bool]) -> tuple[str, str | None]:
    """``(body, wide)``: a page's text without its title line and its site's lines (hashes of the key to common).

    The title is one line: repeats of it are text.  Without a title a short
    first line is one where others follow.  ``wide`` is the text without those
    site lines only that stand in problem 1's share, or with all of them where
    they make up the page; None where it is the body.
    """
    lines = [(line, k) for line, k in zip(_LINES.split(text), _LINES.split(key_text)) if k]
    if title is None and len(lines) > 1 and len(lines[0][0]) <= TITLE_CHARS:
        title = lines[0][1]
    at = next((i for i, (_, k) in enumerate(lines) if k == title), None)
    if at is not None:
        del lines[at]
    whole = "\n".join([x for x, _ in lines])
    if not site:
        return whole, None
    found = [site.get(_hashes(k)) for _, k in lines]
    body = "\n".join([x for (x, _), c in zip(lines, found) if c is None])
    wide = "\n".join([x for (x, _), c in zip(lines, found) if not c])
    if len(wide) < len(whole) * LEFT:
        wide = whole
    return body, None if wide == body else wide


_MEASURES = ("words", "clause", "numbers", "linked", "covered", "phrase")
_RESULT = "doc_id bigint, words int, clause double, numbers double, linked double, covered double, phrase double, stuffed boolean"


def page_measures(documents: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``doc_id, words, clause, numbers, linked, covered, phrase, stuffed`` of every page with a text.

    The shares are those of the reading that decides: the page without its
    site's lines, or if only the wider reading makes a case, that one.  The
    site lines travel with the tasks while they are small (a source has at most
    lines-per-document / SITE_SHARE of them), else each text's own ones are
    joined to it; the results are the same.
    """
    pages = pages_of(documents)
    site = cut(site_lines(pages))
    if site.count() * 200 <= broadcast_bytes:  # about the bytes of a key in a Python dictionary
        by_source: dict[str, dict[tuple[int, int], bool]] = {}
        for r in site.collect():  # its size is checked above
            by_source.setdefault(r.source, {})[r.k1, r.k2] = r.common
        rows = pages.select("doc_id", "text", "key_text", "title", "source")
    else:
        by_source = None
        hits = (lines_of(pages).distinct().join(site.hint("merge"), ["source", "k1", "k2"])
                .groupBy("source", "h1", "h2").agg(F.collect_list(F.struct("k1", "k2", "common")).alias("site")))
        rows = pages.join(hits.hint("merge"), ["source", "h1", "h2"], "left").select("doc_id", "text", "key_text", "title", "site")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, keys, titles = b.column(0), *(b.column(i).to_pylist() for i in (1, 2, 3))
            last = b.column(4).to_pylist()
            if by_source is None:
                sites = [{(x["k1"], x["k2"]): x["common"] for x in s or ()} for s in last]
            else:
                sites = [by_source.get(s, {}) for s in last]
            own = list(map(own_text, texts, keys, titles, sites))
            first = measure([x for x, _ in own])
            also = [i for i, (_, w) in enumerate(own) if w is not None and not is_case(first[i])]
            for i, m in zip(also, measure([own[i][1] for i in also])):
                if is_case(m):
                    first[i] = m
            cols = [pa.array(c, pa.int32() if i == 0 else pa.float64()) for i, c in enumerate(zip(*first))] if first else [pa.array([], pa.int32())] + [pa.array([], pa.float64())] * 5
            yield pa.RecordBatch.from_arrays([ids, *cols, pa.array([is_case(m) for m in first], pa.bool_())], names=["doc_id", *_MEASURES, "stuffed"])

    return rows.mapInArrow(run, _RESULT)


def stuffed_pages(documents: DataFrame) -> DataFrame:
    """``doc_id`` of pages that are mostly keywords, tags, links or one repeated phrase.

    Null and empty texts are no cases.  Documents without a source have no site
    lines.  Copies of a text under other ids are judged alike and make no site
    lines of its own lines.
    """
    return page_measures(documents).where("stuffed").select("doc_id")
