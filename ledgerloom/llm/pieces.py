"""Oversized items cut at natural boundaries (problem 2).

An item is parsed into a tree: sections nested by the rank of their headings,
blocks or paragraphs, list items nested by depth with their own continuation,
lines, sentences, words, marks, characters.  Sibling subtrees are merged
bottom-up to the limit, and only nodes over the limit are descended into.
Each piece but the first repeats the end of the one before from a natural
start.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_CHARS = 4000
OVERLAP = 400
#: Pieces shorter than the limit divided by this are scraps.
SCRAP = 10

# Ranks of what starts on a line; a node ends where one of its own or a smaller rank starts.
_NUMBERED, _TITLE, _BLOCK, _ITEM, _INNER = 10, 30, 40, 50, 1000
#: Items nested deeper than this stand beside each other.
_DEEPEST = 100
_ROW = re.compile(r"[^\r\n\u2028\u2029]*(?:\r\n|[\r\n\u2028\u2029]|\Z)")
_HASHES = re.compile(r"(#{1,6})\s+\S")
_NUMBER = re.compile(r"(\d+(?:\.\d+)*)\.?\s+[^\W\d_][^.!?]{0,70}$")
_TITLE_LINE = re.compile(r"[^\W\d_][^.!?:;|,]{2,60}$")
_BULLET = re.compile(r"(\s*)(?:[-*+•·–—▪◦]|\(?(?:\d{1,3}|[a-zA-Z]|[ivxIVX]{1,4})[.)])\s+\S")
_LINE = re.compile(r"\r\n|\r|\n|\u2028|\u2029")
_SENTENCE = re.compile(r"[.!?…।॥。！？]+[\"'”’)\]]*\s+|[。！？]")
_WORD = re.compile(r"\s+")
_MARK = re.compile(r"[;,|/\\&]+")  # ends words where no space does


@dataclass
class Node:
    start: int
    end: int
    children: list[Node] = field(default_factory=list)


def starts(text: str, spans: list[tuple[int, int]] | None) -> list[tuple[int, int]]:
    """``(position, rank)`` of everything that starts on a line of the text but the first."""
    rows = [(m.start(), m.group().rstrip("\r\n\u2028\u2029")) for m in _ROW.finditer(text) if m.group()]
    numbers = [m[1] if (m := _NUMBER.match(x)) else None for _, x in rows]
    block = {a for a, _ in spans} if spans else None
    out: list[tuple[int, int]] = []
    depths: list[int] = []  # indents of the open list items
    blank = True
    for i, (at, row) in enumerate(rows):
        indent = len(row) - len(row.lstrip())
        beside = [numbers[j].count(".") for j in (i - 1, i + 1) if 0 <= j < len(rows) and numbers[j]]
        rank = _INNER
        if not row.strip():
            blank = True
            continue
        if m := _HASHES.match(row):
            rank = len(m[1])
        elif numbers[i] and numbers[i].count(".") not in beside:  # numbers one below the other are a list
            rank = _NUMBERED + numbers[i].count(".")
        elif m := _BULLET.match(row):
            while depths and depths[-1] >= indent:
                depths.pop()
            rank = _ITEM + min(len(depths), _DEEPEST)
            depths.append(indent)
        elif depths and (not blank or indent > depths[0]):
            while blank and depths and depths[-1] >= indent:
                depths.pop()  # after a blank line only what is indented goes on with the item
        elif _TITLE_LINE.match(row):
            rank = _TITLE
        elif blank and block is None:
            rank = _BLOCK
        if rank < _ITEM:
            depths = []
        if block is not None and at in block and rank == _INNER:
            rank, depths = _BLOCK, []
        if i:
            out.append((at, rank))
        blank = False
    return out


def tree(text: str, spans: list[tuple[int, int]] | None = None) -> Node:
    """The text's structure down to lines."""

    def grow(s: int, e: int, inner: list[tuple[int, int]]) -> Node:
        node = Node(s, e)
        if inner:
            top = min(r for _, r in inner)
            at = [i for i, (_, r) in enumerate(inner) if r == top]
            edges = [s, *(inner[i][0] for i in at), e]
            parts = [inner[x + 1:y] for x, y in zip([-1, *at], [*at, len(inner)])]
            node.children = [grow(a, b, p) for a, b, p in zip(edges[:-1], edges[1:], parts)]
        return node

    return grow(0, len(text), starts(text, spans))


def _finer(text: str, s: int, e: int, level: int) -> tuple[list[Node], int]:
    """Parts of a line by the first of sentences, words and marks that divides it, and that level."""
    for k in range(level, 3):
        ends = [m.end() for m in (_SENTENCE, _WORD, _MARK)[k].finditer(text, s, e) if s < m.end() < e]
        if ends:
            return [Node(a, b) for a, b in zip([s, *ends], [*ends, e])], k
    return [], 3


def _pack(text: str, node: Node, limit: int, level: int = 0) -> list[tuple[int, int]]:
    """Spans of at most limit characters of a node, its small children merged, the others packed first."""
    s, e = node.start, node.end
    if e - s <= limit:
        return [(s, e)]
    children = node.children
    if not children:
        children, level = _finer(text, s, e, level)
        if not children:  # no boundary at all: cut by length
            return [(a, min(a + limit, e)) for a in range(s, e, limit)]
    out: list[tuple[int, int]] = []
    open_ = False  # the last piece is a run of whole siblings that may grow
    for c in children:
        if c.end - c.start > limit:
            if open_ and level == 0 and (c.start - out[-1][0]) * SCRAP < limit:
                # a heading or other scrap goes with what follows it
                head = out.pop()[0]
                c = Node(head, c.end, [Node(head, c.start), *c.children] if c.children else [])
            out += _pack(text, c, limit, level if node.children else level + 1)
            open_ = False
        elif open_ and c.end - out[-1][0] <= limit:
            out[-1] = (out[-1][0], c.end)
        else:
            out.append((c.start, c.end))
            open_ = True
    return out


def _overlap_start(text: str, s: int, previous: int, overlap: int) -> int:
    """Where the repeated part before s starts: a line, sentence or word start within reach."""
    low = max(previous, s - overlap)
    if overlap <= 0 or low >= s:
        return s
    if low == previous:
        return low
    for pattern in (_LINE, _SENTENCE, _WORD):
        m = pattern.search(text, low, s)
        if m and m.end() < s:
            return m.end()
    return low


def split_text(text: str, spans: list[tuple[int, int]] | None = None, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """``(start, new_from, end)`` of each piece: text[start:end], of which text[start:new_from] is repeated."""
    if spans is not None and (any(not 0 <= a <= b <= len(text) for a, b in spans) or spans != sorted(spans)):
        spans = None
    if len(text) <= max_chars:
        return [(0, 0, len(text))]
    limit = max_chars - overlap
    parts: list[tuple[int, int]] = []
    for s, e in _pack(text, tree(text, spans), limit):
        # a scrap beside a node that was descended into joins its neighbour
        if parts and e - parts[-1][0] <= limit and min(e - s, parts[-1][1] - parts[-1][0]) * SCRAP < limit:
            parts[-1] = (parts[-1][0], e)
        else:
            parts.append((s, e))
    out = []
    for i, (s, e) in enumerate(parts):
        out.append((_overlap_start(text, s, parts[i - 1][0], overlap) if i else s, s, e))
    return out


def oversized(windows: DataFrame, blocks: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """``item_kind, item_id, text, block_spans`` of rows whose text is over the limit."""
    w = windows.where(F.length("text") > max_chars).select(F.lit("window").alias("item_kind"), F.col("id").alias("item_id"), "text", "block_spans")
    b = blocks.where(F.length("text") > max_chars).select(F.lit("block").alias("item_kind"), F.col("id").alias("item_id"), "text")
    return w.unionByName(b.withColumn("block_spans", F.lit(None).cast(w.schema["block_spans"].dataType)))


def pieces(windows: DataFrame, blocks: DataFrame, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """``item_kind, item_id, piece_no, start, new_from, end, text`` of every oversized item, in order.

    Items within the limit, null and empty texts need no cutting and give no
    rows.  Without the repeated parts the pieces joined are the text.  Unusable
    block_spans are ignored.  A repeated row gives repeated pieces.  Narrow:
    one item is one row's work.
    """
    if not 0 <= overlap < max_chars:
        raise ValueError("overlap must be smaller than max_chars")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for kind, item, text, spans in zip(b["item_kind"], b["item_id"], b["text"], b["block_spans"]):
                sp = None if spans is None else [(int(x["s"]), int(x["e"])) for x in spans if x is not None and x["s"] is not None and x["e"] is not None]
                for n, (s, new, e) in enumerate(split_text(text, sp, max_chars, overlap)):
                    rows.append((kind, item, n, s, new, e, text[s:e]))
            yield pd.DataFrame(rows, columns=["item_kind", "item_id", "piece_no", "start", "new_from", "end", "text"])

    return oversized(windows, blocks, max_chars).mapInPandas(
        run, "item_kind string, item_id bigint, piece_no int, start int, new_from int, end int, text string")


def found_items(cut: DataFrame) -> DataFrame:
    """``item_kind, item_id`` of the items that were cut: each has one first piece."""
    return cut.where("piece_no = 0").select("item_kind", "item_id")
