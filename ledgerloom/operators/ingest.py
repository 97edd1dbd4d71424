"""Blocks to windows: furniture, gaps, density, overlapping windows, halves."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.text import density, furniture_key, hash128
from ledgerloom.session import cut

BOILERPLATE_MIN_PAGES = 4
GAP_MIN_CHARS = 120
WINDOW_CHARS = 12000
WINDOW_OVERLAP = 1200


def flag_boilerplate(blocks: DataFrame, min_pages: int = BOILERPLATE_MIN_PAGES) -> DataFrame:
    """``id, doc_id, is_boilerplate``: a text on enough pages of its document is furniture (AGG-6).

    Blank and null texts are never furniture.
    """
    k1, k2 = hash128(F.col("key"))
    keyed = blocks.select("id", "doc_id", "page_no", F.nullif(furniture_key(F.col("text")), F.lit("")).alias("key"))
    # the key is made once and leaves as a hash; blank blocks have none
    b = cut(keyed.select("id", "doc_id", "page_no", F.when(F.col("key").isNotNull(), k1).alias("k1"), F.when(F.col("key").isNotNull(), k2).alias("k2")))
    often = (b.where("k1 is not null").select("doc_id", "k1", "k2", "page_no").distinct().groupBy("doc_id", "k1", "k2")
             .agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages).select("doc_id", "k1", "k2", F.lit(True).alias("hit")))
    return b.join(often, ["doc_id", "k1", "k2"], "left").select("id", "doc_id", F.coalesce("hit", F.lit(False)).alias("is_boilerplate"))


def page_gaps(documents: DataFrame, blocks: DataFrame, min_chars: int = GAP_MIN_CHARS) -> DataFrame:
    """``doc_id, page_no, reason`` of pages with little or no text (AGG-7, JOIN-16).

    Documents with a null page count or none have no pages.
    """
    chars = blocks.groupBy("doc_id", "page_no").agg(F.sum(F.length("text")).alias("chars"))
    spine = documents.where("page_count >= 1").select("doc_id", F.explode(F.sequence(F.lit(1), F.col("page_count"))).alias("page_no"))
    g = spine.join(chars, ["doc_id", "page_no"], "left").withColumn("chars", F.coalesce("chars", F.lit(0)))
    return g.where(F.col("chars") < min_chars).select("doc_id", "page_no", F.when(F.col("chars") == 0, "no extractable text; page is likely image-only").otherwise(
        F.concat(F.lit("only "), F.col("chars").cast("string"), F.lit(" characters extracted; likely scanned or graphical"))).alias("reason"))


class WindowFold:
    """Running fold of one document's blocks; holds no more than the open window."""

    def __init__(self, window_chars: int, overlap: int) -> None:
        self.window_chars, self.overlap = window_chars, overlap
        self.open: list[tuple[int, str]] = []
        self.size = 0

    def add(self, key: int, text: str) -> list[tuple[int, str]] | None:
        """Take a block; the window it closes, if any.

        A window closes when the block would exceed the length; trailing whole
        blocks stay until the overlap is reached, and may exceed it.
        """
        closed = None
        if self.open and self.size + len(text) > self.window_chars:
            closed, keep, self.size = self.open, [], 0
            for part in reversed(closed):
                if self.size >= self.overlap:
                    break
                keep.append(part)
                self.size += len(part[1])
            self.open = keep[::-1]
        self.open.append((key, text))
        self.size += len(text)
        return closed


def fold_windows(parts: list[str], window_chars: int, overlap: int) -> list[list[int]]:
    """Positions of the blocks of each window of one document."""
    fold = WindowFold(window_chars, overlap)
    out = [w for i, p in enumerate(parts) if (w := fold.add(i, p))]
    return [[k for k, _ in w] for w in (*out, fold.open) if w]


def build_windows(blocks: DataFrame, window_chars: int = WINDOW_CHARS, overlap: int = WINDOW_OVERLAP) -> DataFrame:
    """``doc_id, window_index, text, block_ids, block_spans, density`` (SEQ-1, SEQ-2).

    Whole blocks are joined by one newline; neighbours share trailing blocks
    until the overlap is reached.  Furniture and null texts are left out.  Each
    document's blocks stream through one fold in reading order, so a task never
    holds more than a batch and an open window; documents spread over the cluster.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, n, fold = None, 0, WindowFold(window_chars, overlap)
        rows: list[tuple] = []

        def emit(window: list[tuple[int, str]]) -> None:
            nonlocal n
            spans, at = [], 0
            for _, t in window:
                spans.append({"s": at, "e": at + len(t)})
                at += len(t) + 1
            rows.append((doc, n, "\n".join(t for _, t in window), [k for k, _ in window], spans))
            n += 1

        columns = ["doc_id", "window_index", "text", "block_ids", "block_spans"]
        for b in batches:
            for d, key, t in zip(b["doc_id"].tolist(), b["id"].tolist(), b["text"].tolist()):
                if d != doc:
                    if fold.open:
                        emit(fold.open)
                    doc, n, fold = d, 0, WindowFold(window_chars, overlap)
                if (w := fold.add(key, t)) is not None:
                    emit(w)
            yield pd.DataFrame(rows, columns=columns)
            rows.clear()
        if fold.open:
            emit(fold.open)
            yield pd.DataFrame(rows, columns=columns)

    b = blocks.where("doc_id is not null and text is not null and not coalesce(is_boilerplate, false)").select("doc_id", "id", "page_no", "block_index", "text")
    s = b.repartition("doc_id").sortWithinPartitions("doc_id", "page_no", "block_index", "id").select("doc_id", "id", "text")
    w = s.mapInPandas(run, "doc_id bigint, window_index int, text string, block_ids array<bigint>, block_spans array<struct<s:int,e:int>>")
    return w.withColumn("density", density(F.col("text")))


def densest(windows: DataFrame, n: int) -> DataFrame:
    """First n windows of each document by falling density, earlier ones first (AGG-14)."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("density"), "window_index")
    return windows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).drop("rank")


def halves(windows: DataFrame) -> DataFrame:
    """``window_id, window_index, text, block_ids, block_spans`` of both halves (SEQ-3).

    Windows with fewer than two blocks or without spans have none.
    """
    n = F.size("block_spans")
    mid = F.expr("size(block_spans) div 2")
    w = windows.where("size(block_spans) >= 2 and text is not null").withColumn("h", F.explode(F.array(
        F.struct(F.lit(0).alias("k"), F.slice("block_spans", F.lit(1), mid).alias("sp"), F.slice("block_ids", F.lit(1), mid).alias("ids")),
        F.struct(F.lit(1).alias("k"), F.slice("block_spans", mid + 1, n - mid).alias("sp"), F.slice("block_ids", mid + 1, n - mid).alias("ids")))))
    first, last = F.element_at("h.sp", 1)["s"], F.element_at("h.sp", -1)["e"]
    spans = F.transform("h.sp", lambda x: F.struct((x["s"] - first).alias("s"), (x["e"] - first).alias("e")))
    return w.select(F.col("id").alias("window_id"), (F.col("window_index") * 10 + F.col("h.k")).alias("window_index"),
                    F.substring("text", first + 1, last - first).alias("text"), F.col("h.ids").alias("block_ids"), spans.alias("block_spans"))


def span_blocks(windows: DataFrame, start: str, end: str) -> DataFrame:
    """``window_id, block_ids`` that overlap [start, end) of a window's text (JOIN-11, SCL-30)."""
    z = F.arrays_zip(F.col("block_spans").alias("span"), F.col("block_ids").alias("bid"))
    hit = F.filter(z, lambda x: (F.expr(start) < x["span"]["e"]) & (F.expr(end) > x["span"]["s"]))
    return windows.where("block_spans is not null").select(F.col("id").alias("window_id"), F.transform(hit, lambda x: x["bid"]).alias("block_ids"))


def dry_run(windows: DataFrame, gaps: DataFrame, documents: DataFrame) -> DataFrame:
    """Windows, pages and gaps per document and in total (null doc_id), with calls needed (AGG-13)."""
    w = windows.groupBy("doc_id").agg(F.count("*").alias("windows"))
    g = gaps.groupBy("doc_id").agg(F.count("*").alias("gaps"))
    d = documents.select("doc_id", F.coalesce("page_count", F.lit(0)).alias("pages")).join(w, "doc_id", "left").join(g, "doc_id", "left").fillna(0)
    r = d.rollup("doc_id").agg(F.sum("windows").alias("windows"), F.sum("pages").alias("pages"), F.sum("gaps").alias("gaps"), F.count("*").alias("documents"))
    return r.withColumn("calls", F.col("windows") + 2)
