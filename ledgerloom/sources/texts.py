"""Text, HTML and file sources (SRC-1 to SRC-8)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINES_PER_PAGE = 40
_EDGE = "[ \t\r\n\f]"


def text_blocks(documents: DataFrame, lines_per_page: int = LINES_PER_PAGE) -> DataFrame:
    """``doc_id, page_no, block_index, text``: lines as blocks, k lines as a page, empty blocks skipped.

    Positions count before the skipping.  Null texts have no blocks.
    """
    d = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    text = F.regexp_replace("line", f"^{_EDGE}+|{_EDGE}+$", "")
    return (d.select("doc_id", (F.expr(f"pos div {lines_per_page}") + 1).cast("int").alias("page_no"),
                     (F.col("pos") % lines_per_page).alias("block_index"), text.alias("text")).where("text != ''"))


# Entities that are decoded.
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def visible_text(html: Column) -> Column:
    """Visible text of HTML: no scripts, styles, comments or tags; block tags end lines."""
    s = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(?:script|style)>|<!--.*?-->", " ")
    s = F.regexp_replace(s, r"(?i)</?(?:p|div|br|li|ul|ol|tr|table|h[1-6]|section|article)[^>]*>", "\n")
    s = F.regexp_replace(s, r"<[a-zA-Z/][^>]*>", "")
    for a, b in _ENTITIES:
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def html_blocks(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Blocks of pages given as HTML."""
    return text_blocks(pages.select(F.col(key).alias("doc_id"), visible_text(F.col(html)).alias("text")))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def is_pdf(content: Column) -> Column:
    """Magic-byte check (SRC-6)."""
    return F.coalesce(F.hex(F.substring(content, 1, 4)) == "25504446", F.lit(False))


def discover(spark: SparkSession, root: str, pattern: str = "*.pdf", limit: int | None = None) -> DataFrame:
    """``path, length, sha256`` of files under a root by lower-case path (SRC-4, SRC-5)."""
    f = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
         .select("path", "length", content_hash(F.col("content")).alias("sha256")).orderBy(F.lower("path")))
    return f if limit is None else f.limit(limit)


def parse_files(files: DataFrame, parser: Callable[[bytes], list[tuple[int, int, str]]]) -> DataFrame:
    """Blocks of binary files by a plug-in parser ``bytes -> [(page_no, block_index, text)]`` (SRC-1)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, *x) for p, c in zip(b["path"], b["content"]) for x in parser(bytes(c)) if x[2].strip()]
            yield pd.DataFrame(rows, columns=["path", "page_no", "block_index", "text"])

    return files.select("path", "content").mapInPandas(run, "path string, page_no int, block_index int, text string")


def load_if_empty(target: DataFrame, shipped: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """The target, or where it is empty the shipped rows, of each key the last by an order (SRC-8).

    Without an order rows of one key must be alike in what matters; the
    greatest row stays, so the result does not depend on where rows lie.
    """
    if not target.isEmpty():
        return target
    rest = [c for c in shipped.columns if c not in key]
    by = F.struct(order, *rest) if order else F.struct(*rest)
    last = shipped.groupBy(*key).agg(F.max_by(F.struct(*rest), by).alias("r"))
    return last.select(*[F.col(c) if c in key else F.col(f"r.{c}").alias(c) for c in shipped.columns])
