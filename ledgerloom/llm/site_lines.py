"""Lines repeated across one site's documents (problem 1).

The documents of a source are numbered without gaps.  Every spelling of a line
gets a bitmap of its documents; the bitmaps of all spellings of one line are
united and stored compressed, one container for each 65,536 documents of the
source.  Cardinalities are exact sums over the containers, and a block is
found by looking its document up among the members of its line's container;
lines are deleted inside each document's row.  Every
aggregate combines before the shuffle and no key holds more than one
container's documents, so neither a hot source nor a hot line gathers in one
task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.bitmaps import CHUNK_BITS, members, packed_words
from ledgerloom.llm.keys import hash128, line_key
from ledgerloom.session import cut

MIN_DOCS = 3
MIN_SHARE = 0.2
#: Documents whose ids share a bucket of a source's numbering.
BUCKET_BITS = 12
#: A list of lines up to this size is broadcast, else joined by a shuffle.
BROADCAST_BYTES = 32 << 20
SALTS = 64
_LINE = ["source", "k1", "k2"]
_BIT = "shiftleft(1L, cast(n & 63 as int))"


def numbered(documents: DataFrame) -> DataFrame:
    """``doc_id, source, n``: documents of each source numbered from 0 in id order, by two levels.

    A repeated document row counts once; of different sources the first counts.
    Documents without an id or a source have no number.
    """
    d = documents.where("doc_id is not null and source is not null").groupBy("doc_id").agg(F.min("source").alias("source")).withColumn("bucket", F.shiftright("doc_id", BUCKET_BITS))
    size = d.groupBy("source", "bucket").agg(F.count("*").alias("size"))
    before = size.withColumn("before", F.sum("size").over(Window.partitionBy("source").orderBy("bucket")) - F.col("size")).drop("size")
    inside = F.row_number().over(Window.partitionBy("source", "bucket").orderBy("doc_id")) - 1
    return d.withColumn("inside", inside).join(before, ["source", "bucket"]).select("doc_id", "source", (F.col("before") + F.col("inside")).alias("n"))


def keyed_lines(blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """``id, source, n, k1, k2, spelling`` of blocks with text in documents with a source."""
    k1, k2 = hash128(line_key(F.col("text")))
    b = (blocks.where("id is not null and doc_id is not null and text is not null").select("id", "doc_id", "text")
         .where(F.col("text").rlike(r"[^\s]")).select("id", "doc_id", k1.alias("k1"), k2.alias("k2"), F.xxhash64("text").alias("spelling")))
    return b.join(numbered(documents), "doc_id").select("id", "source", "n", "k1", "k2", "spelling")


def line_bitmaps(lines: DataFrame) -> DataFrame:
    """``source, k1, k2, chunk, docs, n_docs``: the documents of each line, all its spellings united, as compressed containers."""
    spelled = lines.groupBy(*_LINE, "spelling", F.shiftright("n", 6).alias("word")).agg(F.bit_or(F.expr(_BIT)).alias("bits"))
    # one partitioning serves the union of the spellings and the packing of the words
    near = spelled.withColumn("chunk", F.shiftright("word", CHUNK_BITS - 6)).repartition(*_LINE, "chunk")
    united = near.groupBy(*_LINE, "chunk", "word").agg(F.bit_or("bits").alias("bits"))
    at = F.expr(f"cast(word & {(1 << (CHUNK_BITS - 6)) - 1}L as int)")
    held = united.groupBy(*_LINE, "chunk").agg(F.collect_list(F.struct(at.alias("at"), "bits")).alias("words"), F.sum(F.bit_count("bits")).alias("n_docs"))
    return held.select(*_LINE, "chunk", packed_words("words").alias("docs"), "n_docs")


def documents_per_source(lines: DataFrame) -> DataFrame:
    """``source, source_docs``: documents that have blocks, exactly."""
    return (lines.groupBy("source", F.shiftright("n", 6).alias("word")).agg(F.bit_or(F.expr(_BIT)).alias("bits"))
            .groupBy("source").agg(F.sum(F.bit_count("bits")).alias("source_docs")))


def frequent_lines(maps: DataFrame, per_source: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """``source, k1, k2, n_docs, source_docs`` of lines in enough of a source's documents."""
    n = maps.groupBy(*_LINE).agg(F.sum("n_docs").alias("n_docs")).where(F.col("n_docs") >= min_docs)
    return n.join(per_source, "source").where(F.col("n_docs") >= F.ceil(F.col("source_docs") * F.lit(min_share) - 1e-9))


def repeated_blocks(blocks: DataFrame, documents: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """``block_id`` of every block whose line is repeated too often within its source.

    Null, empty and blank texts are no lines; blocks of unknown documents or
    of documents without a source are no cases; a repeated block row counts
    its document once.  A line of punctuation only equals every other such line.
    """
    lines = cut(keyed_lines(blocks, documents))
    maps = cut(line_bitmaps(lines))
    often = frequent_lines(maps, documents_per_source(lines), min_docs, min_share)
    # each container is read once, and every key of the join is one document's line
    hit = maps.join(often.select(*_LINE), _LINE, "left_semi").select(*_LINE, "chunk", F.explode(members("docs")).alias("low"))
    probe = lines.select("id", *_LINE, F.shiftright("n", CHUNK_BITS).alias("chunk"), F.expr(f"cast(n & {(1 << CHUNK_BITS) - 1}L as int)").alias("low"))
    found = probe.join(hit, [*_LINE, "chunk", "low"])
    return found.select(F.col("id").alias("block_id"))


def line_report(blocks: DataFrame, documents: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """``source, line, n_docs, source_docs``: every repeated line by its first spelling."""
    lines = cut(keyed_lines(blocks, documents))
    often = cut(frequent_lines(line_bitmaps(lines), documents_per_source(lines), min_docs, min_share))
    first = lines.join(often.select(*_LINE), _LINE, "left_semi").groupBy(*_LINE).agg(F.min("id").alias("id"))
    text = blocks.where("id is not null").groupBy("id").agg(F.min("text").alias("line"))
    return often.join(first, _LINE).join(text, "id").select("source", "line", "n_docs", "source_docs")


def text_lines(text: Column) -> Column:
    return F.split(text, r"\r\n|\r|\n")


def keyed_text(text: Column) -> Column:
    """A text with the keys of its lines in their places, made in one pass; line ends stay."""
    kept = F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{Nd}\r\n]+", "")
    return F.regexp_replace(kept, r"\p{Nd}+", "0")


def with_source_list(df: DataFrame, lists: DataFrame) -> DataFrame:
    """df with its source's row of lists: broadcast while the lists are small, else by salted shuffle.

    The lists hold lines that stand in a set share of a source's documents, so
    a source has at most lines-per-document divided by the share of them.
    """
    names = [c for c in lists.columns if c != "source"]
    size = lists.select(F.sum(sum((F.size(c) for c in names), F.lit(1))).alias("n")).first()["n"] or 0
    if size * 16 <= BROADCAST_BYTES:
        return df.join(F.broadcast(lists), "source", "left")
    salted = lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return df.withColumn("salt", F.pmod(F.xxhash64("text"), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), ["source", "salt"], "left").drop("salt")


def clean_documents(blocks: DataFrame, documents: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """``doc_id, text, removed``: every document's text without its source's repeated lines.

    Lines are separated by line ends of any form; where a line goes, the others
    are joined by newlines, a text that loses none stays as it is.  Null texts
    stay null, and a document whose every line goes has an empty text.
    Re-uploads without blocks are cleaned by the lines of their source as well;
    a repeated row gives a repeated result, a row without an id its own.
    """
    lines = cut(keyed_lines(blocks, documents))
    often = frequent_lines(line_bitmaps(lines), documents_per_source(lines), min_docs, min_share)
    drop = cut(often.groupBy("source").agg(F.collect_set(F.struct("k1", "k2")).alias("gone")))
    d = with_source_list(documents.select("doc_id", "source", "text"), drop)
    keys = F.transform(text_lines(keyed_text(F.col("text"))), lambda k: F.struct(*[h.alias(n) for h, n in zip(hash128(k), ("k1", "k2"))]))
    filled = F.transform(text_lines(F.col("text")), lambda x: x.rlike(r"[^\s]"))
    z = F.arrays_zip(text_lines(F.col("text")).alias("line"), keys.alias("key"), filled.alias("filled"))
    z = F.when(F.col("gone").isNotNull() & F.col("text").isNotNull(), z)
    kept = F.filter(z, lambda x: ~(x["filled"] & F.array_contains(F.col("gone"), x["key"])))
    d = d.withColumn("all", F.size(z)).withColumn("kept", kept).withColumn("removed", F.when(F.col("kept").isNotNull(), F.col("all") - F.size("kept")).otherwise(0).cast("bigint"))
    text = F.when(F.col("removed") > 0, F.array_join(F.transform("kept", lambda x: x["line"]), "\n")).otherwise(F.col("text"))
    return d.select("doc_id", text.alias("text"), "removed")
