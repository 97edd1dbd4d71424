"""File, HTML and stream sources; schema migration; deletes."""

import hashlib
import json

from pyspark.sql import functions as F

from ledgerloom.operators import ingest_run
from ledgerloom.sources import sinks, texts
from ledgerloom.streaming import arrivals


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "B.pdf").write_bytes(b"%PDF-1.4 one")
    (tmp_path / "sub" / "a.pdf").write_bytes(b"not a pdf")
    (tmp_path / "c.txt").write_bytes(b"x")
    found = texts.discover(spark, str(tmp_path)).collect()
    assert [r.path.rsplit("/", 1)[1] for r in found] == ["B.pdf", "a.pdf"] and len(found[0].sha256) == 64
    assert texts.discover(spark, str(tmp_path), limit=1).count() == 1
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pdf").load(str(tmp_path))
    assert files.where(texts.is_pdf(F.col("content"))).count() == 1
    blocks = texts.parse_files(files, lambda b: [(1, 0, b.decode()), (1, 1, "  ")])
    assert sorted(r.text for r in blocks.collect()) == ["%PDF-1.4 one", "not a pdf"]


def test_html(spark):
    page = "<html><style>p{}</style><!-- no --><h1>Title</h1><p>a &amp; b &lt;c&gt;<br>line<script>x()</script></p>5 < 6</html>"
    d = spark.createDataFrame([(1, page), (2, None), (3, "")], "id bigint, html string")
    assert [r.text for r in texts.html_blocks(d, "id", "html").orderBy("page_no", "block_index").collect()] == ["Title", "a & b <c>", "line", "5 < 6"]


def test_load_if_empty_and_migration(spark):
    a = spark.createDataFrame([(1, "x")], "k bigint, v string")
    assert texts.load_if_empty(a.where("false"), a, ["k"]).count() == 1 and texts.load_if_empty(a, a.limit(0), ["k"]).count() == 1
    twice = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, "z", 1)], "k bigint, v string, n int")
    assert sorted(map(tuple, texts.load_if_empty(twice.where("false"), twice, ["k"], "n").collect())) == [(1, "y", 2), (2, "z", 1)]
    m = sinks.with_missing_columns(a, {"v": F.lit("no"), "w": F.lit(0)}).first()
    assert (m.k, m.v, m.w) == (1, "x", 0)


def test_an_old_store_is_opened(spark):
    old = spark.createDataFrame([(1, "h")], "doc_id bigint, sha256 string")
    store = sinks.opened(spark, {"documents": old})
    assert set(store) == set(sinks.SCHEMAS) and store["facts"].count() == 0
    assert store["documents"].first().ingest_complete is None and {f.name for f in store["documents"].schema} >= {"doc_id", "created_at"}
    docs = spark.createDataFrame([(5, "Head\ncount 12", 1)], "doc_id bigint, text string, page_count int").withColumn("sha256", texts.content_hash(F.col("text")))
    after = ingest_run.rerun(sinks.empty_store(spark), docs, store["cache"], ["m"], store["terms"])
    assert after["documents"].select("doc_id", "ingest_complete").collect()[0] == (5, False) and after["blocks"].count() == 2 and after["rejected"].count() == 1


def test_cascade_delete_and_prune(spark):
    facts = spark.createDataFrame([(1, 10), (2, 20)], "id bigint, doc_id bigint")
    ev = spark.createDataFrame([(5, 1), (6, 2)], "id bigint, fact_id bigint")
    rel = spark.createDataFrame([(7, 1, 2), (8, 2, 3)], "id bigint, fact_a bigint, fact_b bigint")
    bl = spark.createDataFrame([(9, 10), (11, 20)], "id bigint, doc_id bigint")
    left = sinks.cascade_delete(spark.createDataFrame([(10,)], "doc_id bigint"), facts, ev, rel, bl)
    assert {k: [r.id for r in v.collect()] for k, v in left.items()} == {"facts": [2], "evidence": [6], "relations": [8], "blocks": [11]}
    more = sinks.cascade_delete(spark.createDataFrame([(10,)], "doc_id bigint"), facts, ev, rel, bl, facts.select("id", "doc_id"), bl)
    assert [r.id for r in more["gaps"].collect()] == [2] and [r.id for r in more["rejected"].collect()] == [11]
    assert [r.id for r in sinks.prune(rel, rel.where("id = 8")).collect()] == [8]


def test_stream_takes_each_content_once(spark, tmp_path):
    src, store, prog = (str(tmp_path / x) for x in ("in", "store", "progress"))
    listen = arrivals.Progress()
    spark.streams.addListener(listen)
    try:
        rows = [(1, "a\nb"), (2, "a\nb"), (3, "c"), (4, None)]
        for n, part in enumerate((rows, [(5, "c"), (6, "d"), (1, "a\nb")])):
            d = spark.createDataFrame(part, "doc_id bigint, text string").withColumn("created_at", F.to_timestamp(F.lit("2024-01-01")))
            d.write.parquet(f"{src}/{n}")
            arrivals.ingest_stream(spark, src, d.schema, store, prog).awaitTermination()
        arrivals.ingest_stream(spark, src, d.schema, store, prog).awaitTermination()
        assert sorted(r.text for r in spark.read.parquet(f"{store}/documents").collect()) == ["a\nb", "c", "d"]
        assert sorted(r.text for r in spark.read.parquet(f"{store}/blocks").collect()) == ["a", "b", "c", "d"]
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        assert listen.state and all(s["error"] is None for s in listen.state.values())
    finally:
        spark.streams.removeListener(listen)


def test_stream_keeps_late_arrivals(spark, tmp_path):
    src, store, prog = (str(tmp_path / x) for x in ("in", "store", "progress"))
    for n, part in enumerate(([(1, "a", "2024-06-01")], [(2, "b", "2024-06-02")], [(3, "old", "2020-12-31"), (4, "a", "2020-12-31"), (5, "undated", None)], [(6, "old", "2020-12-30")])):
        d = spark.createDataFrame(part, "doc_id bigint, text string, created_at string").withColumn("created_at", F.to_timestamp("created_at"))
        d.write.parquet(f"{src}/{n}")
        arrivals.ingest_stream(spark, src, d.schema, store, prog).awaitTermination()
    assert sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{store}/documents").collect()) == [(1, "a"), (2, "b"), (3, "old"), (5, "undated")]
    assert sorted(r.text for r in spark.read.parquet(f"{store}/blocks").collect()) == ["a", "b", "old", "undated"]


def _reply(*facts):
    return json.dumps({"facts": [dict(zip(("subject", "metric", "value_raw", "unit_raw", "period_raw", "evidence_quote", "confidence"), f)) for f in facts]})


def test_ingest_and_again(spark):
    """Grounded, invented and nameless proposals, a claim twice, an unread document that is read later."""
    text = "Annual report of Acme\nRevenue was 5.0 crore rupees\nin FY24 as printed\nHead count 12"
    docs = spark.createDataFrame([(1, text, 1), (2, text, 1), (3, "Other text that nobody read", 2), (4, None, 1)], "doc_id bigint, text string, page_count int").withColumn("sha256", texts.content_hash(F.col("text")))
    key = lambda t: hashlib.sha256(f"m\0extract-v1\0{t}".encode()).hexdigest()
    reply = _reply(("Acme", "Revenue", "5.0", "crore rupees", "FY24", "Revenue was 5.0 crore rupees in FY24", 0.9), ("ACME ", "revenue", "5.0", "crore", "FY24", "Revenue was  5.0 crore rupees in FY24", 0.4),
                   ("Acme", "Head count", "12", None, None, "Head count 12", 0.5), ("Acme", "Profit", "7", None, None, "never printed", 0.9), ("", "Head count", "12", None, None, "Head count 12", 0.9))
    cache = spark.createDataFrame([(key(text), reply)], "key string, response string")
    terms = spark.createDataFrame([("subject", "Acme", "acme_ltd")], "kind string, raw string, canon_id string")
    out = ingest_run.run(docs, cache, ["m"], terms)
    f = out["facts"].orderBy("id").collect()
    assert [(x.doc_id, x.metric, x.canon_value, x.canon_unit, x.period_start, x.entity_id, x.metric_id) for x in f] == [
        (1, "Revenue", 5e7, "INR", "2023-04-01", "acme_ltd", "revenue"), (1, "Head count", 12.0, "UNKNOWN", None, "acme_ltd", "head_count")]
    e = {x.fact_id: x for x in out["evidence"].collect()}
    assert [(e[x.id].char_start, e[x.id].page_no, len(e[x.id].block_ids)) for x in f] == [(22, 1, 2), (70, 1, 1)]
    assert sorted((x.doc_id, x.reason) for x in out["rejected"].collect()) == [(1, "evidence_quote not found in source window"), (1, "missing subject or metric"), (3, "no cached response and no API key")]
    assert {x.doc_id: x.ingest_complete for x in out["documents"].collect()} == {1: True, 3: False}
    assert sorted((x.doc_id, x.page_no) for x in out["gaps"].collect()) == [(1, 1), (3, 1), (3, 2)]
    store = out | {"relations": spark.createDataFrame([(f[0].id, f[1].id)], "fact_a bigint, fact_b bigint")}
    full = cache.unionByName(spark.createDataFrame([(key("Other text that nobody read"), _reply(("Other", "text", "1", None, None, "nobody", 0.1)))], "key string, response string"))
    again = ingest_run.rerun(store, docs, full, ["m"], terms)
    assert {x.doc_id: x.ingest_complete for x in again["documents"].collect()} == {1: True, 3: True}
    assert sorted(x.metric for x in again["facts"].collect()) == ["Head count", "Revenue", "text"] and again["relations"].count() == 1 and again["rejected"].count() == 2
    third = ingest_run.rerun(again, docs, full, ["m"], terms)
    assert {k: v.count() for k, v in third.items()} == {k: v.count() for k, v in again.items()}
