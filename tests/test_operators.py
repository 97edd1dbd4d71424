"""Operators on small hand-made tables, with nulls, ties, repeats and empty input."""

import hashlib
import json
import random
import re

from ledgerloom.operators import grounding, ingest, pairing, provider, reconcile, timestamps, units_history, views
from ledgerloom.session import table
from ledgerloom.sources import sinks, texts

FACT = ("id bigint, doc_id bigint, subject string, metric string, value_raw string, unit_raw string, period_raw string, qualifiers map<string,string>, claim_type string, confidence double, "
        "canon_value double, canon_unit string, period_start string, period_end string, period_kind string, entity_id string, metric_id string")


def fact(i, v=1.0, unit="INR", start="2023-04-01", end="2024-03-31", q=None, claim="measurement", entity=None, metric="m", doc=1, raw=None):
    return (i, doc, "S", "M", raw, None, None, q, claim, 0.5, v, unit, start, end, "fiscal_year", entity, metric)


def test_rule_table(spark):
    cases = [
        (fact(1), fact(2), "corroborates"), (fact(1, q={"basis": "a"}), fact(2, q={"basis": "b"}), "corroborates_with_caveat"), (fact(1, q={"basis": "a"}), fact(2, 9.0, q={"basis": "b"}), "reconcilable"),
        (fact(1), fact(2, 9.0), "contradiction_candidate"), (fact(1, claim="attribute"), fact(2), "needs_model"), (fact(1, None), fact(2), "needs_model"),
        (fact(1, start=None, end=None), fact(2, 9.0, start=None, end=None), "insufficient_context"), (fact(1), fact(2, 9.0, start=None, end=None), "insufficient_context"),
        (fact(1, start=None, end=None), fact(2, start=None, end=None), "corroborates"), (fact(1), fact(2, unit="PERCENT"), "unrelated"),
        (fact(1), fact(2, 9.0, start="2022-04-01"), "different_period"), (fact(1, q={"basis": "a"}), fact(2, 9.0, start="2022-04-01", q={"basis": "b"}), "needs_model"),
        (fact(1, q={"source": "a"}), fact(2, 9.0, q={"source": "b"}), "contradiction_candidate"), (fact(1, q={"source": "a", "vintage": "x"}), fact(2, 9.0, q={"source": "b", "vintage": "y"}), "reconcilable"),
        (fact(1, entity="x"), fact(2, 9.0, entity="y"), "reconcilable"), (fact(1, q={"basis": "a"}), fact(2, 9.0), "contradiction_candidate"), (fact(1, unit="UNKNOWN"), fact(2), "corroborates"),
    ]
    rows, pairs = [], []
    for n, (a, b, _) in enumerate(cases):
        rows += [(2 * n, *a[1:]), (2 * n + 1, *b[1:])]
        pairs.append((2 * n, 2 * n + 1))
    got = reconcile.classify(spark.createDataFrame(pairs, "fact_a bigint, fact_b bigint"), spark.createDataFrame(rows, FACT)).orderBy("fact_a").collect()
    assert [r.rule_verdict for r in got] == [c[2] for c in cases]


def test_adjudication(spark):
    f = spark.createDataFrame([fact(1), fact(2, 9.0), fact(3, 100.0), fact(4, 1.0, q={"basis": "a"}), fact(5, 9.0, q={"basis": "b"}), fact(6, 50.0)], FACT)
    c = reconcile.classify(spark.createDataFrame([(1, 2), (1, 3), (4, 5), (1, 4), (2, 6)], "fact_a bigint, fact_b bigint"), f)
    ans = spark.createDataFrame([(1, 2, "contradicts", None, None), (1, 3, "reconciled_by_context", "scale", "100"), (4, 5, "reconciled_by_context", "basis", None)],
                                "fact_a bigint, fact_b bigint, verdict string, kind string, factor string")
    rows = {(r.fact_a, r.fact_b): r for r in reconcile.adjudicate(c, f, ans).collect()}
    got = {(r.fact_a, r.fact_b): (r.model_verdict, r.final_verdict) for r in rows.values()}
    # (2, 6) has no answer and ends the adjudication of the pairs ranked after it
    assert got == {(1, 2): ("contradicts", "contradicts"), (1, 3): ("reconciled_by_context", "reconciled_by_context"), (2, 6): (None, "contradicts"),
                   (4, 5): (None, "insufficient_context"), (1, 4): (None, "corroborates")}
    assert rows[2, 6].explanation == f"{reconcile.RULE_CONFLICT} (NoAnswer)" and rows[4, 5].explanation == reconcile.NO_REVIEW and rows[1, 4].explanation is None
    assert rows[4, 5].qualifier_diff == '{"basis":{"a":"a","b":"b"}}' and rows[1, 3].claimed_transform == '{"kind":"scale","factor":"100"}' and rows[1, 3].verified


def test_answers_are_checked(spark):
    """Unproved transforms, needless agreement and conflicts between unlike facts are held for review; the budget ends the asking."""
    f = spark.createDataFrame([fact(1, 1.0), fact(2, 9.0), fact(3, 9.0, start="2022-04-01", q={"basis": "a"}), fact(4, 7.0, q={"basis": "b"}), fact(5, 3.0), fact(6, 5.0)], FACT)
    c = reconcile.classify(spark.createDataFrame([(1, 2), (3, 4), (1, 5), (1, 6), (2, 5)], "fact_a bigint, fact_b bigint"), f)
    ans = spark.createDataFrame([(1, 2, "reconciled_by_context", "scale", "2", "x", None), (3, 4, "contradicts", None, None, "y", 0.5), (1, 5, "corroborates", None, None, None, 0.25), (1, 6, "who knows", None, None, "z", 0.75), (2, 5, "reconciled_by_context", None, None, "n", 0.1)],
                                "fact_a bigint, fact_b bigint, verdict string, kind string, factor string, explanation string, confidence double")
    r = {(x.fact_a, x.fact_b): x for x in reconcile.adjudicate(c, f, ans).collect()}
    assert {k: (x.model_verdict, x.final_verdict, x.agreed, x.verified) for k, x in r.items()} == {
        (1, 2): ("reconciled_by_context", "needs_review", False, False), (3, 4): ("contradicts", "needs_review", False, None), (1, 5): ("corroborates", "needs_review", False, None),
        (1, 6): ("unrelated", "unrelated", True, None), (2, 5): ("reconciled_by_context", "needs_review", False, False)}
    assert r[1, 2].explanation == "x [unverified: values do not reconcile under a factor of 2: 1 vs 9]" and r[2, 5].explanation == "n [unverified: no transform claimed; nothing to verify]"
    assert r[3, 4].explanation == "y [held: basis, period differs, so the two may not be comparable]" and r[1, 2].confidence == 0.0 and r[1, 6].confidence == 0.75
    short = {(x.fact_a, x.fact_b): x.model_verdict for x in reconcile.adjudicate(c, f, ans, 2).collect()}
    assert sum(v is not None for v in short.values()) == 2 and short[1, 2] is not None


def test_relations_are_built_and_built_again_alike(spark):
    r = random.Random(9)
    f = spark.createDataFrame([fact(i, r.choice([1.0, 1.0, 2.0]), q={"basis": r.choice("ab")}, metric=r.choice(["m", "n"]), doc=i % 3) for i in range(30)], FACT)
    ans = spark.createDataFrame([(0, 1, "contradicts")], "fact_a bigint, fact_b bigint, verdict string")
    once = reconcile.build_relations(f, ans, 3)
    rows = sorted(map(tuple, once.collect()), key=str)
    assert rows and sorted(map(tuple, sinks.upsert(once, reconcile.build_relations(f, ans, 3), ["fact_a", "fact_b"]).collect()), key=str) == rows
    assert all(x.final_verdict for x in once.collect()) and reconcile.build_relations(f.where("id = 1"), ans).count() == 0


def _greedy(scored, cap):
    used, out = {}, set()
    for (x, y), _ in sorted(scored.items(), key=lambda kv: (-kv[1], kv[0])):
        if used.get(x, 0) < cap and used.get(y, 0) < cap:
            used[x], used[y] = used.get(x, 0) + 1, used.get(y, 0) + 1
            out.add((x, y))
    return out


def _compatible(x, y):
    return not x or not y or "UNKNOWN" in (x, y) or x == y


def test_capped_by_metric_matches_plain_restatement(spark):
    r = random.Random(5)
    for n, cap in ((1, 2), (40, 2), (150, 3), (200, 6)):
        f = [(i * 3, r.choice(["m1", "m2", "", None]), r.choice([None, "INR", "USD", "UNKNOWN", "", "DAYS"])) for i in range(n)]
        scored = {(x[0], y[0]): 1.0 for x in f for y in f if x[0] < y[0] and x[1] and x[1] == y[1] and _compatible(x[2], y[2])}
        df = spark.createDataFrame(f, "id bigint, metric_id string, canon_unit string")
        assert {tuple(x) for x in pairing.capped_by_metric(df, cap).collect()} == _greedy(scored, cap)


def test_candidate_pairs_match_plain_restatement(spark):
    """Both channels, entity and unit rules, one cap; names of one word set under several metrics and none."""
    r = random.Random(11)
    names = ["operating revenue growth", "Operating Revenue growth rate", "growth of operating revenue", "net profit", "net profit after tax", "net profit before tax and interest", "of", "", "revenue", "operating growth", "profit net", None]
    stop = {"of", "from", "the", "in", "for", "and", "a", "on", "to"}
    for n, cap in ((60, 2), (220, 3), (300, 6)):
        f = [(i * 2 + 1, r.choice(names), r.choice([None, None, "rev", "profit", "growth"]), r.choice([None, "e1", "e2", ""]), r.choice([None, "INR", "INR", "USD", "UNKNOWN"])) for i in range(n)]
        words = {i: frozenset(w for w in re.findall("[a-z0-9]+", (m or "").lower()) if w not in stop and len(w) > 2) for i, m, *_ in f}
        scored = {}
        for x in f:
            for y in f:
                if x[0] < y[0] and _compatible(x[4], y[4]) and not (x[3] and y[3] and x[3] != y[3] and x[2] != y[2]):
                    u, v = words[x[0]], words[y[0]]
                    s = 1.0 if x[2] and x[2] == y[2] else len(u & v) / len(u | v) if u and v else 0
                    if s >= 0.6:
                        scored[x[0], y[0]] = s
        df = spark.createDataFrame(f, "id bigint, metric string, metric_id string, entity_id string, canon_unit string")
        got = {(x.fact_a, x.fact_b): x.score for x in pairing.candidate_pairs(df, cap).collect()}
        assert set(got) == _greedy(scored, cap) and all(abs(scored[p] - s) < 1e-12 for p, s in got.items()) and len(set(got.values())) > 1
    assert pairing.candidate_pairs(df.where("false")).count() == 0


def test_components_by_rounds_equal_one_task(spark):
    r = random.Random(3)
    links = spark.createDataFrame([(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1040)], "a bigint, b bigint")
    assert {tuple(x) for x in pairing.grouped(links).collect()} == {tuple(x) for x in pairing.grouped(links, 0).collect()}


def test_capped_uniform_equals_greedy(spark):
    f = spark.createDataFrame([fact(i * 7) for i in range(50)], FACT)
    got = {tuple(x) for x in pairing.capped_uniform(f, 6).collect()}
    assert got == {tuple(x) for x in pairing.capped_by_metric(f, 6).collect()} and got


def test_similar_sets(spark):
    names = ["net profit after tax", "net profit before tax", "profit after tax net", "revenue", "operating revenue growth rate", "operating revenue growth", "growth rate revenue", ""]
    s = pairing.token_sets(spark.createDataFrame([(*fact(i)[:3], n, *fact(i)[4:]) for i, n in enumerate(names)], FACT))
    got = {(r.key_a, r.key_b) for r in pairing.similar_sets(s).collect()}
    keys = {r.key: set(r.tokens) for r in s.collect()}
    assert got == {(a, b) for a in keys for b in keys if a < b and len(keys[a] & keys[b]) / len(keys[a] | keys[b]) >= 0.6} and got


def test_windows_fold():
    parts = ["x" * 400] * 20
    w = ingest.fold_windows(parts, 1000, 400)
    assert len(w) > 1 and all(sum(len(parts[i]) for i in x) <= 1600 for x in w) and all(set(a) & set(b) for a, b in zip(w, w[1:]))
    assert ingest.fold_windows(["a" * 50], 10, 5) == [[0]] and ingest.fold_windows([], 10, 5) == []


def test_windows_table(spark):
    r = random.Random(8)
    rows = [(i, i % 7, r.randrange(1, 4), i, "x" * r.choice([0, 5, 60, 300]), r.random() < 0.1) for i in range(400)] + [(900, 3, 1, 1, None, None), (901, None, 1, 1, "y", False)]
    b = spark.createDataFrame(rows, "id bigint, doc_id bigint, page_no int, block_index int, text string, is_boilerplate boolean")
    got = {(w.doc_id, w.window_index): w for w in ingest.build_windows(b, 500, 80).collect()}
    for d in range(7):
        own = sorted([x for x in rows if x[1] == d and x[4] is not None and not x[5]], key=lambda x: (x[2], x[3], x[0]))
        want = [[own[k][0] for k in w] for w in ingest.fold_windows([x[4] for x in own], 500, 80)]
        assert [list(got[d, n].block_ids) for n in range(len(want))] == want and (d, len(want)) not in got
    texts_ = {x[0]: x[4] for x in rows}
    assert all([w.text[s.s:s.e] for s in w.block_spans] == [texts_[k] for k in w.block_ids] for w in got.values())
    assert ingest.build_windows(b.where("false")).count() == 0


def test_blocks_gaps_furniture(spark):
    d = spark.createDataFrame([(1, " a \n\n b", 2), (2, None, None), (3, "", 0)], "doc_id bigint, text string, page_count int")
    assert [(r.block_index, r.text) for r in texts.text_blocks(d).collect()] == [(0, "a"), (2, "b")]
    b = spark.createDataFrame([(i, 1, p, 0, f"Annual report {p}") for i, p in enumerate(range(1, 6))] + [(9, 1, 1, 1, None), (10, 1, 2, 1, " ")], "id bigint, doc_id bigint, page_no int, block_index int, text string")
    assert {r.id for r in ingest.flag_boilerplate(b).where("is_boilerplate").collect()} == set(range(5))
    g = {(r.doc_id, r.page_no): r.reason for r in ingest.page_gaps(d, b).collect()}
    assert set(g) == {(1, 1), (1, 2)} and g[1, 1].startswith("only 15 ")


def test_dedupe_and_json(spark):
    f = spark.createDataFrame([(*fact(1)[:9], 0.5, *fact(1)[10:]), (*fact(2)[:9], 0.95, *fact(2)[10:]), (*fact(3)[:9], 0.95, *fact(3)[10:]), (*fact(4, doc=2)[:9], None, *fact(4)[10:])], FACT)
    e = spark.createDataFrame([(1, "x  y"), (2, "X y"), (3, "x y"), (4, None)], "fact_id bigint, quote string")
    assert {(r.fact_id, r.copies) for r in grounding.dedupe_facts(f, e).collect()} == {(2, 3), (4, 1)}
    assert grounding.lenient_json('junk {"facts": [1]} more {"facts": [2]}') == '{"facts": [1, 2]}' and grounding.lenient_json("no") is None and grounding.lenient_json(None) is None
    r = spark.createDataFrame([(1, '{"facts":[{"subject":"S","metric":"M","confidence":"high"},{"subject":"T","confidence":0.5}]}'), (2, "bad"), (3, 'x {"facts":[{"subject":"U"}]}')], "id bigint, response string")
    assert [(x.id, x.subject, x.confidence, x.claim_type) for x in grounding.explode_proposals(r).orderBy("id", "seq").collect()] == [(1, "S", 0.0, "measurement"), (1, "T", 0.5, "measurement"), (3, "U", 0.0, "measurement")]


def test_sinks(spark):
    old = spark.createDataFrame([(1, 2, "a"), (3, 4, "b")], "fact_a bigint, fact_b bigint, v string")
    new = spark.createDataFrame([(1, 2, "c")], "fact_a bigint, fact_b bigint, v string")
    once = sinks.upsert(old, new, ["fact_a", "fact_b"])
    assert {tuple(r) for r in once.collect()} == {(1, 2, "c"), (3, 4, "b")} == {tuple(r) for r in sinks.upsert(once, new, ["fact_a", "fact_b"]).collect()}
    d = spark.createDataFrame([(1, "x"), (2, "x"), (3, None)], "doc_id bigint, sha256 string")
    assert [tuple(r) for r in sinks.insert_or_get(d).collect()] == [("x", 1, 2)]


def test_wrong_periods_and_pairs(spark):
    docs = spark.createDataFrame([(1, "s", None), (1, "s", None), (2, None, None), (None, "s", None)], "doc_id bigint, source string, created_at timestamp")
    info = spark.createDataFrame([("s", "America/New_York", "mdy")], "source string, tz string, date_order string")
    rows = [(1, "03/04/2020", "2020-03-04", "instant"), (2, "03/04/2020", "2020-04-03", "instant"), (3, "recently", "2020-04-03", "instant"), (4, None, "2020-04-03", "instant"), (5, "x", None, None)]
    f = spark.createDataFrame([(*fact(i)[:6], p, *fact(i)[7:12], s, s, k, None, None) for i, p, s, k in rows], FACT)
    assert {r.fact_id for r in timestamps.wrong_periods(timestamps.normalise_periods(f, docs, info)).collect()} == {2, 3, 4}
    compact = spark.createDataFrame([(*fact(1)[:6], "20240101T101500", *fact(1)[7:])], FACT)
    assert timestamps.normalise_periods(compact, docs, info).first().period_start == "2024-01-01T15:15:00Z"
    q = [(1, "5", "Cr", 5e7, "UNKNOWN"), (2, "5", "Cr", 5e7, "INR"), (3, "5", "₹ Cr", 5e5, "INR"), (4, "none", "₹ Cr", 5.0, "INR"), (5, "5", "₹ Cr", None, None), (6, "5", "₹ Cr", -5e7, "INR"), (7, "5", "₹ Cr", 5.004e7, "INR"), (8, "0", "%", 0.0, "PERCENT")]
    f = spark.createDataFrame([(i, 1 + i % 3, "S", "M", v, u, None, None, None, None, cv, cu, None, None, None, None, None) for i, v, u, cv, cu in q], FACT)
    e = spark.createDataFrame([(1, "value 5 Cr"), (2, "value ₹ 5 Cr"), (2, "value ₹ 5 Cr"), (None, "x"), (1, None)], "fact_id bigint, quote string")
    h = units_history.unit_history(units_history.normalise_quantities(f, e), docs)
    assert {r.fact_id for r in units_history.wrong_pairs(h).collect()} == {3, 4, 6}
    changes = {r.first_fact: (r.kind, r.reverse_factor and round(r.reverse_factor)) for r in units_history.unit_changes(h).collect()}
    assert changes == {3: ("scale", 100), 4: ("none", None), 6: ("sign", None)}
    empty = f.where("false")
    assert units_history.wrong_pairs(units_history.unit_history(units_history.normalise_quantities(empty, e), docs)).count() == 0
    assert timestamps.wrong_periods(timestamps.normalise_periods(empty, docs, info)).count() == 0


def test_unit_history_finds_runs_and_single_facts_however_it_is_divided(spark):
    """One source, 400 documents; facts 100 to 149 lost their scale, others are off alone by little and much."""
    n = 400
    docs = spark.createDataFrame([(i, "s") for i in range(n)], "doc_id bigint, source string").selectExpr("*", "timestamp_seconds(86400L * doc_id) as created_at")
    off = {i: 1e-7 for i in range(100, 150)} | {7: 1.0012, 8: 0.9, 200: 1e7, 398: 1.0015}
    value = lambda i: round(3.0 + (i * 37) % 101 / 7, 2)
    f = spark.createDataFrame([(i, i, "S", "M", str(value(i)), "Rs crore", None, None, None, None, value(i) * 1e7 * off.get(i, 1 + 4e-4 * (i % 3)), "INR", None, None, None, None, None) for i in range(n)], FACT)
    e = spark.createDataFrame([], "fact_id bigint, quote string")
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            h = units_history.unit_history(units_history.normalise_quantities(f, e), docs)
            assert {r.fact_id for r in units_history.wrong_pairs(h).collect()} == set(off)
            runs = {r.first_fact: (r.n_facts, r.kind) for r in units_history.unit_changes(h).collect()}
            assert runs[100] == (50, "scale") and runs[200] == (1, "scale") and runs[8] == (1, "value")
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_like_keeps_wildcards(spark):
    d = spark.createDataFrame([("a\\b",), ("AxB",), ("zz",)], "s string")
    assert d.where(views.like(d.s, "A_b")).count() == 2 and d.where(views.like(d.s, "\\")).count() == 1


def test_tables_read(spark):
    assert table(spark, "/root/testdata/sf0.001", "source_info").count() == 24


def test_extract_recovers_by_halving(spark):
    from pyspark.sql import functions as F

    from ledgerloom.functions.text import cache_key

    w = spark.createDataFrame([(1, 7, 0, "alpha\nbeta", [1, 2], [(0, 5), (6, 10)]), (2, 7, 1, "solo", [3], [(0, 4)]), (3, 7, 2, "none", [4], None)],
                              "id bigint, doc_id bigint, window_index int, text string, block_ids array<bigint>, block_spans array<struct<s:int,e:int>>")
    cache = spark.createDataFrame([("alpha\nbeta", "broken {"), ("alpha", 'ok {"facts":[{"subject":"A","metric":"m","value_raw":81415.38,"qualifiers":["x"],"confidence":"0.5"}, 3]}'), ("solo", "broken")], "t string, response string")
    cache = cache.select(cache_key(F.lit("m2"), F.lit("v"), F.col("t")).alias("key"), "response")
    done, lost = grounding.extract(w, cache, ["m1", "m2"], "v")
    assert [(r.window_id, r.half, r.subject, r.value_raw, r.qualifiers, r.confidence) for r in done.collect()] == [(1, 0, "A", "81415.4", {}, 0.5)]
    assert {(r.window_id, r.half, r.reason) for r in lost.collect()} == {(1, 1, grounding.UNREAD), (2, -1, grounding.UNUSABLE), (3, -1, grounding.UNREAD)}
    d = spark.createDataFrame([(7, "x"), (8, "y")], "doc_id bigint, sha256 string")
    flags = grounding.completed(d, lost)
    assert {tuple(r) for r in flags.collect()} == {(7, False), (8, True)}
    assert [r.doc_id for r in grounding.to_ingest(d, d.join(flags, "doc_id")).collect()] == [7]


def test_provider_rotation():
    from ledgerloom.operators.provider import call, sort_error

    assert [sort_error(RuntimeError(x)) for x in ("429 slow down", "503 Unavailable", "bad prompt")] == ["quota", "retry", "fatal"]
    seen, waits, spent = [], [], set()

    def provider(prompt, key, model):
        seen.append((key, model))
        if key == "k1":
            raise RuntimeError("quota")
        if len(seen) == 2:
            raise TimeoutError("timeout")
        return prompt.upper()

    assert call(provider, "hi", [("k1", "m"), ("k2", "m")], spent, wait=waits.append) == ("m", "HI", None)
    assert spent == {("k1", "m")} and waits == [2.0] and seen == [("k1", "m"), ("k2", "m"), ("k2", "m")]
    assert call(provider, "hi", [("k1", "m")], spent)[2].startswith("every key")


def test_complete_and_groups(spark):
    from ledgerloom.operators import provider

    p = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, prompt string")
    cache = provider.complete(p, spark.createDataFrame([], "key string, response string"), lambda: lambda t, k, m: t + m, ["k"], ["m"], "v")
    got = {r.id: r for r in cache.collect()}
    assert got[1].response == "am" and got[1].error is None and len(got[1].key) == 64
    assert provider.complete(p, cache.select("key", "response"), lambda: None, ["k"], ["m"], "v").count() == 0
    t = spark.createDataFrame([("metric", x) for x in ("Rev", "Sales", "Odd One", "", None)], "kind string, raw string")
    known = spark.createDataFrame([("metric", "Rev", "revenue", "Revenue")], "kind string, raw string, canon_id string, label string")
    groups = spark.createDataFrame([("metric", 0, "x", "X", ["Sales"]), ("metric", 1, "revenue", "Revenue", ["Sales", "Rev"]), ("metric", 2, None, "Z", ["Odd One"])], "kind string, seq int, canon_id string, label string, members array<string>")
    assert {(r.raw, r.canon_id) for r in provider.assign_groups(t, known, groups).collect()} == {("Rev", "revenue"), ("Sales", "revenue"), ("Odd One", "odd_one")}
    prompts = provider.term_prompts(t, known, "{kind}|{terms}|{existing}", 1).collect()
    assert {r.prompt for r in prompts} == {"metric|- Sales|-: revenue: Revenue", "metric|- Odd One|-: revenue: Revenue"}


def test_refresh_pairs_only_what_new_facts_touch(spark):
    r = random.Random(21)
    names = ["net profit after tax", "net profit before tax", "operating revenue growth", "head count", "grain procured", "order book"]
    rows = []
    for i in range(80):
        k = r.randrange(len(names))
        x = fact(i, r.choice([1.0, 2.0]), metric=r.choice([f"m{k}", None]), doc=i % 4)
        rows.append((*x[:3], names[k], *x[4:]))
    f = spark.createDataFrame(rows, FACT)
    old, new = f.where("id < 70"), f.where("id >= 78")
    now = f.where("id < 70 or id >= 78")
    ans = spark.createDataFrame([(0, 1, "contradicts")], "fact_a bigint, fact_b bigint, verdict string")
    before = reconcile.build_relations(old, ans, 3)
    full = {(x.fact_a, x.fact_b): x.final_verdict for x in reconcile.build_relations(now, ans, 3).collect()}
    got = {(x.fact_a, x.fact_b): x.final_verdict for x in sinks.prune(reconcile.refresh_relations(before, now, new, ans, 3), pairing.candidate_pairs(now, 3)).collect()}
    assert got == full
    assert pairing.affected(now, new).count() < now.count()


def test_prompts_and_corpus_terms(spark):
    f = spark.createDataFrame([fact(1), fact(2, 9.0), (3, 1, "Other", "Sales", None, None, None, None, "measurement", 0.5, 1.0, None, None, None, None, None, None)], FACT)
    c = reconcile.classify(spark.createDataFrame([(1, 2)], "fact_a bigint, fact_b bigint"), f)
    e = spark.createDataFrame([(1, 1, "quoted", 4)], "id bigint, fact_id bigint, quote string, page_no int")
    d = spark.createDataFrame([(1, "file.pdf")], "doc_id bigint, filename string")
    p = provider.adjudication_prompts(c, f, e, d, "{a} ~ {b}: {a_quote}/{b_quote} {a_doc} {a_page} {b_page} {diff} {agree_text}").first()
    assert p.prompt == "S | M ~ S | M: quoted/ file.pdf 4 none {} differ"
    assert provider.extraction_prompts(spark.createDataFrame([(7, "text")], "id bigint, text string"), "<{window}>").first().prompt == "<text>"
    known = spark.createDataFrame([("subject", "S", "s_id", "S Ltd")], "kind string, raw string, canon_id string, label string")
    template = "{kind}|{terms}|{existing}"
    asked = provider.term_prompts(f.selectExpr("'metric' as kind", "metric as raw").distinct(), known, template).collect()
    reply = json.dumps({"groups": [{"canon_id": "sales", "label": "Sales", "members": ["Sales", "M"]}]})
    cache = spark.createDataFrame([(hashlib.sha256(f"m\0canon-v1\0{x.prompt}".encode()).hexdigest(), reply) for x in asked], "key string, response string")
    terms, ids = provider.canonicalise_corpus(f, known, cache, ["m"], template)
    assert {(t.kind, t.raw): t.canon_id for t in terms.collect()} == {("subject", "S"): "s_id", ("subject", "Other"): "other", ("metric", "M"): "sales", ("metric", "Sales"): "sales"}
    assert {(x.id, x.entity_id, x.metric_id) for x in ids.collect()} == {(1, "s_id", "sales"), (2, "s_id", "sales"), (3, "other", "sales")}
