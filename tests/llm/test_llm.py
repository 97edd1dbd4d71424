"""Problems tagged llm on small tables, against brute force, exact round trips and libraries."""

import base64
import random
import re
import unicodedata
from collections import defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from ledgerloom.functions.graphs import components
from ledgerloom.llm import bitmaps, bktree, bpe, canonical, copies, groups, mixing, pieces, plans, site_lines, stuffing
from ledgerloom.llm.keys import content_tokens, hash128, line_key

D = "/root/testdata/sf0.001"


def col(spark, expr, values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "a string").select(expr).collect()]


# --- problem 1 ---------------------------------------------------------------

def test_line_key(spark):
    k = col(spark, line_key(F.col("a")), ["Page 12 of 94.", "page 3  OF 7", "Pages 3 of 7", "© 2022 X", "2023 x", "--", None])
    assert k[0] == k[1] != k[2] and k[3] == "0x" == k[4] and k[5] == "" and k[6] is None


def _site(spark, blocks, docs):
    b = spark.createDataFrame(blocks, "id bigint, doc_id bigint, text string").withColumn("source", F.lit("clash"))
    d = spark.createDataFrame(docs, "doc_id bigint, source string, text string").withColumn("id", F.lit(1))
    return b, d


def test_repeated_lines(spark):
    r = random.Random(2)
    docs = [(i * 50, "a" if i % 3 else "b", None) for i in range(60)] + [(99999, None, None), (None, "a", None), (77, "a", None)]
    blocks, n = [], 0
    for i, s, _ in docs:
        if i is None or i == 77:
            continue
        for t in {r.choice(["Share this!", "share  THIS", "Page %d" % r.randrange(2000), "Unique %s" % chr(97 + r.randrange(26)) * r.randrange(1, 9), "  ", "***", None]) for _ in range(4)}:
            n += 1
            blocks.append((n, i, t))
    blocks += [(n + 1, 50, "Share this!"), (n + 2, 31337, "Share this!"), (n + 3, None, "Share this!")]
    b, d = _site(spark, blocks, docs)
    src = {i: s for i, s, _ in docs if i is not None and s}
    key = lambda t: re.sub(r"\d+", "0", re.sub(r"[\W_]+", "", t.lower()))
    have, per = defaultdict(set), defaultdict(set)
    for i, doc, t in blocks:
        if doc in src:
            if t and t.strip():
                per[src[doc]].add(doc)
                have[src[doc], key(t)].add(doc)
    want = {i for i, doc, t in blocks if doc in src and t and t.strip() and len(have[src[doc], key(t)]) >= 3 and len(have[src[doc], key(t)]) * 5 >= len(per[src[doc]])}
    assert {x.block_id for x in site_lines.repeated_blocks(b, d).collect()} == want and want
    assert site_lines.repeated_blocks(b.where("false"), d).count() == 0
    docs2 = d.withColumn("text", F.when(F.col("doc_id") == 50, "Share this!\r\nBody 1\n\nshare this").when(F.col("doc_id") == 100, ""))
    got = {x.doc_id: x.text for x in site_lines.clean_documents(b, docs2).where("doc_id in (50, 100, 150)").collect()}
    assert got == {50: "Body 1\n", 100: "", 150: None}
    # a repeated row stays a row, rows without an id stay apart, untouched texts keep their line ends
    odd = spark.createDataFrame([(50, "a", "Body 3\nshare this\nx"), (50, "a", "Body 3\nshare this\nx"), (None, "a", "one\r\ntwo"), (None, None, "Share this!"), (999, "none", "a\r\nb")], "doc_id bigint, source string, text string")
    both = d.select("doc_id", "source", "text").unionByName(odd.where("doc_id is null or doc_id = 999"))
    lines = both.where("doc_id is null or doc_id != 50").unionByName(odd.where("doc_id = 50"))
    got = sorted((x.doc_id or -1, x.text, x.removed) for x in site_lines.clean_documents(b, lines).where("doc_id is null or doc_id in (50, 999)").where("text is not null").collect())
    assert got == [(-1, "Share this!", 0), (-1, "one\r\ntwo", 0), (50, "Body 3\nx", 1), (50, "Body 3\nx", 1), (999, "a\r\nb", 0)]


def test_bitmap_containers_round_trip():
    r = random.Random(4)
    for v in ([5], [0, 65535], list(range(100, 60000)), sorted(r.sample(range(65536), 3000)), sorted(r.sample(range(65536), 30000)), list(range(65536))):
        c = bitmaps.pack(np.array(v))
        assert bitmaps.unpack(c).tolist() == v and len(c) <= 1 + min(2 * len(v), 8192)


def test_spellings_are_united_and_counted_exactly(spark):
    n = 70_000
    rows = spark.range(n).selectExpr("id", "id as doc_id", "case when id % 2 = 0 then 'Share this!' else 'SHARE  this' end as text")
    maps = site_lines.line_bitmaps(site_lines.keyed_lines(rows, rows.selectExpr("doc_id", "'s' as source"))).orderBy("chunk").collect()
    assert [(m.chunk, m.n_docs) for m in maps] == [(0, 65536), (1, n - 65536)] and bitmaps.unpack(maps[1].docs).tolist() == list(range(n - 65536))
    assert len(maps[0].docs) == 5  # one run


def test_fifth_is_exact(spark):
    # 7 of 35 documents are a fifth, although 0.2 * 35 is a little more than 7
    b, d = _site(spark, [(i, i, "notice" if i < 7 else f"text {'abcdefghijklmnopqrstuvwxyz'[i % 26]}{'xy'[i // 26]}") for i in range(35)], [(i, "s", None) for i in range(35)])
    assert site_lines.repeated_blocks(b, d).count() == 7


# --- problem 2 ---------------------------------------------------------------

def _check_pieces(text, parts, limit, overlap):
    assert "".join(text[n:e] for _, n, e in parts) == text
    assert all(e - s <= limit and 0 <= n - s <= overlap for s, n, e in parts)
    assert parts[0][0] == 0 and parts[-1][2] == len(text)


def test_pieces_cover_any_text():
    r = random.Random(4)
    for _ in range(150):
        words = ["".join(r.choice("abcé€") for _ in range(r.choice([1, 4, 9, 60, 700]))) for _ in range(r.randrange(1, 60))]
        text = "".join(w + r.choice([" ", ". ", "\n", "\n\n", "\r\n", "! ", "।  "]) for w in words)
        cut = sorted(r.sample(range(len(text) + 1), min(len(text), 6)))
        for spans in (None, list(zip(cut, cut[1:])), [(5, 3)], [(0, len(text) + 9)]):
            _check_pieces(text, pieces.split_text(text, spans, 200, 40), 200, 40)


def test_piece_boundaries():
    text = "Intro line here.\n" + "\n".join(f"Heading {c}\n" + " ".join(f"Sentence {i} of {c} ends." for i in range(40)) for c in "ABC")
    parts = pieces.split_text(text, None, 400, 50)
    _check_pieces(text, parts, 400, 50)
    assert all(text[e - 1] in " \n" or e == len(text) for _, _, e in parts)  # sentence or line ends
    assert any(text[n:].startswith("Heading B") for _, n, _ in parts)
    _check_pieces("x" * 1000, pieces.split_text("x" * 1000, None, 400, 0), 400, 0)
    assert pieces.split_text("", None) == [(0, 0, 0)]


def test_sections_nest_and_list_items_stay_whole():
    say = lambda c, n: " ".join(f"Sentence {i} of {c} ends here." for i in range(n))
    text = "\n".join(["# A", say("A", 3), "## A1", say("A1", 10), "## A2", say("A2", 2), "# B", say("B", 5), "## B1", say("B1", 3)])
    parts = [text[n:e] for _, n, e in pieces.split_text(text, None, 330, 0)]
    assert "".join(parts) == text and all(len(p) <= 330 for p in parts)
    assert any(p.startswith("# B\n") for p in parts) and not any("## A2" in p and "# B\n" in p for p in parts)
    assert any(p.startswith("## A2\n") for p in parts)
    listed = "Offices are listed here.\n" + "\n".join(f"- office {i} in the city\n  whose lease of {i} years ends\n  - open on Mondays {i}\n    and Fridays" for i in range(30))
    parts = [listed[n:e] for _, n, e in pieces.split_text(listed, None, 260, 0)]
    assert "".join(parts) == listed and all(p.startswith(("- office", "Offices")) for p in parts)
    t = pieces.tree(listed)
    items = t.children[1].children or t.children
    assert sum(listed[x.start:].startswith("- office") for x in [*t.children, *items]) >= 30
    deep = "\n".join(" " * i + "- x" for i in range(3000))
    _check_pieces(deep, pieces.split_text(deep, None, 200, 20), 200, 20)
    numbers = "\n".join(f"{i}. point {i} of the list" for i in range(1, 60))
    assert all(numbers[n:].split(".")[0].isdigit() for _, n, _ in pieces.split_text(numbers, None, 300, 0))


def test_pieces_query(spark):
    w = spark.createDataFrame([(1, "a b " * 1500, [(0, 10)]), (2, "short", None), (3, None, None), (4, "", None)], "id bigint, text string, block_spans array<struct<s:int,e:int>>")
    b = spark.createDataFrame([(1, "z" * 4001), (2, "z" * 4000)], "id bigint, text string")
    p = pieces.pieces(w, b)
    assert {tuple(r) for r in pieces.found_items(p).collect()} == {("window", 1), ("block", 1)}
    with pytest.raises(ValueError):
        pieces.pieces(w, b, 10, 10)


# --- problem 5 ---------------------------------------------------------------

def _components(edges):
    p = {}

    def find(x):
        p.setdefault(x, x)
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            p[y] = x
    return {x: find(x) for x in p}


def test_groups(spark):
    r = random.Random(6)
    edges = [(i, i + 1) for i in range(1, 40)] + [(100 + i, 100 + (i + 1) % 17) for i in range(17)] + [(200, 201 + i) for i in range(30)]
    edges += [(300 + r.randrange(40), 300 + r.randrange(40)) for _ in range(60)] + [(400 + i, 400 + j) for i in range(6) for j in range(i)] + [(500, 501), (501, 500), (510, 510), (601, 600)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    for core in (0, 20, groups.CORE_EDGES):  # all distributed, the end of it in one task, most of it
        assert {(x.fact_id, x.group_id) for x in groups.groups(df, core).collect()} == set(_components(edges).items())
    assert groups.groups(df.where("false")).count() == 0


def test_core_and_hot_groups(spark, monkeypatch):
    r = random.Random(8)
    edges = [(r.randrange(900), r.randrange(900)) for _ in range(700)] + [(i, i + 1) for i in range(2000, 2600)] + [(5000, 5001 + i) for i in range(300)]
    v, root = components(*(np.array(x) for x in zip(*edges)))
    want = _components(edges)
    assert {i: g for i, g in zip(v.tolist(), root.tolist())} == {i: want.get(i, i) for i in v.tolist()}
    monkeypatch.setattr(groups, "HOT_GROUP", 100)
    monkeypatch.setattr(groups, "MAX_HOT", 1000)
    got = {(x.fact_id, x.group_id) for x in groups.groups(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == set(want.items())


def test_linked_pairs(spark):
    rows = [(1, 10, 11, "corroborates"), (2, 11, 10, "contradicts"), (3, 12, 13, None), (4, 13, 12, "corroborates"), (5, 14, 14, "corroborates"), (6, None, 3, "corroborates"), (7, 15, 16, "corroborates"), (7, 15, 16, "corroborates"), (8, 17, 18, "corroborates"), (9, 17, 18, None)]
    df = spark.createDataFrame(rows, "id bigint, fact_a bigint, fact_b bigint, final_verdict string")
    assert {tuple(x) for x in groups.linked_pairs(df).collect()} == {(12, 13), (15, 16)}


# --- problem 6 ---------------------------------------------------------------

def test_content_tokens(spark):
    same = ["Rs 66,04,312.8 (FY2016-17)", "RS 6604312.8  – fy2016–17".replace("–", "(", 1) + ")", "rs 66 04312.8"]
    k = col(spark, F.array_join(content_tokens(F.col("a")), " "), [same[0], "rs. 6604312.8 (FY2016-17)", "5 728 052 t", "5728052 t", "(289.0) x", "-289.0 x", "289.0 x", "−289.0 x", "२.५", "2.5", None])
    assert k[0] == k[1] and k[2] == k[3] and k[4] == k[5] == k[7] != k[6] and k[8] == k[9] and k[10] is None


@pytest.mark.parametrize("hot", [1, 100_000])
def test_copies(spark, hot):
    f = [(1, 1, "Acme Ltd", "Net profit", "5.0"), (2, 1, "ACME  ltd.", "net-profit", " 5.0"), (3, 1, "Acme Ltd", "Net profit", "50"), (4, 2, "Acme Ltd", "Net profit", "5.0"), (5, 1, "Acme Ltd", "Net profit", "5.0"),
         (6, 1, None, None, None), (7, 1, "", "", ""), (8, 1, "no evidence", "m", "1"), (9, 1, "Acme Ltd", "Net profit", "(5.0)")]
    e = [(1, "Acme | 5.0 | Net profit"), (2, "“net PROFIT; acme; 5.0”"), (3, "Acme | 50 | Net profit"), (4, "Acme | 5.0 | Net profit"), (5, "Acme / Net profit / 5.0"), (5, "Acme / Net profit / 5.0"), (6, "q"), (7, "Q!"), (9, "Acme | (5.0) | Net profit"), (None, "x"), (8, None)]
    f += f[:1]  # a repeated row
    f = spark.createDataFrame(f, "id bigint, doc_id bigint, subject string, metric string, value_raw string").withColumn("quote", F.lit("clash"))
    e = spark.createDataFrame(e, "fact_id bigint, quote string").withColumn("id", F.lit(7))
    assert {tuple(x) for x in copies.copies(f, e, hot).collect()} == {(1, 2), (1, 5), (6, 7)}
    assert {(x.first_id, x.copies) for x in copies.claim_records(f, e, hot).collect()} == {(1, 3), (3, 1), (4, 1), (6, 2), (9, 1)}
    assert copies.copies(f.where("false"), e).count() == 0


def test_numbers_that_come_to_stand_side_by_side(spark):
    f = [(i, 1, "Acme", "Votes polled on resolution 7", "435.8‰") for i in (1, 2)] + [(i, 1, "Acme", "Output", "12 500") for i in (3, 4, 5)] + [(6, 1, "Acme", "Output", "12501")]
    e = [(1, "Acme: Votes polled on resolution 7 435.8‰"), (2, "435.8‰; Acme; Votes polled on resolution 7"), (3, "Output 12,500"), (4, "12500 output"), (5, "output 12 500"), (6, "output 12501")]
    f = spark.createDataFrame(f, "id bigint, doc_id bigint, subject string, metric string, value_raw string")
    assert {tuple(x) for x in copies.copies(f, spark.createDataFrame(e, "fact_id bigint, quote string")).collect()} == {(1, 2), (3, 4), (3, 5)}


def test_records_of_facts_without_a_quote(spark):
    f = [(1, 1, "Acme", "m", "5"), (2, 1, "acme", "m", "5"), (8, 1, "no quote", "m", "1"), (9, 1, "no evidence", "m", "1"), (9, 1, "no evidence", "m", "1"), (None, 1, "x", "m", "1"), (10, 1, "Acme", "m", "6")]
    f = spark.createDataFrame(f, "id bigint, doc_id bigint, subject string, metric string, value_raw string")
    e = spark.createDataFrame([(1, "Acme 5"), (2, "ACME 5"), (8, None), (10, None), (10, "Acme 6"), (None, "x")], "fact_id bigint, quote string")
    assert sorted(map(tuple, copies.all_records(f, e).collect())) == [(1, 2), (8, 1), (9, 1), (10, 1)]
    assert {x.first_id for x in copies.all_records(f, e.where("false")).collect()} == {1, 2, 8, 9, 10}


def test_every_fact_is_recorded(spark):
    r = plans.p6_records(spark, D)
    ids = spark.read.parquet(f"{D}/facts.parquet").select("id").distinct()
    lost = ids.join(r, ids.id == r.first_id, "left_anti").join(plans.p6_found(spark, D), F.col("id") == F.col("fact_id"), "left_anti")
    assert lost.count() == 0


# --- problem 7 ---------------------------------------------------------------

def _levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_bk_tree_finds_every_entry():
    r = random.Random(7)
    word = lambda: "".join(r.choice("abc d") for _ in range(r.randrange(0, 14)))
    entries, queries = [word() for _ in range(80)], [word() for _ in range(60)]
    t = bktree.BkTree(entries)
    got = {(q, t.entries[e], d) for q, e, d in t.within(queries, np.array([3] * 60))}
    assert got == {(i, e, _levenshtein(q, e)) for i, q in enumerate(queries) for e in set(entries) if _levenshtein(q, e) <= 3}
    entries = ["".join(r.choice("abकख語é") for _ in range(r.choice([3, 63, 64, 65, 130]))) for _ in range(30)]
    queries = [e[:k] + r.choice("abक?") + e[k + r.randrange(2):] for e in entries for k in (2, len(e) - 1)]
    t = bktree.BkTree(entries)
    got = {(q, t.entries[e], d) for q, e, d in t.within(queries, np.array([4] * len(queries)))}
    assert got == {(i, e, d) for i, q in enumerate(queries) for e in entries if (d := _levenshtein(q, e)) <= 4}
    assert bktree.BkTree([]).within(["a"], np.array([1])) == []
    assert bktree.typing_distance("ca", "abc") == 2 and bktree.typing_distance("satte", "state") == 1


TERMS = [("subject", "Tamvelu Foods Industries Limited", "tamvelu"), ("subject", "Otterbek Logistics Private Limited", "otterbek"), ("metric", "Inventory write-down", "write_down"), ("metric", "PAT", "pat"), ("metric", "Fuel bill", "fuel"), ("metric", "Gross fixed assets", "gfa")]
NAMES = [("TAMVELU  foods Inds. Ltd.", "tamvelu"), ("Limited Tamvelu Foods Industries", "tamvelu"), ("The Tamvélu Fods Indsutries Limited*", "tamvelu"), ("Tamvelu Foods Industries Limited and susbidiaries", "tamvelu"),
         ("Otterbek Logistics (P) Ltd", "otterbek"), ("Hotel Azurine", "unmatched"), ("", "unmatched"), ("Tamvelu Foods Industries Limited", None), (None, None), ("x" * 5000, "unmatched")]


@pytest.mark.parametrize("most", [1000, 2])
def test_names(spark, most):
    f = spark.createDataFrame([(i, n, "PAT") for i, (n, _) in enumerate(NAMES)] + [(100, None, "Inv. write-donw"), (101, None, "PTA"), (102, None, "Reported gross fixed assets"), (103, None, "feul bill:")], "id bigint, subject string, metric string")
    t = spark.createDataFrame(TERMS + [("metric", None, "x"), ("other", "PTA", "y")], "kind string, raw string, canon_id string")
    got = {(x.fact_id, x.kind): x.canon_id for x in canonical.map_names(f, t, most).collect()}
    want = {(i, "subject"): c for i, (_, c) in enumerate(NAMES) if c} | {(100, "metric"): "write_down", (101, "metric"): "unmatched", (102, "metric"): "gfa", (103, "metric"): "fuel"}
    assert got == want
    assert canonical.map_names(f.where("false"), t, most).count() == 0


LONG_ENTRY = "Directorate General for the Coordinated Supervision of Inland Waterways, Harbours and Coastal Shipping of Upper Halvonia"
MORE = [("subject", LONG_ENTRY, "long"), ("subject", "तमवेलु खाद्य उद्योग लिमिटेड", "hindi"), ("subject", "Alpha Bravo Charlie", "x"), ("subject", "Charlie Bravo Alpha", "y"),
        ("subject", "--", "nothing"), ("subject", "State of Sunvaal", "sunvaal"), ("metric", "Branches open", "branches")]
MORE_NAMES = [(LONG_ENTRY.replace("Inland", "Ilnand").upper(), "long"), ("तमवेलु खाद्य उद्योग लिमिटेद", "hindi"), ("उद्योग तमवेलु खाद्य लिमिटेड", "hindi"), ("केंद्रीय बैंक", "unmatched"), ("Россия", "unmatched"),
              ("Bravo Alpha Charlie", "y"), ("Bravo-Charlie Alpha", "x"), ("", "unmatched"), ("...", "unmatched"), ("Stats of Sunvaal", "sunvaal"), ("Zulu Alpha Charlie", "unmatched")]


def test_names_alike_in_one_list_and_in_shards(spark):
    """Long entries, other scripts, ambiguous word order and typing errors that look like abbreviations."""
    f = spark.createDataFrame([(i, n, "branches oper") for i, (n, _) in enumerate(MORE_NAMES)], "id bigint, subject string, metric string")
    t = spark.createDataFrame(MORE + TERMS, "kind string, raw string, canon_id string")
    got = [{(x.fact_id, x.kind): x.canon_id for x in canonical.map_names(f, t, most).collect()} for most in (1000, 3, 1)]
    assert got[0] == got[1] == got[2]
    assert {i: c for (i, k), c in got[0].items() if k == "subject"} == {i: c for i, (_, c) in enumerate(MORE_NAMES)} and {c for (_, k), c in got[0].items() if k == "metric"} == {"branches"}


# --- problem 8 ---------------------------------------------------------------

def test_encoding_equals_libraries(spark):
    tiktoken, tok = pytest.importorskip("tiktoken"), pytest.importorskip("tokenizers")
    r = random.Random(8)
    texts = ["", None, "aaaaaaaaaaaaaaaa", "a" * 3001, "<|endoftext|> it's", "日本語🎉 नमस्ते\r\n\t x  ", "\x00​", " leading", "'s 't"]
    texts += ["".join(r.choice("ab é日🎉0 \n'") for _ in range(r.randrange(400))) for _ in range(60)]
    texts += [x.text for x in spark.read.parquet(f"{D}/documents.parquet").select("text").collect()]
    got = {x.doc_id: list(x.ids) for x in bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(f"{bpe.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb"))}
    t = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert all(got[i] == t.encode_ordinary(x or "") for i, x in enumerate(texts))
    h = tok.Tokenizer.from_file(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")
    h.encode_special_tokens = True
    assert all(got[i] == e.ids for i, e in enumerate(h.encode_batch([x or "" for x in texts], add_special_tokens=False)))
    counts = {x.doc_id: x.n_tokens for x in bpe.count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), "doc_id").collect()}
    assert counts == {i: len(v) for i, v in got.items()}


# --- problem 9 ---------------------------------------------------------------

def test_mix(spark):
    r = random.Random(9)
    docs = [(i, s, "word " * r.randrange(1, 60)) for i, s in enumerate(r.choices("abc", [70, 25, 5], k=3000))] + [(9001, None, "x"), (9002, "d", ""), (9003, "d", None), (9004, "zz", "no target")]
    docs += docs[:50]  # repeated rows
    t = [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 3), ("d", 0.0, 2), ("e", 0.1, 1)]
    d, t = spark.createDataFrame(docs, "doc_id bigint, source string, text string"), spark.createDataFrame(t, "source string, target_share double, max_repeats int")
    m = mixing.mix(d, t).collect()
    cap = {"a": 1, "b": 2, "c": 3}
    assert m and all(1 <= x.copies <= cap[x.source] for x in m) and len({x.doc_id for x in m}) == len(m)
    s = {x.source: x for x in mixing.shares(d, t).collect()}
    # source e has no documents: the others keep their proportions
    assert all(abs(s[k].actual_share - v) < 0.01 for k, v in (("a", 0.5), ("b", 0.3), ("c", 0.2))) and s["e"].n_tokens == 0
    size = {k: sum(x.n_tokens for x in mixing.sized(d).where(F.col("source") == k).collect()) for k in "abc"}
    assert s["a"].n_tokens + s["b"].n_tokens + s["c"].n_tokens == pytest.approx(min(cap[k] * size[k] / v for k, v in (("a", 0.5), ("b", 0.3), ("c", 0.2))), rel=0.02)
    assert {x.doc_id: x.copies for x in m} == {x.doc_id: x.copies for x in mixing.mix(d, t).collect()}
    assert mixing.mix(d.where("false"), t).count() == 0 and mixing.shares(d.where("false"), t).count() == 5
    plan = mixing.Plan(mixing.sized(d), t)
    counts = {(x.shard, x.source): x.n_slots for x in mixing.shard_counts(d, t).collect()}
    drawn = mixing.slots(plan).groupBy("shard", "source").count().collect()
    assert counts == {(x.shard, x["source"]): x["count"] for x in drawn}
    assert {k: sum(n for (_, c), n in counts.items() if c == k) for k in "abc"} == {k: n for k, _, n in plan.sources}
    # every block of a full pass once, a block of the partial pass at most once more
    for k, blocks, n in plan.sources:
        times = [x["count"] for x in mixing.slots(plan).where(F.col("source") == k).groupBy("block").count().collect()]
        assert sum(times) == n and set(times) <= {n // blocks, n // blocks + 1} and (n < blocks or len(times) == blocks)
    # blocks are full and hold every token once
    held = mixing.packed(plan).selectExpr("*", "to_token - from_token as n")
    full = held.groupBy("source", "block").agg(F.sum("n").alias("n")).join(plan.table.select("source", "blocks"), "source").collect()
    assert all(0 < x.n <= 256 and (x.n == 256 or x.block == x.blocks - 1) for x in full)
    assert {x.doc_id: x.n for x in held.groupBy("doc_id").agg(F.sum("n").alias("n")).collect()} == {x.doc_id: x.n_tokens for x in plan.placed.collect()}


def test_keyed_permutations():
    for n in (1, 2, 3, 7, 256, 1000, 70_001):
        x = np.arange(n)
        p = mixing.permuted(x, n, 12345 + n)
        assert sorted(p.tolist()) == x.tolist() and (mixing.permuted(p, n, 12345 + n, inverse=True) == x).all()
    x = np.arange(10_000)
    p, q = mixing.permuted(x, 10_000, 1), mixing.permuted(x, 10_000, 2)
    assert (p != q).mean() > 0.99 and abs(np.corrcoef(p, x)[0, 1]) < 0.05 and abs(np.corrcoef(np.diff(p), np.diff(q))[0, 1]) < 0.05


def test_shards_are_drawn_as_a_multinomial_given_the_totals():
    share = np.array([0.3, 0.5, 0.15, 0.05])
    k = 600
    totals = np.rint(share * k * mixing.SHARD_SLOTS - np.array([0, 100, 0, 0])).astype(np.int64)
    got = np.array([c for _, c, _ in mixing.drawn(0, k, 0, k, totals, np.zeros(4, np.int64))])
    assert (got.sum(0) == totals).all() and (got[:-1].sum(1) == mixing.SHARD_SLOTS).all()
    spread = np.sqrt(mixing.SHARD_SLOTS * share * (1 - share))
    assert np.allclose(got[:-1].std(0), spread, rtol=0.12) and np.allclose(got[:-1].mean(0), mixing.SHARD_SLOTS * share, rtol=0.02)
    # any task draws the same counts and offsets for its shards
    part = [(s, c.tolist(), o.tolist()) for s, c, o in mixing.drawn(0, k, 250, 260, totals, np.zeros(4, np.int64))]
    assert part == [(s, c.tolist(), o.tolist()) for s, c, o in mixing.drawn(0, k, 0, k, totals, np.zeros(4, np.int64)) if 250 <= s < 260]


def test_groups_of_shards_get_their_exact_proportion(monkeypatch):
    monkeypatch.setattr(mixing, "GROUP_SHARDS", 4)
    totals = np.array([30_001, 5, 12_345], np.int64)
    got = mixing._groups(totals, int(totals.sum()))
    assert sum(c for c, _ in got).tolist() == totals.tolist() and all(c.sum() == 4 * mixing.SHARD_SLOTS for c, _ in got[:-1])
    assert all((o == sum((c for c, _ in got[:i]), np.zeros(3, np.int64))).all() for i, (_, o) in enumerate(got))


# --- problem 10 --------------------------------------------------------------

def _repeats(words, times):
    out = []
    for i in range(len(words)):
        best = 0
        for k in range(1, len(words) - i + 1):
            p = words[i:i + k]
            if sum(words[j:j + k] == p for j in range(len(words) - k + 1)) >= times:
                best = k
        out.append(best)
    return out


def _heaviest(w, times):
    count = lambda i, k: sum(w[j:j + k] == w[i:i + k] for j in range(len(w) - k + 1))
    return max([k * count(i, k) for k in (2, 3, 4) for i in range(len(w) - k + 1) if count(i, k) >= times], default=0)


def test_suffixes_of_many_pages_against_brute_force():
    r = random.Random(10)
    for times in (2, 3):
        pages = [[r.randrange(r.choice([1, 2, 3, 9])) for _ in range(r.randrange(0, 40))] for _ in range(80)] + [[1, 2, 3] * 20, [5] * 33, []]
        s = stuffing.Suffixes([np.array(p, np.int64) for p in pages], times)
        for p, long, heavy in zip(pages, s.longest(), s.heaviest(4, times)):
            assert long.tolist() == _repeats(p, times) and heavy == _heaviest(p, times)


def _read(text):
    """Words of a text and whether each stands in a clause, one sentence at a time."""
    out = []
    for s in re.split(r"(?<=[.!?।])[\"”’)]*\s+|\n", text):
        own = regex.findall(r"[\p{L}\p{M}]+(?:['’][\p{L}\p{M}]+)?|\p{N}+", s)
        out += [(w, len(own) >= stuffing.SENTENCE_WORDS and s.rstrip(" \"”’)").endswith((".", "!", "?", "।"))) for w in own]
    return out


def test_words_of_many_pages_at_once_are_those_of_each_sentence(monkeypatch):
    r = random.Random(11)
    signs = list("ab cd1..!?)\"”’''\n\r\t ") + ["।", "\xa0", "\x85", "é", "½", "²", "Ⅳ", "मि", "\u0301", "𝒜", "😀", "a b c d. "]
    pages = ["", "rock'n'roll", "One two three four.\") Five", "...", "q3 1,000", "x" * 500] + ["".join(r.choices(signs, k=r.randrange(300))) for _ in range(300)]
    for block in (1, 7, 1 << 16):
        monkeypatch.setattr(stuffing, "_BLOCK", block)
        sizes, keys, chars, number, clause = stuffing._words(pages)
        expected = [_read(t) for t in pages]
        flat = [x for p in expected for x in p]
        assert sizes.tolist() == [len(p) for p in expected]
        assert list(zip(chars.tolist(), number.tolist(), clause.tolist())) == [(len(w), w[0].isdigit(), c) for w, c in flat]
        assert len(set(zip(keys.tolist(), (w for w, _ in flat)))) == len(set(keys.tolist())) == len({w for w, _ in flat})
    # pages that are read together or apart measure the same
    measured = stuffing.measure(pages)
    monkeypatch.setattr(stuffing, "BATCH_CHARS", 100)
    assert stuffing.measure(pages) == measured


PROSE = " ".join(f"The {a} reported that {b} rose in the quarter because {c} was late." for a in ("board", "office", "unit", "team") for b in ("costs", "sales", "rent") for c in ("rain", "freight", "coal"))
PAGES = {
    1: (PROSE, False), 2: (", ".join(["cheap loans", "gold rate", "stock tips"] * 20), True), 3: ("\n".join(f"[best loan {i}](https://x.example/{i}ab{i})" for i in range(30)), True),
    4: (" ".join("Why gold rate live? Because gold rate live helps gold rate live users find gold rate live." for _ in range(8)), True), 5: ("", False), 6: (None, False),
    7: ("\n".join(f"Acme {i} | net profit | {i * 37} | {2000 + i} | {i * 11}" for i in range(40)), False), 8: (PROSE + "\nTags: gold rate, stock tips, cheap loans", False),
    9: (" ".join("#GoldRate%d #StockTips #CheapLoans" % i for i in range(20)), True), 10: ("Short note.", False)}


def test_stuffed_pages(spark):
    d = spark.createDataFrame([(i, "s" if i % 2 else None, f"Title {i}", t if t is None else f"Title {i}\n{t}") for i, (t, _) in PAGES.items()], "doc_id bigint, source string, title string, text string").withColumn("line", F.lit("clash"))
    assert {x.doc_id for x in stuffing.stuffed_pages(d).collect()} == {i for i, (_, c) in PAGES.items() if c}
    assert stuffing.stuffed_pages(d.where("false")).count() == 0


def _prose(i):
    return f"Note {chr(97 + i % 26)}{chr(97 + i // 26)}\n" + "\n".join(f"{s}{chr(97 + i % 26)}{chr(97 + i // 26)}." for s in PROSE.split(".") if s)


def test_copies_and_spam_sites_keep_their_lines(spark):
    listed = "cheap loans, gold rate, stock tips, home loan, credit card\n" * 6
    rows = [(i, "s", "Note", _prose(i)) for i in range(40)]
    rows += [(100 + i, "s", "Offers", "Offers\n" + listed) for i in range(3)]  # one page, uploaded three times
    rows += [(200 + i, "spam", "Offers", f"Offers\n{listed}New {chr(97 + i)}") for i in range(4)]  # lines of the whole site
    rows += [(300 + i, "t", "Note", _prose(i)) for i in range(40)] + [(400 + i, "t", "Offers", f"Offers\n{listed}All in one place {chr(97 + i)}.") for i in range(4)]  # in a tenth of the site
    d = spark.createDataFrame(rows, "doc_id bigint, source string, title string, text string")
    assert {x.doc_id for x in stuffing.stuffed_pages(d).collect()} == {*range(100, 103), *range(200, 204), *range(400, 404)}
    # site lines that do not travel with the tasks give the same
    assert sorted(map(tuple, stuffing.page_measures(d).collect())) == sorted(map(tuple, stuffing.page_measures(d, 0).collect()))


def test_short_keyword_pages_are_measured(spark):
    rows = [(1, "gold rate, gold rate, gold rate, stock"), (2, "Short note on rates"), (3, "#GoldRate #StockTips"), (4, "---"), (5, "https://x.example/a"), (6, "The rate rose in May."), (7, "It was late. " * 3 + "Sales rose in May again."), (8, "Gold rate live is gold rate live. " * 4)]
    d = spark.createDataFrame([(i, None, None, t) for i, t in rows], "doc_id bigint, source string, title string, text string")
    assert {x.doc_id for x in stuffing.stuffed_pages(d).collect()} == {1, 3, 5, 8}


def test_title_is_one_line(spark):
    listed = ", ".join(["cheap loans", "gold rate", "stock tips"] * 20)
    rows = [(1, "Gold rate live", "Gold rate live\n" * 40), (2, None, listed), (3, "", listed + "\nEnd"), (4, None, "Note\n" + PROSE), (5, "Board note", "Board note\n" + PROSE), (6, None, "Gold rate live\n" * 40), (7, None, "Gold rate live")]
    d = spark.createDataFrame([(i, None, t, x) for i, t, x in rows], "doc_id bigint, source string, title string, text string")
    assert {x.doc_id for x in stuffing.stuffed_pages(d).collect()} == {1, 2, 3, 6}
    assert stuffing.own_text("Note\nB\r\nC\rnote", "note\nb\r\nc\rnote", "note", {}) == ("B\nC\nnote", None)
    assert stuffing.own_text("Gold rate live", "goldratelive", None, {}) == ("Gold rate live", None) and stuffing.own_text("Note\nB", "note\nb", None, {}) == ("B", None)


def test_hashes_are_those_of_the_tables(spark):
    keys = ["", "a", "share this", "तमवेलु", "x" * 500]
    d = spark.createDataFrame([(k,) for k in keys], "k string")
    assert [stuffing._hashes(k) for k in keys] == [(r.a, r.b) for r in d.select(*[h.alias(n) for h, n in zip(hash128(F.col("k")), "ab")]).collect()]


# --- all ---------------------------------------------------------------------

@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_runs(spark, name):
    assert plans.QUERIES[name](spark, D).columns and (plans.QUERIES[name](spark, D).count() > 0 or name in ("p10_found",))


def test_unicode_words():
    assert canonical.normal("Tamvélu_Foods-Inds. Ltd") == "tamvelu foods industries limited" and unicodedata.name("é")


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_query_equals_sql(spark, name):
    import glob

    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{D}/*.parquet"):
        c.execute(f"create view {f.split('/')[-1][:-8]} as select * from '{f}'")
    df = plans.QUERIES[name](spark, D)
    r = c.execute(plans.ORACLE[name])
    assert [x[0] for x in r.description] == df.columns and sorted(map(tuple, df.collect())) == sorted(r.fetchall())
