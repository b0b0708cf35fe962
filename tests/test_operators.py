"""Scenario and differential tests of the claim-graph operators on small hand-made inputs."""

import collections
import datetime
import functools
import itertools
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.functions import lookup, numbers, text
from skein.operators import comove, components, composites, detect, evidence, gate, market, neardup, ranking, resolve, temporal, terms, themes, upsert
from skein.settings import Settings


def claims(spark, rows):
    return spark.createDataFrame(rows, "claim_id string, source_id string, credibility double, subject_id string, object_id string, dup_group string, stance string, relation string, source_span string")


@pytest.fixture(scope="module")
def pump(spark):
    """One filing about a true company, and five copies of an anonymous post about another."""
    rows = [("c0", "filing", 0.92, "TRUE_CO", "", None, "neutral", "sentiment", "reported results")]
    return claims(spark, rows + [(f"p{i}", f"anon{i % 2}", 0.1, "PUMP", "", "dup_p", "bullish", "sentiment", "to the moon") for i in range(5)])


def test_credible_rank_demotes_the_pump(spark, pump):
    seeds = spark.createDataFrame([("filing",)], "node string")
    got = {r["node"]: r for r in evidence.importance(pump, seeds).collect()}
    assert got["PUMP"]["rank_naive"] < got["TRUE_CO"]["rank_naive"]
    assert got["PUMP"]["rank_credible"] > got["TRUE_CO"]["rank_credible"]
    assert (got["PUMP"]["m_raw"], got["PUMP"]["k_eff"]) == (5, 1)
    assert [r["label"] for r in evidence.k_of_m(pump).collect()] == ["K=1 of M=5"]
    assert {r[0]: r[1] for r in evidence.trusted_share(pump).collect()} == {"TRUE_CO": 1.0, "PUMP": 0.0}


def test_copies_from_one_source_endorse_once(pump):
    got = {(r["src"], r["dst"]): r["weight"] for r in evidence.endorsements(pump).collect()}
    assert got == {("filing", "TRUE_CO"): 0.92, ("anon0", "PUMP"): 0.1, ("anon1", "PUMP"): 0.1}


def test_ranks_are_dense_and_break_ties_by_name(spark):
    df = spark.createDataFrame([("b", 0.5), ("a", 0.5), ("c", 0.1)], "n string, s double").repartition(3)
    assert [(r["n"], r["r"]) for r in evidence.ranked(df, "s", "n", "r").orderBy("r").collect()] == [("a", 1), ("b", 2), ("c", 3)]


def plain_pagerank(edges, seeds=None, alpha=0.85, rounds=12):
    nodes = sorted({x for a, b, _ in edges for x in (a, b)})
    out = {n: sum(w for a, _, w in edges if a == n) for n in nodes}
    t = {n: 1.0 for n in nodes} if seeds is None else {n: float(n in seeds) for n in nodes}
    if not sum(t.values()):
        t = {n: max(sum(w for _, b, w in edges if b == n), 1e-9) for n in nodes}
    t = {n: v / sum(t.values()) for n, v in t.items()}
    r = {n: 1 / len(nodes) for n in nodes}
    for _ in range(rounds):
        lost = sum(r[n] for n in nodes if not out[n])
        new = {n: (1 - alpha) * t[n] + alpha * lost * t[n] for n in nodes}
        for a, b, w in edges:
            new[b] += alpha * r[a] * w / out[a]
        done = sum(abs(new[n] - r[n]) for n in nodes) < len(nodes) * 1e-10
        r = new
        if done:
            break
    return r


@pytest.mark.parametrize("small", [0, 1000])
@pytest.mark.parametrize("seeds", [None, ["n1", "n4"], ["absent"]])
def test_pagerank(spark, seeds, small):
    """In one task and by jobs, stopped after twelve rounds."""
    random.seed(1)
    edges = {(f"n{random.randrange(9)}", f"n{random.randrange(12)}"): random.randint(1, 4) for _ in range(25)}
    edges = [(a, b, float(w)) for (a, b), w in edges.items() if a != b]
    df = spark.createDataFrame(edges, "src string, dst string, weight double")
    s = None if seeds is None else spark.createDataFrame([(x,) for x in seeds], "node string")
    got = {r["node"]: r["score"] for r in ranking.pagerank(df, s, most=12, small=small).collect()}
    want = plain_pagerank(edges, seeds)
    assert got.keys() == want.keys() and all(abs(got[n] - want[n]) < 1e-9 for n in want)
    assert abs(sum(got.values()) - 1) < 1e-6


def test_pagerank_goes_to_tolerance(spark):
    edges = [(f"n{i}", f"n{(i * 7 + 1) % 11}", 1.0 + i % 3) for i in range(11)]
    df = spark.createDataFrame(edges, "src string, dst string, weight double")
    got = {r["node"]: r["score"] for r in ranking.pagerank(df).collect()}
    want = plain_pagerank(edges, rounds=300)
    assert all(abs(got[n] - want[n]) < 1e-12 for n in want)
    assert ranking.pagerank(df.limit(0)).count() == 0


@pytest.mark.parametrize("most_nodes", [0, 1000])
@pytest.mark.parametrize("seeds", [None, ["n1"]])
def test_pagerank_of_large_graphs_both_ways(spark, monkeypatch, seeds, most_nodes):
    """Over blocks of edges, of which a node has several, and by joins where the nodes are too many for that."""
    monkeypatch.setattr(ranking, "MOST_NODES", most_nodes)
    monkeypatch.setattr(ranking, "BLOCK", 7)
    random.seed(2)
    edges = [(f"n{a}", f"n{b}", 1.0 + random.random()) for a in range(30) for b in random.sample(range(40), 4) if a != b] + [(f"n{a}", "hub", 1.0) for a in range(30)]
    df = spark.createDataFrame(edges, "src string, dst string, weight double")
    s = None if seeds is None else spark.createDataFrame([(x,) for x in seeds], "node string")
    got = {r["node"]: r["score"] for r in ranking.pagerank(df, s, small=0).collect()}
    want = plain_pagerank(edges, seeds, rounds=300)
    assert got.keys() == want.keys() and all(abs(got[n] - want[n]) < 1e-12 for n in want)


def test_pagerank_rounds_shuffle_nothing(spark):
    """More rounds over a graph too large for one task move no more rows between tasks; joins moved all scores in each."""
    random.seed(3)
    edges = [(f"n{a}", f"n{random.randrange(3000)}", 1.0) for a in range(2000) for _ in range(3)]
    df = spark.createDataFrame(edges, "src string, dst string, weight double").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    few, many = (shuffled(spark, lambda k=k: ranking.pagerank(df, tolerance=0, most=k, small=0).count()) for k in (1, 6))
    assert many < 1.2 * few


def test_importance_counts_copies_once(spark):
    """The edges that both graphs share, against each graph's own."""
    rows = [("s1", "a", "b", 0.5, "d1", "1"), ("s1", "a", "b", 0.9, "d1", "2"), ("s1", "a", "", 0.4, None, "3"), ("s2", "b", None, 0.3, None, "4"), ("", "a", "c", 0.2, None, "5")]
    known = spark.createDataFrame(rows, "source_id string, subject_id string, object_id string, credibility double, dup_group string, claim_id string")
    both = evidence.edges(known, F.xxhash64(evidence.story()))
    rounded = lambda x: sorted((r["src"], r["dst"], round(r["weight"], 9)) for r in x.collect())
    assert rounded(evidence.endorsements(known)) == [("", "a", 0.2), ("a", "b", 1.4), ("a", "c", 0.2), ("s1", "a", 1.3), ("s2", "b", 0.3)]
    assert rounded(both.select("src", "dst", "weight")) == rounded(evidence.endorsements(known))
    assert rounded(evidence.named(both).select("src", "dst", F.col("n").alias("weight"))) == rounded(evidence.mentions(known))


def test_validity_is_half_open(spark):
    df = spark.createDataFrame([("a", "2000-01-01", "2008-09-01", "2000-01-01"), ("b", "2008-09-01", None, "2009-01-01")], "k string, status_valid_from string, status_valid_to string, knowledge_time string")
    at = lambda t, **o: sorted(r["k"] for r in temporal.active_universe(df, t, **o).collect())
    assert at("2008-08-31") == ["a"] and at("2008-09-01") == [] and at("2008-09-01", known=None) == ["b"] and at("1900-01-01") == []
    assert [r["k"] for r in temporal.survivorship(df, "2005-01-01", "2010-01-01", "k").collect()] == ["a"]


def test_alias_changes_hands(spark):
    al = spark.createDataFrame([("TICK", "old", "2000-01-01", "2008-09-01"), ("TICK", "new", "2008-09-01", None)], "surface_form string, target_id string, valid_from string, valid_to string")
    assert [temporal.alias_at(al, "TICK", t).first()["target_id"] for t in ("2008-08-31", "2008-09-01")] == ["old", "new"]


def test_patch_keeps_what_is_null_or_absent(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k int, x string, y double")
    new = spark.createDataFrame([(1, None, 5.0), (3, "c", None)], "k int, x string, z double")
    got = {r["k"]: (r["x"], r["y"], r["z"]) for r in upsert.upsert_patch(old, new, ["k"]).collect()}
    assert got == {1: ("a", 1.0, 5.0), 2: ("b", 2.0, None), 3: ("c", None, None)}
    twice = upsert.upsert_patch(upsert.upsert_patch(old, new, ["k"]), new, ["k"])
    assert {r["k"]: (r["x"], r["y"], r["z"]) for r in twice.collect()} == got


def test_uniqueness(spark):
    df = spark.createDataFrame([(1, 2), (1, 2)], "a int, b int")
    with pytest.raises(ValueError):
        upsert.assert_unique(df, ["a"])
    assert upsert.append_new(df, df.limit(0), "a").count() == 1
    new = upsert.append_new(df.withColumn("_carried", F.lit(1)), df.limit(0), "a")
    assert new.columns == ["a", "b"]


def test_stamp_replace_and_gate(spark, tmp_path):
    nodes = spark.createDataFrame([("i1", 1), ("i2", 2)], "k string, v int")
    values = spark.createDataFrame([("l1", 9), ("l9", 5)], "k string, v int")
    link = spark.createDataFrame([("l1", "s1")], "l string, s string"), spark.createDataFrame([("s1", "i1")], "s string, i string")
    got = upsert.stamp(nodes, values, "k", [(link[0], "l", "s"), (link[1], "s", "i")])
    assert {r["k"]: r["v"] for r in got.collect()} == {"i1": 9, "i2": 2}
    path = str(tmp_path / "t")
    upsert.replace(nodes, path)
    again = upsert.replace(spark.read.parquet(path).where("v = 2"), path)
    assert [r["k"] for r in again.collect()] == ["i2"]
    ids = [spark.createDataFrame([(x,) for x in ("a", "b")], f"{c} string") for c in ("issuer_id", "target_id")]
    sec = spark.createDataFrame([("a", "s1"), ("b", "s2")], "issuer_id string, security_id string")
    lst = spark.createDataFrame([("s1",), ("s2",), ("s3",)], "security_id string")
    one = upsert.gate_universe(ids[0].where("issuer_id = 'a'"), ids[0], sec, lst, ids[1])
    assert {n: df.count() for n, df in one.items()} == {"issuers": 1, "securities": 1, "listings": 1, "aliases": 1}
    assert upsert.gate_universe(None, ids[0], sec, lst, ids[1])["listings"].count() == 3


def test_day_partitions_are_replaced(spark, tmp_path):
    p = str(tmp_path / "days")
    df = spark.createDataFrame([("t", "2024-01-01", 1), ("t", "2024-01-02", 2)], "theme string, day string, n int")
    upsert.write_days(df, p, "day")
    upsert.write_days(df.where("day = '2024-01-02'").withColumn("n", F.lit(9)), p, "day")
    assert sorted((str(r["day"]), r["n"]) for r in spark.read.parquet(p).collect()) == [("2024-01-01", 1), ("2024-01-02", 9)]


# ------------------------------------------------------------------ text


def test_keyword_boundaries(spark):
    rows = spark.createDataFrame([("AI chips",), ("mail from hawaii",), ("반도체용 장비",), ("revenue",)], "t string")
    got = rows.select(text.keyword_hit(F.col("t"), "AI"), text.keyword_hit(F.col("t"), "반도체"), text.keyword_hit(F.col("t"), "EV")).collect()
    assert [tuple(r) for r in got] == [(True, False, False), (False, False, False), (False, True, False), (False, False, False)]


def test_stance(spark):
    from skein.functions import lexicons as L

    rows = [("급등 호재", "bullish"), ("소송 우려", "bearish"), ("평범한 날", "neutral"), ("stock beat but falls on probe", "bearish")]
    df = spark.createDataFrame(rows, "t string, want string")
    assert all(r[0] == r[1] for r in df.select(text.stance(F.col("t"), L.BULLISH, L.BEARISH), "want").collect())


def test_html_and_publishers(spark):
    df = spark.createDataFrame([("<b>A</b>&amp; B<br>C", "https://www.mk.co.kr/x"), ("x", "http://other.org/y"), ("x", None)], "t string, u string")
    got = df.select(text.unescape_html(text.strip_html(F.col("t"))), text.publisher(F.col("u"), {"mk.co.kr": "MK"})).collect()
    assert [tuple(r) for r in got] == [("A & B C", "MK"), ("x", "other.org"), ("x", "unknown")]


def test_nfkc(spark):
    df = spark.createDataFrame([(" ＡＢＣ ",), ("straße",), (None,)], "t string")
    assert [r[0] for r in df.select(text.norm_nfkc("t")).collect()] == ["abc", "strasse", None]


@pytest.mark.parametrize(
    ("raw", "outlet", "want"),
    [
        ("Shares jump - Daily. More here", "Daily", "Shares jump. More here"),
        ("Shares jump. Shares jump on results", None, "Shares jump. on results"),
        ("Deal signed - Alpha Securities. On Monday Alpha Securities said", None, "Deal signed. On Monday Alpha Securities said"),
        ("Deal signed - reuters", None, "Deal signed"),
        ("Deal - half done", None, "Deal - half done"),
        (None, None, ""),
        ("Up 3% - A+B (x). Up 3% today A+B (x) ·", "A+B (x)", "Up 3%. today"),
        ("Chip  demand\trises", "DAILY", "Chip demand rises"),
        ("Report by \\E[a-z]", "\\E[a-z]", "Report by"),
        ("One. Two. Three - Reuters", None, "One. Two. Three - Reuters"),
        (" - x. - ", None, "x"),
    ],
)
def test_clean_headline(spark, raw, outlet, want):
    df = spark.createDataFrame([(raw, outlet)], "t string, o string")
    got = df.select(text.clean_headlines(F.col("t"), F.col("o"), ("Reuters",)), text.clean_headlines(F.col("t"), F.col("o"), ("Reuters",), 4)).first()
    assert got[0] == want and got[1] == want[:4].rstrip()


def test_folding_before_bigrams(spark):
    rows = spark.createDataFrame([("ＡＢ ß",), ("ab ss",), (None,), ("x",)], "t string")
    got = [sorted(r[0]) for r in rows.select(text.bigrams(F.col("t"))).collect()]
    assert got == [["ab", "bs", "ss"], ["ab", "bs", "ss"], [], []]


def test_outlets_and_sectors(spark):
    df = spark.createDataFrame([("The Wall Street Journal", "2911", "26"), ("Zacks", "7399", "01"), (None, None, None), ("한국경제 TV", "100", "99x")], "o string, s string, k string")
    got = df.select(text.is_quality_outlet(F.col("o")), lookup.sic_sector(F.col("s"))["sector"], lookup.sic_sector(F.col("s"))["industry"], lookup.ksic_name(F.col("k")), lookup.ksic_sector(lookup.ksic_name(F.col("k")))["sector"]).collect()
    assert [tuple(r) for r in got] == [(True, "Energy", "Oil & Gas Refining & Marketing", "전자부품·반도체", "Technology"), (False, "Technology", "Technology", "농업", "Other"), (False, "Other", "Other", "기타()", "Other"), (True, "Consumer Defensive", "Consumer Defensive", "기타(99x)", "Other")]


def test_divergence(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([0.5, 0.5], [1.0, 0.0])], "p array<double>, q array<double>")
    got = [r[0] for r in df.select(numbers.jsd(F.col("p"), F.col("q"))).collect()]
    assert got[0] == 0 and abs(got[1] - 1) < 1e-12 and 0.3 < got[2] < 0.32


def test_lookups(spark):
    df = spark.createDataFrame([("3571",), ("0100",), ("6021",), ("9999",), ("9021",), ("x",)], "c string")
    assert [r[0] for r in df.select(lookup.division(F.col("c"))).collect()] == ["Manufacturing", "Agriculture", "Finance", "Public", "Public", "Other"]
    got = spark.range(1).select(lookup.item_text(F.lit("1.03, 9.99,2.02"))).first()[0]
    assert got == "1.03 Bankruptcy or Receivership; 9.99; 2.02 Results of Operations and Financial Condition"


def test_same_group(spark):
    rows = [("삼성증권", "삼성SDI", True), ("기아", "현대모비스", True), ("Alpha", "Alpha Beta", True), ("Acme Holdings", "Acme", True), ("한화", "두산", False), ("Acme", "Zeta", False)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert all(r[0] == r[1] for r in df.select(lookup.same_group(F.col("a"), F.col("b")), "want").collect())


# ------------------------------------------------------------------ detectors


def test_grounding(spark):
    c = claims(spark, [("a", "s", 1.0, "X", "", None, "bullish", "sentiment", "the claim was denied"), ("b", "s", 1.0, "X", "", None, "bullish", "sentiment", "reportedly strong"), ("c", "s", 1.0, "X", "", None, "bullish", "sentiment", "strong"), ("d", "s", 1.0, "X", "", None, "neutral", "sentiment", "denied")])
    assert {r["claim_id"]: r["issue"] for r in detect.grounding(c).collect()} == {"a": "polarity-inverted", "b": "hedge/attribution-dropped"}


def test_omission(spark):
    docs = spark.createDataFrame([("d1", "Acme faces a fraud probe, said Beta"), ("d2", "Acme grows"), ("d3", "Acme fraud")], "doc_id string, text string")
    raised = spark.createDataFrame([("d1", ["Acme"]), ("d3", ["fraud", "Acme"])], "doc_id string, elevated array<string>")
    got = detect.omission(docs, raised, ("Acme", "Beta")).collect()
    assert [(r["doc_id"], r["dropped"], r["recall"], r["omissions"]) for r in got] == [("d1", ["fraud", "probe"], 0.25, ["Beta", "fraud", "probe"])]
    # two lists of 1 and 4 that share 1: (2 * 5 / 2) - 1 = 4 in all, none beyond the four seen
    assert (got[0]["hidden"], got[0]["hidden_pct"]) == (0.0, 0.0)


def test_omission_folds_and_canonical_names(spark):
    docs = spark.createDataFrame([("d1", "ＡＣＭＥ: ＦＲＡＵＤ at the small acme"), ("d2", "fraud, but never read")], "doc_id string, text string")
    raised = spark.createDataFrame([("d1", ["Acme Inc"])], "doc_id string, elevated array<string>")
    got = detect.omission(docs, raised, ("ACME", "acme"), ("Fraud",), {"ACME": "Acme Inc", "acme": "Acme Inc"}).collect()
    assert [(r["doc_id"], r["dropped"], r["recall"], r["omissions"]) for r in got] == [("d1", ["Fraud"], 0.5, ["Fraud"])]


def test_spans_within(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b  c\nd e x"), (3, "bc d")], "doc long, text string")
    items = spark.createDataFrame([("whole", "b c d e f g"), ("five", "a b c d e"), ("short", "c d"), ("none", " "), ("word", "d")], "item string, text string")
    got = sorted((r["item"], r["doc"]) for r in detect.spans_within(items, docs, "item", "doc").collect())
    assert got == [("five", 1), ("five", 2), ("short", 1), ("short", 2), ("whole", 1), ("word", 1), ("word", 2), ("word", 3)]


def test_dispersion(spark):
    docs = spark.createDataFrame([("d", "Risk of loss. A lawsuit looms. There is a record though")], "doc_id string, text string")
    c = spark.createDataFrame([("d", "There is a record though")], "doc_id string, source_span string")
    assert [r["doc_id"] for r in detect.stance_dispersion(docs, c).collect()] == ["d"]


# ------------------------------------------------------------------ near-duplicates


def jac(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def test_leaders_follow_key_order(spark):
    random.seed(4)
    words = [f"w{i}" for i in range(30)]
    docs = []
    for i in range(60):
        if docs and random.random() < 0.7:
            t = random.choice(docs)[1].split()
            t[random.randrange(len(t))] = random.choice(words)
        else:
            t = random.sample(words, 12)
        docs.append((i, " ".join(t)))
    lead, want = [], {}
    for i, t in docs:
        s = set(t.split())
        hit = next((k for k, g in lead if jac(g, s) >= 0.8), None)
        if hit is None:
            lead.append((i, s))
        want[i] = i if hit is None else hit
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r["id"]: r["leader"] for r in neardup.leaders(df).collect()} == want


def test_amplifiers(spark):
    docs = spark.createDataFrame([(1, "a b c d e", 5), (2, "a b c d e", 3), (3, "x y z", 1)], "doc_id long, text string, ingest_time long")
    got = {r["id"]: (r["dup_group"], r["is_amplifier"]) for r in neardup.amplifiers(docs, neardup.leaders(docs)).collect()}
    assert got == {1: ("dup_2", True), 2: ("dup_2", False)}


def grams(t):
    import re

    s = re.sub("[^0-9a-z가-힣]", "", t.lower())
    return {s[i : i + 2] for i in range(len(s) - 1)}


def same_story(a, b, thr):
    x, y = grams(a), grams(b)
    return len(x & y) >= 8 and len(x & y) / min(len(x), len(y)) >= thr


def alike(x, y, thr):
    """Two records may tell one story: compatible entities, bigrams at the threshold."""
    return (x.ent == y.ent or not x.ent or not y.ent) and same_story(x.text, y.text, thr)


def stories_by_definition(records):
    """(text, day, ents, size) of each story, as its definition says.

    A day's stories are the connected parts of the graph of its records; a
    story is named by its first record by day, text and id. One whose name is
    alike to the name of a story of the day before, which itself went into no
    other, goes into the first such.
    """
    edges = {r: [q for q in records if q.day == r.day and (q.text == r.text or alike(q, r, 0.4))] for r in records}

    @functools.cache
    def name(r):
        part, fringe = {r}, [r]
        while fringe:
            fringe = [q for x in fringe for q in edges[x] if q not in part and not part.add(q)]
        return min(part, key=lambda q: (q.day, q.text, q.id))

    names = {name(r) for r in records}

    @functools.cache
    def into(n):
        before = datetime.date.fromisoformat(n.day) - datetime.timedelta(1)
        hosts = [m for m in names if m.day == str(before) and alike(m, n, 0.75) and into(m) == m]
        return min(hosts, key=lambda q: (q.text, q.id), default=n)

    parts = {}
    for r in records:
        parts.setdefault(into(name(r)), []).append(r)
    return sorted((n.text, n.day, tuple(sorted({r.ent for r in p if r.ent})), len(p)) for n, p in parts.items())


def test_stories(spark):
    random.seed(7)
    base = ["quarterly profit rises on strong memory chip demand", "court orders recall of faulty batteries nationwide", "central bank keeps its key rate unchanged again", "abc"]
    rows = []
    for i in range(70):
        t = random.choice(base).split()
        if random.random() < 0.6:
            t.insert(random.randrange(len(t) + 1), random.choice(["today", "sources", "say", "analyst"]))
        rows.append((i, f"2024-03-{random.randrange(1, 8):02d}", " ".join(t), random.choice([None, "A", "B"])))
    df = spark.createDataFrame(rows, "id long, day string, text string, ent string")
    got = sorted((r["text"], r["day"], tuple(r["ents"]), r["n_src"]) for r in neardup.collapse_stories(df).collect())
    record = collections.namedtuple("record", "id day text ent")
    assert got == stories_by_definition([record(*r) for r in rows])


def test_daily_templates_do_not_chain(spark):
    rows = [(i, f"2024-02-{i + 1:02d}", "market wrap for the day: the index closed higher on foreign demand", None) for i in range(28)]
    got = neardup.collapse_stories(spark.createDataFrame(rows, "id long, day string, text string, ent string")).collect()
    assert len(got) >= 14


def test_diverse(spark):
    rows = [("g", 1, "profit rises on memory demand"), ("g", 2, "profit rises on memory demand today"), ("g", 3, "court orders a recall"), ("h", 1, "court orders a recall")]
    got = neardup.diverse(spark.createDataFrame(rows, "g string, o int, t string"), "g", ["o"], "t").collect()
    assert sorted((r["g"], r["o"]) for r in got) == [("g", 1), ("g", 3), ("h", 1)]


@pytest.mark.parametrize("hub", [0, 3, 1000])
def test_components_of_random_graphs(spark, monkeypatch, hub):
    """Stars, chains and random links against a plain search, with and without hubs."""
    monkeypatch.setattr(components, "HUB", hub)
    random.seed(5)
    edges = [(100, i) for i in range(101, 130)] + [(i, i + 1) for i in range(30)] + [(random.randrange(200, 260), random.randrange(200, 260)) for _ in range(45)] + [(5, 5), (None, 1)]
    near = {}
    for a, b in edges[:-1]:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for a in sorted(near):
        fringe = [a] if a not in want else []
        while fringe:
            x = fringe.pop()
            want[x] = a
            fringe += [y for y in near[x] if y not in want]
    linked = {x for a, b in edges if a != b and None not in (a, b) for x in (a, b)}
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: c for x, c in want.items() if x in linked}


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(90, 80)], "u long, v long")
    assert {r["node"]: r["component"] for r in components.connected_components(e).collect()} == {i: 0 for i in range(41)} | {80: 80, 90: 80}


# ------------------------------------------------------------------ themes, market, co-movement


def test_surge_needs_recent_stories(spark):
    d = datetime.date(2024, 1, 30)
    rows = [("a", d - datetime.timedelta(i), 2) for i in range(7)] + [("a", d - datetime.timedelta(20), 4), ("b", d, 4)]
    got = {r["theme"]: r["surge"] for r in themes.surge(spark.createDataFrame(rows, "theme string, day date, count long"), "2024-01-30").collect()}
    assert got["b"] is None and got["a"] == round((14 / 7 + 0.5) / (4 / 28 + 0.5), 2)


def test_rescue(spark):
    edges = spark.createDataFrame([("a", "b", 9)], "a string, b string, w long")
    weak = spark.createDataFrame([("c", "d", 3), ("a", "c", 2), ("e", "a", 1)], "a string, b string, w long")
    added, alone = themes.rescue(edges, weak, ["a", "b", "c", "d", "e"])
    assert added == [("c", "d", 3)] and alone == ["e"]


def test_day_change(spark):
    bars = spark.createDataFrame([("s", "2024-01-01", 10.0, 1.0), ("s", "2024-01-02", 11.0, 1.0), ("one", "2024-01-02", 5.0, 1.0)], "series string, day string, close double, volume double")
    of = lambda t: {r["series"]: r["chg"] for r in market.day_change(bars, t).collect()}
    assert of("2024-01-05") == {"s": 0.1, "one": None} and of("2024-01-16")["s"] is None and of("2024-01-01")["s"] is None


def test_clusters_find_planted_blocks(spark):
    names = [f"s{i}" for i in range(9)]
    pairs = [(a, b, 0.9 if int(a[1]) // 3 == int(b[1]) // 3 else 0.05) for a, b in itertools.combinations(names, 2)]
    got = comove.flow_clusters(spark.createDataFrame(pairs, "a string, b string, r double")).collect()
    label = {r["series"]: r["cluster"] for r in got}
    assert len({label["s0"], label["s3"], label["s6"]}) == 3
    assert all(label[f"s{i}"] == label[f"s{i // 3 * 3}"] for i in range(9))
    with pytest.raises(ValueError):
        comove.flow_clusters(spark.createDataFrame(pairs, "a string, b string, r double"), most=5)


def test_communities(spark):
    edges = [(a, b, 5) for g in ("abcd", "wxyz") for a, b in itertools.combinations(g, 2)] + [("a", "w", 1)]
    got = {r["node"]: r["community"] for r in comove.communities(spark.createDataFrame(edges, "a string, b string, w long")).collect()}
    assert len({got[c] for c in "abcd"}) == 1 and len({got[c] for c in "wxyz"}) == 1 and got["a"] != got["w"]


def test_silhouette_and_rand(spark):
    d = np.array([[0, 0.1, 1, 1], [0.1, 0, 1, 1], [1, 1, 0, 0.1], [1, 1, 0.1, 0]])
    assert comove.silhouette(d, np.array([0, 0, 1, 1])) > 0.8 and comove.silhouette(d, np.zeros(4, int)) == 0
    same = spark.createDataFrame([(i % 2, (i + 1) % 2) for i in range(8)], "x int, y int")
    assert comove.rand_index(same).first()["ari"] == 1.0
    # a point alone doesn't count: the mean is that of the pair
    assert comove.silhouette(d[:3, :3], np.array([0, 0, 1])) == 0.9 and comove.silhouette(d, np.arange(4)) == 0
    assert comove.adjusted_rand(np.array([0, 0, 1, 1]), np.array([1, 1, 0, 0])) == 1.0 and comove.adjusted_rand(np.zeros(4, int), np.zeros(4, int)) == 0.0
    assert comove.stable(0.3, [0.2, 0.12]) and not comove.stable(0.3, [0.2, 0.1]) and not comove.stable(-0.1, [0.1, 0.1])


# ------------------------------------------------------------------ resolution, gates, settings


def test_weighted_ratio():
    assert resolve.weighted_ratio("Samsung Electronics", "samsung electronics") == 100
    assert resolve.weighted_ratio("Electronics Samsung", "Samsung Electronics") >= 95
    assert resolve.weighted_ratio("Samsung Electronics Co", "Hyundai Motor") < 60
    assert resolve.weighted_ratio("", "x") == 0 == resolve.weighted_ratio(None, "x")
    assert resolve.ratio("kitten", "sitting") == pytest.approx(200 * 4 / 13)


def test_candidates_lose_none(spark):
    """Against all pairs, in several scripts, with repeated words, shared words and reordered ones."""
    names = ["Лукойл Нефть", "三菱商事株式會社", "Samsung Electronics", "New York New York Hotel", "삼성전자", "Ångström Labs", "A", "Société Générale", "Beta Motors International Holdings Company", "x y z"]
    surfaces = ["Лукойл Нефт", "三菱商事株式会社", "electronics samsung", "york new hotel", "삼성 전자", "Angstrom Labs", "a", "Societe Generale SA", "Motors", "Holdings Beta", "z y x", "!!", "", "Samsang Elektronics", "New York"]
    issuers = spark.createDataFrame([(f"I{i}", n) for i, n in enumerate(names)], "issuer_id string, name string")
    got = {(r["surface"], r["target"]): r["score"] for r in resolve.candidates(spark.createDataFrame([(s,) for s in surfaces], "surface string"), issuers, top=99).collect()}
    want = {(s, f"I{i}"): resolve.weighted_ratio(s, n) / 100 for s in surfaces for i, n in enumerate(names) if resolve.weighted_ratio(s, n) >= 80}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and ("Лукойл Нефт", "I0") in got


def test_random_candidates_lose_none(spark):
    random.seed(11)
    words = ["".join(random.choice("abcdeé漢") for _ in range(random.randrange(1, 7))) for _ in range(14)]
    text_of = lambda: " ".join(random.choice(words) for _ in range(random.randrange(1, 5)))
    change = lambda t: "".join(c for c in t if random.random() > 0.15)
    names = [text_of() for _ in range(25)]
    surfaces = sorted({change(random.choice(names)) if random.random() < 0.7 else text_of() for _ in range(50)})
    issuers = spark.createDataFrame([(f"I{i}", n) for i, n in enumerate(names)], "issuer_id string, name string")
    got = {(r["surface"], r["target"]) for r in resolve.candidates(spark.createDataFrame([(s,) for s in surfaces], "surface string"), issuers, top=999).collect()}
    assert got == {(s, f"I{i}") for s in surfaces for i, n in enumerate(names) if resolve.weighted_ratio(s, n) >= 80}


def test_claims_need_their_document_and_source(spark):
    ex = spark.createDataFrame([("d1", [("X", "supplies", "")])], "doc_id string, claims array<struct<subject_surface:string,relation:string,object_text:string>>")
    docs = spark.createDataFrame([("d1", "s", "t", "t")], "doc_id string, source_id string, event_time string, ingest_time string")
    none = spark.createDataFrame([], "surface string, target_id string")
    sources = spark.createDataFrame([("s", 0.5)], "source_id string, credibility double")
    assert resolve.build_claims(ex, docs, sources, none).first()["credibility"] == 0.5
    for d, k in ((docs.limit(0), sources), (docs, sources.limit(0))):
        with pytest.raises(Exception, match="no (document|source)"):
            resolve.build_claims(ex, d, k, none).collect()


def test_resolution_abstains(spark):
    issuers = spark.createDataFrame([("I1", "Alpha Holdings"), ("I2", "Alpha Holding"), ("I3", "Beta Motors")], "issuer_id string, name string")
    issuers = issuers.select("*", F.lit("1990").alias("status_valid_from"), F.lit(None).cast("string").alias("status_valid_to"), F.lit("1990").alias("knowledge_time"))
    al = spark.createDataFrame([("BM", "I3", "2000", None), ("AH", "I1", "2000", None), ("AH", "I2", "2000", None)], "surface_form string, target_id string, valid_from string, valid_to string")
    s = spark.createDataFrame([("BM",), ("AH",), ("Alpha Holdings",), ("beta motors",), ("Gamma",)], "surface string")
    got = {r["surface"]: (r["status"], r["target_id"]) for r in resolve.resolve(s, al, issuers, "2010").collect()}
    assert got == {"BM": ("resolved", "I3"), "AH": ("provisional", None), "Alpha Holdings": ("provisional", None), "beta motors": ("resolved", "I3"), "Gamma": ("provisional", None)}


@pytest.mark.parametrize(("ages", "blocked"), [([1, 2, 3], False), ([9, 9, 1, 1], False), ([9, 9, 9, 1], True), ([], True), ([None, None], True), ([None, 1], False)])
def test_macro_gate(spark, ages, blocked):
    day = lambda a: None if a is None else str(datetime.date(2024, 1, 31) - datetime.timedelta(a))
    df = spark.createDataFrame([(day(a),) for a in ages], "end string")
    assert gate.macro_gate(gate.freshness(df, "end", "2024-01-31")).first()["blocked"] == blocked


def test_settings(monkeypatch):
    monkeypatch.setenv("SKEIN_ALPHA", "0.5")
    assert Settings.from_env().alpha == 0.5 and Settings.from_env().accept == 0.92


def test_theme_view(spark):
    """Weak edges, an isolated parent, a child, heads without repeats, prices, and rising themes."""
    day = datetime.date(2024, 1, 30)
    rows = [(i, f"alpha and beta rise, story number {i} of many", day - datetime.timedelta(i % 3), ["A"]) for i in range(6)]
    rows += [(10 + i, f"gamma meets delta in plan {i}{i}", day, ["B", "MACRO:X"]) for i in range(2)] + [(20, "omega alone", None, None), (21, "gamma kid", day, ["B"])]
    found = spark.createDataFrame(rows, "id long, text string, day date, ents array<string>")
    spine = {k: [k] for k in ("alpha", "beta", "gamma", "delta", "omega")}
    prices = spark.createDataFrame([("A", 0.01)], "ent string, chg double")
    got = composites.theme_view(found, spine, "2024-01-30", {"kid": ("gamma", ["kid"])}, ("rise",), ("fall",), prices=prices)
    edges = {(r["a"], r["b"]): (r["w"], r["lift"], r["weak"], r["volume_only"]) for r in got["edges"].collect()}
    assert edges == {("alpha", "beta"): (6, 1.7, False, False), ("delta", "gamma"): (2, 3.3, True, False)}
    nodes = {r["theme"]: r for r in got["nodes"].collect()}
    assert [n for n, r in nodes.items() if r["isolated"]] == ["omega"] and nodes["gamma"]["children"] == ["kid"] and nodes["kid"]["parent"] == "gamma"
    assert nodes["alpha"]["surge"] == round((6 / 7 + 0.5) / 0.5, 2) and nodes["gamma"]["surge"] is None and nodes["omega"]["heat"] == 0.3
    assert nodes["alpha"]["series"][-3:] == [2, 2, 2] and nodes["alpha"]["related"] == ["beta"]
    assert {(r["theme"], r["ent"], r["chg"]) for r in got["entities"].collect()} == {("alpha", "A", 0.01), ("beta", "A", 0.01), ("gamma", "B", None)}
    heads = [r["head"] for r in got["heads"].where("theme = 'alpha'").collect()]
    assert len(heads) == 1 and {r["theme"] for r in got["rising"].collect()} == {"alpha", "beta"}


def test_stories_of_vetted_outlets(spark):
    rows = [(1, "Chip demand rises on memory boom - KBS", "2024-01-01", "A", "KBS"), (2, "Chip demand rises on memory boom", "2024-01-01", "B", "Reuters"), (3, "Chip demand rises on memory boom", "2024-01-01", "C", "A blog")]
    got = composites.stories(spark.createDataFrame(rows, "id long, text string, day string, ent string, outlet string")).collect()
    assert [(r["text"], r["ents"], r["n_src"]) for r in got] == [("Chip demand rises on memory boom", ["A", "B"], 2)]


def test_flow_report_of_planted_blocks(spark):
    """Three blocks that move together, in both halves: found, stable, pure, loaded."""
    rng = np.random.default_rng(2)
    rows, sector = [], []
    shocks = rng.normal(size=(3, 100))
    for i in range(12):
        ret = 0.01 * (shocks[i // 4] + 0.3 * rng.normal(size=100))
        rows += [(f"s{i:02d}", str(datetime.date(2024, 1, 1) + datetime.timedelta(t)), float(x)) for t, x in enumerate(ret)]
        sector.append((f"s{i:02d}", f"sec{i // 4}"))
    rets = spark.createDataFrame(rows, "series string, day string, ret double")
    sectors, tags = spark.createDataFrame(sector, "series string, sector string"), spark.createDataFrame([(s, "ai") for s, _ in sector], "series string, theme string")
    members, clusters = comove.flow_report(rets, sectors, tags, least_names=12)
    rows = clusters.collect()
    assert len(rows) == 3 and all(r["stable"] and r["purity"] == 1.0 and r["ari"] == 1.0 and r["themes"] == ["ai"] and not r["cross_sector"] for r in rows)
    assert members.count() == 12 and members.agg(F.min("loading")).first()[0] > 0.8
    assert comove.flow_report(rets, sectors, least_names=13)[0].count() == 0


def test_yardstick_skips_small_cohorts(spark):
    rows = [(f"s{i}", str(datetime.date(2024, 1, 1) + datetime.timedelta(t)), 100.0 + (t * (i + 3)) % 7) for i in range(4) for t in range(90)]
    bars = spark.createDataFrame(rows, "series string, day string, close double")
    sectors = spark.createDataFrame([(f"s{i}", f"x{i % 2}") for i in range(4)], "series string, sector string")
    r = comove.yardstick(bars, sectors).first()
    assert r["skipped"] and r["gap_full"] is None and not r["stable"]
    history = spark.createDataFrame([(-9.0, -9.0), (9.0, 9.0)], "gap double, cross_mu double")
    r = comove.yardstick(bars, sectors, least_names=4, history=history).first()
    assert not r["skipped"] and (r["gap_pct"], r["cross_mu_pct"]) == (50.0, 50.0)


@pytest.mark.parametrize("top", [3, 120])
def test_emergent_against_all_pairs(spark, monkeypatch, top):
    """The best terms by all their partners, though only some are counted; no pair of kept terms is a row."""
    monkeypatch.setattr(terms, "FIRST", 1)
    monkeypatch.setattr(terms, "HELD", 50)
    random.seed(11)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    docs = [sorted({words[min(59, int(random.expovariate(0.06)))] for _ in range(random.randrange(1, 9))}) for _ in range(120)] + [["alone"]] * 4
    df = collections.Counter(w for x in docs for w in x)
    kept = {w for w, n in df.items() if 3 <= n <= 0.2 * len(docs)}
    pairs = collections.Counter(p for x in docs for p in itertools.combinations([w for w in x if w in kept], 2))
    n_of = collections.Counter(w for p in pairs for w in p)
    best = sorted(kept, key=lambda w: (-n_of[w], -df[w], w))[:top]
    inside = {p: n for p, n in pairs.items() if p[0] in best and p[1] in best}
    degree = collections.Counter(w for p in inside for w in p)
    tokens = spark.createDataFrame([(i, w) for i, x in enumerate(docs) for w in x], "doc_id long, term string")
    nodes, edges = terms.emergent(tokens, len(docs), 3, 0.2, 2, top)
    assert {(r["term"], r["df"], r["degree"]) for r in nodes.collect()} == {(w, df[w], degree[w]) for w in best}
    assert {(r["a"], r["b"], r["w"]) for r in edges.collect()} == {(*p, n) for p, n in inside.items() if n >= 2}
    assert terms.emergent(tokens.limit(0), 0)[0].count() == 0


def written(spark):
    """Bytes that the stages so far have written for shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none = sc._gateway.new_array(sc._jvm.double, 0)
    stages = sc._jsc.sc().statusStore().stageList(sc._jvm.java.util.ArrayList(), False, False, none, sc._jvm.java.util.ArrayList())
    return {(x.stageId(), x.attemptId()): x.shuffleWriteBytes() for x in (stages.apply(i) for i in range(stages.size()))}


def shuffled(spark, do):
    """Bytes shuffled while ``do`` runs."""
    before = written(spark)
    do()
    return sum(n for k, n in written(spark).items() if k not in before)


def test_emergent_pairs_are_not_shuffled(spark):
    """60 texts of 700 kept terms have 15 million pairs, some 7 million of them different; their terms are 42,000."""
    random.seed(12)
    rows = [(i, w) for i in range(60) for w in random.sample(range(4000), 700)]
    tokens = spark.createDataFrame(rows, "doc_id long, term long").select("doc_id", F.concat(F.lit("t"), "term").alias("term")).cache()
    tokens.count()
    assert shuffled(spark, lambda: terms.emergent(tokens, 60, 2, 0.5)[1].count()) < 12_000_000


def test_emergent_candidates_meet_a_share_of_partners(spark, monkeypatch):
    """1,600 terms of eight topics could be among the best by their bound; they don't go to each share of their partners, and the best are those by all pairs."""
    for name, value in {"FIRST": 2, "HELD": 4_000, "SEEN": 50, "DEVIATIONS": 4}.items():
        monkeypatch.setattr(terms, name, value, raising=False)
    random.seed(16)
    docs = [{200 * (i % 8) + k for k in random.sample(range(200), 150)} for i in range(320)]
    for hub in range(1600, 1630):
        for i in random.sample(range(320), 40):
            docs[i].add(hub)
    df, met = collections.Counter(w for x in docs for w in x), collections.defaultdict(set)
    for x in docs:
        for w in x:
            met[w] |= x
    tokens = spark.createDataFrame([(i, f"t{w}") for i, x in enumerate(docs) for w in x], "doc_id long, term string").cache()
    tokens.count()
    got = []
    moved = shuffled(spark, lambda: got.extend(terms.emergent(tokens, 320, 2, 0.5, top=20)[0].collect()))
    want = sorted(met, key=lambda w: (-len(met[w]), -df[w], f"t{w}"))[:20]
    assert {r["term"] for r in got} == {f"t{w}" for w in want}
    assert moved < 1_500_000


def test_story_pairs_of_blocks(spark, monkeypatch):
    """Blocks and tiles find the same pairs as all comparisons, rare bigrams and Hangul included, and a forest connects what they do."""
    monkeypatch.setattr(neardup, "BLOCK", 20)
    monkeypatch.setattr(neardup, "TILE", 7)
    random.seed(13)
    words = ["profit", "rises", "memory", "court", "recall", "반도체", "수출이", "늘었다", "금리를", "z9q", "힣가"]
    rows = [(i, f"2024-03-0{1 + i % 2}", " ".join(random.sample(words, 5)), random.choice([None, "", "A", "B"])) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, day string, text string, ent string")
    want = {}
    for x, y in itertools.combinations(rows, 2):
        both = len(grams(x[2]) & grams(y[2]))
        if x[1] == y[1] and (x[3] == y[3] or not x[3] or not y[3]) and same_story(x[2], y[2], 0.6):
            want[x[0], y[0]] = both
    got = neardup.story_pairs(df, overlap=0.6).collect()
    assert len(got) == len(want) and {(r["a"], r["b"]): r["n_shared"] for r in got} == want
    forest = neardup._alike(neardup._of_bigrams(df, 8), False, 8, 0.6, forest=True).select("a", "b").collect()
    assert {(r["a"], r["b"]) for r in forest} <= set(want) and len(forest) < len(want)

    def parts(links):
        root = list(range(120))
        for a, b in links:
            old, new = sorted((root[a], root[b]), reverse=True)
            root = [new if x == old else x for x in root]
        return root

    assert parts(forest) == parts(want)


def test_story_candidates_are_not_shuffled(spark):
    """1,500 texts of the same syllables: every two are candidates by their bigrams, few are alike."""
    random.seed(14)
    rows = [(i, "2024-03-01", "".join(random.choice("abcdefghijkl") for _ in range(60)), None) for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, day string, text string, ent string")
    assert shuffled(spark, lambda: neardup.story_pairs(df, overlap=0.9).count()) < 1_500_000


def test_stories_move_no_texts(spark):
    """300 texts of 8,000 characters in two stories with one beginning: the story's first is found among whole texts, few of which are shuffled."""
    random.seed(17)
    words = ["".join(random.choices("abcdefghijklmnopqrst", k=8)) for _ in range(1000)]
    rows = [(i, "2024-03-01", "the same beginning " + " ".join(random.sample(words, 890)) if i % 2 else f"0{i:03} " + "".join(random.choices("0123456789", k=8000)), None) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, day string, text string, ent string")
    got = []
    moved = shuffled(spark, lambda: got.extend(neardup.collapse_stories(df, overlap=0.9).collect()))
    assert {(r["text"], r["n_src"]) for r in got} == {(min(t for i, _, t, _ in rows if i % 2 == k), 150) for k in (0, 1)}
    assert moved < 1_200_000


def test_sets_go_to_their_part_once(spark, monkeypatch):
    """60 near copies of a text of 3,000 words have 1,770 pairs; no pair brings its sets along. Large parts in blocks give the same."""
    random.seed(15)
    base = [f"w{i}" for i in range(3000)]
    rows = [(i, " ".join([*random.sample(base, 2950), f"x{i}"])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {(i, j): len(x & y) / len(x | y) for (i, x), (j, y) in itertools.combinations([(i, set(t.split())) for i, t in rows], 2)}
    got = []
    assert shuffled(spark, lambda: got.extend(neardup.jaccard_pairs(df).collect())) < 12_000_000
    assert {(r["a"], r["b"]): r["jaccard"] for r in got} == want
    monkeypatch.setattr(neardup, "CELL", 7)
    assert {(r["a"], r["b"]): r["jaccard"] for r in neardup.jaccard_pairs(df).collect()} == want


def plain_ranks(links, seeds):
    """Both graphs' scores of every node from links (src, dst, g, w), by whole rounds."""
    best, naive = {}, {}
    for i, (src, dst, g, w) in enumerate(links):
        key = src, dst, i if g is None else ("g", g)
        best[key] = max(best.get(key, 0), w)
        if src and dst:
            naive[src, dst] = naive.get((src, dst), 0) + 1
    credible = {}
    for (src, dst, _), w in best.items():
        credible[src, dst] = credible.get((src, dst), 0) + w
    return [plain_pagerank([(a, b, w) for (a, b), w in e.items()], s, rounds=300) for e, s in ((naive, None), (credible, seeds))]


@pytest.mark.parametrize("folded", [7, 1 << 20])
@pytest.mark.parametrize(("cycle", "seeds"), [(False, ["s1", "s4", "absent"]), (True, ["s1", "p3"]), (False, ["absent"])])
def test_ranks_of_claims(spark, monkeypatch, folded, cycle, seeds):
    from skein.operators import claimgraph

    monkeypatch.setattr(claimgraph, "FOLDED", folded)
    rng = random.Random(5)
    links = [(f"s{rng.randrange(6)}", f"p{rng.randrange(9)}", rng.randrange(4), rng.choice([0.1, 0.5, 1.0])) for _ in range(150)]
    links += [(f"p{rng.randrange(9)}", f"c{rng.randrange(12)}", None, rng.choice([0.1, 0.5, 1.0])) for _ in range(60)]
    # copies of a link without a group add up; an end without a name is in one graph only
    links += [("p1", "c1", None, 0.5)] * 30 + [("", "p2", 1, 0.5), ("s2", "p5", 9, 0.1)] + [("s2", "p5", 9, 0.7)] * 20
    links += [("c1", "s1", None, 1.0), ("c2", "p1", None, 0.2)] if cycle else []
    df = spark.createDataFrame(links, "src string, dst string, g long, w double").repartition(5)
    got = {r["node"]: r for r in claimgraph.ranks(df, spark.createDataFrame([(x,) for x in seeds], "node string")).collect()}
    naive, credible = plain_ranks(links, seeds)
    assert set(got) == {b for _, b, _, _ in links}
    for x, r in got.items():
        assert abs(r["ppr_naive"] - naive[x]) < 1e-8 and abs(r["ppr_credible"] - credible[x]) < 1e-8
    assert claimgraph.ranks(df, spark.createDataFrame([("s1",)], "node string"), most_nodes=5) is None


def test_ranks_of_claims_pass_over_edges_as_often_as_paths_are_long(spark):
    from skein.operators import claimgraph

    df = spark.createDataFrame([(f"s{k % 5}", f"p{k % 7}", k, 0.5) for k in range(40)] + [(f"p{k % 7}", f"c{k}", None, 0.5) for k in range(20)], "src string, dst string, g long, w double")
    seeds = spark.createDataFrame([("s1",)], "node string")
    jobs = lambda most: jobs_of(spark, lambda: claimgraph.ranks(df, seeds, tolerance=0, most=most).collect())
    assert jobs(40) == jobs(2)


def jobs_of(spark, run):
    """Number of jobs that a function starts."""
    spark.sparkContext.setJobGroup(group := uuid.uuid4().hex, "")
    try:
        run()
    finally:
        spark.sparkContext._jsc.sc().clearJobGroup()
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


@pytest.mark.parametrize("most_links", [0, None])
def test_standing(spark, most_links):
    """In one task and by rounds; each end is looked at after all that come before it."""
    rng = random.Random(8)
    pairs = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(110)})
    want = {}
    for x in sorted({x for p in pairs for x in p}):
        want[x] = not any(want[a] for a, b in pairs if b == x)
    got = neardup.standing(spark.createDataFrame(pairs, "a long, b long"), most_links=most_links).collect()
    assert len(got) == len(want) and {r["id"]: r["stays"] for r in got} == want
    assert neardup.standing(spark.createDataFrame([], "a long, b long"), most_links=most_links).count() == 0


def test_standing_takes_no_rounds_for_long_chains(spark):
    chain = lambda n: spark.createDataFrame([(k, k + 1) for k in range(n)], "a long, b long")
    few, many = (jobs_of(spark, lambda n=n: neardup.standing(chain(n)).collect()) for n in (2, 40))
    assert few == many


def test_leaders_keep_copies_and_texts_without_words(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "!"), (3, "e d c b a"), (4, None), (5, "!"), (6, "x")], "doc_id long, text string")
    assert sorted(map(tuple, neardup.leaders(docs).collect())) == [(1, 1), (2, 2), (3, 1), (4, 4), (5, 5), (6, 6)]
