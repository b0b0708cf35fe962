"""Readers of landed files, writers of artifacts, and the incremental path."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from skein import schemas
from skein.operators import resolve
from skein.sources import artifacts, landed
from skein.streaming import themeday


@pytest.fixture
def put(tmp_path):
    def write(name, value):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        raw = value if isinstance(value, str) else json.dumps(value)
        (gzip.open(p, "wt") if name.endswith(".gz") else p.open("w")).write(raw) if not name.endswith(".gz") else p.write_bytes(gzip.compress(raw.encode()))
        return str(p)

    return write


def test_corpus_and_claims(spark, put, tmp_path):
    put("corpus/a.json", [{"doc_id": "d1", "source_id": "s", "text": "t", "event_time": "2024-01-01T00:00:00"}, {"doc_id": "d2", "source_id": "s", "lang": "en", "text": "t", "event_time": "x", "ingest_time": "y"}])
    put("corpus/b.json", {"doc_id": "d3", "source_id": "s", "text": "t", "event_time": "z"})
    docs = landed.corpus(spark, str(tmp_path / "corpus"))
    assert sorted(tuple(r) for r in docs.select("doc_id", "lang", "ingest_time").collect()) == [("d1", "ko", "2024-01-01T00:00:00"), ("d2", "en", "y"), ("d3", "ko", "z")]
    put("ex/d1.json", {"claims": [{"subject_surface": "Acme", "relation": "supplies", "object_text": "Unknown"}, {"subject_surface": "Acme", "relation": "sentiment", "stance": "bullish"}], "elevated_entities": ["Acme"]})
    ex = landed.extractions(spark, str(tmp_path / "ex"), docs)
    assert {r["doc_id"]: len(r["claims"]) for r in ex.collect()} == {"d1": 2, "d2": 0, "d3": 0}
    res = spark.createDataFrame([("Acme", "I1")], "surface string, target_id string")
    sources = spark.createDataFrame([("s", 0.6)], "source_id string, credibility double")
    got = resolve.build_claims(ex, docs, sources, res).orderBy("claim_id").collect()
    assert [(r["claim_id"], r["subject_id"], r["object_id"], r["stance"], r["span_start"]) for r in got] == [("d1#c0", "I1", "provisional::Unknown", "neutral", -1), ("d1#c1", "I1", "", "bullish", -1)]


def test_master(spark, put):
    m = landed.master(spark, put("m.json", {"issuers": [{"issuer_id": "I", "name": "N"}], "securities": [], "listings": [], "aliases": [{"surface_form": "x", "target_id": "I"}], "must_not_link": [["A", "B"]]}))
    assert m["issuers"].count() == 1 and m["listings"].count() == 0 and tuple(m["must_not_link"].first()) == ("A", "B")


def test_submissions(spark, put):
    p = put("s.json", {"cik": "320", "name": "Co", "formerNames": [{"name": "Old", "from": "2000-01-01T00:00:00.000Z", "to": "2008-09-01T00:00:00.000Z"}], "filings": {"recent": {"accessionNumber": ["a1", "a2", "a3"], "form": ["8-K", "10-K", "8-K"], "filingDate": ["2024-01-02", "2024-01-01", "2023-01-01"], "acceptanceDateTime": ["2024-01-02T10:00:00.000Z", "", None], "items": ["1.03", "", "2.02"]}}})
    got = landed.submissions(spark, p).collect()
    assert [(r["doc_id"], r["event_time"]) for r in got] == [("edgar_0000000320_a1", "2024-01-02T10:00:00"), ("edgar_0000000320_a3", "2023-01-01T00:00:00")]
    assert landed.sectors(spark, p).count() == 0
    q = put("t.json", {"cik": "9", "sic": "9021", "sicDescription": "x"})
    assert tuple(landed.sectors(spark, q).first()) == ("CIK0000000009", "9021", "x", "Public")
    assert tuple(landed.former_names(spark, p).first()) == ("Old", "CIK0000000320", "2000-01-01T00:00:00", "2008-09-01T00:00:00")


def test_xml(spark, put):
    rss = put("n.xml", "<rss><channel><item><title>T1</title><link>http://a/1</link><description>&lt;b&gt;S&lt;/b&gt;</description><pubDate>Mon, 05 Feb 2024 15:04:05 GMT</pubDate><source url='u'>Daily</source></item></channel></rss>")
    r = landed.rss(spark, rss).first()
    assert (r["text"], r["outlet"], r["event_time"]) == ("T1. S", "Daily", "2024-02-05T15:04:05") and r["doc_id"].startswith("news_")
    many = "".join(f"<item><title>T{i} &amp;amp; more</title><link>http://a/{i}</link><description>&lt;p&gt;S{i} &amp;quot;x&amp;quot;</description></item>" for i in range(5)) + "<item><title> </title><link>http://a/9</link></item>"
    got = landed.rss(spark, put("m.xml", f"<rss><channel>{many}</channel></rss>"), max_items=3).collect()
    assert sorted((r["text"], r["outlet"]) for r in got) == [(f'T{i} &amp; more. S{i} "x"', "unknown") for i in range(3)]
    assert landed.rss(spark, put("m2.xml", f"<rss><channel>{many}</channel></rss>"), max_items=None).count() == 5
    track = landed.emitted(landed.rss(spark, rss), "2024-03-01T00:00:00", F.lit("MACRO:GC=F"), "macro", F.lit("gold price")).first()
    assert (track["source_id"], track["_cred_class"], track["_subject_id"], track["event_time"], track["ingest_time"]) == ("news::daily", "community", "MACRO:GC=F", "2024-02-05T15:04:05", "2024-03-01T00:00:00")
    corp = put("c.xml", "<result><list><corp_code>1</corp_code><corp_name>A</corp_name><stock_code>005930</stock_code></list><list><corp_code>2</corp_code><corp_name>B</corp_name><stock_code> </stock_code></list></result>")
    assert [r["stock_code"] for r in landed.corps(spark, corp).collect()] == ["005930"]


def test_news_json_history_ratings(spark, put):
    n = landed.news_json(spark, put("n.json", {"items": [{"title": "<b>A</b>", "originallink": "https://www.mk.co.kr/1", "description": "d", "pubDate": "Tue, 06 Feb 2024 01:02:03 +0900"}]}), {"mk.co.kr": "MK"}).first()
    assert (n["outlet"], n["text"], n["event_time"]) == ("MK", "A. d", "2024-02-06T01:02:03")
    h = landed.history(spark, put("h.json.gz", {"as_of": "x", "tickers": {"AAA": {"sector": "S", "closes": [1.0, 2.0], "dates": ["2024-01-01", "2024-01-02"]}}}))
    assert [(str(r["day"]), r["close"]) for r in h.orderBy("day").collect()] == [("2024-01-01", 1.0), ("2024-01-02", 2.0)]
    r = landed.ratings(spark, put("r.json", [{"issuer_id": "I", "consensus": {"buy": 2}, "changes": [{"date": f"2024-01-{d:02d}"} for d in range(1, 10)]}, {"issuer_id": "J", "consensus": {}}])).collect()
    assert [x["issuer_id"] for x in r] == ["I"] and [c["date"] for c in r[0]["changes"]] == [f"2024-01-{d:02d}" for d in range(9, 3, -1)]


def test_constituents_and_subthemes(spark, put):
    sp, nq = put("sp.csv", "Symbol,Name\nBRK.B,x\nAAPL,y\n"), put("nq.csv", "Symbol,Name\naapl,y\nZZZ,z\n")
    ids = put("t.json", '{"ticker": "BRK-B", "cik_str": 1067983}\n{"ticker": "AAPL", "cik_str": 320193}\n')
    got = {r["issuer_id"]: r["memberships"] for r in landed.constituents(spark, {"S&P500": sp, "NASDAQ100": nq}, ids).collect()}
    assert got == {"CIK0001067983": ["S&P500"], "CIK0000320193": ["S&P500", "NASDAQ100"]}
    kids = landed.subthemes(spark, put("sub.json", {"_note": "x", "ai": [{"id": "llm", "label": "LLM", "keywords": ["LLM"]}], "zz": [{"id": "q", "label": "Q", "keywords": []}]}), ["ai"]).collect()
    assert [(r["theme_id"], r["parent_id"], r["keywords"]) for r in kids] == [("llm", "ai", ["LLM"])]


def test_snapshot_aliases(spark):
    df = spark.createDataFrame([(5930, 1.5)], "Code int, ChagesRatio double")
    r = landed.snapshot(df, {"code": ("Code", "Symbol"), "chg": ("ChangesRatio", "ChagesRatio"), "cap": ("Marcap",)}).first()
    assert (r["code"], r["chg"]) == ("005930", 0.015)


def test_backup_round_trip(spark, tmp_path):
    t = spark.createDataFrame([("s1", "n", "t", "filing", 0.92, True)], schemas.SOURCE)
    artifacts.dump({"sources": t}, str(tmp_path / "b"))
    assert artifacts.restore(spark, str(tmp_path / "b"), {"sources": schemas.SOURCE})["sources"].collect() == t.collect()
    with pytest.raises(PermissionError):
        artifacts.reload(spark, str(tmp_path / "b"), str(tmp_path / "live"), {"sources": schemas.SOURCE})
    for _ in range(2):
        assert artifacts.reload(spark, str(tmp_path / "b"), str(tmp_path / "live"), {"sources": schemas.SOURCE}, allowed=True) == {"sources": 1}
    artifacts.snapshot(t, str(tmp_path / "snap"), "2024-01-01T00:00:00")
    artifacts.snapshot(t.withColumn("name", F.lit("new")), str(tmp_path / "snap"), "2024-01-01")
    assert [r["name"] for r in spark.read.parquet(str(tmp_path / "snap")).collect()] == ["new"]


def test_incremental_days(spark, put, tmp_path):
    row = lambda i, t, d: json.dumps({"doc_id": i, "source_id": "s", "lang": "en", "text": t, "event_time": d, "ingest_time": d})
    put("in/1.json", "\n".join([row("a", "AI chip", "2024-01-01T05:00:00"), row("a", "AI chip", "2024-01-01T05:00:00"), row("b", "mail", "2024-01-01T06:00:00")]))
    tags, out, ck = {"ai": ["AI"]}, str(tmp_path / "out"), str(tmp_path / "ck")
    run = lambda: themeday.upsert_days(themeday.landed(spark, str(tmp_path / "in"), schemas.DOCUMENT), out, ck, tags).awaitTermination(60)
    run()
    assert [(r["theme"], str(r["day"]), r["count"]) for r in themeday.read_days(spark, out).collect()] == [("ai", "2024-01-01", 1)]
    put("in/2.json", row("c", "AI again", "2024-01-01T09:00:00"))
    run()
    run()
    assert [(r["theme"], r["count"]) for r in themeday.read_days(spark, out).collect()] == [("ai", 2)]
    put("in/3.json", row("d", "AI on another day", "2024-01-02T09:00:00"))
    run()
    assert sorted((str(r["day"]), r["count"]) for r in themeday.read_days(spark, out).collect()) == [("2024-01-01", 2), ("2024-01-02", 1)]
    # one folder for each day, whatever the number of batches
    assert len([p for p in (tmp_path / "out").iterdir() if p.name.startswith("day=")]) == 2
