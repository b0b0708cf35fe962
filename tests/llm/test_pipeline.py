"""The pipeline's stages against plain versions, each on the input it really gets."""

from pyspark.sql import functions as F

import corpus_pipeline
from skein.llm import quality
from tests.llm import brute
from tests.llm.test_simhash_groups import groups


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, got = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()} if "text" in docs.columns else {}
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = docs.collect()
        got[name] = after
        if name != "packing":
            assert docs.columns == columns
        if name == "quality":
            labels = spark.read.parquet(f"{sf}/labels.parquet")
            kept = {r["doc_id"] for r in quality.quality_rules(spark.read.parquet(f"{sf}/documents.parquet"), labels).where("kept").collect()}
            assert {r["doc_id"] for r in after} == kept and not any(brute.base_quality(r["text"])[-1] for r in after)
        elif name == "dedup":
            assert sorted(r["doc_id"] for r in after) == sorted(set(groups(before).values()))
        elif name == "secrets":
            assert {r["doc_id"] for r in after} == before.keys()
            for r in after:
                assert not brute.base_spans(r["text"]) and r["n_chars"] == len(r["text"])
                if "[SECRET]" not in r["text"] and "[EXAMPLE]" not in r["text"]:
                    assert r["text"] == before[r["doc_id"]]
        else:
            assert {r["doc_id"] for r in after} == before.keys()
            assert sum(r["length"] for r in after) == sum(r["doc_tokens"] for r in after if r["start"] == 0)
    again = corpus_pipeline.run(spark, sf).collect()
    key = lambda rows: sorted((r["doc_id"], r["start"], r["length"]) for r in rows)
    assert sum(n for *_, n in key(again)) == sum(n for *_, n in key(got["packing"]))


def test_stages_on_odd_rows(spark, sf):
    """Null and repeated ids, null and empty texts, clashing columns, and empty tables."""
    good = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in spark.read.parquet(f"{sf}/documents.parquet").where("n_chars between 500 and 3000").orderBy("doc_id").limit(40).collect()]
    rows = [*good, *[(None, f"password=abcdefgh{i}ijkl {t}", x, y, n) for i, (_, t, x, y, n) in enumerate(good[:5])], *good[:3], (None, None, None, None, None), (10**6, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0
        clash = docs.select("*", *[F.lit("clash").alias(c) for c in ("_gone", "gone", "row", "rid", "c", "h", "ids", "score")])
        out = stage(spark, clash, sf)
        if name == "packing":
            assert sum(r["doc_tokens"] for r in out.where("start = 0").collect()) == sum(r["length"] for r in out.collect())
            continue
        assert out.columns == clash.columns
        if name == "secrets":
            assert out.count() == len(rows) and out.where("text like '%password=%'").count() == 0
        elif name == "dedup":
            assert out.where("doc_id is null").count() == 6 and out.where("doc_id is not null").count() == out.where("doc_id is not null").select("doc_id").distinct().count()
