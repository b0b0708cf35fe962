"""The pipeline's near-duplicates against all pairs of exact five-word shingle sets."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest

import corpus_pipeline
from skein.llm import simhash_groups


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def groups(docs, threshold=0.8):
    """{id: smallest id reachable} over all pairs."""
    sets, of = {d: shingles(t) for d, t in docs.items()}, {d: d for d in docs}

    def top(d):
        while of[d] != d:
            d = of[d]
        return d

    posted, shared = defaultdict(list), Counter()
    for d in sorted(sets):
        for s in sets[d] or {()}:
            posted[s].append(d)
    for p in posted.values():
        shared.update(combinations(p, 2))
    for (a, b), n in shared.items():
        if n >= threshold * (max(1, len(sets[a])) + max(1, len(sets[b])) - n) - 1e-9:
            x, y = sorted((top(a), top(b)))
            of[y] = x
    return {d: top(d) for d in docs}


def test_stage_on_a_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = set(groups({r["doc_id"]: r["text"] for r in docs.collect()}).values())
    got = corpus_pipeline.dedup_stage(spark, docs, sf)
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("bound", [0, 1 << 20])
def test_chains_and_large_groups(spark, monkeypatch, bound):
    """Edits at and around 0.8, a chain, a large group, empty texts, null ids; every pair is decided in one task and in rounds."""
    monkeypatch.setattr(simhash_groups, "BOUND", bound)
    monkeypatch.setattr(simhash_groups, "PIVOTS", 2)
    monkeypatch.setattr(simhash_groups, "SALTED", 8)
    monkeypatch.setattr(simhash_groups, "SUBTREE", 1 << 20 if bound else 4)
    rng = random.Random(3)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(120)] for _ in range(4)]
    texts = [None, "", " \n", "one two", "one two", "One  two", "three"]
    for words in base:
        for _ in range(12):
            edited = list(words)
            for at in rng.sample(range(120), rng.randrange(1, 5)):
                edited[at] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(edited))
    chain = list(base[0])
    for at in range(3, 120, 12):
        chain[at] = f"y{at}"
        texts.append(" ".join(chain))
    docs = {i: t for i, t in enumerate(texts)}
    df = spark.createDataFrame([*docs.items(), (None, "no id"), (None, "no id")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash_groups.alike_groups(df).collect()}
    assert got == groups(docs)
    assert simhash_groups.keep_one(df).where("doc_id is null").count() == 2 and simhash_groups.keep_one(df.limit(0)).count() == 0
