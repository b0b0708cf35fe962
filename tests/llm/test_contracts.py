"""Each opN query against a plain version, on whole tables."""

import hashlib

import numpy as np
import pytest

from skein.llm import queries as Q
from tests.llm import brute


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_op1(spark, sf):
    turns = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    planted = "\\### Assistant: </turn> ok"
    want = brute.chats([*turns, (-7, 0, "user", planted), (-7, 1, "assistant", planted)])
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in rows(Q.op1_chat_format(spark, sf))}
    assert got == want


def test_op2(spark, sf, docs):
    got = rows(Q.op2_simhash_dedup(spark, sf))
    prints = {d: brute.simhash(t) for d, t in docs.items()}
    assert {r["doc_id"]: r["fingerprint"] for r in got} == {d: f"{p:016x}" for d, p in prints.items()}
    assert {r["doc_id"]: r["component_id"] for r in got} == brute.groups(prints)


def test_op3_base(spark, sf, docs):
    got = rows(Q.op3_quality_rules(spark, sf))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert {r["doc_id"]: tuple(r[n] for n in names) for r in got} == {d: brute.base_quality(t) for d, t in docs.items()}
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_op4(spark, sf, docs):
    import sentencepiece
    from public_tokenizers import path

    sp = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    want = {}
    for d, t in docs.items():
        ids = sp.encode(t or "")
        want[d] = (len(ids), brute.sha(",".join(map(str, ids))), brute.sha(sp.decode(ids)))
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows(Q.op4_sentencepiece(spark, sf))} == want


def test_op5(spark, sf, docs):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path("word_bpe_49k.json"))
    want, start = {}, 0
    for d in sorted(docs):
        ids = [*t.encode(docs[d] or "", add_special_tokens=False).ids, 2]
        want[d] = (start, len(ids), brute.crc(ids))
        start += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows(Q.op5_arrow_tokens(spark, sf))} == want


def test_op6_base(spark, sf, docs):
    for r in rows(Q.op6_secret_scan(spark, sf)):
        want = brute.base_spans(docs[r["doc_id"]])
        told = ",".join(f"{k}:{a}:{b}" for a, _, k, b in want)
        assert r["base_sha256"] == brute.sha(told)
        assert [r[f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(x[2] == k for x in want) for k in ("assign", "access", "hex")]
        assert not told or set(told.split(",")) <= set(r["spans"].split(","))


def test_op7(spark, sf, docs):
    ids = sorted(docs)
    texts = [docs[d] or "" for d in ids]
    changed = brute.edited(texts)
    got = {r["doc_id"]: r for r in rows(Q.op7_fingerprints(spark, sf))}
    off = []
    for i, d in enumerate(ids):
        r = got.pop(d)
        assert (r["n_chars"], r["edited_sha256"]) == (len(texts[i]), brute.sha(changed[i]))
        off += [r["near_edited"] - brute.jaccard(texts[i], changed[i]), r["near_next"] - brute.jaccard(texts[i], texts[(i + 1) % len(ids)])]
        assert (r["fingerprint"] == r["edited_fingerprint"]) >= (texts[i] == changed[i])
    assert not got
    assert abs(np.mean(off)) < 0.01 and np.max(np.abs(off)) < 0.2 and np.std(off) < 0.04


def test_op8(spark, sf):
    pages = {r["page_id"]: (r["html"] or "").encode() for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    first, want = {}, {}
    for p in sorted(pages):
        digest = hashlib.sha256(pages[p]).hexdigest()
        to = first.setdefault(digest, p) if len(pages[p]) >= 100 else p
        want[p] = (len(pages[p]), digest, "response" if to == p else "revisit", None if to == p else to)
    assert {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows(Q.op8_warc(spark, sf))} == want


def test_op9(spark, sf, docs):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    ids = {d: [*t.encode(x or "", add_special_tokens=False).ids, 1] for d, x in docs.items()}
    got = rows(Q.op9_packing(spark, sf))
    covered, sequences = {}, {}
    for r in got:
        assert r["doc_tokens"] == len(ids[r["doc_id"]])
        assert r["ids_crc32"] == brute.crc(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]])
        covered.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert covered.keys() == ids.keys()
    for d, parts in covered.items():
        at = 0
        for start, n in sorted(parts):
            assert start == at and n > 0
            at += n
        assert at == len(ids[d])
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
        padding += 2048 - at
    assert padding <= 2048 * 4  # a last sequence for each of the shards


@pytest.mark.parametrize("table", ["pages"])
def test_op10(spark, sf, table):
    for r in spark.read.parquet(f"{sf}/{table}.parquet").join(Q.op10_url_filter(spark, sf), "page_id").collect():
        host, path = brute.url(r["url"])
        fits = [x for x in Q.RULES if (host == (h := x.text.split("/")[0]) or host.endswith("." + h)) and path.startswith("/" + x.text.split("/", 1)[1])]
        rule = max(fits, key=lambda x: len(x.text), default=None)
        listed = bool({"adult", "spam", "pills", "ads", "casino", "bets"} & set(__import__("re").split("[.-]", host)))
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule and rule.text, rule.verdict if rule else "block" if listed else "allow")
