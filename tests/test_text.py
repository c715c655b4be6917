"""Tokens, stems, identifiers, and traps of the text model."""

import re

from pyspark.sql import functions as F

from granary.config import Config, candidate_width, dump_config, load_config, set_value
from granary.functions import text as T
from granary.operators import bm25
from granary.operators.chunking import chunk_text


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column).first()[0]


def test_identifier_parts(spark):
    parts = lambda t: one(spark, t, T.identifier_parts("x"))
    assert parts("verifyStripeWebhook") == ["verify", "Stripe", "Webhook"]
    assert parts("HTTPSConnection") == ["HTTPS", "Connection"]
    assert parts("__a__bC_") == ["a", "b", "C"]


def test_tokens_hold_whole_parts_and_stems(spark):
    got = one(spark, "verifyStripeWebhook tokens x déjà_vu", T.tokens("x"))
    assert got == ["verifystripewebhook", "verify", "stripe", "webhook", "tokens", "_vu", "vu", "token"]
    assert one(spark, "", T.tokens("x")) == []


def test_stems(spark):
    stem = lambda t: one(spark, t, T.stem("x"))
    cases = {"bodies": "body", "weddings": "wedding", "wedding": "wedd", "verified": "verifi", "verify": "verify", "class": "class",
             "dies": "dies", "tokens": "token", "signatures": "signatur", "glasses": "glasse"}
    assert {t: stem(t) for t in cases} == cases


def test_queries_are_stemmed_twice_and_lose_stop_words_after(spark):
    q = bm25.analyse_queries(spark.createDataFrame([(1, "how are the weddings and something"), (2, None), (3, "日本語")], "query_id long, query string"))
    rows = {r.query_id: r for r in q.collect()}
    assert rows[1].content == ["wedding", "someth", "wedd"]
    assert rows[2].content == [] and rows[2].ids == [] and rows[3].content == []


def test_identifiers(spark):
    got = one(spark, "see config.json, 1.5, STRIPE_KEY, fooBar, internationalization and plain", T.identifiers("x"))
    assert set(got) == {"STRIPE_KEY", "fooBar", "internationalization", "config.json"}


def test_blank_counts_nbsp_and_bom(spark):
    assert one(spark, "  ﻿\n", T.is_blank("x")) and one(spark, None, T.is_blank("x")) and not one(spark, " a ", T.is_blank("x"))


def test_coverage_is_zero_without_terms(spark):
    row = spark.createDataFrame([([], ["a"]), (["a", "b"], ["a"])], "t array<string>, c array<string>")
    assert [r[0] for r in row.select(T.token_coverage("t", "c")).collect()] == [0.0, 0.5]


def test_chunks_of_lines():
    code = "\n".join(f"line {i}" if i % 20 else "" for i in range(200))
    chunks = chunk_text(code)
    assert chunks[0][1] == 1 and chunks[-1][2] == 200
    assert all(b[1] <= a[2] + 1 and b[1] > a[1] for a, b in zip(chunks, chunks[1:]))
    plain = chunk_text("\n".join("x" for _ in range(150)))
    assert [(a, b) for _, a, b in plain] == [(1, 80), (73, 150)]
    assert chunk_text("\n  \n﻿") == [] and chunk_text(None) == [] and chunk_text("") == []
    assert len(chunk_text("y" * 9000)[0][0]) == 6000


def test_settings():
    assert load_config("not json") == Config() and load_config(None).top_k == 5
    c = load_config('{"topK": 7, "unknown": 1}')
    assert c.top_k == 7 and c.extra == {"unknown": 1} and load_config(dump_config(c)) == c
    assert set_value(c, "ragEnabled", "yes").rag_enabled is False and set_value(c, "excludePatterns", "a").exclude_patterns == ("a",)
    assert [candidate_width(k) for k in (1, 10, 50)] == [40, 80, 200]
    try:
        set_value(c, "nope", 1)
        raise AssertionError
    except KeyError:
        pass


def test_both_tokenizers_agree(spark):
    import random

    rng = random.Random(1)
    texts = ["".join(rng.choice("abcXYZ_19 s.iengd") for _ in range(80)) for _ in range(80)] + ["", "tokens bodies HTTPServers"]
    df = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    rows = bm25.analyse_chunks(df).join(df, "chunk_id").select("tokens", T.tokens("text").alias("t")).collect()
    assert len(rows) == len(texts) and all(r.tokens == r.t for r in rows)


def test_stop_words_are_distinct():
    assert len(set(T.STOPWORDS)) == 153 and all(re.fullmatch("[a-z]+", w) for w in T.STOPWORDS)


def test_hash_bucket_matches_python(spark):
    import hashlib

    for word in ("token", "webhook", "a_b"):
        h = hashlib.md5(word.encode()).digest()
        row = spark.range(1).select(T.hash_bucket(F.lit(word)), T.hash_sign(F.lit(word))).first()
        assert tuple(row) == (int.from_bytes(h[:4], "little") % 384, 1.0 if h[4] & 1 else -1.0)


def test_queries_are_analysed_as_the_columns_say(spark):
    texts = ["how does getUserName work?", "see config.yaml and v1.2.3 or 1.2.3", "STRIPE_KEY the themselves _ a1 internationalisation", "", "Déjà_vu weddings verified", "the HTTPServer2 http.server x.y a.b1"]
    df = spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")
    got = {r.query_id: (r.content, r.ids) for r in bm25.analyse_queries(df).collect()}
    want = df.select("query_id", T.content_terms(T.query_terms("query")).alias("content"), T.identifiers("query").alias("ids")).collect()
    assert got == {r.query_id: (r.content, r.ids) for r in want}
