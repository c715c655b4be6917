"""BM25, ranking, gate, diversity, search and the stored index on small fixtures."""

import math
import sqlite3

import pytest
from pyspark.sql import functions as F

from granary.config import Config
from granary.operators import bm25, inject, ranking, vector
from granary.plans import search
from granary.plans.index import RetrievalIndex
from granary.sources import extract, files

DOCS = {
    "docs/deployment.md": "# Deployment\nRoll back a deployment by pinning the earlier release.\nThe rollback keeps the database.",
    "docs/onboarding.md": "# Onboarding\nNew people read the handbook and meet the team.",
    "src/auth/session.ts": "export function sessionTokenLifetime() {\n  // session tokens last for twelve hours\n  return SESSION_TTL_HOURS * 3600;\n}",
    "src/payments/webhooks.ts": "export function verifyStripeWebhook(sig) {\n  const s = process.env.STRIPE_WEBHOOK_SECRET;\n  return check(sig, s);\n}",
}


@pytest.fixture(scope="module")
def tables(spark):
    chunks = spark.createDataFrame(
        [(i + 1, i + 1, t, 1, t.count("\n") + 1) for i, t in enumerate(DOCS.values())] + [(9, 1, None, None, None)],
        "chunk_id long, file_id long, text string, start_line int, end_line int",
    )
    return chunks, spark.createDataFrame([(i + 1, p) for i, p in enumerate(DOCS)], "file_id long, path string")


QUESTIONS = [
    (1, "how are stripe webhook signatures verified?"),
    (2, "what does verifyStripeWebhook do with STRIPE_WEBHOOK_SECRET?"),
    (3, "how long do session tokens last?"),
    (4, "how do I roll back a deployment?"),
    (5, "best sourdough bread recipe?"),
    (6, "quantum entanglement experiments in superconducting qubits"),
    (7, ""),
    (8, None),
]


def test_hybrid_search_answers_or_stays_silent(spark, tables):
    queries = spark.createDataFrame(QUESTIONS, "query_id long, query string")
    found = search.search(queries, *tables)
    first = {r.query_id: r.path for r in found.results.where("rank = 1").collect()}
    assert first == {1: "src/payments/webhooks.ts", 2: "src/payments/webhooks.ts", 3: "src/auth/session.ts", 4: "docs/deployment.md"}
    reasons = {r.query_id: r.reason for r in found.status.collect()}
    assert reasons == {1: "ok", 2: "ok", 3: "ok", 4: "ok", 5: "gated-out", 6: "gated-out", 7: "empty-query", 8: "empty-query"}


def test_search_over_nothing(spark, tables):
    chunks, names = tables
    queries = spark.createDataFrame(QUESTIONS, "query_id long, query string")
    found = search.search(queries, chunks.where("false"), names, semantic=False)
    assert found.results.count() == 0
    assert {r.reason for r in found.status.collect()} == {"no-candidates", "empty-query"}
    assert search.search(queries.where("false"), chunks, names).results.count() == 0


def test_bm25_equals_sqlite(spark, tables):
    chunks, _ = tables
    analysed = bm25.analyse_chunks(chunks)
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(tokens)")
    for r in analysed.orderBy("chunk_id").collect():
        con.execute("insert into t(rowid, tokens) values (?, ?)", (r.chunk_id, " ".join(r.tokens)))
    queries = bm25.analyse_queries(spark.createDataFrame(QUESTIONS[:6], "query_id long, query string"))
    ours = {(r.query_id, r.chunk_id): r.bm25 for r in bm25.score(queries, analysed).collect()}
    theirs = {}
    for q in queries.collect():
        match = " OR ".join(f'"{t}"' for t in q.content)
        for i, rank in con.execute("select rowid, bm25(t) from t where t match ?", (match,)):
            theirs[(q.query_id, i)] = -rank
    assert ours.keys() == theirs.keys() and all(math.isclose(ours[k], theirs[k], rel_tol=1e-9) for k in ours)


def test_gate_score_and_cutoff(spark):
    rows = spark.createDataFrame(
        [(1, 0.2, 0.2, 0), (2, 0.5, 0.1, 0), (3, 0.1, 0.8, 0), (4, 0.1, 0.1, 1), (5, 0.1, 0.1, 0), (6, None, 0.5, 0)],
        "i int, cosine double, coverage double, identifier_hits int",
    )
    assert [r.i for r in rows.where(ranking.gate(Config())).orderBy("i").collect()] == [2, 3, 4, 6]
    assert [r.i for r in rows.where(ranking.gate(Config(min_identifier_hits=0))).orderBy("i").collect()] == [2, 3, 4, 6]
    scored = spark.createDataFrame([(1, 2.0), (1, 1.5), (1, 0.4), (2, 0.1)], "query_id int, score double")
    assert ranking.cutoff(scored, 0.45).count() == 3


def test_fusion_favours_agreement_and_the_lexical_list(spark):
    lex = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, chunk_id long, pos int")
    sem = spark.createDataFrame([(1, 12, 1, 0.9), (1, 11, 2, 0.8)], "query_id long, chunk_id long, pos int, cosine double")
    got = ranking.fuse(lex, sem, 60, 10).orderBy("fused_pos").collect()
    assert [r.chunk_id for r in got] == [11, 10, 12] and got[1].cosine is None


def test_diversity(spark):
    rows = spark.createDataFrame(
        [(1, 1, "a", 4.0, 1, [1.0, 0.0]), (1, 2, "a", 3.0, 2, [0.0, 1.0]), (1, 3, "a", 2.0, 3, [0.7, -0.7]), (1, 4, "b", 1.0, 4, [0.999, 0.01]), (1, 5, None, 0.5, 5, None)],
        "query_id long, chunk_id long, path string, score double, fused_pos int, vec array<float>",
    )
    ids = lambda vectors: [r.chunk_id for r in ranking.diversify(rows, Config(), vectors).orderBy("rank").collect()]
    assert ids(False) == [1, 2, 4, 5] and ids(True) == [1, 2, 5]


def test_top_cosines_take_zero_vectors_and_ties(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0])], "i long, vec array<float>")
    got = vector.top_cosines(v.where("i = 1"), v, 2, 2, "i", "i").orderBy("pos").collect()
    assert [(r.chunk_id, r.cosine) for r in got] == [(1, 1.0), (2, 1.0)]
    assert vector.top_cosines(v.where("false"), v, 2, 2, "i", "i").count() == 0


def test_blocks_stop_at_the_first_overflow(spark):
    rows = spark.createDataFrame([(1, k, "p", 1, 2, 1.0, "x" * n) for k, n in ((1, 100), (2, 900), (3, 10))], "query_id long, rank int, path string, start_line int, end_line int, score double, text string")
    got = inject.blocks(rows, Config(max_inject_tokens=100)).first()
    assert got.n_blocks == 1 and "### 1. p:1-2 (score 1.00)" in got.context and "### 3." not in got.context


def test_prompt_filter(spark):
    p = spark.createDataFrame([(1, "a long question"), (1, "a long question"), (2, "/clear the lot"), (3, "  ok "), (4, None)], "prompt_id long, prompt_text string")
    assert [r.prompt_id for r in inject.eligible_prompts(p, Config()).collect()] == [1]
    assert inject.eligible_prompts(p, Config(rag_enabled=False)).count() == 0


def test_index_lives_through_changes(spark, tmp_path):
    index = RetrievalIndex(spark, str(tmp_path / "index"))
    rows = lambda docs: spark.createDataFrame([("r", p, t, len(t or ""), 1.0) for p, t in docs.items()], "root string, path string, text string, size long, mtime double")
    assert index.is_stale()
    assert index.index(rows(DOCS | {"blank.md": " \n"})) == {"indexed": 4, "unchanged": 0, "skipped": 1, "chunks": 4}
    assert index.index(rows(DOCS)) == {"indexed": 0, "unchanged": 4, "skipped": 0, "chunks": 0}
    changed = {k: v for k, v in DOCS.items() if k != "docs/onboarding.md"} | {"docs/deployment.md": "# Deployment\nRoll forward only."}
    assert index.refresh(rows(changed)) == {"indexed": 1, "unchanged": 2, "skipped": 0, "chunks": 1, "removed": 1}
    assert not index.is_stale() and index.status().first().files == 3
    asked = spark.createDataFrame([(1, "roll forward deployment")], "query_id long, query string")
    assert index.search(asked).results.first().path == "docs/deployment.md"
    names = index.files_by_path(spark.createDataFrame([("r", "src/auth/session.ts"), ("r", "gone.md")], "root string, path string")).collect()
    assert {(r.path, r.chunk_count) for r in names} == {("src/auth/session.ts", 1), ("gone.md", None)}
    other = RetrievalIndex(spark, str(tmp_path / "index"), dim=10)
    with pytest.raises(ValueError):
        other.index(rows(DOCS))
    index.clear()
    assert index.status().first().files == 0 and index.meta["vec_dim"] == 384
    assert index.rebuild(rows(DOCS), force=True)["indexed"] == 4


def test_file_rules(spark, tmp_path):
    for name, body in {"a/x.py": b"x", "node_modules/y.js": b"y", "b/z.bin": b"z", "b/n.py": b"a\0b", "Makefile": b"m", "b/e.py": b"", "docs/k.md": b"k"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    got = {r.path for r in files.listing(spark, str(tmp_path)).collect()}
    assert got == {"a/x.py", "Makefile", "docs/k.md"}
    got = {r.path for r in files.listing(spark, str(tmp_path), Config(exclude_patterns=("docs/**", "Make*"))).collect()}
    assert got == {"a/x.py"}
    assert [r.path for r in files.listing(spark, str(tmp_path / "b/z.bin")).collect()] == ["z.bin"]


def test_extraction():
    got = extract.html_to_markdown("<html><head><title>t</title></head><h2>A  b</h2><p>x <b>y</b></p><pre>c\n d</pre><ul><li>one</li><li>two</li></ul>")
    assert got.startswith("## A b") and "**y**" in got and "```\nc\n d\n```" in got and "*   one\n*   two" in got
    assert extract.html_to_markdown(None) is None and extract.docx_text(b"no zip") is None


def test_best_scores_are_the_top_of_all_scores_either_way(spark, monkeypatch):
    words = "apple pear plum fig kiwi lime date sloe".split()
    texts = [(i, i, " ".join(words[j] for j in range(8) if (i * 7 + j * j) % (j + 2) == 0) + " half_done" * (i % 3 == 0)) for i in range(60)]
    chunks = spark.createDataFrame([*texts, (90, 90, None), (91, 91, "")], "chunk_id long, file_id long, text string")
    asked = [(1, "plum fig"), (2, "half_done kiwi kiwi"), (3, ""), (4, None), (5, "apple pear lime date"), (5, "apple pear lime date")]
    queries = bm25.analyse_queries(spark.createDataFrame(asked, "query_id long, query string"))
    analysed = bm25.analyse_chunks(chunks)
    rows = lambda df: sorted((r.query_id, r.pos, r.chunk_id, round(r.bm25, 9)) for r in df.collect())
    expected = rows(bm25.top(bm25.score(queries, analysed), 4))
    assert len(expected) == 12
    assert rows(bm25.top_scores(queries, chunks, 4)) == expected
    monkeypatch.setattr(bm25, "LIST_ROWS", 7)
    monkeypatch.setattr(bm25, "QUERY_ROWS", 2)
    assert rows(bm25.top_scores(queries, chunks, 4)) == expected
    monkeypatch.setattr(bm25, "ASKED_BOUND", 0)
    assert rows(bm25.top_scores(queries, chunks, 4)) == expected
    assert bm25.top_scores(queries.where("false"), chunks, 4).count() == 0


def test_search_over_the_stored_index_equals_search_over_the_tables(spark, tmp_path):
    words = "apple pear plum fig kiwi lime date sloe getUserName half_done".split()
    text = lambda i: "\n".join(" ".join(words[(i * 7 + j * k) % 10] for j in range(12)) for k in range(1, 90 + i % 40))
    rows = lambda ids, extra="": spark.createDataFrame([("r", f"d/f{i}.md", text(i) + extra, 10, 1.0) for i in ids], "root string, path string, text string, size long, mtime double")
    asked = spark.createDataFrame([(1, "plum fig getUserName"), (2, "half_done kiwi"), (3, ""), (4, "user name apple?"), (5, "nothing here")], "query_id long, query string")
    index = RetrievalIndex(spark, str(tmp_path / "index"))
    index.index(rows(range(12)))
    index.index(rows(range(3, 5), " kiwi half_done"))
    index.delete(index.files.where("path = 'd/f7.md'").select("file_id"))
    assert [bool(s["gone"]) for s in index.manifest["segments"]] == [False, True, True] and index.files.count() == 11

    def same(*ways):
        for semantic in ways:
            stored, plain = index.search(asked, semantic=semantic), search.search(asked, index.chunks, index.files, semantic=semantic)
            rows = lambda df: sorted((r.query_id, r.rank, r.path, r.start_line, round(r.score, 9)) for r in df.collect())
            got = rows(stored.results)
            assert got == rows(plain.results) and len(got) > 5
            assert sorted(stored.status.collect()) == sorted(plain.status.collect())

    same(True)
    index.merge()
    assert len(index.manifest["segments"]) == 1 and index.manifest["chunks"] == index.chunks.count()
    same(False)
    left = {p.name for p in (tmp_path / "index").iterdir() if not p.name.startswith(".")}
    assert len([n for n in left if n.startswith("manifest")]) == 2
    assert index.inject(spark.createDataFrame([(1, "where is the plum and the fig?")], "prompt_id long, prompt_text string"), semantic=False).count() == 1


def test_a_change_leaves_stored_segments_alone_and_a_second_writer_out(spark, tmp_path):
    at = tmp_path / "index"
    index = RetrievalIndex(spark, str(at))
    rows = lambda docs: spark.createDataFrame([("r", p, t, 1, 1.0) for p, t in docs.items()], "root string, path string, text string, size long, mtime double")
    index.index(rows(DOCS))
    first = {p: p.stat().st_mtime_ns for p in at.rglob("*.parquet")}
    index.refresh(rows(DOCS | {"docs/onboarding.md": "# Changed"}))
    assert all(p.stat().st_mtime_ns == t for p, t in first.items())
    before = index.manifest
    index.exclude(add=("docs/**", "*.min.js"))
    assert index.exclude(remove=("docs/**", "absent")) == ("*.min.js",) and index.track(add=("/a", "/b", "/a")) == ("/a", "/b")
    with pytest.raises(RuntimeError):
        index._publish(before, chunks=0)
    assert index.config.exclude_patterns == ("*.min.js",) and index.set("topK", "7").top_k == 7
    twice = rows(DOCS).unionByName(rows({"docs/deployment.md": "newer"}).withColumn("mtime", F.lit(2.0))).unionByName(rows({"docs/onboarding.md": DOCS["docs/onboarding.md"]}))
    assert index.index(twice) == {"indexed": 2, "unchanged": 2, "skipped": 0, "chunks": 2}
    assert index.files.count() == 4 and index.chunks.where("text = 'newer'").count() == 1


def test_a_failing_model_leaves_lexical_search(spark, tables):
    queries = spark.createDataFrame(QUESTIONS, "query_id long, query string")

    def broken(texts):
        raise OSError("no model here")

    with pytest.warns(UserWarning, match="lexical search only"):
        found = search.search(queries, *tables, model=broken)
    plain = search.search(queries, *tables, semantic=False)
    rows = lambda df: sorted((r.query_id, r.rank, r.chunk_id, r.score, r.cosine) for r in df.collect())
    assert rows(found.results) == rows(plain.results)


def test_prefixes_reach_the_model(spark):
    import numpy as np

    df = spark.createDataFrame([(1, "ab"), (2, None)], "i long, text string")
    got = vector.embed(df, "i", lambda texts: np.array([[len(t), 1.0] for t in texts]), prefix="query: ").orderBy("i").collect()
    assert [r.vec for r in got] == [[9.0, 1.0], [7.0, 1.0]]


def test_results_as_rows_and_as_json(spark, tables):
    import json

    queries = spark.createDataFrame(QUESTIONS[:5], "query_id long, query string")
    results = search.search(queries, *tables).results
    rows = {r.query_id: r for r in search.shown(results, 20).where("rank = 1").collect()}
    assert rows[4].lines == "1-3" and len(rows[4].preview) == 20 and rows[4].cosine == f"{float(rows[4].cosine):.3f}"
    shown = {r.query_id: json.loads(r.json) for r in search.as_json(results).collect()}
    assert shown[4][0]["path"] == "docs/deployment.md" and [x["rank"] for x in shown[4]] == list(range(1, len(shown[4]) + 1))


def test_payloads_become_prompts(spark):
    lines = ['{"prompt": "how to roll back?", "cwd": "/a"}', '{"user_prompt": "second way"}', '{"prompt": null}', "no json", None, '{"prompt": "p", "user_prompt": "u"}']
    df = spark.createDataFrame(list(enumerate(lines)), "prompt_id long, payload string")
    assert {(r.prompt_id, r.prompt_text, r.cwd) for r in inject.prompts_of(df).collect()} == {(0, "how to roll back?", "/a"), (1, "second way", None), (5, "p", None)}


def test_a_stream_of_changes_is_taken_up_once(spark, tmp_path):
    from granary.streaming.refresh import index_stream

    rows = spark.createDataFrame([("r", p, t, 1, 1.0) for p, t in DOCS.items()], "root string, path string, text string, size long, mtime double")
    rows.write.parquet(str(tmp_path / "in"))
    index = RetrievalIndex(spark, str(tmp_path / "index"))
    for folder in ("c1", "c2"):  # all is delivered a second time
        index_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), index, str(tmp_path / folder)).awaitTermination()
    assert index.files.count() == 4 and len(index.manifest["segments"]) == 1


def test_unchanged_files_are_rebuilt_from_all_their_chunks(spark):
    import hashlib

    from granary.operators.chunking import chunk_text
    from granary.plans.index import unchanged

    body = "".join(f"line {i % 7} {i // 3}\n" for i in range(300))
    whole = {1: "one\ntwo", 2: "one\ntwo\n", 3: body, 4: body.rstrip("\n"), 5: body.replace("\n", "\r\n"), 6: body + "\n\n\n", 7: body, 8: body, 9: "x\r\ny\r\n", 10: body}
    rows = [(100 * i + k, i, k, t.removesuffix("\r")) for i, text in whole.items() for k, (t, _, _) in enumerate(chunk_text(text))]
    rows += [(9000 + i, f, o, t) for i, f, o, t in rows if f in (1, 3)]  # delivered again
    rows = [r for r in rows if r[:3] != (801, 8, 1)]  # a chunk is missing
    rows = [(i, f, o, t.replace("line 3", "line 4") if f == 7 else t) for i, f, o, t in rows]  # the text is another one
    digest = {i: hashlib.sha1(t.encode()).hexdigest() for i, t in whole.items()} | {10: None}
    f = spark.createDataFrame([(i, digest[i], 0 if i == 3 else len(t)) for i, t in whole.items()], "file_id long, hash string, size long")
    c = spark.createDataFrame([*rows, (1, 77, 0, "x"), (2, 3, 9, None)], "chunk_id long, file_id long, ord int, text string")
    assert {r.file_id for r in unchanged(f, c).collect()} == {1, 2, 3, 4, 5, 6, 9}


def test_joined_chunks_overlap_as_brute_force_says():
    import random

    from granary.operators.chunking import _common_run

    rng = random.Random(1)
    for _ in range(2000):
        a, b = ([rng.choice("xy") for _ in range(rng.randint(1, 9))] for _ in "ab")
        assert _common_run(a, b) == max(k for k in range(min(len(a), len(b)) + 1) if a[len(a) - k :] == b[:k])


def test_html_is_known_by_any_element_at_its_start(spark):
    opened = ["<html>", "\ufeff<html>", "\u00a0\ufeff\n<!DOCTYPE html>", "<body>", "<head>", "<section>", "<article class='x'>", "<ul>", "<table\nid=a>", "<!-- a\n> b -->\n<p>", "<?xml version='1.0'?>\n<!DOCTYPE HTML>", "<H2>", "<br/>"]
    other = ["<|endoftext|>", "<project>", "<T>", "<path d=''>", "# a\n<p>", "a < b", "<!-- only a remark -->\n# Title", "", None, "<people>", "<p-card>", "<?xml version='1.0'?><rss>"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(opened + other)], "doc_id long, text string")
    assert {r.doc_id for r in rows.where(extract.is_html("text")).collect()} == set(range(len(opened)))


def test_html_query_keeps_documents_led_by_a_byte_order_mark(spark, tmp_path):
    from granary import queries

    rows = [(1, "\ufeff<html><body><h1>A</h1><p>b</p></body></html>"), (2, "<ul><li>x</li></ul>"), (3, "plain")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {tuple(r) for r in queries.html_to_markdown(spark, str(tmp_path)).collect()} == {(1, "# A\n\nb"), (2, "*   x")}


def test_phrases_are_counted_as_brute_force_says(spark):
    texts = ["a_bc bc_bc", "bc bc bc bc_bc", "AbcDe_fg de fg de_fg_de", "", None, "x", "fg_de fg", "de_fg de_fg de fg hi"]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    queries = spark.createDataFrame([(1, "bc_bc de_fg"), (2, "de_fg_de fg_de fg_hi"), (3, "bc")], "query_id long, query string")
    asked = bm25._asked(bm25.analyse_queries(queries)).selectExpr("key", "query_id", "1 as times").collect()
    wanted = bm25.Wanted(asked)
    names = {code: key for key, code in wanted.codes.items()}
    found, size, _ = bm25.matched(chunks, wanted)
    got = {(r.chunk_id, names[k], tf) for r in found.collect() for k, tf in zip(r.keys, r.tfs)}
    expected, analyser = set(), bm25.Analyser()
    for chunk, text in enumerate(texts):
        held = bm25.index_tokens(analyser.tokens(text))
        for key in wanted.codes:
            parts = [p for p in key.split("_") if p]
            n = sum(held[i : i + len(parts)] == parts for i in range(len(held)))
            if n:
                expected.add((chunk, key, n))
    assert got == expected and size == len(texts) and len([x for x in got if x[1].startswith("_")]) >= 4
