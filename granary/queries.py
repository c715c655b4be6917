"""Registered queries of the retrieval operators, and the SQL they are held against."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.config import Config
from granary.functions import text as T
from granary.operators import bm25, chunking, inject, ranking, vector
from granary.operators.bm25 import K1, LEAST_IDF, B
from granary.plans import index, search
from granary.plans.runtime import keep, prepare, table
from granary.sources import extract, files

CONFIG = Config()
EXCLUDES = Config(exclude_patterns=("*.min.js", "docs/**", "test/", "**/generated/*.ts", "*_dump.sql"))
JOINED = " "


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(prepare(spark), d, "chunks")


def _prompts(spark: SparkSession, d: str) -> DataFrame:
    """Prompts as queries, repeated rows once."""
    p = table(prepare(spark), d, "prompts").select(F.col("prompt_id").alias("query_id"), F.col("prompt_text").alias("query"))
    return p.distinct()


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(prepare(spark), d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def tok_raw(spark, d):
    return _chunks(spark, d).where("text is not null").select("chunk_id", F.array_join(T.raw_tokens("text"), JOINED).alias("tokens"))


def _distinct_words(spark, d):
    return _chunks(spark, d).select(F.explode(T.raw_tokens("text")).alias("token")).distinct()


def tok_parts(spark, d):
    return _distinct_words(spark, d).select("token", F.array_join(T.identifier_parts("token"), JOINED).alias("parts"))


def tok_stream(spark, d):
    analysed = bm25.analyse_chunks(_chunks(spark, d).where("text is not null"))
    return analysed.select("chunk_id", F.array_join("tokens", JOINED).alias("tokens"))


def stem_terms(spark, d):
    words = _distinct_words(spark, d).select(F.lower("token").alias("term")).distinct()
    return words.select("term", T.stem("term").alias("stem"))


def query_terms(spark, d):
    q = bm25.analyse_queries(_prompts(spark, d))
    return q.select("query_id", F.array_join("content", JOINED).alias("content"))


def query_identifiers(spark, d):
    q = bm25.analyse_queries(_prompts(spark, d))
    return q.select("query_id", F.array_join(F.array_sort("ids"), JOINED).alias("ids"))


def content_hash(spark, d):
    return table(prepare(spark), d, "documents").where("text is not null").select("doc_id", T.content_hash("text").alias("hash"))


def unchanged_files(spark, d):
    """Files whose stored hash is that of the text their chunks make up."""
    own = table(prepare(spark), d, "files").select("file_id", "root_id", "path", "hash", "size")
    return index.unchanged(own, _chunks(spark, d)).select("file_id", "root_id", "path")


def missing_files(spark, d):
    """Files of tracked roots that the index runs of their root's last 30 days no longer list."""
    log = table(prepare(spark), d, "index_log").withColumn("last", F.max("logged_at").over(Window.partitionBy("root_id")))
    logged = log.where("logged_at >= last - interval 30 days").select("file_id").distinct()
    tracked = table(spark, d, "roots").where("tracked_at is not null").select("root_id")
    return table(spark, d, "files").join(tracked, "root_id", "left_semi").join(logged, "file_id", "left_anti").select("file_id", "root_id", "path")


def files_in_order(spark, d):
    """S15 and S16's column set; the order is the reader's."""
    return table(prepare(spark), d, "files").select("path", "root_id", "file_id", "size").orderBy("path", "root_id")


def store_stats(spark, d):
    return index.store_stats(table(prepare(spark), d, "files"), table(spark, d, "chunks"))


def index_counters(spark, d):
    """Per run indexed, unchanged, skipped, chunks; a log row delivered again counts once, as last received."""
    w = Window.partitionBy("log_id").orderBy(F.desc("received_at"), F.desc("logged_at"))
    rows = table(prepare(spark), d, "index_log").withColumn("_n", F.row_number().over(w)).where("_n = 1")
    kind = lambda o: F.count_if(F.col("outcome") == o)
    return rows.groupBy("run_id").agg(
        kind("indexed").alias("indexed"), kind("unchanged").alias("unchanged"), kind("skipped").alias("skipped"),
        F.coalesce(F.sum("chunk_rows"), F.lit(0)).alias("chunks"),
    )


def term_df(spark, d):
    return index.term_statistics(_chunks(spark, d))


def doc_len(spark, d):
    return bm25.lengths(bm25.analyse_chunks(_chunks(spark, d)))


def _lexical(queries: DataFrame, spark, d, n: int) -> DataFrame:
    return bm25.top_scores(keep(bm25.analyse_queries(queries)), _chunks(spark, d), n)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def bm25_topn(spark, d):
    return _rounded(_lexical(_items(spark, d), spark, d, CONFIG.candidates), "bm25")


def bm25_phrase(spark, d):
    """Prompts ask for identifiers with underscores, whose parts must stand side by side."""
    return _rounded(_lexical(_prompts(spark, d), spark, d, CONFIG.candidates), "bm25")


def _embeddings(spark, d):
    e = table(prepare(spark), d, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    return e.where("vec_id % 20 = 0"), e  # the stated queries, against all rows


def vector_topn(spark, d):
    q, e = _embeddings(spark, d)
    return _rounded(vector.top_cosines(q, e, CONFIG.candidates, 64, "vec_id", "vec_id"), "cosine")


def hash_embedding(spark, d):
    """T13 as rows: each chunk's buckets that are not zero."""
    words = bm25.analyse_chunks(_chunks(spark, d)).select("chunk_id", F.explode("tokens").alias("t"))
    sums = words.groupBy("chunk_id", T.hash_bucket("t").alias("bucket")).agg(F.sum(T.hash_sign("t")).alias("s"))
    length = F.sqrt(F.sum(F.col("s") * F.col("s")).over(Window.partitionBy("chunk_id")))
    return sums.withColumn("value", F.round(F.col("s") / length, 6)).where("s <> 0").select("chunk_id", "bucket", "value")


def _rankings(spark, d):
    """Two rankings of the same rows: by the vectors, and by the vectors' first half."""
    q, e = _embeddings(spark, d)
    half = lambda x: x.select("vec_id", F.slice("vec", 1, 32).alias("vec"))
    first = vector.top_cosines(half(q), half(e), CONFIG.candidates, 32, "vec_id", "vec_id").drop("cosine")
    return first, vector.top_cosines(q, e, CONFIG.candidates, 64, "vec_id", "vec_id")


def rrf_fuse(spark, d):
    fused = ranking.fuse(*_rankings(spark, d), CONFIG.rrf_k, CONFIG.candidates)
    return fused.select("query_id", "chunk_id", F.round("rrf", 9).alias("rrf"), "fused_pos", F.round("cosine", 6).alias("cosine"))


def _corpus(spark, d) -> search.Corpus:
    return search.Corpus(_chunks(spark, d), table(spark, d, "files"))


def _evidence(spark, d, semantic: bool = False):
    return search.candidates(_prompts(spark, d), _corpus(spark, d), CONFIG, semantic)


def evidence(spark, d):
    """What speaks for each lexical candidate of each prompt."""
    rows = _evidence(spark, d)[1].select("query_id", "chunk_id", "coverage", "identifier_hits", "file_boost", "fused_pos", "rrf")
    return _rounded(rows, "coverage", "rrf")


def gate_counts(spark, d):
    """The status row of each prompt, lexical search."""
    return search.search(_prompts(spark, d), _chunks(spark, d), table(spark, d, "files"), CONFIG, semantic=False).status


def score_cutoff(spark, d):
    rows = _evidence(spark, d)[1].where(ranking.gate(CONFIG)).withColumn("score", ranking.score(CONFIG))
    return _rounded(ranking.cutoff(rows, CONFIG.relative_threshold).select("query_id", "chunk_id", "score"), "score")


def _shown(found: search.Searched) -> DataFrame:
    return _rounded(found.results.select("query_id", "rank", "chunk_id", "path", "score"), "score")


def lexical_search(spark, d):
    return _shown(search.search(_prompts(spark, d), _chunks(spark, d), table(spark, d, "files"), CONFIG, semantic=False))


def hybrid_search(spark, d):
    """R11, the flagship: BM25 and hash vectors fused, gated, scored, diversified."""
    return _shown(search.search(_prompts(spark, d), _chunks(spark, d), table(spark, d, "files"), CONFIG))


def _listing(docs: DataFrame) -> DataFrame:
    """Documents as files of one root, by their ids."""
    return docs.select(F.lit("documents").alias("root"), F.col("doc_id").cast("string").alias("path"), "text", F.length("text").alias("size"), F.lit(0.0).alias("mtime"))


def _new_index(spark) -> index.RetrievalIndex:
    return index.RetrievalIndex(spark, f"{prepare(spark).sparkContext.getCheckpointDir()}/index-{uuid.uuid4().hex}")


def index_build(spark, d):
    """The files of an index built over all documents."""
    built = _new_index(spark)
    built.index(_listing(table(prepare(spark), d, "documents")))
    return built.files.select("path", "hash", "chunk_count")


def _refreshed(spark, d) -> tuple[index.RetrievalIndex, dict]:
    """An index of all documents, each hundredth with another text, then refreshed with what they are now, each fiftieth gone."""
    docs, built = table(prepare(spark), d, "documents"), _new_index(spark)
    built.index(_listing(docs.withColumn("text", F.when(F.col("doc_id") % 100 == 0, F.concat("text", F.lit("\nlater"))).otherwise(F.col("text")))))
    return built, built.refresh(_listing(docs.where("doc_id % 50 <> 1")))


def index_refresh(spark, d):
    """The files of the refreshed index."""
    return _refreshed(spark, d)[0].files.select("path", "hash", "chunk_count")


def index_changes(spark, d):
    """What the refresh counted, beside what the index then holds."""
    built, counts = _refreshed(spark, d)
    held = built.files.agg(F.count(F.lit(1)).alias("files"), F.sum("chunk_count").alias("held_chunks"))
    return held.select("files", "held_chunks", *(F.lit(counts[k]).cast("bigint").alias(k) for k in ("indexed", "unchanged", "skipped", "removed", "chunks")))


def prompt_filter(spark, d):
    rows = table(prepare(spark), d, "prompts").select("prompt_id", "prompt_text")
    return inject.eligible_prompts(rows, CONFIG)


def inject_block(spark, d):
    """F8, R10, K4 with lexical search."""
    return search.inject(table(prepare(spark), d, "prompts"), _corpus(spark, d), CONFIG, semantic=False)


def result_rows(spark, d):
    """K5, K6: results as a caller is shown them."""
    return search.shown(search.search(_prompts(spark, d), _chunks(spark, d), table(spark, d, "files"), CONFIG).results)


def chunk_lines(spark, d):
    return chunking.chunk_lines(table(prepare(spark), d, "documents"), "doc_id")


def chunk_break_points(spark, d):
    docs = table(prepare(spark), d, "documents").where("text is not null")
    return chunking.break_points(docs, "doc_id")


def html_to_markdown(spark, d):
    docs = table(prepare(spark), d, "documents").where(extract.is_html("text"))
    return docs.select("doc_id", extract.to_markdown(T.trimmed("text")).alias("markdown"))


def ext_filter(spark, d):
    """Files of known types and fitting size outside excluded directories."""
    f = table(prepare(spark), d, "files").withColumn("path", files.normal_path("path"))
    kept = files.wanted(F.col("path"), CONFIG) & F.col("size").between(1, CONFIG.max_file_bytes)
    return f.where(kept).select("file_id", "path")


def exclude_filter(spark, d):
    """S5 over the same."""
    f = table(prepare(spark), d, "files").withColumn("path", files.normal_path("path"))
    return f.where(files.wanted(F.col("path"), EXCLUDES)).select("file_id", "path")


QUERIES = {
    f.__name__: f
    for f in (
        tok_raw, tok_parts, tok_stream, stem_terms, query_terms, query_identifiers, content_hash, unchanged_files,
        missing_files, index_build, index_refresh, index_changes, files_in_order, store_stats, index_counters, term_df, doc_len, bm25_topn, bm25_phrase,
        vector_topn, hash_embedding, rrf_fuse, evidence, gate_counts, score_cutoff, lexical_search, hybrid_search,
        prompt_filter, inject_block, result_rows, chunk_lines, chunk_break_points, html_to_markdown, ext_filter, exclude_filter,
    )
}

# --- the same in SQL ---------------------------------------------------------------------------------------------

_WS = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_RAW = "regexp_extract_all({t}, '[A-Za-z_][A-Za-z0-9_]*')"
_PARTS = (
    r"[p for p in string_split(regexp_replace(regexp_replace({w}, '([a-z0-9])([A-Z])', '\1_\2', 'g'), "
    r"'([A-Z])([A-Z][a-z])', '\1_\2', 'g'), '_') if p <> '']"
)


def _sql_stem(t: str) -> str:
    cut = lambda k: f"substr({t}, 1, length({t}) - {k})"
    return (
        f"case when length({t}) <= 4 then {t} when {t} like '%ies' and length({t}) > 5 then {cut(3)} || 'y' "
        f"when {t} like '%ing' and length({t}) > 6 then {cut(3)} when {t} like '%ed' and length({t}) > 5 then {cut(2)} "
        f"when {t} like '%es' and {t} not like '%ses' then {cut(2)} when {t} like '%s' and {t} not like '%ss' then {cut(1)} else {t} end"
    )


def _sql_tokens(text: str) -> str:
    """T4 of a text as a list expression."""
    parts = _PARTS.format(w="w")
    own = (
        "list_concat([lower(v) for v in [w] if length(v) >= 2], "
        f"[lower(p) for p in {parts} if length(p) >= 2 and lower(p) <> lower(w) and not regexp_full_match(p, '[0-9]+')])"
    )
    flat = f"flatten([{own} for w in {_RAW.format(t=text)}])"
    return flat


_TOKENS_CTE = f"""
    own as (select chunk_id, {_sql_tokens("coalesce(text, '')")} as own from chunks),
    toks as (select chunk_id, list_concat(own, [{_sql_stem("t")} for t in own if {_sql_stem("t")} <> t]) as tokens from own),
    ix as (select chunk_id, tokens, flatten([[p for p in string_split(t, '_') if p <> ''] for t in tokens]) as terms from toks)
"""


def _queries_cte(source: str) -> str:
    return f"""
    q0 as ({source}),
    q1 as (select query_id, query, {_sql_tokens("query")} as own from q0),
    q2 as (select query_id, query, list_concat(own, [{_sql_stem("t")} for t in own if {_sql_stem("t")} <> t]) as toks from q1),
    qt as (select query_id, query, unnest(toks) as t, generate_subscripts(toks, 1) as i from q2),
    qd as (select query_id, {_sql_stem("t")} as term, min(i) as i from qt group by all),
    qc as (select query_id, term, i from qd where term not in ({_STOP}))
"""


_PROMPT_SOURCE = "select distinct prompt_id as query_id, coalesce(prompt_text, '') as query from prompts"
_ITEM_SOURCE = "select item_id as query_id, text as query from benchmark"
_IDS = f"""
    ids as (
      select distinct query_id, w from (select query_id, unnest({_RAW.format(t="query")}) as w from q0)
      where (regexp_matches(w, '[_0-9]') or (regexp_matches(w, '[a-z]') and regexp_matches(w, '[A-Z]')) or length(w) >= 12)
        and lower(w) not in ({_STOP})
      union
      select distinct query_id, w from (select query_id, unnest(regexp_extract_all(query, '[A-Za-z0-9_-]+(?:\\.[A-Za-z0-9]+)+')) as w from q0)
      where length(w) >= 4 and not regexp_full_match(w, '[0-9]+(\\.[0-9]+)+'))
"""
_BM25 = f"""
    post as (select term, chunk_id, count(*) as tf from (select chunk_id, unnest(terms) as term from ix) group by all),
    dl as (select chunk_id, len(terms) as dl from ix),
    tot as (select count(*) as n, avg(dl) as avgdl from dl),
    qp as (select distinct term, [p for p in string_split(term, '_') if p <> ''] as parts from qc),
    hits as (
      select qp.term, post.chunk_id, post.tf from qp join post on len(qp.parts) = 1 and post.term = qp.parts[1]
      union all
      select term, chunk_id, tf from (
        select qp.term, ix.chunk_id,
               len([i for i in range(1, len(ix.terms) - len(qp.parts) + 2) if ix.terms[i:i + len(qp.parts) - 1] = qp.parts]) as tf
        from (select distinct term, chunk_id from post) f join qp on len(qp.parts) > 1 and f.term = qp.parts[1]
             join ix on ix.chunk_id = f.chunk_id)
      where tf > 0),
    dfs as (select term, count(*) as df from hits group by term),
    wt as (select term, case when ln((n - df + 0.5) / (df + 0.5)) <= 0 then {LEAST_IDF} else ln((n - df + 0.5) / (df + 0.5)) end as idf from dfs, tot),
    bm as (select qc.query_id, h.chunk_id, sum(w.idf * h.tf * {K1 + 1} / (h.tf + {K1} * ({1 - B} + {B} * dl.dl / tot.avgdl))) as bm25
           from qc join hits h on h.term = qc.term join wt w on w.term = qc.term join dl on dl.chunk_id = h.chunk_id, tot group by all),
    lex as (select * from (select *, row_number() over (partition by query_id order by round(bm25, 9) desc, chunk_id) as pos from bm)
            where pos <= {CONFIG.candidates})
"""
_EVIDENCE = f"""
    fused as (select query_id, chunk_id, 1.0 / ({CONFIG.rrf_k} + pos) as rrf, pos as fused_pos from lex),
    cov as (select f.query_id, f.chunk_id, count(*) filter (list_contains(t.tokens, qc.term)) / count(*) as coverage
            from fused f join toks t on t.chunk_id = f.chunk_id join qc on qc.query_id = f.query_id group by all),
    hit as (select f.query_id, f.chunk_id, count(*) as hits from fused f join ids on ids.query_id = f.query_id
            join chunks c on c.chunk_id = f.chunk_id where contains(coalesce(c.text, ''), ids.w) group by all),
    base as (select file_id, path, lower(regexp_extract(path, '([^/]*)$', 1)) as b from files),
    names as (select file_id, path, b, list_concat(o, [{_sql_stem("t")} for t in o if {_sql_stem("t")} <> t]) as bt
              from (select *, {_sql_tokens("b")} as o from base)),
    boost as (select f.query_id, f.chunk_id, {CONFIG.file_name_boost} as boost from fused f join chunks c on c.chunk_id = f.chunk_id
              join names n on n.file_id = c.file_id join qc on qc.query_id = f.query_id
              where length(qc.term) >= 3 and (contains(n.b, qc.term) or list_contains(n.bt, qc.term)) group by all),
    ev as (select f.query_id, f.chunk_id, n.path, f.rrf, f.fused_pos, cov.coverage, coalesce(hit.hits, 0)::int as identifier_hits,
                  coalesce(boost.boost, 0.0)::double as file_boost, c.text, c.start_line, c.end_line
           from fused f join chunks c on c.chunk_id = f.chunk_id join names n on n.file_id = c.file_id
           join cov on cov.query_id = f.query_id and cov.chunk_id = f.chunk_id
           left join hit on hit.query_id = f.query_id and hit.chunk_id = f.chunk_id
           left join boost on boost.query_id = f.query_id and boost.chunk_id = f.chunk_id),
    gated as (select *, rrf / (2.0 / {CONFIG.rrf_k + 1}) + {CONFIG.w_identifier} * least(identifier_hits, 3) + {CONFIG.w_coverage} * coverage + file_boost as score
              from ev where identifier_hits >= {CONFIG.min_identifier_hits} or coverage >= {CONFIG.min_token_coverage}),
    cut as (select * from (select *, max(score) over (partition by query_id) as best from gated) where score >= best * {CONFIG.relative_threshold}),
    per as (select *, row_number() over (partition by query_id, path order by score desc, fused_pos) as nth from cut),
    res as (select * from (select *, row_number() over (partition by query_id order by score desc, fused_pos) as rank from per where nth <= {CONFIG.max_per_file})
            where rank <= {CONFIG.top_k})
"""
# --- the hybrid search: hash vectors, both rankings, and the fold over what the cut leaves ---
_HYBRID = f"""
    ht as (select chunk_id as id, unnest(tokens) as t, 'c' as side from toks union all
           select query_id, t, 'q' from (select query_id, unnest(toks) as t from q2 where query_id in (select query_id from qc union select query_id from ids))),
    hb as (select side, id, (('0x' || h[7:8] || h[5:6] || h[3:4] || h[1:2])::bigint % {vector.DIM})::int as b,
                  sum(case when h[10] in ('1','3','5','7','9','b','d','f') then 1.0 else -1.0 end::double) as s
           from (select side, id, md5(t) as h from ht) group by all),
    hv as (select side, id, b, (s / sqrt(sum(s * s) over (partition by side, id)))::float::double as v from hb where s <> 0),
    hn as (select side, id, sqrt(sum(v * v)) as n from hv group by all),
    able as (select query_id from qc union select query_id from ids),
    dots as (select q.id as query_id, c.id as chunk_id, sum(q.v * c.v) as dot from hv q join hv c on q.side = 'q' and c.side = 'c' and q.b = c.b group by all),
    cosines as (select a.query_id, c.chunk_id, round(coalesce(d.dot / (nq.n * nc.n), 0.0), 9) as cosine
            from able a cross join (select chunk_id from chunks where chunk_id is not null) c
            left join dots d on d.query_id = a.query_id and d.chunk_id = c.chunk_id
            left join hn nq on nq.side = 'q' and nq.id = a.query_id left join hn nc on nc.side = 'c' and nc.id = c.chunk_id),
    sem as (select * from (select *, row_number() over (partition by query_id order by cosine desc, chunk_id) as pos from cosines) where pos <= {CONFIG.candidates}),
    both_lists as (select coalesce(l.query_id, s.query_id) as query_id, coalesce(l.chunk_id, s.chunk_id) as chunk_id, l.pos as lexpos, s.pos as sempos, s.cosine,
             coalesce(1.0::double / ({CONFIG.rrf_k} + l.pos), 0) + coalesce(1.0::double / ({CONFIG.rrf_k} + s.pos), 0) as rrf
             from lex l full join sem s on l.query_id = s.query_id and l.chunk_id = s.chunk_id),
    fused as (select query_id, chunk_id, rrf, fused_pos, cosine from (select *, row_number() over (partition by query_id
              order by round(rrf, 12) desc, lexpos asc nulls last, sempos asc nulls last) as fused_pos from both_lists) where fused_pos <= {CONFIG.candidates})
"""


def _folded(gated: str, cosine: str) -> str:
    """From evidence to results, with the near-duplicate test among the rows taken: a fold a row at a time."""
    return f"""
    scored as (select *, rrf / (2.0 / {CONFIG.rrf_k + 1}) + {CONFIG.w_identifier} * least(identifier_hits, 3) + {CONFIG.w_coverage} * coverage
                      + {CONFIG.w_cosine} * greatest(0.0, coalesce({cosine}, 0.0)) + file_boost as score
              from ev where identifier_hits >= {CONFIG.min_identifier_hits} or coverage >= {CONFIG.min_token_coverage} {gated}),
    cutrows as (select *, row_number() over (partition by query_id order by score desc, fused_pos) as i
                from (select *, max(score) over (partition by query_id) as best from scored) where score >= best * {CONFIG.relative_threshold}),
    dense as (select id, list(v order by b) as v, list(b order by b) as bs from hv where side = 'c' and id in (select chunk_id from cutrows) group by id),
    full_vec as (select id, [coalesce(v[list_position(bs, k)], 0.0) for k in range({vector.DIM})] as v from dense),
    seq as (select c.*, f.v from cutrows c left join full_vec f on f.id = c.chunk_id),
    fold(query_id, i, taken) as (
      select distinct query_id, 0::bigint, []::struct(chunk_id bigint, path varchar, v double[])[] from seq
      union all
      select f.query_id, s.i, case when len(f.taken) >= {CONFIG.top_k} or len([t for t in f.taken if t.path is not distinct from s.path]) >= {CONFIG.max_per_file}
             or len([t for t in f.taken if list_cosine_similarity(t.v, s.v) >= {CONFIG.near_dup_cosine}]) > 0 then f.taken
             else list_append(f.taken, struct_pack(chunk_id := s.chunk_id, path := s.path, v := s.v)) end
      from fold f join seq s on s.query_id = f.query_id and s.i = f.i + 1),
    chosen as (select query_id, unnest([t.chunk_id for t in taken]) as chunk_id, generate_subscripts(taken, 1) as rank
               from (select *, row_number() over (partition by query_id order by i desc) as r from fold) where r = 1)
"""


_CHUNK_LINES = f"""
    with recursive t as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
    b as (select *, [regexp_full_match(x, '[{_WS}]*') for x in lines] as blank from t),
    n as (select *, coalesce(list_max([k for k in range(1, len(lines) + 1) if not blank[k]]), 0)::int as n from b),
    st as (select *, [k::int for k in range(1, n) if blank[k] or (not blank[k + 1]
           and regexp_matches(lines[k + 1], '{chunking.CONSTRUCT.replace(T.BLANK, _WS).replace("'", "''")}'))] as starts from n),
    step(doc_id, first, stop) as (
      select doc_id, 0, 0 from st where n > 0
      union all
      select doc_id, nat, nat + (whole - nat) // pow(2, list_min([h for h in range(0, 8) if (whole - nat) // pow(2, h)::int <= 1
             or length(array_to_string(lines[nat + 1:nat + (whole - nat) // pow(2, h)::int], chr(10))) <= {chunking.MAX_CHARS}]))::int
      from (select s.doc_id, st.lines, case when s.stop = 0 then 0 else greatest(s.first + 1, s.stop - 8) end as nat,
                   case when nat + 80 < st.n then coalesce(list_max([x for x in st.starts if x <= nat + 80 and x >= nat + 25]), nat + 80)
                        else least(nat + 80, st.n) end as whole
            from step s join st on st.doc_id = s.doc_id where s.stop < st.n)),
    raw as (select s.doc_id, s.first, s.stop, array_to_string(st.lines[s.first + 1:s.stop], chr(10)) as whole from step s join st on st.doc_id = s.doc_id where s.stop > 0),
    cutup as (select doc_id, first, stop, k, substr(whole, k * {chunking.MAX_CHARS} + 1, {chunking.MAX_CHARS}) as text
              from (select *, unnest(range(0, greatest(1, (length(whole) + {chunking.MAX_CHARS - 1}) // {chunking.MAX_CHARS}))) as k from raw))
    select doc_id, (row_number() over (partition by doc_id order by first, k) - 1)::int as ord, (first + 1)::int as start_line, stop::int as end_line, text
    from cutup where not regexp_full_match(text, '[{_WS}]*')
"""


_COUNTED = f"""counted as (select doc_id, count(*)::int as chunk_count from ({_CHUNK_LINES}) group by doc_id),
    held as (select d.doc_id, d.doc_id::varchar as path, sha1(d.text) as hash, c.chunk_count from documents d join counted c on c.doc_id = d.doc_id)"""
_SEARCH = f"with {_TOKENS_CTE}, {_queries_cte(_PROMPT_SOURCE)}, {_IDS}, {_BM25}, {_EVIDENCE} "
_HYBRID_EV = _EVIDENCE[_EVIDENCE.index("cov as") : _EVIDENCE.index("gated as")].rstrip().rstrip(",")
_HYBRID_SEARCH = (
    f"with recursive {_TOKENS_CTE}, {_queries_cte(_PROMPT_SOURCE)}, {_IDS}, {_BM25}, {_HYBRID}, "
    + _HYBRID_EV.replace("f.rrf, f.fused_pos,", "f.rrf, f.fused_pos, f.cosine,")
    + ", " + _folded(f"or coalesce(cosine >= {CONFIG.cosine_floor}, false)", "cosine")
)
_ELIGIBLE = f"""
    (select distinct prompt_id, prompt_text, regexp_replace(coalesce(prompt_text, ''), '^[{_WS}]+|[{_WS}]+$', '', 'g') as s from prompts)
"""
_INJECT = f"""
    with {_TOKENS_CTE}, {_queries_cte(f"select prompt_id as query_id, coalesce(prompt_text, '') as query from {_ELIGIBLE} where length(s) >= 8 and s not like '/%'")},
    {_IDS}, {_BM25}, {_EVIDENCE},
    bl as (select query_id, rank, '### ' || rank || '. ' || coalesce(path, '') || ':' || concat_ws('-', start_line, end_line) || ' (score ' || printf('%.2f', round(score, 2))
           || ')' || chr(10) || case when length(text) > {CONFIG.max_chunk_chars} then substr(text, 1, {CONFIG.max_chunk_chars}) || chr(10) || '…' else coalesce(text, '') end as block from res),
    us as (select *, sum(length(block)) over (partition by query_id order by rank) as used from bl)
    select query_id, count(*) as n_blocks, '{inject.OPENING}' || string_agg(block, chr(10) || chr(10) order by rank) || '{inject.CLOSING}' as context
    from us where used <= {CONFIG.max_inject_tokens * 4} group by query_id
"""
_EXT = ", ".join(f"'{e}'" for e in files.extensions(CONFIG))
_SPECIAL = ", ".join(f"'{e}'" for e in files.SPECIAL_NAMES)
_DIRS = ", ".join(f"'{e}'" for e in files.EXCLUDED_DIRS)
_WANTED = f"""
    with p as (select file_id, size, replace(path, '\\', '/') as path from files),
    b as (select *, lower(regexp_extract(path, '([^/]*)$', 1)) as base, string_split(path, '/') as parts from p),
    k as (select * from b where (base in ({_SPECIAL}) or regexp_extract(base, '^.+(\\.[^.]*)$', 1) in ({_EXT}))
          and not list_has_any(parts[1:len(parts) - 1], [{_DIRS}]))
"""
_EMBEDDED = """
    with v as (select vec_id, [x::double for x in embedding] as v from embeddings),
    s as (select a.vec_id as query_id, b.vec_id as chunk_id, round(list_cosine_similarity(a.v, b.v), 9) as cosine,
                 round(list_cosine_similarity(a.v[1:32], b.v[1:32]), 9) as half
          from v a join v b on a.vec_id % 20 = 0),
    r as (select *, row_number() over (partition by query_id order by cosine desc, chunk_id) as pos,
                 row_number() over (partition by query_id order by half desc, chunk_id) as hpos from s)
"""

SQL: dict[str, str] = {
    "tok_raw": f"select chunk_id, array_to_string({_RAW.format(t='text')}, ' ') as tokens from chunks where text is not null",
    "tok_parts": f"""
        with w as (select distinct unnest({_RAW.format(t="text")}) as token from chunks)
        select token, array_to_string({_PARTS.format(w="token")}, ' ') as parts from w""",
    "tok_stream": f"""with {_TOKENS_CTE} select t.chunk_id, array_to_string(t.tokens, ' ') as tokens
        from toks t join chunks c on c.chunk_id = t.chunk_id where c.text is not null""",
    "stem_terms": f"""
        with w as (select distinct lower(w) as term from (select unnest({_RAW.format(t="text")}) as w from chunks))
        select term, {_sql_stem("term")} as stem from w""",
    "query_terms": f"""with {_queries_cte(_PROMPT_SOURCE)}
        select q0.query_id, coalesce(string_agg(term, ' ' order by i), '') as content
        from q0 left join qc on qc.query_id = q0.query_id group by q0.query_id, q0.query""",
    "query_identifiers": f"""with q0 as ({_PROMPT_SOURCE}), {_IDS}
        select q0.query_id, coalesce(string_agg(w, ' ' order by w), '') as ids
        from q0 left join ids on ids.query_id = q0.query_id group by q0.query_id, q0.query""",
    "content_hash": "select doc_id, sha1(text) as hash from documents where text is not null",
    "unchanged_files": r"""
        with recursive p as (select file_id, coalesce(ord, -1) as ord, chunk_id, text from chunks where text is not null and file_id is not null),
        v as (select file_id, 1 as way, ord, arg_max(text, chunk_id) as text from p group by file_id, ord
              union all select file_id, 2, ord, arg_min(text, chunk_id) from p group by file_id, ord),
        s as (select file_id, way, row_number() over (partition by file_id, way order by ord) as i, string_split(text, chr(10)) as lines from v),
        fold(file_id, way, i, built) as (
          select file_id, way, i, lines from s where i = 1
          union all
          select file_id, way, i, case when k = 0 and len(built) > 1 and ends_with(built[len(built) - 1], chr(13)) and not ends_with(built[len(built)], chr(13))
                 then list_concat(list_append(built[1:len(built) - 1], built[len(built)] || chr(13)), lines) else list_concat(built[1:len(built) - k], lines) end
          from (select f.file_id, f.way, s.i, f.built, s.lines,
                       coalesce(list_max([k for k in range(1, least(len(f.built), len(s.lines)) + 1)
                                 if [regexp_replace(x, '\r$', '') for x in f.built[len(f.built) - k + 1:len(f.built)]] = [regexp_replace(x, '\r$', '') for x in s.lines[1:k]]]), 0) as k
                from fold f join s on s.file_id = f.file_id and s.way = f.way and s.i = f.i + 1)),
        whole as (select distinct file_id, array_to_string(built, chr(10)) as text
                  from (select *, row_number() over (partition by file_id, way order by i desc) as r from fold) where r = 1)
        select distinct f.file_id, f.root_id, f.path from files f join whole w on w.file_id = f.file_id
        where len([n for n in range(0, greatest(coalesce(f.size, 0) - strlen(w.text), 64) + 1)
                   if sha1(w.text || repeat(chr(10), n::int)) = lower(f.hash) or sha1(w.text || repeat(chr(13) || chr(10), n::int)) = lower(f.hash)]) > 0""",
    "missing_files": """
        with l as (select *, max(logged_at) over (partition by root_id) as last from index_log)
        select file_id, root_id, path from files where root_id in (select root_id from roots where tracked_at is not null)
        and file_id not in (select file_id from l where file_id is not null and logged_at >= last - interval 30 days)""",
    "index_build": f"with {_COUNTED} select path, hash, chunk_count from held",
    "index_refresh": f"with {_COUNTED} select path, hash, chunk_count from held where doc_id % 50 <> 1",
    "index_changes": f"""with {_COUNTED}
        select count(*) filter (doc_id % 50 <> 1) as files, (sum(chunk_count) filter (doc_id % 50 <> 1))::bigint as held_chunks,
               count(*) filter (doc_id % 50 <> 1 and doc_id % 100 = 0) as indexed, count(*) filter (doc_id % 50 <> 1 and doc_id % 100 <> 0) as unchanged,
               (select count(*) from documents where doc_id % 50 <> 1 and doc_id not in (select doc_id from held)) as skipped,
               count(*) filter (doc_id % 50 = 1) as removed, coalesce(sum(chunk_count) filter (doc_id % 100 = 0), 0)::bigint as chunks from held""",
    "files_in_order": "select path, root_id, file_id, size from files order by path, root_id",
    "store_stats": """
        select (select count(*) from files) as files, count(*) as chunks, count(vec) as vectors,
               coalesce(sum(length(text)), 0)::bigint as chars, round(coalesce(sum(length(text)), 0) / 4)::bigint as approx_tokens from chunks""",
    "index_counters": """
        with l as (select * from (select *, row_number() over (partition by log_id order by received_at desc, logged_at desc) as n from index_log) where n = 1)
        select run_id, count(*) filter (outcome = 'indexed') as indexed, count(*) filter (outcome = 'unchanged') as unchanged,
               count(*) filter (outcome = 'skipped') as skipped, coalesce(sum(chunk_rows), 0)::bigint as chunks from l group by run_id""",
    "term_df": f"""with {_TOKENS_CTE}, p as (select term, chunk_id, count(*) as tf from (select chunk_id, unnest(terms) as term from ix) group by all)
        select term, count(*) as df, sum(tf)::bigint as cf from p group by term""",
    "doc_len": f"with {_TOKENS_CTE} select chunk_id, len(terms) as dl from ix",
    "bm25_topn": f"with {_TOKENS_CTE}, {_queries_cte(_ITEM_SOURCE)}, {_BM25} select query_id, chunk_id, round(bm25, 6) as bm25, pos::int as pos from lex",
    "bm25_phrase": f"with {_TOKENS_CTE}, {_queries_cte(_PROMPT_SOURCE)}, {_BM25} select query_id, chunk_id, round(bm25, 6) as bm25, pos::int as pos from lex",
    "vector_topn": _EMBEDDED + f"select query_id, chunk_id, round(cosine, 6) as cosine, pos::int as pos from r where pos <= {CONFIG.candidates}",
    "hash_embedding": f"""with {_TOKENS_CTE},
        h as (select chunk_id, md5(t) as h from (select chunk_id, unnest(tokens) as t from toks)),
        b as (select chunk_id, (('0x' || h[7:8] || h[5:6] || h[3:4] || h[1:2])::bigint % 384)::int as bucket,
                     case when h[10] in ('1','3','5','7','9','b','d','f') then 1.0 else -1.0 end::double as s from h),
        g as (select chunk_id, bucket, sum(s) as s from b group by all),
        l as (select *, sqrt(sum(s * s) over (partition by chunk_id)) as len from g)
        select chunk_id, bucket, round(s / len, 6) as value from l where s <> 0""",
    "rrf_fuse": _EMBEDDED
    + f"""
        , f as (select query_id, chunk_id, case when hpos <= {CONFIG.candidates} then hpos end as lex, case when pos <= {CONFIG.candidates} then pos end as sem,
                       case when pos <= {CONFIG.candidates} then cosine end as cosine
                from r where pos <= {CONFIG.candidates} or hpos <= {CONFIG.candidates}),
        g as (select *, coalesce(1.0::double / ({CONFIG.rrf_k} + lex), 0) + coalesce(1.0::double / ({CONFIG.rrf_k} + sem), 0) as rrf from f),
        o as (select *, row_number() over (partition by query_id order by round(rrf, 12) desc, lex asc nulls last, sem asc nulls last) as fused_pos from g)
        select query_id, chunk_id, round(rrf, 9) as rrf, fused_pos::int as fused_pos, round(cosine, 6) as cosine from o where fused_pos <= {CONFIG.candidates}""",
    "evidence": _SEARCH + """select query_id, chunk_id, round(coverage, 6) as coverage, identifier_hits, file_boost, fused_pos::int as fused_pos,
        round(rrf::double, 6) as rrf from ev""",
    "gate_counts": _SEARCH + """
        , n as (select query_id, count(*) as c from ev group by query_id), g as (select query_id, count(*) as c from gated group by query_id),
        able as (select distinct query_id from qc union select distinct query_id from ids)
        select q0.query_id, case when able.query_id is null then 'empty-query' when n.c is null then 'no-candidates'
               when g.c is null then 'gated-out' else 'ok' end as reason, coalesce(n.c, 0) as n_candidates, coalesce(g.c, 0) as n_gated
        from q0 left join able on able.query_id = q0.query_id left join n on n.query_id = q0.query_id left join g on g.query_id = q0.query_id""",
    "score_cutoff": _SEARCH + "select query_id, chunk_id, round(score, 6) as score from cut",
    "hybrid_search": _HYBRID_SEARCH + """select c.query_id, c.rank::int as rank, c.chunk_id, s.path, round(s.score, 6) as score
        from chosen c join cutrows s on s.query_id = c.query_id and s.chunk_id = c.chunk_id""",
    "inject_block": _INJECT,
    "result_rows": _HYBRID_SEARCH + """select c.query_id, c.rank::int as rank, s.path, concat_ws('-', s.start_line, s.end_line) as lines,
        printf('%.3f', round(s.score, 3)) as score, case when s.cosine is not null then printf('%.3f', round(s.cosine, 3)) end as cosine,
        printf('%.2f', round(s.coverage, 2)) as coverage, substr(s.text, 1, 1200) as preview
        from chosen c join cutrows s on s.query_id = c.query_id and s.chunk_id = c.chunk_id""",
    "chunk_lines": _CHUNK_LINES,
    "lexical_search": _SEARCH + "select query_id, rank::int as rank, chunk_id, path, round(score, 6) as score from res",
    "prompt_filter": f"""
        with t as (select distinct prompt_id, prompt_text, regexp_replace(coalesce(prompt_text, ''), '^[{_WS}]+|[{_WS}]+$', '', 'g') as s from prompts)
        select prompt_id, prompt_text from t where length(s) >= 8 and s not like '/%'""",
    "chunk_break_points": f"""
        with t as (select doc_id, string_split(regexp_replace(text, '(?:\\n[{_WS}]*)+$', ''), chr(10)) as lines from documents where text is not null),
        l as (select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) - 1 as line_no from t),
        p as (select *, lag(line) over (partition by doc_id order by line_no) as before from l)
        select doc_id, line_no::int as line_no from p where before is not null and (regexp_full_match(before, '[{_WS}]*')
          or (not regexp_full_match(line, '[{_WS}]*') and regexp_matches(line, '{chunking.CONSTRUCT.replace(T.BLANK, _WS).replace("'", "''")}')))""",
    "ext_filter": _WANTED + f"select file_id, path from k where size between 1 and {CONFIG.max_file_bytes}",
    "exclude_filter": _WANTED + r"""select file_id, path from k where not (
        regexp_matches(base, '^[^/]*\.min\.js$') or regexp_matches(path, '^docs/') or regexp_matches(path, '^test/')
        or regexp_matches(path, '^(?:[^/]+/)*generated/[^/]*\.ts$') or regexp_matches(regexp_extract(path, '([^/]*)$', 1), '_dump\.sql$'))""",
}
