"""Gated hybrid search of a DataFrame of queries over a DataFrame of chunks."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.config import Config
from granary.functions import text as T
from granary.operators import bm25, ranking, vector
from granary.operators.inject import blocks, eligible_prompts
from granary.plans.runtime import collected, free, keep

FEW_IDS = 500_000  # candidate ids that are broadcast to fetch their rows, counted first: 4 MB; more are shuffled


@dataclass
class Searched:
    """What a search gives: ranked results, and one row of status for every query.

    ``close`` removes the tables that both are read from; a long-lived session closes what it has read.
    """

    results: DataFrame
    status: DataFrame
    kept: list[str] = field(default_factory=list)

    def close(self) -> None:
        free(self.status.sparkSession, self.kept)


class Corpus:
    """What a search reads: here chunks and files as they lie, analysed by one pass over the texts.

    chunks: (chunk_id, file_id, text, start_line, end_line); files: (file_id, path).
    """

    def __init__(self, chunks: DataFrame, files: DataFrame, model: vector.Embedder | None = None, config: Config | None = None):
        self.chunks, self.files = chunks, files
        self.model, self.config = model or vector.HashEmbedder(), config or Config()
        self.dim: int | None = getattr(self.model, "dim", None)  # of queries and chunks alike, if the model says it

    def matched(self, wanted: bm25.Wanted) -> tuple[DataFrame, int, float]:
        """What each chunk holds of the wanted terms, see ``bm25.matched``."""
        return bm25.matched(self.chunks, wanted)

    def vectors(self) -> DataFrame:
        """(chunk_id, vec) of all chunks."""
        return vector.embed(self.chunks.where("chunk_id is not null"), "chunk_id", self.model, prefix=self.config.passage_prefix)

    def details(self, ids: DataFrame, semantic: bool) -> DataFrame:
        """(chunk_id, file_id, text, start_line, end_line, tokens, vec) of some chunks; vec is null unless ``semantic``."""
        rows = bm25.with_tokens(self._of(ids, "chunk_id", "file_id", "text", "start_line", "end_line")).drop("index_tokens")
        if semantic:
            return vector.with_vectors(rows, self.model, prefix=self.config.passage_prefix)
        return rows.withColumn("vec", F.lit(None).cast("array<float>"))

    def _of(self, ids: DataFrame, *columns: str) -> DataFrame:
        few = ids.limit(FEW_IDS + 1).count() <= FEW_IDS
        rows = self.chunks.select(F.col("chunk_id").cast("bigint").alias("chunk_id"), *columns[1:])
        return rows.join(F.broadcast(ids) if few else ids, "chunk_id", "left_semi")


def candidates(queries: DataFrame, corpus: Corpus, config: Config, semantic: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(analysed queries, candidates with evidence, the candidates' chunks): J1, J5, J6, F11, T8-T10.

    Both rankings come first; texts, tokens and vectors are then fetched for the distinct
    candidates only. If the model fails, search goes on with the lexical ranking alone.
    """
    asked = keep(bm25.analyse_queries(queries))
    able = asked.where("size(content) + size(ids) > 0")  # F7
    n = config.candidates
    lexical = bm25.top_scores(able, corpus.chunks, n, corpus.matched)
    close = None
    if semantic:
        try:
            q = keep(vector.embed(able, "query_id", corpus.model, "query", config.query_prefix))
            close = keep(vector.top_cosines(q, corpus.vectors(), n, corpus.dim, "query_id", "chunk_id"))
        except Exception as problem:  # whatever ails the model, its dimension included
            warnings.warn(f"lexical search only, the model failed: {str(problem)[:200]}", stacklevel=2)
    fused = keep(ranking.fuse(lexical, close, config.rrf_k, n))
    details = keep(corpus.details(fused.select("chunk_id").distinct(), close is not None))
    paths = corpus.files.select("file_id", "path", T.base_name("path").alias("base")).dropDuplicates(["file_id"])
    paths = paths.join(details.select("file_id").distinct(), "file_id", "left_semi")
    paths = bm25.with_tokens(paths, "base").drop("index_tokens").withColumnRenamed("tokens", "base_tokens")
    # narrow rows meet first; texts and tokens, the wide ones, move once and are done with where they arrive
    rows = fused.join(details.select("chunk_id", "file_id", "start_line", "end_line"), "chunk_id").join(paths, "file_id")
    rows = rows.join(able.select("query_id", "content", "ids"), "query_id").join(details.select("chunk_id", "text", "tokens"), "chunk_id")
    evidence = rows.select(
        "query_id", "chunk_id", "path", "start_line", "end_line", "rrf", "fused_pos", "cosine",
        T.token_coverage("content", "tokens").alias("coverage"),
        T.identifier_hits("ids", F.coalesce("text", F.lit(""))).alias("identifier_hits"),
        T.file_name_boost("content", "base", "base_tokens", config.file_name_boost).alias("file_boost"),
    )
    return asked, evidence, details


def search_corpus(queries: DataFrame, corpus: Corpus, config: Config, semantic: bool = True) -> Searched:
    """Results of every query over a corpus, see ``search``."""
    with collected() as kept:
        asked, evidence, details = candidates(queries, corpus, config, semantic)
        evidence = keep(evidence)
    gated = evidence.where(ranking.gate(config))
    scored = ranking.cutoff(gated.withColumn("score", ranking.score(config)), config.relative_threshold)
    chosen = ranking.diversify(scored.join(details.select("chunk_id", "vec"), "chunk_id"), config, vectors=semantic)
    results = scored.join(chosen, ["query_id", "chunk_id"]).join(details.select("chunk_id", "text"), "chunk_id")
    counts = evidence.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_candidates"), F.count_if(ranking.gate(config)).alias("n_gated")
    )
    status = asked.join(counts, "query_id", "left").select(
        "query_id",
        F.when(F.size("content") + F.size("ids") == 0, "empty-query")
        .when(F.col("n_candidates").isNull(), "no-candidates")
        .when(F.col("n_gated") == 0, "gated-out")
        .otherwise("ok")
        .alias("reason"),
        F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"),
        F.coalesce("n_gated", F.lit(0)).alias("n_gated"),
    )
    return Searched(results, status, kept)


def search(queries: DataFrame, chunks: DataFrame, files: DataFrame, config: Config | None = None, semantic: bool = True, model: vector.Embedder | None = None) -> Searched:
    """Results of every query, possibly none, and why.

    queries: (query_id bigint, query string); null ids take no part, null queries count as
    empty. chunks: (chunk_id, file_id, text, start_line, end_line); files: (file_id, path).
    Chunks without text or file give no candidates. status reasons: ok, empty-query,
    no-candidates, gated-out. Both rankings are computed when this is called, the rest when read.
    """
    config = config or Config()
    return search_corpus(queries, Corpus(chunks, files, model, config), config, semantic)


def inject(prompts: DataFrame, corpus: Corpus, config: Config | None = None, semantic: bool = True) -> DataFrame:
    """M9: (query_id, n_blocks, context) of the prompts that deserve and find some."""
    config = config or Config()
    asked = eligible_prompts(prompts.select("prompt_id", "prompt_text"), config)
    asked = asked.select(F.col("prompt_id").alias("query_id"), F.col("prompt_text").alias("query"))
    return blocks(search_corpus(asked, corpus, config, semantic).results, config)


def shown(results: DataFrame, preview: int = 1200) -> DataFrame:
    """K5, K6: (query_id, rank, path, lines, score, cosine, coverage, preview) as a caller is shown them."""
    return results.select(
        "query_id", "rank", "path", F.concat_ws("-", "start_line", "end_line").alias("lines"), F.format_string("%.3f", "score").alias("score"),
        F.when(F.col("cosine").isNotNull(), F.format_string("%.3f", "cosine")).alias("cosine"),
        F.format_string("%.2f", "coverage").alias("coverage"), F.substring("text", 1, preview).alias("preview"),
    )


def as_json(results: DataFrame, preview: int = 200) -> DataFrame:
    """K5: (query_id, json): each query's results by rank as one JSON array; the preview is short."""
    row = F.struct("rank", "path", "start_line", "end_line", F.round("score", 3).alias("score"), F.round("cosine", 3).alias("cosine"),
                   F.round("coverage", 2).alias("coverage"), F.substring("text", 1, preview).alias("preview"))
    return results.groupBy("query_id").agg(F.to_json(F.sort_array(F.collect_list(row))).alias("json"))
