"""Fusion, evidence gate, score, relative cutoff, diversity and final cut of each query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.config import Config
from granary.functions import text as T


def fuse(lexical: DataFrame, semantic: DataFrame | None, k: int, n: int) -> DataFrame:
    """(query_id, chunk_id, rrf, cosine, fused_pos) from rankings with ``pos``; ties favour the lexical list."""
    lists = lexical.select("query_id", "chunk_id", F.col("pos").alias("lex"), F.lit(None).cast("int").alias("sem"), F.lit(None).cast("double").alias("cosine"))
    if semantic is not None:
        lists = lists.unionByName(
            semantic.select("query_id", "chunk_id", F.lit(None).cast("int").alias("lex"), F.col("pos").alias("sem"), "cosine")
        )
    both = lists.groupBy("query_id", "chunk_id").agg(F.min("lex").alias("lex"), F.min("sem").alias("sem"), F.max("cosine").alias("cosine"))
    share = lambda c: F.coalesce(1 / (F.lit(k) + F.col(c)), F.lit(0.0))
    both = both.withColumn("rrf", share("lex") + share("sem"))
    w = Window.partitionBy("query_id").orderBy(F.round("rrf", 12).desc(), F.asc_nulls_last("lex"), F.asc_nulls_last("sem"))
    return both.withColumn("fused_pos", F.row_number().over(w)).where(F.col("fused_pos") <= n).drop("lex", "sem")


def gate(config: Config) -> Column:
    """independent evidence by identifiers, by meaning, or by coverage."""
    hits, cos = F.col("identifier_hits"), F.col("cosine")
    return (
        ((hits > 0) & (hits >= config.min_identifier_hits))
        | F.coalesce(cos >= config.cosine_floor, F.lit(False))
        | (F.col("coverage") >= config.min_token_coverage)
    )


def score(config: Config) -> Column:
    """Fused rank relative to first place in both lists, plus weighed evidence."""
    return (
        F.col("rrf") / (2 / (config.rrf_k + 1))
        + config.w_identifier * F.least(F.col("identifier_hits"), F.lit(3))
        + config.w_coverage * F.col("coverage")
        + config.w_cosine * F.greatest(F.lit(0.0), F.coalesce("cosine", F.lit(0.0)))
        + F.coalesce("file_boost", F.lit(0.0))
    )


def cutoff(scored: DataFrame, ratio: float) -> DataFrame:
    """Rows that reach a share of their query's best score."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    return scored.withColumn("_best", best).where(F.col("score") >= F.col("_best") * ratio).drop("_best")


def diversify(scored: DataFrame, config: Config, vectors: bool) -> DataFrame:
    """In score order at most ``max_per_file`` rows of a path and none too close to one taken.

    ``scored`` has query_id, chunk_id, path, score, fused_pos and, with ``vectors``, vec. A
    query has at most as many rows as there are candidates (200), so the fold over its
    sorted array is bounded. Adds ``rank`` from 1; the cut to top_k comes after the fold.
    """
    row = F.struct(
        (-F.col("score")).alias("key"), F.col("fused_pos"), F.col("chunk_id"), F.col("path"),
        (F.col("vec") if vectors else F.lit(None).cast("array<float>")).alias("vec"),
    )
    lists = scored.groupBy("query_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    kind = lists.schema["rows"].dataType.simpleString()

    def take(taken: Column, x: Column) -> Column:
        same_file = F.size(F.filter(taken, lambda t: t["path"].eqNullSafe(x["path"])))
        close = (
            F.exists(
                taken,
                lambda t: t["vec"].isNotNull() & x["vec"].isNotNull() & (F.size(t["vec"]) == F.size(x["vec"]))
                & (T.cosine(t["vec"], x["vec"]) >= config.near_dup_cosine),
            )
            if vectors
            else F.lit(False)
        )
        full = F.size(taken) >= config.top_k  # what follows cannot change the rows already taken
        return F.when(full | (same_file >= config.max_per_file) | F.coalesce(close, F.lit(False)), taken).otherwise(F.concat(taken, F.array(x)))

    chosen = F.slice(F.aggregate("rows", F.array().cast(kind), take), 1, config.top_k)
    ranks = lists.select("query_id", F.posexplode(chosen).alias("place", "x"))
    return ranks.select("query_id", F.col("x.chunk_id").alias("chunk_id"), (F.col("place") + 1).alias("rank"))
