"""Registered queries of the training-data operators, and the SQL some can be held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import generated, leakage, near_duplicates, neighbors, reading, secrets, splitting, tokens
from granary.plans.runtime import prepare, table

NEAR = 0.82


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    near = neighbors.nearest_vectors(table(prepare(spark), d, "chunks"), min_similarity=NEAR)
    return neighbors.similar_pairs(near, NEAR)


def p1_neighbours(spark: SparkSession, d: str) -> DataFrame:
    near = neighbors.nearest_vectors(table(prepare(spark), d, "chunks"))
    return near.select(F.col("id").alias("chunk_id"), "other", "similarity")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    lines = secrets.secret_lines(table(prepare(spark), d, "chunks"), table(spark, d, "files"))
    return lines.withColumnRenamed("id", "chunk_id")


def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    blanked = secrets.redacted(table(prepare(spark), d, "chunks"), table(spark, d, "files"))
    return blanked.withColumnRenamed("id", "chunk_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(prepare(spark), d, "chunks")).select(F.col("id").alias("chunk_id")).distinct()


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    pieces = splitting.split_oversized(table(prepare(spark), d, "chunks"))
    return pieces.withColumnRenamed("id", "chunk_id")


def p3_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """Round trip: every oversized text from its pieces again, and whether all its pieces keep the limits."""
    whole = splitting.rebuilt(splitting.split_oversized(table(prepare(spark), d, "chunks")))
    within = (F.col("widest_lines") <= 80) & (F.col("longest_chars") <= 6000)
    return whole.select(F.col("id").alias("chunk_id"), "hash", "chars", "lines", within.alias("within"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.all_pairs(*near_duplicates.near_duplicates(table(prepare(spark), d, "chunks")))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """(chunk_id, class_id, links): the class of equal texts, and its number of similar classes."""
    membership, pairs = near_duplicates.near_duplicates(table(prepare(spark), d, "chunks"))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    return membership.join(ends, "rep", "left").select(
        F.col("id").alias("chunk_id"), F.col("rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links")
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return generated.not_handwritten(generated.label_files(table(prepare(spark), d, "files"), table(spark, d, "chunks")))


def p5_labels(spark: SparkSession, d: str) -> DataFrame:
    return generated.label_files(table(prepare(spark), d, "files"), table(spark, d, "chunks")).select("file_id", "label")


def p5_moved(spark: SparkSession, d: str) -> DataFrame:
    """Files whose label their place in the tree decides against, or without, their own evidence."""
    labels = generated.label_files(table(prepare(spark), d, "files"), table(spark, d, "chunks"))
    return labels.where("label <> own").select("file_id", F.col("own").alias("own_label"), "label")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(table(prepare(spark), d, "documents")).withColumnRenamed("id", "doc_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(prepare(spark), d, "documents"), table(spark, d, "benchmark"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    tables = (table(prepare(spark), d, name) for name in ("documents", "reading_grades", "benchmark"))
    return reading.reading_levels(*tables)


def p8_held_out(spark: SparkSession, d: str) -> DataFrame:
    """Five folds of the graded documents, each judged by the grades of the other four."""
    tables = (table(prepare(spark), d, name) for name in ("documents", "reading_grades", "benchmark"))
    return reading.held_out(*tables)


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_neighbours, p2_found, p2_redacted, p3_found, p3_pieces, p3_rebuilt, p4_found, p4_groups,
        p5_found, p5_labels, p5_moved, p6_ids, p7_found, p8_found, p8_held_out,
    )
}

_WS = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+$"

SQL = {
    "p1_found": """
        with v as (select chunk_id, [x::double for x in vec] as v from chunks
                   where len(vec) = 64 and len([x for x in vec if x <> 0]) > 0),
        s as (select a.chunk_id as a, b.chunk_id as b, round(list_cosine_similarity(a.v, b.v), 6) as sim
              from v a join v b on a.chunk_id <> b.chunk_id),
        r as (select a, b, sim, row_number() over (partition by a order by sim desc, b) as n from s)
        select distinct least(a, b) as chunk_a, greatest(a, b) as chunk_b from r where n <= 10 and sim >= 0.82
    """,
    "p3_found": f"""
        with t as (select chunk_id, text, regexp_replace(text, '{_WS}', '') as kept from chunks)
        select chunk_id from t
        where length(text) > 6000
           or (length(kept) > 0 and length(kept) - length(replace(kept, chr(10), '')) + 1 > 80)
    """,
    "p3_rebuilt": f"""
        with t as (select chunk_id, text, regexp_replace(text, '{_WS}', '') as kept from chunks)
        select chunk_id, sha1(text) as hash, length(text)::int as chars,
               (length(text) - length(replace(text, chr(10), '')) + case when text like '%' || chr(10) then 0 else 1 end)::int as lines, true as within
        from t
        where length(text) > 6000
           or (length(kept) > 0 and length(kept) - length(replace(kept, chr(10), '')) + 1 > 80)
    """,
    "p4_found": """
        with w as (select chunk_id, [lower(x) for x in regexp_extract_all(text, '[A-Za-z0-9_]+')] as w
                   from chunks where text is not null),
        s as (select distinct chunk_id, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) as s from w),
        n as (select chunk_id, count(*) as n from s group by chunk_id having count(*) >= 10),
        k as (select s.chunk_id, n.n, s.s from s join n using (chunk_id)),
        c as (select x.chunk_id as chunk_a, y.chunk_id as chunk_b, x.n as na, y.n as nb, count(*) as common
              from k x join k y on x.s = y.s and x.chunk_id < y.chunk_id group by all)
        select chunk_a, chunk_b from c where common >= 0.6 * (na + nb - common) - 1e-9
    """,
}
