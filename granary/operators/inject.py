"""Prompts to context blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.config import Config
from granary.functions import text as T

OPENING = "<retrieved-context>\nThese passages passed the relevance gate of the local index. Use those that help.\n\n"
CLOSING = "\n</retrieved-context>"


def prompts_of(payloads: DataFrame, payload_col: str = "payload") -> DataFrame:
    """Adds prompt_text and cwd from JSON payloads; a prompt may go by either of two names, rows without one fall away."""
    read = F.from_json(payload_col, "prompt string, user_prompt string, cwd string")
    rows = payloads.withColumn("_read", read).withColumn("prompt_text", F.coalesce("_read.prompt", "_read.user_prompt"))
    return rows.where("prompt_text is not null").withColumn("cwd", F.col("_read.cwd")).drop("_read", payload_col)


def eligible_prompts(prompts: DataFrame, config: Config, text_col: str = "prompt_text") -> DataFrame:
    """F8: prompts of at least eight characters that are no command, each row once."""
    kept = T.trimmed(F.coalesce(F.col(text_col), F.lit("")))
    rows = prompts.where((F.length(kept) >= 8) & ~kept.startswith("/") & F.lit(config.rag_enabled))
    return rows.distinct()


def blocks(results: DataFrame, config: Config) -> DataFrame:
    """(query_id, n_blocks, context): results by rank until the first that overflows the budget."""
    body = T.truncated("text", config.max_chunk_chars)
    lines = F.concat_ws("-", "start_line", "end_line")
    block = F.concat(
        F.lit("### "), F.col("rank").cast("string"), F.lit(". "), F.coalesce("path", F.lit("")), F.lit(":"), lines,
        F.lit(" (score "), F.format_string("%.2f", "score"), F.lit(")\n"), F.coalesce(body, F.lit("")),
    )
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    # lengths are positive, so rows within the running sum are a prefix
    kept = results.withColumn("block", block).withColumn("used", F.sum(F.length("block")).over(w))
    kept = kept.where(F.col("used") <= config.max_inject_tokens * 4)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"]), "\n\n")
    return kept.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_blocks"), F.concat(F.lit(OPENING), joined, F.lit(CLOSING)).alias("context")
    )
