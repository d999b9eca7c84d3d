"""The registered queries of the training-text operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskframe.llm import chat, decontaminate, fingerprint, language, lines, near, negatives, packing, runs, sites, substrings, tokenfile, toxicity
from maskframe.llm.store import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that leaks into it."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the token file gives back for every document."""
    return tokenfile.round_trip(table(spark, sf_dir, "documents"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited version, and how alike they are."""
    return fingerprint.compare_with_edited(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stand in windows which start earlier elsewhere."""
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), with_text=False).drop("kept")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class, copies and number of links of every document."""
    return near.near_copies(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that are aligned with an earlier one."""
    return lines.remove_aligned(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return language.identify(table(spark, sf_dir, "documents"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one of control strings, read back from its formatted text."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.format_conversations(turns.unionByName(chat.hostile(spark)))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every 50th vector, after a seventh of the labels were moved."""
    return negatives.hard_negatives(negatives.with_moved_labels(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0)


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return sites.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the periodic runs of every document, after a tenth of them were given periodic tails."""
    return runs.digests(runs.collapse(runs.with_periodic_tails(table(spark, sf_dir, "documents"))))


def registered() -> dict[str, Query]:
    return {
        q.__name__: q
        for q in (op1_decontamination, op2_token_file, op3_fingerprints, op4_substring_dedup, op5_ngram_join, op6_packing, op7_line_dedup, op8_toxicity, op9_language, op10_chat, op11_hard_negatives, op12_main_text, op13_runs)
    }


HARD_NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
         CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score,
         row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) AS k
  FROM s WHERE same),
n AS (
  SELECT p.anchor_id, positive_id, positive_score, s.other AS negative_id, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other) AS INTEGER) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id
  WHERE p.k <= 5 AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


def sql() -> dict[str, str]:
    """The same results as SQL for DuckDB, where it can express them."""
    return {"op11_hard_negatives": HARD_NEGATIVES}
