"""Notes and chunks derived from the tables of a folder, with the same derivation as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, content with a heading, links and tags, path, name, tags and time; text is the document itself."""
    i = F.col("doc_id")
    links = F.concat(
        F.lit("## Links\n[["), F.col("source"), F.lit("]] [[n"), (i * 7 % 50).cast("string"), F.lit("|other]] [[n"), (i * 3 % 50).cast("string"), F.lit("#part]] ![["),
        F.col("lang"), F.lit("]] #"), F.col("lang"), F.lit(" #Tag-"), F.col("source"), F.lit(" # no"),
    )
    return table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.concat(F.lit("# "), F.col("source"), F.lit("\n\n"), F.col("text"), F.lit("\n\n"), links).alias("content"),
        F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), i.cast("string"), F.lit(".md")).alias("source_path"),
        F.concat(F.lit("n"), (i % 50).cast("string")).alias("wikilink_name"), F.array("lang", "source").alias("tags"), "lang", "source",
        F.concat(F.lit("On "), F.col("source")).alias("title"), i.cast("double").alias("modified_at"),
    )


NOTES = """notes AS (SELECT doc_id, text, '# ' || source || chr(10) || chr(10) || text || chr(10) || chr(10) || '## Links' || chr(10) || '[[' || source || ']] [[n' || (doc_id * 7 % 50) || '|other]] [[n'
  || (doc_id * 3 % 50) || '#part]] ![[' || lang || ']] #' || lang || ' #Tag-' || source || ' # no' AS content, source || '/' || lang || '/' || doc_id || '.md' AS source_path,
  'n' || (doc_id % 50) AS wikilink_name, [lang, source] AS tags, lang, source, 'On ' || source AS title, CAST(doc_id AS DOUBLE) AS modified_at FROM documents)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as chunks: document_id, position, offset, content, tags, links."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("document_id"), F.col("turn").cast("int").alias("position"), (F.col("turn") * 2).cast("int").alias("offset"), F.col("text").alias("content"),
        F.array("role").alias("tags"), F.array(F.concat(F.lit("n"), (F.col("conv_id") % 5).cast("string"))).alias("outgoing_links"),
    )


TURNS = """turns AS (SELECT CAST(conv_id AS VARCHAR) AS document_id, CAST(turn AS INTEGER) AS position, CAST(turn * 2 AS INTEGER) AS "offset", text AS content, [role] AS tags,
  ['n' || (conv_id % 5)] AS outgoing_links FROM conversations)"""


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as hits, some with scores, and a summary hit (position -1) for conversations that a system turn opens."""
    own = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", F.col("turn").cast("int").alias("position"))
    summary = table(spark, sf_dir, "conversations").where("turn = 0 and role = 'system'").select("conv_id", F.lit(-1).alias("position"))
    both = own.unionByName(summary)
    score = F.when(F.col("conv_id") % 3 > 0, (F.col("conv_id") * 7 + F.col("position")) % 10 / 10.0)
    return both.select(F.col("conv_id").cast("string").alias("document_id"), "position", ((F.col("conv_id") * 31 + F.col("position")) % 1009).cast("int").alias("hit_rank"), score.alias("relevance_score"))


HITS = """hits AS (SELECT CAST(conv_id AS VARCHAR) AS document_id, position, CAST((conv_id * 31 + position) % 1009 AS INTEGER) AS hit_rank,
  CASE WHEN conv_id % 3 > 0 THEN ((conv_id * 7 + position) % 10) / 10.0 END AS relevance_score FROM (SELECT conv_id, CAST(turn AS INTEGER) AS position FROM conversations WHERE role = 'assistant'
  UNION ALL SELECT conv_id, -1 FROM conversations WHERE turn = 0 AND role = 'system'))"""
