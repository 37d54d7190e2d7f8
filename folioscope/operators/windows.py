"""Neighbour windows: hits grow by their neighbours, touching windows merge, and each window becomes one result."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def neighbour_windows(hits: DataFrame, reach: int = 1) -> DataFrame:
    """hits (document_id, position, ...) with start and stop; a summary (position -1) gets 0 to 0 at a reach of 1."""
    return hits.withColumns({"start": F.greatest(F.lit(0), F.col("position") - reach), "stop": F.col("position") + reach})


def merged_windows(windows: DataFrame) -> DataFrame:
    """(document_id, start, stop): windows that overlap or touch, as islands."""
    by = Window.partitionBy("document_id").orderBy("start", "stop")
    reached = F.max("stop").over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = windows.select("document_id", "start", "stop", F.when(F.col("start") > reached + 1, 1).otherwise(0).alias("fresh"))
    marked = marked.withColumn("island", F.sum("fresh").over(by))
    return marked.groupBy("document_id", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("island")


def hit_windows(hits: DataFrame, merged: DataFrame) -> DataFrame:
    """Windows that hold a hit, with the first hit's rank and the best score; summary hits lie in none."""
    joined = hits.select("document_id", "position", "hit_rank", "relevance_score").join(merged, "document_id").where(F.col("position").between(F.col("start"), F.col("stop")))
    return joined.groupBy("document_id", "start", "stop").agg(F.min("hit_rank").alias("hit_rank"), F.max("relevance_score").alias("relevance_score"))


def assemble(hits: DataFrame, chunks: DataFrame, reach: int = 1) -> DataFrame:
    """One row per window that has stored chunks: id, content, position, offset, tags, links, score, in order of first hits.

    hits: document_id, position, hit_rank, relevance_score; chunks: document_id, position, offset, content, tags, outgoing_links.
    """
    if reach <= 0:
        keys = ["document_id", "position"]
        best = hits.groupBy(*keys).agg(F.min("hit_rank").alias("hit_rank"), F.max("relevance_score").alias("relevance_score"))
        out = best.join(chunks, keys).select("document_id", F.concat_ws("_", "document_id", "position").alias("id"), "content", "position", "offset", "tags", "outgoing_links", "relevance_score", F.col("position").alias("window_start"), F.col("position").alias("window_end"), "hit_rank")
        return out
    found = hit_windows(hits, merged_windows(neighbour_windows(hits, reach)))
    rows = found.join(chunks, "document_id").where(F.col("position").between(F.col("start"), F.col("stop")))
    union = lambda c: F.sort_array(F.array_distinct(F.flatten(F.collect_list(c))))
    out = rows.groupBy("document_id", "start", "stop", "hit_rank", "relevance_score").agg(
        F.sort_array(F.collect_list(F.struct("position", "content"))).alias("parts"),
        F.min("position").alias("position"), F.max("position").alias("last"), F.min("offset").alias("offset"), union("tags").alias("tags"), union("outgoing_links").alias("outgoing_links"),
    )
    return out.select(
        "document_id", F.concat_ws("_", "document_id", "position").alias("id"), F.array_join(F.col("parts.content"), "\n\n").alias("content"), "position", "offset", "tags", "outgoing_links",
        "relevance_score", F.col("position").alias("window_start"), F.col("last").alias("window_end"), "hit_rank",
    )
