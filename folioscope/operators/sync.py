"""Incremental synchronisation of a chunk table with a listing of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A note of fewer chunks gets no summary.
LEAST_CHUNKS = 3


def stored_sources(chunks: DataFrame) -> DataFrame:
    """(source_path, modified_at): the oldest time stored for each path."""
    return chunks.groupBy("source_path").agg(F.min("modified_at").alias("modified_at"))


def plan(listing: DataFrame, stored: DataFrame) -> DataFrame:
    """(source_path, action) with ADD, REPLACE (strictly newer), KEEP and DELETE."""
    a = listing.select("source_path", F.col("modified_at").alias("now"))
    b = stored.select("source_path", F.col("modified_at").alias("before"))
    action = F.when(F.col("before").isNull(), "ADD").when(F.col("now").isNull(), "DELETE").when(F.col("now") > F.col("before"), "REPLACE").otherwise("KEEP")
    return a.join(b, "source_path", "full_outer").select("source_path", action.alias("action"))


def apply(chunks: DataFrame, actions: DataFrame, fresh: DataFrame) -> DataFrame:
    """The next state: chunks of kept paths and fresh chunks of added and replaced ones."""
    gone = actions.where(F.col("action").isin("DELETE", "REPLACE")).select("source_path")
    wanted = actions.where(F.col("action").isin("ADD", "REPLACE")).select("source_path")
    return chunks.join(gone, "source_path", "left_anti").select(*chunks.columns).unionByName(fresh.join(wanted, "source_path", "left_semi").select(*chunks.columns))


def delete(chunks: DataFrame, paths: DataFrame) -> DataFrame:
    """Chunks without those of the paths; unknown paths are no error."""
    return chunks.join(paths.select("source_path"), "source_path", "left_anti")


def with_summaries(chunks: DataFrame, summaries: DataFrame, least: int = LEAST_CHUNKS) -> DataFrame:
    """Adds a chunk at position -1 for notes with enough chunks and a summary that isn't blank.

    summaries: the chunk columns but position and offset, one row per source_path.
    """
    long = chunks.groupBy("source_path").count().where(F.col("count") >= least).select("source_path")
    own = summaries.where(F.trim("content") != "").join(long, "source_path", "left_semi").withColumns({"position": F.lit(-1), "offset": F.lit(0)})
    return own.select(*chunks.columns).unionByName(chunks)
