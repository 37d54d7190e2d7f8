"""The link graph that notes' wikilinks span."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edges(chunks: DataFrame) -> DataFrame:
    """(wikilink_name, target): distinct links of each note."""
    return chunks.select("wikilink_name", F.explode("outgoing_links").alias("target")).distinct()


def outgoing(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks of the notes that hits link to, by name."""
    wanted = hits.select(F.explode("outgoing_links").alias("wikilink_name")).distinct()
    return chunks.join(wanted, "wikilink_name", "left_semi")


def outgoing_by_path(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks whose path begins with a link target: each path is cut at every length that some target has."""
    wanted = hits.select(F.explode("outgoing_links").alias("prefix")).where("prefix <> ''").distinct()
    cut = chunks.select("id", "source_path", F.explode(F.sequence(F.lit(1), F.length("source_path"))).alias("n")).select("id", F.expr("substring(source_path, 1, n)").alias("prefix"))
    found = cut.join(wanted, "prefix").select("id").distinct()
    return chunks.join(found, "id", "left_semi")


def incoming(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks that link to a hit's note."""
    names = hits.select(F.col("wikilink_name").alias("target")).distinct()
    linking = chunks.select("id", F.explode("outgoing_links").alias("target")).join(names, "target").select("id").distinct()
    return chunks.join(linking, "id", "left_semi")


def expand(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits, what they link to and what links to them; one row per id."""
    columns = chunks.columns
    return hits.select(*columns).unionByName(outgoing(hits, chunks)).unionByName(incoming(hits, chunks)).dropDuplicates(["id"])


def last_values(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the place of its first row, the values of its last."""
    others = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(F.min(order).alias(order), *[F.max_by(c, order).alias(c) for c in others])
