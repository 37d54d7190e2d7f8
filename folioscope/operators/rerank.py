"""Rerankers over a result DataFrame; models come in as providers (see plans.providers)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as fx
from folioscope.operators import retrieval


def minmax(results: DataFrame, score: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """Scores stretched to 0..1 within a result; 1 where all are equal."""
    if by:
        over = Window.partitionBy(*by)
        low, high = F.min(score).over(over), F.max(score).over(over)
        return results.withColumn(out, F.when(high > low, (F.col(score) - low) / (high - low)).otherwise(1.0))
    ends = results.agg(F.min(score).alias("_low"), F.max(score).alias("_high"))
    joined = results.join(F.broadcast(ends), F.lit(True))
    return joined.withColumn(out, F.when(F.col("_high") > F.col("_low"), (F.col(score) - F.col("_low")) / (F.col("_high") - F.col("_low"))).otherwise(1.0)).drop("_low", "_high")


def clipped(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def by_embedding(results: DataFrame, query: Sequence[float], vector_col: str = "embeddings", by: Sequence[str] = ()) -> DataFrame:
    """relevance_score: cosine similarity to the query, stretched and clipped."""
    scored = results.withColumn("_cosine", retrieval.cosine(F.col(vector_col), F.lit([float(x) for x in query])))
    return minmax(scored, "_cosine", "_stretched", by).withColumn("relevance_score", clipped(F.col("_stretched"))).drop("_cosine", "_stretched")


def with_rubric(results: DataFrame, answer_col: str, weight: float = 1.0) -> DataFrame:
    """Fuses a model's rubric answer (null, as after a failure: 0) into relevance_score at weight / (1 + weight)."""
    rubric = F.coalesce(fx.rubric_score(answer_col), F.lit(0.0))
    return results.withColumn("relevance_score", F.lit(weight / (1 + weight)) * rubric + F.lit(1 / (1 + weight)) * F.col("relevance_score"))


def by_service(results: DataFrame, scores: DataFrame, index_col: str = "index", id_col: str = "id") -> DataFrame:
    """relevance_score from a service's (index, score) list; 0 where it has none."""
    mapped = results.join(scores.select(index_col, F.col("score").alias("relevance_score")), index_col, "left")
    return mapped.withColumn("relevance_score", F.coalesce("relevance_score", F.lit(0.0))).orderBy(F.desc("relevance_score"), id_col)


def by_list(results: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows in the order of the first row's array column ids; unknown and repeated ids go."""
    order = ids.select(F.posexplode("ids").alias("position_in_list", id_col)).groupBy(id_col).agg(F.min("position_in_list").alias("position_in_list"))
    return results.join(order, id_col).orderBy("position_in_list")


def choose(proxy: bool, embedding: bool, chat: bool) -> str:
    """Which reranker a configuration asks for."""
    return "service" if proxy else "embedding+rubric" if embedding and chat else "embedding" if embedding else "fusion"
