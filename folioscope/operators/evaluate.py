"""Retrieval evaluation: word coverage, rank agreement, and case files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def cases(spark: SparkSession, path: str) -> DataFrame:
    """(query, expected, unwanted) of a colon-separated file; its first line and lines without three parts are skipped."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("n", "line")).where("n > 0")
    own = rows.select(F.split("line", ":").alias("p")).where(F.size("p") == 3)
    words = lambda i: F.filter(F.transform(F.split(F.get("p", F.lit(i)), ","), lambda x: F.trim(x)), lambda x: x != "")
    return own.select(F.trim(F.get("p", F.lit(0))).alias("query"), words(1).alias("expected"), words(2).alias("unwanted"))


def found_words(text: Column, words: Column) -> Column:
    low = F.lower(text)
    return F.filter(words, lambda w: F.instr(low, F.lower(w)) > 0)


def precision(text: Column, expected: Column) -> Column:
    """The share of expected words that the text holds; 1 for none expected."""
    return F.when(F.size(expected) == 0, 1.0).otherwise(F.size(found_words(text, expected)) / F.size(expected))


def recall(text: Column, unwanted: Column) -> Column:
    """The share of unwanted words that the text lacks; 1 for none."""
    return F.when(F.size(unwanted) == 0, 1.0).otherwise(1 - F.size(found_words(text, unwanted)) / F.size(unwanted))


def f_score(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))


def chunk_text(title: Column, description: Column, content: Column) -> Column:
    return F.concat_ws("\n", title, description, content)


def grade(f: Column) -> Column:
    return F.when(f >= 0.7, "excellent").when(f >= 0.5, "good").when(f >= 0.3, "fair").otherwise("poor")


def rank_agreement(expected: DataFrame, results: DataFrame, k: int = 5) -> DataFrame:
    """(query, position_accuracy, overlap_accuracy) of the k best results against k expected ids.

    expected: query, ids; results: query, id, score.
    """
    by = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    top = results.withColumn("n", F.row_number().over(by)).where(F.col("n") <= k).groupBy("query").agg(F.sort_array(F.collect_list(F.struct("n", "id"))).alias("t")).select("query", F.col("t.id").alias("got"))
    both = expected.join(top, "query")
    same = F.size(F.filter(F.arrays_zip("ids", "got"), lambda x: x["ids"] == x["got"]))
    return both.select("query", (same / k).alias("position_accuracy"), (F.size(F.array_intersect("ids", "got")) / k).alias("overlap_accuracy"))


def means(scored: DataFrame) -> DataFrame:
    """One row: the cases that succeeded (no error), how many, their mean precision, recall and f_score, and the grade."""
    good = scored.where(F.col("error").isNull()) if "error" in scored.columns else scored
    own = good.agg(F.count("*").alias("cases"), *[F.avg(c).alias(c) for c in ("precision", "recall", "f_score")])
    return own.withColumn("grade", grade(F.coalesce("f_score", F.lit(0.0))))


def mean_agreement(agreement: DataFrame) -> DataFrame:
    """One row: the mean position and overlap accuracy over all queries."""
    return agreement.agg(F.count("*").alias("queries"), F.avg("position_accuracy").alias("position_accuracy"), F.avg("overlap_accuracy").alias("overlap_accuracy"))
