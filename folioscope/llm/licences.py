"""License scans by diagonal voting, with DataFrame operations alone.

The hash of every rolling pair of words is joined to the pairs of all templates. A hit at word p of a text and pair t
of a template votes for the diagonal p - t; neighbouring diagonals of one template (up to `slack` apart, as words that
were added or left out shift them) are merged, and a span is verified word by word (hits are compared as words, not
only as hashes) by the share of the template's pairs that it holds. Phrases need all their pairs on one diagonal.

The templates are a fixed list, so their table is broadcast; only hits are shuffled, once, by document. A closing
mark after each text's last pair carries the number of words, so that texts without a hit stay in the result.

A null text is empty and a null doc_id is carried through; repeated rows are scanned each; empty tables give no rows;
other columns are ignored. Texts are scanned whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm import common

# Phrases with their labels, then notices with the labels that this method adds.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
NOTICES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit-grant",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl-notice",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this work is licensed under a creative commons attribution": "cc-by",
    "released under the mit license": "mit-notice",
}
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SLACK = 3
SHARE = 0.8


def templates() -> list[tuple[int, str, bool, int, int, str, str]]:
    """(template, label, is a phrase, number of pairs, pair's place, first word, second word)."""
    out = []
    for k, (text, label) in enumerate([*PHRASES.items(), *NOTICES.items()]):
        words = text.split()
        out += [(k, label, text in PHRASES, len(words) - 1, i, a, b) for i, (a, b) in enumerate(zip(words, words[1:], strict=False))]
    return out


def words_of(text) -> F.Column:
    """Lower-cased words of a text; split() leaves an empty string at an end that has a separator, cut off by slice."""
    return F.split(common.ascii_lower(F.coalesce(text, F.lit(""))), SEPARATOR)


def scan(docs: DataFrame, slack: int = SLACK, share: float = SHARE) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (label, start, end, share)."""
    spark = docs.sparkSession
    pairs = spark.createDataFrame(templates(), "template int, label string, phrase boolean, pairs int, at int, a string, b string")
    end = spark.createDataFrame([(-1, "", False, 0, 0, "", "")], pairs.schema).withColumn("hash", F.lit(0).cast("long"))
    pairs = pairs.withColumn("hash", F.xxhash64("a", "b")).union(end)

    own = docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row"), words_of(F.col("text")).alias("w"))
    head, tail = F.when(F.get("w", F.lit(0)) == "", 1).otherwise(0), F.when(F.get("w", F.size("w") - 1) == "", 1).otherwise(0)
    own = own.select("doc_id", "row", F.slice("w", head + 1, F.greatest(F.size("w") - head - tail, F.lit(0))).alias("w"))
    # One hash for each pair of neighbours, then the closing mark 0 in the place of the missing last pair.
    hashes = F.transform(F.concat(F.col("w"), F.when(F.size("w") == 0, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))), lambda x, i: F.when(i >= F.size("w") - 1, F.lit(0).cast("long")).otherwise(F.xxhash64(x, F.get("w", i + 1))))
    grams = own.select("doc_id", "row", "w", F.posexplode(hashes).alias("place", "hash"))
    hits = grams.join(F.broadcast(pairs), "hash").where((F.col("template") < 0) | ((F.get("w", F.col("place")) == F.col("a")) & (F.get("w", F.col("place") + 1) == F.col("b"))))
    hits = hits.select("doc_id", "row", "template", "label", "phrase", "pairs", "at", (F.col("place") - F.col("at")).alias("diagonal"), F.when(F.col("template") < 0, F.size("w")).alias("n_words"))
    hits = hits.repartition("row")

    lines = hits.groupBy("row", "doc_id", "template", "label", "phrase", "pairs", "diagonal").agg(F.count("*").alias("votes"), F.min("at").alias("low"), F.max("at").alias("high"), F.max("n_words").alias("n_words"))
    by = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(by) > F.when(F.col("phrase"), 0).otherwise(slack)
    lines = lines.withColumn("span", F.sum(F.when(apart, 1).otherwise(0)).over(by))
    spans = lines.groupBy("row", "doc_id", "template", "label", "phrase", "pairs", "span").agg(
        F.sum("votes").alias("votes"), F.min(F.col("diagonal") + F.col("low")).alias("start"), F.max(F.col("diagonal") + F.col("high") + 1).alias("stop"), F.max("n_words").alias("n_words"),
    )
    held = F.when(F.col("pairs") > 0, F.least(F.col("votes") / F.col("pairs"), F.lit(1.0))).otherwise(0.0)
    fits = F.when(F.col("phrase"), F.col("votes") == F.col("pairs")).otherwise((held >= share) & (F.col("stop") - F.col("start") <= 1.5 * F.col("pairs") + 1)) & (F.col("template") >= 0)
    spans = spans.select("*", held.alias("held"), fits.alias("fits"), (fits & F.col("phrase")).alias("base"))
    names = lambda test: F.array_join(F.array_sort(F.collect_set(F.when(test, F.col("label")))), ",")
    return spans.groupBy("row", "doc_id").agg(
        F.max("n_words").cast("long").alias("n_words"), F.count_if("base").alias("n_base"),
        F.min(F.when(F.col("base"), F.col("start"))).cast("long").alias("first_word"), F.max(F.when(F.col("base"), F.col("start"))).cast("long").alias("last_word"),
        names(F.col("base")).alias("base_labels"), names(F.col("fits")).alias("labels"), F.max(F.when(F.col("fits"), F.col("held")).otherwise(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(F.col("fits"), F.struct("label", "start", "stop", "held")))).alias("spans"),
    ).drop("row")


def oracle_sql(slack: int = SLACK, share: float = SHARE) -> str:
    """The same result in DuckDB's SQL for tables with distinct ids, pairs joined as words."""
    rows = ", ".join(f"({k}, '{label}', {str(phrase).lower()}, {n}, {i}, '{a}', '{b}')" for k, label, phrase, n, i, a, b in templates())
    return f"""
WITH t(template, label, phrase, pairs, tp, a, b) AS (VALUES {rows}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{common.ASCII_UPPER}', '{common.ASCII_LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
g AS (SELECT doc_id, w, unnest(range(len(w) - 1)) AS place FROM d WHERE len(w) > 1),
h AS (SELECT doc_id, template, label, phrase, pairs, tp, place - tp AS diagonal FROM g JOIN t ON w[place + 1] = a AND w[place + 2] = b),
l AS (SELECT doc_id, template, label, phrase, pairs, diagonal, count(*) AS votes, min(tp) AS low, max(tp) AS high FROM h GROUP BY ALL),
f AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER q > CASE WHEN phrase THEN 0 ELSE {slack} END THEN 1 ELSE 0 END AS fresh FROM l WINDOW q AS (PARTITION BY doc_id, template ORDER BY diagonal)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS span FROM f),
p AS (SELECT doc_id, label, phrase, pairs, sum(votes) AS votes, min(diagonal + low) AS start, max(diagonal + high + 1) AS stop FROM s GROUP BY doc_id, template, label, phrase, pairs, span),
v AS (SELECT *, least(votes / pairs, 1.0) AS held, CASE WHEN phrase THEN votes = pairs ELSE least(votes / pairs, 1.0) >= {share} AND stop - start <= 1.5 * pairs + 1 END AS fits FROM p)
SELECT doc_id, CAST(len(any_value(w)) AS BIGINT) AS n_words, count(*) FILTER (WHERE fits AND phrase) AS n_base,
  CAST(min(start) FILTER (WHERE fits AND phrase) AS BIGINT) AS first_word, CAST(max(start) FILTER (WHERE fits AND phrase) AS BIGINT) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE fits AND phrase), '') AS base_labels,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE fits), '') AS labels,
  round(CAST(coalesce(max(held) FILTER (WHERE fits), 0.0) AS DOUBLE), 6) AS score
FROM d LEFT JOIN v USING (doc_id) GROUP BY doc_id"""
