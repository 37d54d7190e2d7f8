"""Results as text: Markdown, a compact list, and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text as fx

#: The lines of a result, which callers read.
RESULT, SOURCE, CONTENT, TAGS, LINKS = "# Result %d%s ", "**Source:** `%s`", "**Content:**\n```\n%s\n```", "**Tags:** %s", "**Links:** %s"
BRIEF, BRIEF_TAGS, BRIEF_LINKS = "**%d.** Source: %s%s)\n   %s", "Tags: %s", "Links: %s"
NOTHING, NOTHING_BRIEF, MORE = "No results found for query: **%s**", "No results found for: %s", "... and %d more results"


def _listed(pattern: str, items: Column, one: str) -> Column:
    """A line of items, null where there are none."""
    return F.when(F.size(items) > 0, F.format_string(pattern, F.array_join(F.transform(items, lambda x: F.format_string(one, x)), ", ")))


def markdown_item(rank: Column, score: Column, source: Column, content: Column, tags: Column, links: Column, most: int = 1000) -> Column:
    return F.concat_ws(
        "\n", F.format_string(RESULT, rank, fx.score_label(score)), F.format_string(SOURCE, source), F.format_string(CONTENT, fx.truncated(fx.stripped(content), most)),
        _listed(TAGS, tags, "#%s"), _listed(LINKS, links, "[[%s]]"), F.lit(""),
    )


def compact_item(rank: Column, score: Column, source: Column, content: Column, tags: Column, links: Column, most: int = 150, most_items: int = 10) -> Column:
    return F.concat_ws(
        "\n", F.format_string(BRIEF, rank, source, fx.score_label(score), fx.truncated(fx.stripped(content), most)),
        _listed(BRIEF_TAGS, F.slice(tags, 1, most_items), "#%s"), _listed(BRIEF_LINKS, F.slice(links, 1, most_items), "[[%s]]"), F.lit(""),
    )


def joined(items: DataFrame, item: str, order: str, separator: str = "\n") -> DataFrame:
    """All items of a bounded result as one text."""
    rows = items.agg(F.sort_array(F.collect_list(F.struct(order, item))).alias("r"))
    return rows.select(F.array_join(F.col(f"r.{item}"), separator).alias("text"))


def markdown(items: DataFrame, item: str, order: str, query: str) -> DataFrame:
    """All items of a bounded result, or a line that there are none."""
    return joined(items, item, order).select(F.when(F.col("text") == "", F.format_string(NOTHING, F.lit(query))).otherwise(F.col("text")).alias("text"))


def compact(items: DataFrame, item: str, order: str, most: int = 3, query: str = "") -> DataFrame:
    """The first items and how many more there are."""
    rows = items.agg(F.sort_array(F.collect_list(F.struct(order, item))).alias("r"))
    more = F.size("r") - most
    text = F.concat_ws("\n", F.array_join(F.slice(F.col(f"r.{item}"), 1, most), "\n"), F.when(more > 0, F.format_string(MORE, more)))
    return rows.select(F.when(F.size("r") == 0, F.format_string(NOTHING_BRIEF, F.lit(query))).otherwise(text).alias("text"))


# ---- prompts ----


def rerank_prompt(question: Column, passage: Column) -> Column:
    return F.format_string("How well does the passage answer the question: perfect, good, some or bad?\nQuestion: %s\nPassage: %s", question, passage)


def summary_prompt(title: Column, description: Column, source: Column, content: Column) -> Column:
    lines = "Summarise the note for a search index, in plain prose without tags or links.\nTitle: %s\nDescription: %s\nSource path: %s\n\nDocument:\n%s\n\nSummary:"
    return F.format_string(lines, F.coalesce(title, F.lit("")), F.coalesce(description, F.lit("")), source, content)


def hypothetical_prompt(question: Column) -> Column:
    return F.format_string("Write the passage of a note that answers the question, and nothing else.\nQuestion: %s\nPassage:", question)


def selection_prompt(question: Column, chunks: Column) -> Column:
    return F.format_string("Name the ids of the chunks that help to answer, best first, as a JSON list.\nQuestion: %s\n%s", question, chunks)


def answer_prompt(question: Column, notes: Column) -> Column:
    return F.format_string("Answer from these notes.\nQuestion: %s\n%s", question, notes)


def queries_prompt(question: Column) -> Column:
    return F.format_string("Name at most five web searches, or pages to read, that help to answer, as a JSON list.\nQuestion: %s", question)


def reflection_prompt(question: Column, findings: Column) -> Column:
    return F.format_string("Do the findings answer the question? Reply in JSON with is_sufficient, knowledge_gap and follow_up_queries.\nQuestion: %s\nFindings:\n%s", question, findings)


def evidence_prompt(question: Column, gap: Column, sources: Column) -> Column:
    """sources: the texts that came; a knowledge gap that is null or empty is left out."""
    asked = F.when(F.coalesce(gap, F.lit("")) != "", F.format_string("\nKnowledge gap: %s", gap)).otherwise("")
    return F.format_string("Keep what bears on the query, with its sources.\nQuery: %s%s\nResults:\n%s", question, asked, F.array_join(sources, "\n\n"))


def recovery_prompt(question: Column, gap: Column, failed: Column, most: int = 4) -> Column:
    """failed: URLs that couldn't be fetched, of which the first few are named."""
    asked = F.when(F.coalesce(gap, F.lit("")) != "", F.format_string("\nKnowledge gap: %s", gap)).otherwise("")
    named = F.array_join(F.transform(F.slice(failed, 1, most), lambda x, i: F.format_string("%d. %s", i + 1, x)), "\n")
    return F.format_string("Read these pages for the query.\nQuery: %s%s\nPages:\n%s", question, asked, named)


def context(rows: DataFrame, id_col: str = "id", content: str = "content") -> DataFrame:
    """Chunks by id as one context text."""
    return joined(rows.withColumn("_item", F.concat(F.lit("["), F.col(id_col), F.lit("] "), F.col(content))), "_item", id_col, "\n\n")
