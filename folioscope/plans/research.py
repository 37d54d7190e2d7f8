"""The research loop: queries fan out, evidence is cleaned and reduced, a reflection decides whether to go on."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import urls
from folioscope.operators import formats
from folioscope.plans import providers
from folioscope.sources import web

NOTHING = "NO_RELEVANT_EVIDENCE"
MOST_RECOVERED = 4


class Planner(Protocol):
    def queries(self, question: str) -> list[str]: ...

    def clean(self, query: str, sources: list[str], gap: str) -> str: ...

    def recover(self, query: str, failed: list[str], gap: str) -> str: ...

    def reflect(self, question: str, findings: list[str]) -> tuple[bool, str, list[str]]: ...

    def answer(self, question: str, findings: list[str]) -> tuple[str, str]: ...


def listed(answer: str) -> list[str]:
    """The strings of a JSON list, else the lines of an answer without bullets and numbers."""
    try:
        found = json.loads(answer)
        return [str(x).strip() for x in found if str(x).strip()] if isinstance(found, list) else []
    except ValueError:
        return [x for line in answer.splitlines() if (x := re.sub(r"^\s*(?:[-*]|\d+[.)])\s*", "", line).strip())]


class ChatPlanner:
    """Plans by asking a model; prompts are those of operators.formats."""

    def __init__(self, spark: SparkSession, chat: providers.Chat):
        self.spark, self.chat = spark, chat

    def _ask(self, prompt) -> str:
        return self.chat.ask(self.spark.range(1).select(prompt.alias("p")).first()["p"]).strip()

    def queries(self, question: str) -> list[str]:
        return listed(self._ask(formats.queries_prompt(F.lit(question)))) or [question]

    def clean(self, query: str, sources: list[str], gap: str = "") -> str:
        return self._ask(formats.evidence_prompt(F.lit(query), F.lit(gap), F.array(*[F.lit(s) for s in sources])))

    def recover(self, query: str, failed: list[str], gap: str = "") -> str:
        return self._ask(formats.recovery_prompt(F.lit(query), F.lit(gap), F.array(*[F.lit(u) for u in failed]), MOST_RECOVERED))

    def reflect(self, question: str, findings: list[str]) -> tuple[bool, str, list[str]]:
        """Enough is known if the model names no gap; a reply that can't be read ends the research."""
        try:
            reply = json.loads(self._ask(formats.reflection_prompt(F.lit(question), F.lit("\n\n".join(findings)))))
            return bool(reply["is_sufficient"]), str(reply.get("knowledge_gap") or ""), [str(q) for q in reply.get("follow_up_queries") or []]
        except (ValueError, KeyError, TypeError, AttributeError):
            return True, "", []

    def answer(self, question: str, findings: list[str]) -> tuple[str, str]:
        reply = self._ask(formats.answer_prompt(F.lit(question), F.lit("\n\n".join(findings))))
        first, _, rest = reply.partition("\n\n")
        return first, rest


@dataclass
class Report:
    answer: str
    explanation: str
    sources: list[str] = field(default_factory=list)


def fan_out(spark: SparkSession, queries: list[str]) -> DataFrame:
    """(n, query, is_url): one row per branch."""
    rows = spark.createDataFrame([(i, q) for i, q in enumerate(queries)], "n int, query string")
    return rows.withColumn("is_url", urls.is_valid(F.col("query")))


def branch_hits(branches: DataFrame, hits: DataFrame) -> DataFrame:
    """(n, place, url): what a search found for each branch, or the URL that a branch is itself."""
    direct = branches.where("is_url").select("n", F.lit(0).alias("place"), F.col("query").alias("url"))
    return hits.join(branches.where("not is_url").select("n"), "n", "left_semi").select("n", "place", "url").unionByName(direct)


def reduced(texts: DataFrame) -> DataFrame:
    """(n, good, good_urls, bad) of texts (n, place, url, text): texts that came and URLs that failed, in the order of hits."""
    good, empty = ~F.col("text").startswith("ERROR"), F.array().cast("array<string>")
    parts = texts.groupBy("n").agg(
        F.sort_array(F.collect_list(F.when(good, F.struct("place", "text", "url")))).alias("g"), F.sort_array(F.collect_list(F.when(~good, F.struct("place", "url")))).alias("b"),
    )
    return parts.select("n", F.coalesce("g.text", empty).alias("good"), F.coalesce("g.url", empty).alias("good_urls"), F.coalesce("b.url", empty).alias("bad"))


def evidence(branches: DataFrame, hits: DataFrame, transport: web.Transport) -> DataFrame:
    """(n, query, good, good_urls, bad) of every branch. hits: n, place, url."""
    all_hits = branch_hits(branches, hits)
    parts, empty = reduced(all_hits.join(web.fetch(all_hits, transport), "url")), F.array().cast("array<string>")
    return branches.join(parts, "n", "left").select("n", "query", *[F.coalesce(c, empty).alias(c) for c in ("good", "good_urls", "bad")])


def merged_evidence(own: str, recovered: str | None) -> str:
    """What a recovery of failed sources adds to a branch's evidence."""
    if not recovered or recovered.startswith(NOTHING):
        return own
    return recovered if own.startswith(NOTHING) else f"{own}\n\n{recovered}"


def should_stop(sufficient: bool, loops: int, follow_ups: list[str], most_loops: int = 3) -> bool:
    return sufficient or loops >= most_loops or not follow_ups


def research(spark: SparkSession, question: str, planner: Planner, search, transport: web.Transport, most_loops: int = 3) -> Report:
    """search(branches) gives hits (n, place, url). Each round is one distributed job over its branches."""
    queries, findings, sources, loops, gap = planner.queries(question)[:5], [], [], 0, ""
    while True:
        branches = fan_out(spark, queries)
        for row in evidence(branches, search(branches), transport).orderBy("n").collect():  # as many rows as there are queries
            own = planner.clean(row["query"], row["good"], gap) if row["good"] else NOTHING
            if row["bad"]:
                try:
                    own = merged_evidence(own, planner.recover(row["query"], row["bad"][:MOST_RECOVERED], gap))
                except Exception:  # noqa: BLE001  recovery is optional
                    pass
            findings.append(own)
            sources += row["good_urls"]
        loops += 1
        sufficient, gap, queries = planner.reflect(question, findings)
        if should_stop(sufficient, loops, queries, most_loops):
            break
    answer, explanation = planner.answer(question, findings)
    return Report(answer, explanation, list(dict.fromkeys(sources)))


def researcher(kind: str, spark: SparkSession, planner: Planner, search, transport: web.Transport, most_loops: int = 3) -> Callable[[str], Report]:
    """What answers questions by research of a kind; there is one kind so far."""
    if kind != "deep_research":
        raise ValueError(f"unknown kind of research: {kind!r}")
    return lambda question: research(spark, question, planner, search, transport, most_loops)
