"""Search from a question to windows, the agent over the link graph, and the note tools with their error contract."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope import config, schema
from folioscope.functions import text as fx
from folioscope.operators import chunking, formats, graph, rerank, retrieval, sync, windows
from folioscope.operators.store import ChunkStore
from folioscope.plans import providers
from folioscope.schema import Scope
from folioscope.sources import vault

log = logging.getLogger(__name__)
ITEM = ("id", "content", "title", "source_path", "wikilink_name", "tags", "outgoing_links", "position", "offset")
NO_ANSWER = "No answer could be generated."


class SearchEngine:
    """Hypothetical passage, hybrid search, score floor, listwise rerank, neighbour windows; each model step may fail."""

    def __init__(self, store: ChunkStore, embedder: providers.Embedder, hyde: providers.Chat | None = None, reranker: providers.Chat | None = None, limit: int = 25, least: float = 0.5, neighbours: int = 1):
        self.store, self.embedder, self.hyde, self.reranker, self.limit, self.least, self.neighbours = store, embedder, hyde, reranker, limit, least, neighbours

    def passage(self, query: str) -> str:
        """What is embedded: a cleaned hypothetical passage, or the query."""
        if self.hyde is None:
            return query
        found = providers.hypothetical(self.hyde, query)
        if not found:
            return query
        return self.store.spark.range(1).select(fx.clean_generated(F.lit(found)).alias("t")).first()["t"] or query

    def hits(self, query: str, tags: Sequence[str] = (), path: str | None = None, scope: Scope = Scope.ALL) -> DataFrame:
        vector = self.embedder.embed([self.passage(query)])[0]
        found = self.store.search(query, vector, self.limit, tags, path, scope)
        kept = retrieval.first_of_each(retrieval.min_score(found, self.least))
        return self.listwise(kept, query) if self.reranker else kept.orderBy("hit_rank")

    def listwise(self, kept: DataFrame, query: str) -> DataFrame:
        """The rows that the model names, in its order; all of them if it fails."""
        try:
            context = formats.context(kept).first()["text"]
            ids = json.loads(self.reranker.ask(f"Name the ids of the chunks that help to answer, best first, as a JSON list.\nQuestion: {query}\n{context}"))
            named = kept.sparkSession.createDataFrame([([str(x) for x in ids],)], "ids array<string>")
        except Exception:  # noqa: BLE001  the search result stands without the reranker
            log.exception("listwise reranking failed")
            return kept.orderBy("hit_rank")
        return rerank.by_list(kept, named).withColumn("hit_rank", F.col("position_in_list") + 1).drop("position_in_list").orderBy("hit_rank")

    def search(self, query: str, tags: Sequence[str] = (), path: str | None = None, scope: Scope = Scope.ALL) -> DataFrame:
        """Windows in the order of their first hits, with the first chunk's other columns."""
        hits = self.hits(query, tags, path, scope)
        keyed = hits.select(fx.note_id_of_chunk("id").alias("document_id"), "position", "hit_rank", "relevance_score")
        stored = self.store.chunks().withColumn("document_id", fx.note_id_of_chunk("id"))
        out = windows.assemble(keyed, stored.select("document_id", "position", "offset", "content", "tags", "outgoing_links"), self.neighbours)
        first = stored.select("document_id", "position", "title", "description", "source", "source_path", "wikilink_name", "modified_at", "file_size")
        return out.join(first, ["document_id", "position"]).orderBy("hit_rank")


def with_service(results: DataFrame, score: Callable[[list[str]], list[tuple[int, float]]], fallback: Callable[[], DataFrame], content: str = "content") -> DataFrame:
    """Scores from a service for a bounded result; the fallback's rows where the service fails."""
    rows = results.orderBy("id").select("id", content).collect()  # a search result, bounded by its limit
    if not rows:
        return results.withColumn("relevance_score", F.lit(None).cast("double"))
    try:
        found = score([str(r[content]) for r in rows])
    except Exception:  # noqa: BLE001
        log.exception("the reranking service failed")
        return fallback()
    spark = results.sparkSession
    numbered = spark.createDataFrame([(i, r["id"]) for i, r in enumerate(rows)], "index int, id string")
    scores = spark.createDataFrame([(int(i), float(s)) for i, s in found], "index int, score double")
    return rerank.by_service(results.drop("relevance_score").join(numbered, "id"), scores).drop("index")


def reranked(results: DataFrame, query: str, settings: config.Config, embedder: providers.Embedder | None = None, chat: providers.Chat | None = None, service: Callable[[str, list[str]], list[tuple[int, float]]] | None = None) -> DataFrame:
    """A search result (id, content, embeddings, hit_rank) scored by the reranker that the settings choose, best first.

    results may come from vectors, from full text or from both. Without a model, or where the service fails, the fused ranks stay.
    """
    kind = rerank.choose(bool(settings.proxy_reranker), bool(settings.embedding_reranker), bool(settings.chat_reranker))
    fused = results.withColumn("relevance_score", 1.0 / (retrieval.RRF_K + F.col("hit_rank")))
    if kind == "service" and service is not None:
        out = with_service(fused, lambda texts: service(query, texts), lambda: fused)
    elif kind.startswith("embedding") and embedder is not None:
        out = rerank.by_embedding(fused, embedder.embed([query])[0])
        if kind == "embedding+rubric" and chat is not None:
            asked = out.withColumn("_prompt", formats.rerank_prompt(F.lit(query), F.coalesce("content", F.lit(""))))
            out = rerank.with_rubric(providers.answers(asked, "_prompt", "_answer", chat), "_answer", settings.rerank_weight).drop("_prompt", "_answer")
    else:
        out = fused
    return out.orderBy(F.desc("relevance_score"), "id")


class SearchAgent:
    """Rewrites the question, infers tags, searches, follows links both ways, and answers; every step has a fallback."""

    def __init__(self, engine: SearchEngine, chat: providers.Chat):
        self.engine, self.chat = engine, chat

    def _ask(self, prompt: str, fallback: str) -> str:
        try:
            return self.chat.ask(prompt).strip() or fallback
        except Exception:  # noqa: BLE001
            return fallback

    def chunks(self, question: str, tags: Sequence[str] = ()) -> DataFrame:
        query = self._ask(f"Rewrite as a search query: {question}", question)
        raw = self._ask(f"Tags for: {question}", "")
        spark = self.engine.store.spark
        inferred = spark.range(1).select(fx.parse_tags(F.lit(raw)).alias("t")).first()["t"]
        wanted = list(dict.fromkeys([*tags, *inferred]))
        try:
            hits = self.engine.hits(query, wanted)
            if wanted and hits.isEmpty():
                hits = self.engine.hits(query, tags)
        except Exception:  # noqa: BLE001
            log.exception("search failed")
            return spark.createDataFrame([], schema.CHUNK)
        return graph.expand(hits.select(*self.engine.store.chunks().columns), self.engine.store.chunks())

    def search(self, question: str, tags: Sequence[str] = ()) -> str:
        context = formats.context(self.chunks(question, tags)).first()["text"]
        return self._ask(f"Answer from these notes.\nQuestion: {question}\n{context}", NO_ANSWER)


class NoteTools:
    """Search, list, read and rename notes; what fails answers as callers expect."""

    def __init__(self, spark: SparkSession, root: str, store: ChunkStore, engine: SearchEngine, summariser: providers.Chat | None = None):
        self.spark, self.root, self.store, self.engine, self.summariser = spark, root, store, engine, summariser

    def _chunks(self, notes: DataFrame) -> DataFrame:
        """Chunks of notes, with a summary at position -1 of those that have enough of them."""
        own = notes.select("content", "source_path", "wikilink_name", "file_size", "modified_at", F.col("tags").alias("note_tags"), "metadata.title", "metadata.description", "metadata.source", F.col("id").alias("note"))
        chunks = chunking.chunks(own)
        if self.summariser is not None:
            asked = own.withColumn("_prompt", formats.summary_prompt(F.col("title"), F.col("description"), F.col("source_path"), F.col("content")))
            long = chunks.groupBy("source_path").count().where(F.col("count") >= sync.LEAST_CHUNKS).select("source_path")
            answered = providers.answers(asked.join(long, "source_path", "left_semi"), "_prompt", "_summary", self.summariser)
            summaries = answered.where("_summary is not null").withColumn("content", F.trim("_summary")).drop("_prompt", "_summary")
            chunks = sync.with_summaries(chunks, summaries)
        built = chunking.build(chunks, F.col("source_path"), F.col("note_tags"))
        return built.withColumn("id", F.concat("note", F.lit("_"), F.col("position").cast("string")))

    def synchronise(self) -> dict[str, int]:
        """The store follows the vault; files that can't be read are tried again the next time."""
        return self.store.synchronise(vault.listing(self.spark, self.root), self._chunks, vault.notes)

    def search(self, query: str, tags: Sequence[str] = (), path: str | None = None) -> list[dict]:
        """At most 500 characters of query; any failure gives an empty list."""
        if not 1 <= len(query) <= 500:
            return []
        try:
            return [r.asDict() for r in self.engine.search(query, tags, path).select(*ITEM).collect()]
        except Exception:  # noqa: BLE001
            log.exception("search failed")
            return []

    def list_files(self, folder: str = "") -> str:
        try:
            entries = [r["entry"] for r in vault.folder(vault.listing(self.spark, self.root), folder).collect()]
        except Exception as e:  # noqa: BLE001
            return f"Error listing files in {folder}: {e}"
        return "\n".join(entries) if entries else f"No files found in folder: {folder}"

    def read(self, name: str, offset: int = 0, limit: int | None = None) -> str:
        return vault.read_note(vault.listing(self.spark, self.root), name, offset, limit)

    def rename(self, old_path: str, new_path: str) -> int:
        changed = vault.rename_note(self.spark, self.root, old_path, new_path)
        self.synchronise()
        return changed
