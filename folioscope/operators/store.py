"""A chunk table as immutable snapshots of buckets: readers see a whole state, writers replace only the buckets they touch.

Rows lie in buckets by a hash of their source_path. root/_snapshots/<version>.json says for each bucket which folder under
root/data holds its chunks, its sources and its postings (the inverted index of each text column, sorted by term), and how
many chunks and tokens there are. A change writes new folders for the touched buckets, then creates the next version's
file, which must not exist yet: of two writers one creates it, the other begins anew on the state that it finds. So no
state is lost and the index always fits its chunks. Files go through Spark's file system, so the root may lie in any store
that Spark reaches and that creates files exclusively. Folders that the last two versions don't name are deleted.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope import schema
from folioscope.operators import retrieval, sync, windows
from folioscope.schema import Scope

Embedder = Callable[[DataFrame, str, str], DataFrame]
COLUMNS = Scope.ALL.value
LENGTHS = [f"length_{c}" for c in COLUMNS]
STORED = T.StructType([*schema.CHUNK.fields, *[T.StructField(c, T.IntegerType()) for c in LENGTHS]])
POSTINGS = T.StructType([T.StructField("term", T.StringType()), T.StructField("id", T.StringType()), T.StructField("length", T.IntegerType()), T.StructField("tf", T.LongType())])
SCHEMAS = {"chunks": STORED, "sources": schema.SOURCES, **{f"postings_{c}": POSTINGS for c in COLUMNS}}
TRIES, KEPT = 20, 2


class NotInitializedError(RuntimeError):
    """The store has no table yet."""


class ConflictError(RuntimeError):
    """Other writers changed the store each time this one was ready."""


def embedding_text(name: str = "wikilink_name", content: str = "content"):
    return F.concat(F.lit("Doc: "), F.col(name), F.lit(" Content:"), F.col(content))


class ChunkStore:
    def __init__(self, spark: SparkSession, root: str, embed: Embedder | None = None, dimensions: int | None = None, buckets: int = 16):
        """buckets: into how many parts a new table is split; some thousand rows to a bucket keep small changes cheap."""
        self.spark, self.root, self.embed, self.dimensions, self.buckets = spark, root.rstrip("/"), embed, dimensions, buckets

    # ---- snapshots ----

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path
        return path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _names(self, folder: str) -> list[str]:
        fs, path = self._fs()
        return sorted(s.getPath().getName() for s in fs.listStatus(path(folder))) if fs.exists(path(folder)) else []

    def snapshots(self) -> list[int]:
        return [int(n[1:-5]) for n in self._names(f"{self.root}/_snapshots") if n.endswith(".json") and n.startswith("v")]

    def _state(self, version: int) -> dict | None:
        """What a version's file says; None while it is being written."""
        fs, path = self._fs()
        stream = fs.open(path(f"{self.root}/_snapshots/v{version:010d}.json"))
        try:
            raw = bytes(stream.readAllBytes())
        finally:
            stream.close()
        try:
            return json.loads(raw)
        except ValueError:
            return None

    def _latest(self) -> tuple[int, dict]:
        for version in reversed(self.snapshots()):
            if (state := self._state(version)) is not None:
                return version, state
        raise NotInitializedError("call initialize() first")

    def _publish(self, version: int, state: dict) -> bool:
        """Creates the version's file; False if another writer was faster."""
        fs, path = self._fs()
        try:
            out = fs.create(path(f"{self.root}/_snapshots/v{version:010d}.json"), False)
        except Py4JJavaError as e:
            if "exist" in str(e.java_exception).lower():
                return False
            raise
        out.write(json.dumps(state).encode())
        out.close()
        return True

    def initialize(self) -> ChunkStore:
        """Opens the table, or makes an empty one."""
        if not self.snapshots():
            self._publish(1, {"buckets": self.buckets, "folders": {name: {} for name in SCHEMAS}, "sizes": {}})
        return self

    def _commit(self, change: Callable[[dict], tuple[DataFrame, DataFrame, list[int]] | None]) -> None:
        """change(state) gives the chunks and sources of the buckets that it touches, and these buckets; None for no change."""
        for _ in range(TRIES):
            version, state = self._latest()
            made = change(state)
            if made is None:
                return
            chunks, sources, touched = made
            data = uuid.uuid4().hex
            found = self._write(data, state["buckets"], chunks, sources)
            folders = {name: {b: f for b, f in old.items() if int(b) not in touched} | dict.fromkeys(found[name], data) for name, old in state["folders"].items()}
            sizes = {b: s for b, s in state["sizes"].items() if int(b) not in touched} | self._sizes(data, found["chunks"])
            if self._publish(version + 1, {"buckets": state["buckets"], "folders": folders, "sizes": sizes}):
                self._clean(version + 1)
                return
            fs, path = self._fs()
            fs.delete(path(f"{self.root}/data/{data}"), True)
        raise ConflictError(f"gave up after {TRIES} tries")

    def _bucket(self, n: int):
        return F.pmod(F.xxhash64("source_path"), F.lit(n).cast("long")).cast("int")

    def _write(self, data: str, n: int, chunks: DataFrame, sources: DataFrame) -> dict[str, list[str]]:
        """Writes the folders of a change; returns the buckets that each has rows of."""

        def put(rows: DataFrame, name: str, order: Sequence[str]) -> list[str]:
            # Rebalancing splits large buckets into several files and never makes empty ones.
            own = rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", *order)
            own.write.partitionBy("bucket").parquet(f"{self.root}/data/{data}/{name}")
            return [x.removeprefix("bucket=") for x in self._names(f"{self.root}/data/{data}/{name}") if x.startswith("bucket=")]

        lengths = {f"length_{c}": F.size(retrieval.tokens(F.col(c))) for c in COLUMNS}
        found = {"chunks": put(chunks.withColumns({**lengths, "bucket": self._bucket(n)}), "chunks", ["source_path", "position"])}
        found["sources"] = put(sources.withColumn("bucket", self._bucket(n)), "sources", ["source_path"])
        written = self._folders("chunks", dict.fromkeys(found["chunks"], data), STORED)
        for c in COLUMNS:
            own = retrieval.postings(written.withColumn("bucket", self._bucket(n)), c, "id", ["bucket"])
            found[f"postings_{c}"] = put(own, f"postings_{c}", ["term"])
        return found

    def _sizes(self, data: str, buckets: list[str]) -> dict[str, list[int]]:
        """By bucket the number of chunks, then of each column's tokens."""
        if not buckets:
            return {}
        rows = self.spark.read.parquet(f"{self.root}/data/{data}/chunks").groupBy("bucket").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in LENGTHS]).collect()
        return {str(r["bucket"]): [r["n"], *(int(r[c] or 0) for c in LENGTHS)] for r in rows}

    def _clean(self, version: int) -> None:
        """Deletes versions before the last KEPT ones, and the folders that only they name."""
        fs, path = self._fs()
        used = lambda v: {f for name in (self._state(v) or {"folders": {}})["folders"].values() for f in name.values()}
        old = [v for v in self.snapshots() if v <= version - KEPT]
        kept = {f for v in self.snapshots() if v > version - KEPT for f in used(v)}
        for v in old:
            for folder in used(v) - kept:
                fs.delete(path(f"{self.root}/data/{folder}"), True)
            fs.delete(path(f"{self.root}/_snapshots/v{v:010d}.json"), False)

    def _folders(self, name: str, folders: dict[str, str], of: T.StructType) -> DataFrame:
        paths = [f"{self.root}/data/{f}/{name}/bucket={b}" for b, f in sorted(folders.items())]
        return self.spark.read.schema(of).parquet(*paths) if paths else self.spark.createDataFrame([], of)

    def _read(self, name: str, state: dict | None = None, only: Sequence[int] | None = None) -> DataFrame:
        folders = (state or self._latest()[1])["folders"][name]
        return self._folders(name, {b: f for b, f in folders.items() if only is None or int(b) in only}, SCHEMAS[name])

    def chunks(self) -> DataFrame:
        return self._read("chunks").select(*schema.CHUNK.names)

    def sources(self) -> DataFrame:
        """(source_path, modified_at), empty notes included."""
        return self._read("sources")

    # ---- writing ----

    def _embedded(self, chunks: DataFrame) -> DataFrame:
        if "embeddings" in chunks.columns or self.embed is None:
            own = chunks if "embeddings" in chunks.columns else chunks.withColumn("embeddings", F.lit(None).cast("array<float>"))
        else:
            own = self.embed(chunks.withColumn("_text", embedding_text()), "_text", "embeddings").drop("_text")
        return own.select(*[F.col(f.name).cast(f.dataType) for f in schema.CHUNK])

    def _touched(self, paths: DataFrame, n: int) -> list[int]:
        return [r["b"] for r in paths.select(self._bucket(n).alias("b")).distinct().collect()]  # at most one row a bucket

    def store(self, chunks: DataFrame) -> None:
        """Appends chunks, embedded."""

        def change(state: dict):
            touched = self._touched(chunks, state["buckets"])
            own = self._embedded(chunks)
            listed = own.groupBy("source_path").agg(F.min("modified_at").alias("modified_at"))
            before = self._read("sources", state, touched)
            return self._read("chunks", state, touched).select(*schema.CHUNK.names).unionByName(own), before.unionByName(listed).groupBy("source_path").agg(F.min("modified_at").alias("modified_at")), touched

        self._commit(change)

    def delete(self, paths: Sequence[str]) -> None:
        gone = self.spark.createDataFrame([(p,) for p in paths], "source_path string")

        def change(state: dict):
            touched = self._touched(gone, state["buckets"])
            chunks = self._read("chunks", state, touched).select(*schema.CHUNK.names)
            return sync.delete(chunks, gone), sync.delete(self._read("sources", state, touched), gone), touched

        self._commit(change)

    def synchronise(self, listing: DataFrame, chunk: Callable[[DataFrame], DataFrame], read: Callable[[DataFrame], DataFrame] = lambda changed: changed) -> dict[str, int]:
        """One atomic step to the state of a listing (source_path, modified_at, ...).

        read() gets the rows that are new or newer and chunk() what came of it. Rows with an `error` are not chunked: their
        paths stay as they were, so the next step tries them again, and are counted as FAILED. Returns the number of paths
        for each action; nothing is written if nothing changed.
        """
        counts: dict[str, int] = {}

        def change(state: dict):
            counts.clear()
            actions = sync.plan(listing, self._read("sources", state)).persist()
            counts.update({r["action"]: r["count"] for r in actions.groupBy("action").count().collect()})
            if not set(counts) - {"KEEP"}:
                return None
            changed = listing.join(actions.where(F.col("action").isin("ADD", "REPLACE")), "source_path", "left_semi")
            notes = read(changed).persist()
            if "error" in notes.columns:
                failed = notes.where("error is not null").select("source_path")
                if n := failed.count():
                    counts["FAILED"] = n
                actions = actions.join(failed, "source_path", "left_anti")
                notes = notes.where("error is null").drop("error")
            acted = actions.where("action <> 'KEEP'")
            if acted.isEmpty():
                return None
            touched = self._touched(acted, state["buckets"])
            chunks = self._read("chunks", state, touched).select(*schema.CHUNK.names)
            sources = sync.delete(self._read("sources", state, touched), acted)
            listed = notes.select("source_path", F.col("modified_at").cast("double"))
            return sync.apply(chunks, actions, self._embedded(chunk(notes))), sources.unionByName(listed), touched

        self._commit(change)
        return counts

    def reindex(self) -> None:
        """Writes all buckets anew, as few files as their sizes allow, with their postings."""
        self._commit(lambda state: (self._read("chunks", state).select(*schema.CHUNK.names), self._read("sources", state), list(range(state["buckets"]))))

    # ---- reading ----

    def by_ids(self, ids: Sequence[str]) -> DataFrame:
        """Chunks of the ids; missing ones are left out."""
        return self.chunks().where(F.col("id").isin(list(ids))) if ids else self.chunks().limit(0)

    def sources_by_name(self, name: str) -> list[str]:
        rows = retrieval.sources_named(self.chunks(), name).orderBy("source_path").collect()
        return [r["source_path"] for r in rows]

    def full_text(self, query: str, k: int, scope: Scope = Scope.ALL, tags: Sequence[str] = (), path: str | None = None) -> DataFrame:
        """The k best chunks by BM25 (id, score, rank), from the postings of the query's terms: no text is read."""
        _, state = self._latest()
        terms = retrieval.query_terms(self.spark, query)
        filtered = bool(tags or path)
        held = retrieval.scoped(self._read("chunks", state), tags, path)
        parts = []
        for place, c in enumerate(COLUMNS):
            if c not in scope.value:
                continue
            hits = self._read(f"postings_{c}", state).where(F.col("term").isin(terms))
            if filtered:
                hits = hits.join(held.select("id"), "id", "left_semi")
                sizes = held.agg(F.count("*").alias("n"), F.avg(f"length_{c}").alias("mean"))
            else:
                n = sum(s[0] for s in state["sizes"].values())
                sizes = self.spark.range(1).select(F.lit(n).alias("n"), F.lit(sum(s[1 + place] for s in state["sizes"].values()) / max(1, n)).alias("mean"))
            parts.append(retrieval.weighed(hits, sizes, "id"))
        return retrieval.best(retrieval.summed(parts, "id"), k, "id")

    def search(self, query: str, vector: Sequence[float], limit: int = 5, tags: Sequence[str] = (), path: str | None = None, scope: Scope = Scope.ALL) -> DataFrame:
        """Chunks in the order of their fused rank, with hit_rank and a null relevance_score."""
        own = retrieval.scoped(self.chunks(), tags, path).where(F.col("embeddings").isNotNull())
        found = retrieval.fuse(retrieval.knn(own, vector, limit), self.full_text(query, limit, scope, tags, path), limit)
        joined = self.chunks().join(F.broadcast(found.select("id", F.col("rank").alias("hit_rank"))), "id")
        return joined.withColumn("relevance_score", F.lit(None).cast("double")).orderBy("hit_rank")

    def search_windows(self, query: str, vector: Sequence[float], limit: int = 25, reach: int = 1, least: float = 0.5, **filters) -> DataFrame:
        """Search, score floor, then merged neighbour windows in order of their first hits."""
        hits = retrieval.min_score(self.search(query, vector, limit, **filters), least)
        as_hits = hits.select(F.regexp_replace("id", r"_[^_]*$", "").alias("document_id"), "position", "hit_rank", "relevance_score")
        stored = self.chunks().select(F.regexp_replace("id", r"_[^_]*$", "").alias("document_id"), "position", "offset", "content", "tags", "outgoing_links")
        return windows.assemble(as_hits, stored, reach).orderBy("hit_rank")
