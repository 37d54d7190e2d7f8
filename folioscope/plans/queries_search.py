"""Queries of retrieval, reranking, windows, synchronisation, the link graph and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import text as fx
from folioscope.operators import evaluate, formats, graph, rerank, retrieval, sync, windows
from folioscope.plans.tables import HITS, NOTES, TURNS, hits, notes, table, turns
from folioscope.schema import Scope

QUERIES: dict = {}
SQL: dict[str, str] = {}
QUERY = "the and of thing"
TERMS = ["the", "and", "of", "thing"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("embeddings"), "label")


def query_vector(spark, d) -> list[float]:
    return list(table(spark, d, "embeddings").where("vec_id = 0").first()["embedding"])


_Q = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"
_L2 = f"list_distance(CAST(embedding AS DOUBLE[]), CAST({_Q} AS DOUBLE[]))"
_COS = f"list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST({_Q} AS DOUBLE[]))"


@query(f"SELECT vec_id AS id, round(d, 6) AS distance, CAST(row_number() OVER (ORDER BY d, vec_id) AS INTEGER) AS rank FROM (SELECT vec_id, {_L2} AS d FROM embeddings ORDER BY d, vec_id LIMIT 20)")
def knn_l2_topk(spark, d):
    return retrieval.knn(vectors(spark, d), query_vector(spark, d), 20).withColumn("distance", F.round("distance", 6))


@query(f"SELECT vec_id AS id, round(s, 6) AS score, CAST(row_number() OVER (ORDER BY s DESC, vec_id) AS INTEGER) AS rank FROM (SELECT vec_id, {_COS} AS s FROM embeddings ORDER BY s DESC, vec_id LIMIT 20)")
def knn_cosine_topk(spark, d):
    return retrieval.knn(vectors(spark, d), query_vector(spark, d), 20, metric="cosine").withColumn("score", F.round("score", 6))


@query(f"SELECT vec_id AS id, round(d, 6) AS distance, CAST(row_number() OVER (ORDER BY d, vec_id) AS INTEGER) AS rank FROM (SELECT vec_id, {_L2} AS d FROM embeddings WHERE label = 3 ORDER BY d, vec_id LIMIT 10)")
def knn_filtered(spark, d):
    return retrieval.knn(vectors(spark, d).where("label = 3"), query_vector(spark, d), 10).withColumn("distance", F.round("distance", 6))


_TOK = "list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[\\p{{L}}\\p{{N}}]+'), lambda t: length(t) <= 30)"


@query(f"SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK.format(c='text')}) AS term FROM documents) GROUP BY doc_id, term) GROUP BY term")
def token_df_tf(spark, d):
    return retrieval.term_statistics(table(spark, d, "documents"), "text")


def _bm25_sql(table_name: str, column: str, key: str = "doc_id") -> str:
    terms = ", ".join(f"'{t}'" for t in TERMS)
    return f"""(WITH t AS (SELECT {key} AS id, {_TOK.format(c=column)} AS toks FROM {table_name}), s AS (SELECT count(*) AS n, avg(len(toks)) AS mean FROM t),
h AS (SELECT id, len(toks) AS length, term, count(*) AS tf FROM (SELECT id, toks, unnest(toks) AS term FROM t) WHERE term IN ({terms}) GROUP BY id, len(toks), term),
f AS (SELECT term, count(*) AS df FROM h GROUP BY term)
SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 9) AS score FROM h JOIN f USING (term) CROSS JOIN s GROUP BY id)"""


_BM25 = _bm25_sql("documents", "text")


@query(f"SELECT id AS doc_id, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank FROM (SELECT * FROM {_BM25} ORDER BY score DESC, id LIMIT 25)")
def bm25_topk(spark, d):
    found = retrieval.bm25(table(spark, d, "documents"), QUERY, ["text"], "doc_id").orderBy(F.desc("score"), "doc_id").limit(25)
    return retrieval.ranked(found, "score", "doc_id", True).withColumn("score", F.round("score", 6))


@query(f"WITH {NOTES}, u AS (SELECT * FROM {_bm25_sql('notes', 'content')} UNION ALL SELECT * FROM {_bm25_sql('notes', 'title')}) SELECT id AS doc_id, round(sum(score), 6) AS score FROM u GROUP BY id")
def bm25_multi_column(spark, d):
    return retrieval.bm25(notes(spark, d), QUERY, ["content", "title"], "doc_id").withColumn("score", F.round("score", 6))


_RANKED = f"""v AS (SELECT vec_id AS id, row_number() OVER (ORDER BY {_L2}, vec_id) AS vr FROM embeddings), f AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS tr FROM {_BM25}),
r AS (SELECT id, vr, tr, coalesce(1.0::DOUBLE / (60 + vr), 0) + coalesce(1.0::DOUBLE / (60 + tr), 0) AS fused FROM (SELECT * FROM v WHERE vr <= 30) a FULL JOIN (SELECT * FROM f WHERE tr <= 30) b USING (id))"""


def _fused(spark, d, k: int):
    found = retrieval.full_text(table(spark, d, "documents").withColumnRenamed("text", "content").withColumnRenamed("doc_id", "id"), QUERY, 30)
    return retrieval.fuse(retrieval.knn(vectors(spark, d), query_vector(spark, d), 30), found, k)


@query(f"WITH {_RANKED} SELECT id, CAST(vr AS INTEGER) AS vector_rank, CAST(tr AS INTEGER) AS text_rank, round(fused, 6) AS fused, CAST(row_number() OVER (ORDER BY fused DESC, id) AS INTEGER) AS rank FROM r ORDER BY rank LIMIT 20")
def rrf_hybrid_topk(spark, d):
    return _fused(spark, d, 20).withColumn("fused", F.round("fused", 6))


@query(f"""WITH {_RANKED}, h AS (SELECT id, row_number() OVER (ORDER BY fused DESC, id) AS hit_rank FROM r ORDER BY hit_rank LIMIT 20),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS position FROM documents),
b AS (SELECT doc_id, min(position) AS p FROM l WHERE regexp_matches(lower(content), '\\bthe\\b|\\band\\b') GROUP BY doc_id)
SELECT CAST(id AS VARCHAR) AS document_id, CAST(hit_rank AS INTEGER) AS hit_rank, CAST(min(l.position) AS INTEGER) AS position, CAST(max(l.position) AS INTEGER) AS window_end, string_agg(content, chr(10) || chr(10) ORDER BY l.position) AS content
FROM h JOIN b ON b.doc_id = h.id JOIN l ON l.doc_id = h.id AND l.position BETWEEN greatest(0, p - 1) AND p + 1 GROUP BY id, hit_rank""")
def hybrid_search(spark, d):
    """Full text and vectors fused, the best documents' first matching lines as hits, and merged neighbour windows."""
    best = _fused(spark, d, 20).select(F.col("id").alias("doc_id"), F.col("rank").alias("hit_rank"))
    # The 20 texts are exchanged once; the hits and the stored lines both read that exchange.
    texts = table(spark, d, "documents").select("doc_id", "text").join(F.broadcast(best), "doc_id").repartition("doc_id")
    lines = texts.select("doc_id", "hit_rank", F.posexplode(F.split("text", "\n")).alias("position", "content"))
    own = lines.where(F.lower("content").rlike(r"\bthe\b|\band\b")).groupBy("doc_id", "hit_rank").agg(F.min("position").alias("position"))
    found = own.select(F.col("doc_id").cast("string").alias("document_id"), "position", "hit_rank", F.lit(None).cast("double").alias("relevance_score"))
    empty = F.array().cast("array<string>")
    stored = lines.select(F.col("doc_id").cast("string").alias("document_id"), "position", F.col("position").alias("offset"), "content", empty.alias("tags"), empty.alias("outgoing_links"))
    return windows.assemble(found, stored).select("document_id", "hit_rank", "position", "window_end", "content")


# ---- reranking ----

_SCORED = f"scored AS (SELECT vec_id AS id, label, embedding, {_COS} AS c FROM embeddings)"


@query(f"WITH {_SCORED} SELECT id, label, round(CASE WHEN max(c) OVER w > min(c) OVER w THEN (c - min(c) OVER w) / (max(c) OVER w - min(c) OVER w) ELSE 1.0 END, 6) AS relevance_score FROM scored WINDOW w AS (PARTITION BY label)")
def minmax_rerank(spark, d):
    return rerank.by_embedding(vectors(spark, d), query_vector(spark, d), by=["label"]).select("id", "label", F.round("relevance_score", 6).alias("relevance_score"))


_ANSWER = "CASE id % 5 WHEN 0 THEN 'It is PERFECT' WHEN 1 THEN 'good' WHEN 2 THEN 'some relevance' WHEN 3 THEN 'bad' ELSE NULL END"


@query(f"""WITH {_SCORED}, m AS (SELECT id, least(greatest((c - min(c) OVER ()) / (max(c) OVER () - min(c) OVER ()), 0), 1) AS e, {_ANSWER} AS a FROM scored)
SELECT id, round(0.5 * CASE WHEN a ILIKE '%perfect%' THEN 1.0 WHEN a ILIKE '%good%' THEN 0.75 WHEN a ILIKE '%some%' THEN 0.5 WHEN a ILIKE '%bad%' THEN 0.25 ELSE 0.0 END + 0.5 * e, 6) AS relevance_score FROM m""")
def weighted_fusion_rerank(spark, d):
    own = rerank.by_embedding(vectors(spark, d), query_vector(spark, d)).withColumn("answer", F.expr(_ANSWER))
    return rerank.with_rubric(own, "answer").select("id", F.round("relevance_score", 6).alias("relevance_score"))


_RUBRIC = "CASE doc_id % 6 WHEN 0 THEN 'Perfect match' WHEN 1 THEN 'somewhat GOOD' WHEN 2 THEN 'some' WHEN 3 THEN 'bad, but perfect' WHEN 4 THEN text ELSE '' END"


@query(f"""SELECT doc_id, CASE WHEN a ILIKE '%perfect%' THEN 1.0 WHEN a ILIKE '%good%' THEN 0.75 WHEN a ILIKE '%some%' THEN 0.5 WHEN a ILIKE '%bad%' THEN 0.25 ELSE 0.0 END::DOUBLE AS score FROM (SELECT doc_id, {_RUBRIC} AS a FROM documents)""")
def rubric_score(spark, d):
    return table(spark, d, "documents").select("doc_id", fx.rubric_score(F.expr(_RUBRIC)).alias("score"))


@query("""WITH l AS (SELECT unnest([7, 3, 999999, 7, 12, 0, 3]) AS doc_id, generate_subscripts([7, 3, 999999, 7, 12, 0, 3], 1) - 1 AS p)
SELECT doc_id, CAST(min(p) AS INTEGER) AS position_in_list, any_value(lang) AS lang FROM l JOIN documents USING (doc_id) GROUP BY doc_id""")
def listwise_select(spark, d):
    ids = spark.createDataFrame([([7, 3, 999999, 7, 12, 0, 3],)], "ids array<long>")
    return rerank.by_list(table(spark, d, "documents").select("doc_id", "lang"), ids, "doc_id").select("doc_id", "position_in_list", "lang")


@query("SELECT d.doc_id, coalesce(s.score, 0.0)::DOUBLE AS relevance_score FROM documents d LEFT JOIN (VALUES (0, 0.9), (3, 0.1), (7, 0.5), (50, 1.0)) AS s(i, score) ON s.i = d.doc_id")
def score_backmap(spark, d):
    scores = spark.createDataFrame([(0, 0.9), (3, 0.1), (7, 0.5), (50, 1.0)], "index long, score double")
    own = table(spark, d, "documents").select(F.col("doc_id").alias("index"), F.col("doc_id").alias("id"))
    return rerank.by_service(own, scores).select(F.col("id").alias("doc_id"), "relevance_score")


@query(f"WITH {HITS}, k AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY hit_rank, position) AS n FROM hits WHERE coalesce(relevance_score, 1.0) >= 0.5) SELECT document_id, position, hit_rank FROM k WHERE n = 1")
def min_score_dedupe(spark, d):
    own = retrieval.min_score(hits(spark, d), 0.5).withColumn("order", F.struct("hit_rank", "position"))
    return retrieval.first_of_each(own, "document_id", "order").select("document_id", "position", "hit_rank")


# ---- windows ----


@query(f"WITH {HITS} SELECT document_id, position, CAST(greatest(0, position - 1) AS INTEGER) AS start, CAST(position + 1 AS INTEGER) AS stop FROM hits")
def neighbor_windows(spark, d):
    return windows.neighbour_windows(hits(spark, d)).select("document_id", "position", "start", "stop")


_ISLANDS = f"""{HITS}, w AS (SELECT document_id, greatest(0, position - 1) AS start, position + 1 AS stop FROM hits),
m AS (SELECT *, CASE WHEN start > max(stop) OVER (PARTITION BY document_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS fresh FROM w),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY document_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM m),
islands AS (SELECT document_id, CAST(min(start) AS INTEGER) AS start, CAST(max(stop) AS INTEGER) AS stop FROM i GROUP BY document_id, island)"""


@query(f"WITH {_ISLANDS} SELECT * FROM islands")
def window_merge(spark, d):
    return windows.merged_windows(windows.neighbour_windows(hits(spark, d)))


@query(f"""WITH {_ISLANDS}, {TURNS}, f AS (SELECT document_id, start, stop, min(hit_rank) AS hit_rank, max(relevance_score) AS relevance_score FROM hits JOIN islands USING (document_id) WHERE position BETWEEN start AND stop GROUP BY ALL)
SELECT f.document_id, f.document_id || '_' || min(t.position) AS id, string_agg(t.content, chr(10) || chr(10) ORDER BY t.position) AS content, CAST(min(t.position) AS INTEGER) AS position, CAST(max(t.position) AS INTEGER) AS window_end,
  CAST(min(t."offset") AS INTEGER) AS "offset", array_to_string(list_sort(list_distinct(flatten(list(t.tags)))), '|') AS tags, CAST(relevance_score AS DOUBLE) AS relevance_score, hit_rank
FROM f JOIN turns t ON t.document_id = f.document_id AND t.position BETWEEN start AND stop GROUP BY f.document_id, start, stop, hit_rank, relevance_score""")
def window_assemble(spark, d):
    out = windows.assemble(hits(spark, d), turns(spark, d))
    return out.select("document_id", "id", "content", "position", "window_end", "offset", F.array_join("tags", "|").alias("tags"), "relevance_score", "hit_rank")


# ---- synchronisation ----

_SNAPSHOTS = f"""{NOTES}, listing AS (SELECT source_path, CASE lang WHEN 'en' THEN modified_at + 1 WHEN 'de' THEN modified_at - 1 ELSE modified_at END AS now FROM notes WHERE source <> 'src3'),
stored AS (SELECT source_path, modified_at AS before FROM notes WHERE source <> 'src4'),
plan AS (SELECT source_path, CASE WHEN before IS NULL THEN 'ADD' WHEN now IS NULL THEN 'DELETE' WHEN now > before THEN 'REPLACE' ELSE 'KEEP' END AS action FROM listing FULL JOIN stored USING (source_path))"""


def _snapshots(spark, d):
    """One folder is new, one is gone; English notes are newer than stored, German ones older."""
    own = notes(spark, d)
    shift = F.when(F.col("lang") == "en", 1).when(F.col("lang") == "de", -1).otherwise(0)
    listing = own.where("source <> 'src3'").withColumn("modified_at", F.col("modified_at") + shift)
    stored = own.where("source <> 'src4'")
    return listing, stored


@query(f"WITH {_SNAPSHOTS} SELECT * FROM plan")
def sync_plan(spark, d):
    listing, stored = _snapshots(spark, d)
    return sync.plan(listing, sync.stored_sources(stored))


@query(f"""WITH {_SNAPSHOTS} SELECT source_path, before AS modified_at FROM stored WHERE source_path IN (SELECT source_path FROM plan WHERE action = 'KEEP')
UNION ALL SELECT source_path, now FROM listing WHERE source_path IN (SELECT source_path FROM plan WHERE action IN ('ADD', 'REPLACE'))""")
def sync_apply(spark, d):
    listing, stored = _snapshots(spark, d)
    actions = sync.plan(listing, sync.stored_sources(stored))
    columns = ["source_path", "modified_at"]
    return sync.apply(stored.select(*columns), actions, listing.select(*columns))


@query(f"WITH {TURNS}, c AS (SELECT document_id, count(*) AS n FROM turns GROUP BY document_id) SELECT document_id, position, content FROM turns UNION ALL SELECT document_id, -1, 'about ' || document_id FROM c WHERE n > 2")
def summary_union(spark, d):
    chunks = turns(spark, d).select(F.col("document_id").alias("source_path"), "position", "offset", "content")
    summaries = chunks.select("source_path").distinct().withColumn("content", F.concat(F.lit("about "), F.col("source_path")))
    return sync.with_summaries(chunks, summaries).select(F.col("source_path").alias("document_id"), "position", "content")


# ---- graph ----

_GRAPH = f"{NOTES}, g AS (SELECT doc_id AS id, wikilink_name, source_path, source, lang, [source, 'n' || (doc_id * 7 % 50), 'n' || (doc_id * 3 % 50)] AS links FROM notes), hit AS (SELECT * FROM g WHERE source = 'src5' AND lang = 'de')"


def _graph(spark, d):
    i = F.col("doc_id")
    links = F.array("source", F.concat(F.lit("n"), (i * 7 % 50).cast("string")), F.concat(F.lit("n"), (i * 3 % 50).cast("string")))
    own = notes(spark, d).select(i.alias("id"), "wikilink_name", "source_path", "source", "lang", links.alias("outgoing_links"))
    return own.where("source = 'src5' and lang = 'de'"), own


@query(f"WITH {_GRAPH} SELECT id, wikilink_name FROM g WHERE wikilink_name IN (SELECT unnest(links) FROM hit)")
def outgoing_neighbors(spark, d):
    return graph.outgoing(*_graph(spark, d)).select("id", "wikilink_name")


@query(f"WITH {_GRAPH} SELECT id, source_path FROM g WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT unnest(links) AS l FROM hit) WHERE starts_with(source_path, l))")
def outgoing_by_path(spark, d):
    return graph.outgoing_by_path(*_graph(spark, d)).select("id", "source_path")


@query(f"WITH {_GRAPH} SELECT id, wikilink_name FROM g WHERE EXISTS (SELECT 1 FROM hit WHERE list_contains(g.links, hit.wikilink_name))")
def incoming_neighbors(spark, d):
    return graph.incoming(*_graph(spark, d)).select("id", "wikilink_name")


@query(f"""WITH {_GRAPH} SELECT DISTINCT id FROM (SELECT id FROM hit UNION ALL SELECT id FROM g WHERE wikilink_name IN (SELECT unnest(links) FROM hit)
UNION ALL SELECT id FROM g WHERE EXISTS (SELECT 1 FROM hit WHERE list_contains(g.links, hit.wikilink_name)))""")
def graph_union(spark, d):
    return graph.expand(*_graph(spark, d)).select("id")


@query(f"WITH {_GRAPH} SELECT wikilink_name, count(*) AS n_targets FROM (SELECT DISTINCT wikilink_name, unnest(links) AS target FROM g) GROUP BY wikilink_name")
def link_degrees(spark, d):
    return graph.edges(_graph(spark, d)[1]).groupBy("wikilink_name").agg(F.count("*").alias("n_targets"))


# ---- evaluation and formats ----

_WORDS = "['the', 'Und', 'que', 'apache']"
_UNWANTED = "['license', 'xyz']"


@query(f"""WITH t AS (SELECT doc_id, len(list_filter({_WORDS}, lambda w: contains(lower(text), lower(w)))) / 4.0 AS p, 1 - len(list_filter({_UNWANTED}, lambda w: contains(lower(text), lower(w)))) / 2.0 AS r FROM documents)
SELECT doc_id, round(CAST(p AS DOUBLE), 6) AS precision, round(CAST(r AS DOUBLE), 6) AS recall, round(CAST(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS DOUBLE), 6) AS f_score FROM t""")
def word_precision_recall(spark, d):
    words, unwanted = F.array(*[F.lit(w) for w in ("the", "Und", "que", "apache")]), F.array(F.lit("license"), F.lit("xyz"))
    p, r = evaluate.precision(F.col("text"), words), evaluate.recall(F.col("text"), unwanted)
    return table(spark, d, "documents").select("doc_id", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(evaluate.f_score(p, r), 6).alias("f_score"))


@query("""WITH r AS (SELECT label AS query, vec_id AS id, row_number() OVER (PARTITION BY label ORDER BY (vec_id * 37) % 101 DESC, vec_id) AS n, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS e FROM embeddings),
g AS (SELECT query, list(id ORDER BY n) FILTER (WHERE n <= 5) AS got, list(id ORDER BY e) FILTER (WHERE e <= 5) AS ids FROM r GROUP BY query)
SELECT query, len(list_filter([1, 2, 3, 4, 5], lambda i: ids[i] = got[i])) / 5.0::DOUBLE AS position_accuracy, len(list_intersect(ids, got)) / 5.0::DOUBLE AS overlap_accuracy FROM g""")
def topk_overlap(spark, d):
    from pyspark.sql import Window

    own = table(spark, d, "embeddings").select(F.col("label").alias("query"), F.col("vec_id").alias("id"), (F.col("vec_id") * 37 % 101).alias("score"))
    first = own.withColumn("e", F.row_number().over(Window.partitionBy("query").orderBy("id"))).where("e <= 5").groupBy("query").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return evaluate.rank_agreement(first, own)


_TRIMMED = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
_SHORT = "CASE WHEN length({t}) > {n} THEN substr({t}, 1, {n}) || '...' ELSE {t} END"


@query(f"""WITH {NOTES} SELECT doc_id, '# Result ' || doc_id || ' (Score: ' || printf('%.3f', doc_id / 1000.0) || ') ' || chr(10) || '**Source:** `' || source_path || '`' || chr(10) || '**Content:**' || chr(10) || '```' || chr(10)
  || {_SHORT.format(t=_TRIMMED, n=1000)} || chr(10) || '```' || chr(10) || '**Tags:** #' || lang || ', #' || source || chr(10) || '**Links:** [[' || wikilink_name || ']]' || chr(10) AS item FROM notes""")
def markdown_format(spark, d):
    own = notes(spark, d)
    return own.select("doc_id", formats.markdown_item(F.col("doc_id"), F.col("doc_id") / 1000.0, F.col("source_path"), F.col("text"), F.col("tags"), F.array("wikilink_name")).alias("item"))


@query(f"""WITH {NOTES}, best AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM {_BM25} ORDER BY r LIMIT 8),
items AS (SELECT r, '**' || r || '.** Source: ' || source_path || ')' || chr(10) || '   ' || {_SHORT.format(t=_TRIMMED, n=150)} || chr(10) || 'Tags: #' || lang || ', #' || source || chr(10) AS item FROM best JOIN notes ON doc_id = id)
SELECT string_agg(item, chr(10) ORDER BY r) FILTER (WHERE r <= 3) || chr(10) || '... and 5 more results' AS text FROM items""")
def compact_format(spark, d):
    """The eight best documents of a search as a compact list."""
    none, own = F.array().cast("array<string>"), notes(spark, d)
    rows = retrieval.best(retrieval.bm25(own, QUERY, ["text"], "doc_id"), 8, "doc_id").join(own, "doc_id")
    items = rows.select("rank", formats.compact_item(F.col("rank"), F.lit(None).cast("double"), F.col("source_path"), F.col("text"), F.col("tags"), none).alias("item"))
    return formats.compact(items, "item", "rank")


@query(f"SELECT doc_id, {_TOK.format(c='text')}[1] AS first_token, len({_TOK.format(c='text')}) AS n_tokens FROM documents")
def scope_tokens(spark, d):
    column = Scope.CONTENT.value[0]
    own = table(spark, d, "documents").withColumnRenamed("text", column).select("doc_id", retrieval.tokens(F.col(column)).alias("t"))
    return own.select("doc_id", F.get("t", F.lit(0)).alias("first_token"), F.size("t").cast("long").alias("n_tokens"))
