"""Queries of URLs, pages, fetching, research and streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from folioscope.functions import htmltext, urls
from folioscope.functions import text as fx
from folioscope.plans import research
from folioscope.plans.tables import table
from folioscope.sources import web
from folioscope.streaming import poll

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: URLs of each kind around those of the pages; SQL that both engines read.
URL = """CASE page_id % 13 WHEN 0 THEN 'https://arxiv.org/abs/2301.' || page_id WHEN 1 THEN 'http://export.arxiv.org/pdf/2301.' || page_id || 'v2.pdf' WHEN 2 THEN 'https://en.wikipedia.org/wiki/Page_' || page_id
  WHEN 3 THEN 'https://www.reddit.com/r/x/comments/' || page_id || '/' WHEN 4 THEN 'https://github.com/a/b' || page_id WHEN 5 THEN 'https://github.com/a/b/blob/main/x/' || page_id || '.py' WHEN 6 THEN 'https://github.com/a'
  WHEN 7 THEN 'https://Example.COM:8080/p?q=' || page_id WHEN 8 THEN 'ftp://host/' || page_id WHEN 9 THEN 'not a url ' || page_id WHEN 10 THEN 'https://notarxiv.organic/abs/1' ELSE url END"""
_KINDS = rf"""u AS (SELECT page_id, url, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)) AS h, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS p FROM (SELECT page_id, {URL} AS url FROM pages)),
k AS (SELECT *, CASE WHEN NOT regexp_matches(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+') THEN 'invalid' WHEN h = 'arxiv.org' OR h LIKE '%.arxiv.org' THEN 'arxiv' WHEN contains(h, '.wikipedia.org') THEN 'wikipedia'
  WHEN h = 'reddit.com' OR h LIKE '%.reddit.com' THEN 'reddit' WHEN h = 'github.com' AND contains(p, '/blob/') THEN 'github_blob' WHEN h = 'github.com' AND len(list_filter(string_split(p, '/'), lambda x: x <> '')) = 2 THEN 'github_repo' ELSE 'page' END AS kind FROM u)"""


def _urls(spark, d):
    return table(spark, d, "pages").select("page_id", F.expr(URL).alias("url"))


@query(f"WITH {_KINDS} SELECT page_id, kind, h AS host FROM k")
def url_classify(spark, d):
    return _urls(spark, d).select("page_id", urls.kind(F.col("url")).alias("kind"), urls.host(F.col("url")).alias("host"))


@query(rf"""WITH {_KINDS} SELECT page_id, CASE kind WHEN 'arxiv' THEN 'https://arxiv.org/html/' || regexp_extract(p, '^/(?:abs|pdf|html)/([^/]+?)(?:\.pdf)?(?:/|$)', 1) WHEN 'wikipedia' THEN 'https://' || h || '/w/index.php?title=' || regexp_replace(p, '^/wiki/', '') || '&action=raw'
  WHEN 'reddit' THEN regexp_replace(url, '/+$', '') || '.json' WHEN 'github_blob' THEN 'https://raw.githubusercontent.com' || replace(p, '/blob/', '/') WHEN 'github_repo' THEN 'https://raw.githubusercontent.com' || p || '/main/README.md' WHEN 'page' THEN url END AS first_candidate FROM k""")
def url_rewrite(spark, d):
    return _urls(spark, d).select("page_id", F.get(urls.fetch_candidates(F.col("url")), F.lit(0)).alias("first_candidate"))


@query(rf"WITH {_KINDS} SELECT page_id, regexp_extract(p, '^/(?:abs|pdf|html)/([^/]+?)(?:\.pdf)?(?:/|$)', 1) AS paper FROM k")
def arxiv_id(spark, d):
    return _urls(spark, d).select("page_id", urls.arxiv_id(F.col("url")).alias("paper"))


@query(r"""SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)) AS host,
  length(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '<[^>]*>', '', 'g')) AS text_chars FROM pages""")
def html_title_text(spark, d):
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</(script|style)>", ""), r"<[^>]*>", "")
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1).alias("title"), urls.host(F.col("url")).alias("host"), F.length(bare).cast("long").alias("text_chars"))


@query("SELECT page_id, regexp_matches(lower(ltrim(html)), '^(<!doctype html|<html|<head|<body)') AS is_html, starts_with(html, '%PDF-') AS is_pdf FROM pages")
def html_sniff(spark, d):
    return table(spark, d, "pages").select("page_id", fx.looks_like_html("html").alias("is_html"), fx.looks_like_pdf("html").alias("is_pdf"))


@query()
def html_markdown(spark, d):
    return table(spark, d, "pages").select("page_id", htmltext.markdown(F.col("html")).alias("markdown"))


#: Documents as MediaWiki markup; SQL that both engines read.
_WIKI = """'== ' || source || ' ==' || chr(10) || '=== Deep ' || lang || ' ===  ' || chr(10) || '* one ' || chr(39) || chr(39) || chr(39) || 'bold' || chr(39) || chr(39) || chr(39) || ' and ' || chr(39) || chr(39) || 'slanted' || chr(39) || chr(39)
  || chr(10) || '** two<ref name=x>gone</ref>' || chr(10) || '{{tpl|x}}[[Page ' || doc_id || '|shown]] [[Other]] [https://x.org site]<ref name=y/>' || chr(10) || text"""
_QUOTE = "' || chr(39) || '"


def _wiki_sql() -> str:
    """The replacements of markup, nested in their order."""
    sql = _WIKI
    steps = [(x, "") for x in fx.WIKI_DROPPED] + [(rf"(?m)^={{{n}}}\s*(.*?)\s*={{{n}}}\s*$", "#" * (n - 1) + r" \1") for n in range(6, 1, -1)]
    # RE2 has no lookahead: a bullet is followed by anything but another one.
    steps += [(x.replace("(?d)", ""), y.replace("$1", r"\1")) for x, y in fx.WIKI_INLINE[:3]] + [(r"(?m)^\*(?:\s|([^*\s]))", r"- \1")]
    for pattern, becomes in [*steps, (r"^\s+|\s+$", "")]:
        sql = f"regexp_replace({sql}, '" + pattern.replace("'", "''") + f"', '{becomes}', 'g')"
    return sql


@query(f"SELECT doc_id, {_wiki_sql()} AS markdown FROM documents")
def wiki_to_markdown(spark, d):
    return table(spark, d, "documents").select("doc_id", fx.mediawiki(F.expr(_WIKI)).alias("markdown"))


_TYPE = "CASE page_id % 9 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN 'application/pdf' WHEN 2 THEN 'image/png' WHEN 3 THEN 'Text/Plain' WHEN 4 THEN 'application/json' WHEN 5 THEN 'text/markdown;x=y' ELSE '' END"
_BODY = "CASE WHEN page_id % 9 = 6 THEN '%PDF-1.7 ' || page_id WHEN page_id % 18 = 7 THEN ' ' WHEN page_id % 18 = 16 THEN 'words ' || page_id ELSE '  ' || html END"


@query(f"""WITH a AS (SELECT page_id, lower(trim(split_part({_TYPE}, ';', 1))) AS kind, {_BODY} AS body FROM pages)
SELECT page_id, CASE WHEN kind IN ('text/html', 'application/xhtml+xml') THEN 'html' WHEN kind = 'application/pdf' THEN 'pdf' WHEN kind IN ('text/plain', 'text/markdown') THEN 'text' WHEN kind <> '' THEN 'unsupported' WHEN starts_with(body, '%PDF-') THEN 'pdf'
  WHEN regexp_matches(lower(ltrim(body)), '^(<!doctype html|<html|<head|<body)') THEN 'html' WHEN trim(body) <> '' THEN 'text' ELSE 'unsupported' END AS extractor FROM a""")
def content_type_dispatch(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.expr(_TYPE).alias("content_type"), F.expr(_BODY).alias("body"))
    return rows.select("page_id", web.dispatch(F.col("content_type"), F.col("body"), F.lit("")).alias("extractor"))


_STATUS = "CASE event_id % 7 WHEN 0 THEN 200 WHEN 1 THEN 204 WHEN 2 THEN 301 WHEN 3 THEN 404 WHEN 4 THEN 429 WHEN 5 THEN 503 ELSE 0 END"


@query(f"""SELECT event_id, CASE WHEN event_id % 14 = 6 THEN 'ERROR: request timeout' WHEN {_STATUS} BETWEEN 400 AND 499 THEN 'ERROR: http code 4xx' WHEN NOT {_STATUS} BETWEEN 200 AND 299 THEN 'ERROR: unsupported content' END AS message FROM events""")
def error_map(spark, d):
    return table(spark, d, "events").select("event_id", fx.error_message(F.expr(_STATUS), F.col("event_id") % 14 == 6).alias("message"))


@query("""WITH a AS (SELECT user_id, event_id AS attempt, CASE WHEN event_type IN ('click', 'view') THEN 'page ' || event_id ELSE 'ERROR: ' || event_type END AS text FROM events)
SELECT user_id, coalesce(min_by(text, attempt) FILTER (WHERE NOT starts_with(text, 'ERROR')), max_by(text, attempt)) AS text FROM a GROUP BY user_id""")
def fetch_first_success(spark, d):
    text = F.when(F.col("event_type").isin("click", "view"), F.concat(F.lit("page "), F.col("event_id").cast("string"))).otherwise(F.concat(F.lit("ERROR: "), F.col("event_type")))
    return web.first_success(table(spark, d, "events").select("user_id", F.col("event_id").alias("attempt"), text.alias("text")), "user_id")


_GOOGLE = """'{"items": [{"link": "' || url || '", "title": "T' || page_id || '"}, {"title": "no link"}, {"link": "https://b.org/' || page_id || '", "title": "B", "snippet": "s ' || page_id || '"}]}'"""


@query("SELECT page_id, url, 'T' || page_id AS title, 'N/A' AS snippet FROM pages UNION ALL SELECT page_id, 'https://b.org/' || page_id, 'B', 's ' || page_id FROM pages")
def search_items(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.explode(web.google_items(F.expr(_GOOGLE))).alias("x"))
    return rows.select("page_id", "x.url", "x.title", "x.snippet")


_DDG = """'<div><a class="result__a" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fx.org%2Fa' || page_id || '&rut=1">The <b>X</b>' || chr(10) || ' page ' || page_id || '</a><a class="result__snippet">Some   <b>text</b> here</a></div>'
  || '<div><a class="result__a" href="https://duckduckgo.com/y.js?ad=1">Ad</a></div><div><a class="result__a" href="https://y.org/' || page_id || '">Y</a></div>'"""


@query("SELECT page_id, 'https://x.org/a' || page_id AS url, 'The X page ' || page_id AS title, 'Some text here' AS snippet FROM pages UNION ALL SELECT page_id, 'https://y.org/' || page_id, 'Y', '' FROM pages")
def search_page(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.explode(htmltext.results(F.expr(_DDG))).alias("x"))
    return rows.select("page_id", "x.url", "x.title", "x.snippet")


_POST = """CASE WHEN page_id % 5 = 0 THEN '{}' ELSE '[{"data": {"children": [{"data": {"title": "T' || page_id || '", "selftext": "' || url || '"}}]}}]' END"""


@query("SELECT page_id, CASE WHEN page_id % 5 > 0 THEN '# T' || page_id || chr(10) || chr(10) || url END AS text FROM pages")
def reddit_post(spark, d):
    return table(spark, d, "pages").select("page_id", web.reddit_text(F.expr(_POST)).alias("text"))


# ---- research over the pages table ----


@query("""WITH q AS (SELECT item_id AS n FROM benchmark), h AS (SELECT n, page_id, url, row_number() OVER (PARTITION BY n ORDER BY page_id) AS place FROM q JOIN pages ON page_id % 40 = n)
SELECT CAST(n AS INTEGER) AS n, count(*) AS hits, count(DISTINCT url) AS urls FROM h WHERE place <= 10 GROUP BY n""")
def research_fanout(spark, d):
    """Benchmark items fan out to the pages that a search over the table finds for each."""
    from pyspark.sql import Window

    branches = table(spark, d, "benchmark").select(F.col("item_id").cast("int").alias("n"), F.col("text").alias("query"), urls.is_valid(F.col("text")).alias("is_url"))
    found = table(spark, d, "pages").select((F.col("page_id") % 40).cast("int").alias("n"), "page_id", "url")
    found = found.withColumn("place", F.row_number().over(Window.partitionBy("n").orderBy("page_id"))).where("place <= 10")
    found = research.branch_hits(branches, found)
    return found.groupBy("n").agg(F.count("*").alias("hits"), F.countDistinct("url").alias("urls"))


@query("""WITH h AS (SELECT page_id % 40 AS n, page_id, url, page_id % 7 = 0 AS failed FROM pages)
SELECT CAST(n AS INTEGER) AS n, count(*) FILTER (WHERE NOT failed) AS good, count(*) FILTER (WHERE failed) AS bad, string_agg(CAST(page_id AS VARCHAR), ',' ORDER BY page_id) FILTER (WHERE NOT failed) AS ids FROM h GROUP BY n""")
def research_reduce(spark, d):
    """Evidence of all branches: texts that came and those that failed, in order."""
    failed, page = F.col("page_id") % 7 == 0, F.col("page_id").cast("string")
    own = table(spark, d, "pages").select((F.col("page_id") % 40).cast("int").alias("n"), F.col("page_id").alias("place"), page.alias("url"), F.when(failed, "ERROR: gone").otherwise("text").alias("text"))
    ids = F.when(F.size("good_urls") > 0, F.array_join("good_urls", ","))
    return research.reduced(own).select("n", F.size("good").cast("long").alias("good"), F.size("bad").cast("long").alias("bad"), ids.alias("ids"))


@query("SELECT date_trunc('hour', ts) AS window_start, CAST(user_id % 10 AS BIGINT) AS source, count(*) AS updates, max(ts) AS newest FROM events GROUP BY 1, 2")
def source_updates(spark, d):
    own = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 10).alias("source"))
    return poll.latest_updates(own)


def _state(spark) -> str:
    """The shared folder for streams' state and results; a temporary one only where none is set and all runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or tempfile.mkdtemp(prefix="folioscope-")).rstrip("/")


@query()
def stream_sync(spark, d):
    """The same over a stream of files: windows that the watermark has closed, written as they close and read again."""
    path = f"{d}/events.parquet"
    own = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "*").parquet(path if path.endswith("/") else f"{d}/events.parque[t]")
    updates = poll.latest_updates(own.select(F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 10).alias("source")))
    at = f"{_state(spark)}/stream-sync-{uuid.uuid4().hex}"
    run = updates.writeStream.outputMode("append").format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(updates.schema).parquet(f"{at}/rows")
