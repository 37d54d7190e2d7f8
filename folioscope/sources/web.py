"""Fetching and searching: transports are injected; parsing and choosing are DataFrame operations.

A transport maps a URL to (status, content type, body as text or bytes); it is called in Arrow batches on the executors.
sources.http has one for the network; tests and tables inject their own.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import htmltext, urls
from folioscope.functions import text as fx
from folioscope.sources import pdf

MOST_CHARS = 15000
CUT_MARK = "\n\n[Content truncated]"
HTML_TYPES = ("text/html", "application/xhtml+xml")
TEXT_TYPES = ("text/plain", "text/markdown")
TIMED_OUT, FAILED = -1, 0
Transport = Callable[[str], tuple[int, str, str | bytes]]


def choose_search(google_key: str | None, google_engine: str | None) -> str:
    return "google" if google_key and google_engine else "duckduckgo"


def google_items(body: Column) -> Column:
    """array<struct<url, title, snippet>> of a JSON answer; items without a link go."""
    items = F.from_json(body, "struct<items:array<struct<link:string,title:string,snippet:string>>>")["items"]
    with_link = F.filter(items, lambda x: F.coalesce(x["link"], F.lit("")) != "")
    or_na = lambda c: F.coalesce(c, F.lit("N/A"))
    return F.coalesce(F.transform(with_link, lambda x: F.struct(x["link"].alias("url"), or_na(x["title"]).alias("title"), or_na(x["snippet"]).alias("snippet"))), F.array())


def reddit_text(body: Column) -> Column:
    title, own = F.get_json_object(body, "$[0].data.children[0].data.title"), F.get_json_object(body, "$[0].data.children[0].data.selftext")
    return F.when(title.isNotNull(), F.concat(F.lit("# "), title, F.lit("\n\n"), F.coalesce(own, F.lit(""))))


def attempts(rows: DataFrame, url: str = "url") -> DataFrame:
    """Rows with an attempt number and its URL for each candidate."""
    return rows.select("*", F.posexplode(urls.fetch_candidates(F.col(url))).alias("attempt", "candidate"))


def fetched(tried: DataFrame, transport: Transport) -> DataFrame:
    """Adds status, content_type and body; a transport that fails gives FAILED or TIMED_OUT. The text of a PDF is its body."""
    names = tried.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tried.schema) + ", status int, content_type string, body string"

    def run(batches):
        for batch in batches:
            got = []
            for url in batch.column(names.index("candidate")).to_pylist():
                try:
                    status, kind, body = transport(url)
                    got.append((status, kind, body) if isinstance(body, str) else (status, *pdf.as_text(kind, body)))
                except TimeoutError:
                    got.append((TIMED_OUT, "", ""))
                except Exception:  # noqa: BLE001  any failure of a transport is an answer of its own
                    got.append((FAILED, "", ""))
            arrays = [pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*names, "status", "content_type", "body"])

    return tried.mapInArrow(run, schema)


def dispatch(content_type: Column, body: Column, url: Column) -> Column:
    """Which extractor a body goes to: html, pdf, text, or unsupported."""
    kind = fx.content_type(content_type)
    return (
        F.when(kind.isin(*HTML_TYPES), "html").when(kind == "application/pdf", "pdf").when(kind.isin(*TEXT_TYPES), "text")
        .when(kind != "", "unsupported").when(fx.looks_like_pdf(body), "pdf").when(fx.looks_like_html(body), "html").when(F.trim(body) != "", "text").otherwise("unsupported")
    )


def extracted(answers: DataFrame, url: str = "url") -> DataFrame:
    """Adds text: Markdown, converted wikitext, a post, plain text, or an ERROR line."""
    site, kind = urls.kind(F.col(url)), dispatch(F.col("content_type"), F.col("body"), F.col("candidate"))
    body = F.col("body")
    text = F.when(site == "wikipedia", fx.mediawiki(body)).when(site == "reddit", F.coalesce(reddit_text(body), F.lit(fx.ERROR_CONTENT))).when(kind == "html", htmltext.markdown(body)).when(kind == "text", fx.plain_text(body))
    error = F.coalesce(fx.error_message("status", F.col("status") == TIMED_OUT), F.when(kind.isin("pdf", "unsupported"), fx.ERROR_CONTENT))
    out = F.coalesce(error, F.when(F.trim(text) != "", text), F.lit(fx.ERROR_EMPTY))
    # Of a repository's README only a missing one leads to the next; any other failure ends the search.
    last = (site == "github_repo") & error.isNotNull() & (F.col("status") != 404)
    return answers.withColumns({"text": fx.truncated(out, MOST_CHARS, CUT_MARK), "last": last})


def first_success(rows: DataFrame, key: str) -> DataFrame:
    """Per key the text of the first attempt that isn't an error (or that is marked `last`), else that of the last one."""
    ends = ~F.col("text").startswith("ERROR")
    ends = ends | F.col("last") if "last" in rows.columns else ends
    best = F.min_by(F.when(ends, F.col("text")), F.when(ends, F.col("attempt")))
    return rows.groupBy(key).agg(F.coalesce(best, F.max_by("text", "attempt")).alias("text"))


def fetch(rows: DataFrame, transport: Transport, url: str = "url") -> DataFrame:
    """(url, text) for distinct URLs; invalid ones give an ERROR line."""
    own = rows.select(url).distinct()
    got = first_success(extracted(fetched(attempts(own, url), transport), url), url)
    return own.join(got, url, "left").select(url, F.coalesce("text", F.lit("ERROR: invalid URL")).alias("text"))
