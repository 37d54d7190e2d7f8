"""Transports over HTTP by the standard library: pages, web search and a reranking service.

Each takes an opener with urlopen's signature, so tests need no network. Nothing here is called unless a caller passes it on.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field

SECONDS, RESULTS = 30, 10
# Where the services answer.
GOOGLE, DUCKDUCKGO = "https://www.googleapis.com/customsearch/v1", "https://html.duckduckgo.com/html/"
HEADERS = {"User-Agent": "Mozilla/5.0 (X11; Linux x86_64)", "Accept": "text/html,application/xhtml+xml,text/plain,application/pdf;q=0.9,*/*;q=0.5"}


def _send(opener: Callable, url: str, data: bytes | None = None, headers: dict[str, str] | None = None) -> tuple[int, str, bytes]:
    """(status, content type, body); an error's status counts as an answer, a timeout is raised as TimeoutError."""
    request = urllib.request.Request(url, data=data, headers={**HEADERS, **(headers or {})})
    try:
        with opener(request, timeout=SECONDS) as answer:
            return answer.status, answer.headers.get("Content-Type", "") or "", answer.read()
    except urllib.error.HTTPError as e:
        return e.code, "", b""
    except urllib.error.URLError as e:
        if isinstance(e.reason, TimeoutError):
            raise e.reason from e
        raise


@dataclass(frozen=True)
class Pages:
    """The transport that web.fetch takes."""

    opener: Callable = urllib.request.urlopen

    def __call__(self, url: str) -> tuple[int, str, bytes]:
        return _send(self.opener, url)


@dataclass(frozen=True)
class WebSearch:
    """The answer of a search as text, for web.google_items or htmltext.results; '' where it fails."""

    key: str = ""
    engine: str = ""
    region: str = "us-en"
    opener: Callable = urllib.request.urlopen

    @property
    def kind(self) -> str:
        from folioscope.sources import web

        return web.choose_search(self.key, self.engine)

    def __call__(self, query: str) -> str:
        if self.kind == "google":
            asked = urllib.parse.urlencode({"key": self.key, "cx": self.engine, "q": query, "num": RESULTS, "safe": "off"})
            request = (f"{GOOGLE}?{asked}", None, {})
        else:
            asked = urllib.parse.urlencode({"q": query, "b": "", "l": self.region})
            request = (DUCKDUCKGO, asked.encode(), {"Content-Type": "application/x-www-form-urlencoded"})
        try:
            status, _, body = _send(self.opener, *request)
        except OSError:
            return ""
        return body.decode("utf-8", "replace") if 200 <= status < 300 else ""


@dataclass(frozen=True)
class Reranker:
    """Scores of passages by a service that speaks the common rerank protocol; raises OSError where it fails."""

    url: str
    model: str
    key: str = field(default="", repr=False)
    opener: Callable = urllib.request.urlopen

    def __call__(self, query: str, texts: list[str]) -> list[tuple[int, float]]:
        asked = json.dumps({"model": self.model, "query": query, "documents": texts, "top_n": len(texts)}).encode()
        status, _, body = _send(self.opener, f"{self.url.rstrip('/')}/v1/rerank", asked, {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
        if not 200 <= status < 300:
            raise OSError(f"the reranking service answered {status}")
        return [(int(r["index"]), float(r.get("relevance_score", r.get("score", 0.0)))) for r in json.loads(body).get("results", [])]
