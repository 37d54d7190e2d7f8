"""HTML to Markdown, and search-result pages, on the standard parser."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import parse_qs, unquote, urlparse

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_BREAKS = {"p", "div", "section", "article", "ul", "ol", "table", "tr", "blockquote", "pre", "header", "footer", "nav", "main", "aside", "form"}
_SILENT = {"script", "style", "head", "noscript", "template", "svg"}


class _Markdown(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.silent, self.lists, self.links, self.pre = 0, [], [], 0

    def handle_starttag(self, tag, attrs):
        if tag in _SILENT:
            self.silent += 1
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            depth, kind = max(0, len(self.lists) - 1), self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            self.out.append("\n" + "  " * depth + (f"{kind[1]}. " if kind[0] == "ol" else "* "))
        elif tag == "br":
            self.out.append("  \n")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("_")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "a":
            self.links.append(dict(attrs).get("href") or "")
            self.out.append("[" if self.links[-1] else "")
        elif tag == "hr":
            self.out.append("\n\n* * *\n\n")
        if tag in ("ul", "ol"):
            self.lists.append([tag, 0])
        if tag == "pre":
            self.pre += 1
        if tag in _BREAKS:
            self.out.append("\n\n" if tag not in ("ul", "ol") or len(self.lists) < 2 else "")

    def handle_endtag(self, tag):
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("_")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "a" and self.links:
            href = self.links.pop()
            self.out.append(f"]({href})" if href else "")
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n")
        if tag in ("ul", "ol") and self.lists:
            self.lists.pop()
        if tag == "pre":
            self.pre = max(0, self.pre - 1)
        if tag in _BREAKS:
            self.out.append("\n\n" if tag not in ("ul", "ol") or not self.lists else "")

    def handle_data(self, data):
        if not self.silent:
            self.out.append(data if self.pre else re.sub(r"\s+", " ", data))


def to_markdown(page: str | None) -> str | None:
    """Text with headings, lists, emphasis and links; images are left out."""
    if page is None:
        return None
    parser = _Markdown()
    parser.feed(page)
    parser.close()
    text = re.sub(r"[ \t]+\n(?!\n)", lambda m: "  \n" if m[0].startswith("  ") else "\n", "".join(parser.out))
    return re.sub(r"\n[ \t]*\n\s*", "\n\n", text).strip()


class _Results(HTMLParser):
    """Links of class result__a with the result__snippet after each."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.into: str | None = None
        self.depth = 0

    def handle_starttag(self, tag, attrs):
        own = dict(attrs)
        classes = (own.get("class") or "").split()
        if self.into:
            self.depth += tag not in ("br", "img", "wbr")
        elif "result__a" in classes:
            self.rows.append({"url": own.get("href") or "", "title": "", "snippet": ""})
            self.into, self.depth = "title", 1
        elif "result__snippet" in classes and self.rows:
            self.into, self.depth = "snippet", 1

    def handle_endtag(self, tag):
        if self.into:
            self.depth -= 1
            if self.depth <= 0:
                self.into = None

    def handle_data(self, data):
        if self.into:
            self.rows[-1][self.into] += data


def search_results(page: str | None) -> list[dict]:
    """(url, title, snippet) of a result page, without advertisements; redirects are resolved."""
    parser = _Results()
    parser.feed(page or "")
    parser.close()
    out = []
    for row in parser.rows:
        if "y.js?" in row["url"] or not row["url"]:
            continue
        target = parse_qs(urlparse(row["url"]).query).get("uddg")
        out.append({"url": unquote(target[0]) if target else row["url"], "title": " ".join(row["title"].split()), "snippet": " ".join(row["snippet"].split())})
    return out


def markdown(page: Column) -> Column:
    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(to_markdown, na_action="ignore")

    return run(page)


def results(page: Column) -> Column:
    """array<struct<url, title, snippet>> of a result page."""

    @F.pandas_udf("array<struct<url:string,title:string,snippet:string>>")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(search_results)

    return run(page)
