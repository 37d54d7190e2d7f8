"""Where a URL leads, and what is fetched for it, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where a repository's front page may lie.
BRANCHES, READMES = ("main", "master"), ("README.md", "README.rst", "README.txt", "README")


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def is_valid(url: Column) -> Column:
    return url.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+")


def parts(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda x: x != "")


def kind(url: Column) -> Column:
    """arxiv, wikipedia, reddit, github_blob, github_repo, page or invalid."""
    h, p = host(url), parts(url)
    return (
        F.when(~is_valid(url), "invalid")
        .when((h == "arxiv.org") | h.endswith(".arxiv.org"), "arxiv")
        .when(h.contains(".wikipedia.org"), "wikipedia")
        .when((h == "reddit.com") | h.endswith(".reddit.com"), "reddit")
        .when((h == "github.com") & path(url).contains("/blob/"), "github_blob")
        .when((h == "github.com") & (F.size(p) == 2), "github_repo")
        .otherwise("page")
    )


def arxiv_id(url: Column) -> Column:
    """The paper's id in an abs, pdf or html path; '' for none."""
    return F.regexp_extract(path(url), r"^/(?:abs|pdf|html)/([^/]+?)(?:\.pdf)?(?:/|$)", 1)


def fetch_candidates(url: Column) -> Column:
    """The URLs to try in turn; the first that answers counts."""
    h, p, paper = host(url), parts(url), arxiv_id(url)
    arxiv = F.array(*[F.concat(F.lit(f"https://arxiv.org/{x}/"), paper) for x in ("html", "pdf", "abs")])
    readmes = F.array(*[F.concat(F.lit("https://raw.githubusercontent.com/"), F.get(p, F.lit(0)), F.lit("/"), F.get(p, F.lit(1)), F.lit(f"/{b}/{r}")) for b in BRANCHES for r in READMES])
    wiki = F.concat(F.lit("https://"), h, F.lit("/w/index.php?title="), F.regexp_replace(path(url), "^/wiki/", ""), F.lit("&action=raw"))
    blob = F.regexp_replace(F.regexp_replace(url, r"://github\.com/", "://raw.githubusercontent.com/"), "/blob/", "/")
    k = kind(url)
    return (
        F.when((k == "arxiv") & (paper != ""), arxiv)
        .when(k == "wikipedia", F.array(wiki))
        .when(k == "reddit", F.array(F.concat(F.regexp_replace(url, "/+$", ""), F.lit(".json"))))
        .when(k == "github_blob", F.array(blob))
        .when(k == "github_repo", readmes)
        .when(k == "invalid", F.array().cast("array<string>"))
        .otherwise(F.array(url))
    )
