"""Page text against a recursive reference renderer, and pages that are hostile in size or nesting."""

import random
import time

import pytest

from folioscope.llm import html

MARGIN = {"p": 1, "div": 0, "blockquote": 1, "section": 0, "h2": 1}


def random_tree(rng, depth):
    """Children as words or (tag, children); the markup closes every tag, so it has one meaning."""
    out = []
    for _ in range(rng.randrange(1, 4)):
        kind = rng.choice(["word", "word", "inline", "block", "list", "hidden"]) if depth else "word"
        if kind == "word":
            out.append(f"w{rng.randrange(99)} ")
        elif kind == "inline":
            out.append(("b", [f"i{rng.randrange(99)} "]))
        elif kind == "block":
            out.append((rng.choice(["div", "section", "blockquote"]), random_tree(rng, depth - 1)))
        elif kind == "list":
            out.append((rng.choice(["ul", "ol"]), [("li", random_tree(rng, depth - 1)) for _ in range(rng.randrange(1, 4))]))
        else:
            out.append((rng.choice(["script", "hidden"]), ["unseen "]))
    return out


def markup(children):
    out = []
    for c in children:
        if isinstance(c, str):
            out.append(c)
        elif c[0] == "hidden":
            out.append(f"<div hidden>{markup(c[1])}</div>")
        else:
            out.append(f"<{c[0]}>{markup(c[1])}</{c[0]}>")
    return "".join(out)


def reference(children, parent="div"):
    """[(blank lines before, text)] of a flow, and the margin it leaves behind."""
    lines, gap, words, number = [], 0, [], 1

    def flush():
        nonlocal gap
        text = " ".join("".join(words).split())
        words.clear()
        if text:
            lines.append((gap, text))
            gap = 0

    for c in children:
        if isinstance(c, str):
            words.append(c)
            continue
        tag, own = c
        if tag in ("script", "hidden"):
            continue
        if tag == "b":
            words.extend(own)
            continue
        flush()
        margin = 0 if tag == "li" else int(tag in ("p", "blockquote", "h2") or (tag in ("ul", "ol") and parent != "li"))
        inner, after = reference(own, tag)
        gap = max(gap, margin)
        if tag == "li":
            mark = f"{number}. " if parent == "ol" else "- "
            number += 1
            inner = [(g, (mark if i == 0 else " " * len(mark)) + t) for i, (g, t) in enumerate(inner)]
        for i, (g, t) in enumerate(inner):
            lines.append((max(g, gap) if i == 0 else g, t))
        gap = max(after, margin) if inner else max(gap, after, margin)
    flush()
    return lines, gap


def test_equals_a_recursive_reference():
    rng = random.Random(1)
    for _ in range(400):
        tree = random_tree(rng, 4)
        lines, _ = reference(tree)
        want = "".join(("" if i == 0 else "\n\n" if g else "\n") + t for i, (g, t) in enumerate(lines))
        assert html.extract(markup(tree)) == want, markup(tree)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a | b\n  | c"),
        ("<table><tr><td>a<td rowspan=2>b<tr><td>c<tr><td>d<td>e</table>", "a | b\nc |\nd | e"),
        ("<table><tr><td rowspan=0>a<td>b<tr><td>c<tbody><tr><td>d<td>e</table>", "a | b\n  | c\nd | e"),
        ("<table><tr><td colspan=2 rowspan=2>wide<td>x<tr><td>y<tr><td>1<td>2<td>3</table>", "wide  | x\n      | y\n1 | 2 | 3"),
        ("<div>" * 500 + "<span hidden>secret</span>x", "x"),
        ("<b>" * 500 + "<p style='visibility:hidden'>secret</p>x", "x"),
        ("<a title='1>0'>t</a> <a title='open>u", "t u"),
        ("<div><p>a</p></div>b", "a\n\nb"),
    ],
)
def test_layout(page, want):
    assert html.extract(page) == want


@pytest.mark.parametrize("unit", ["<a", "<a \"", "<a '\"> ", "<!", "</a", "<div>a", "<p><span>", "<ul><li>a", "<table><tr><td>x", "<td rowspan=9 colspan=9>a", "<x '><y \"'>", "&amp", "<tr><td rowspan=60000>"])
def test_hostile_pages_take_linear_time(unit):
    page = unit * ((1 << 20) // len(unit))
    begun = time.time()
    out = html.extract(page)
    assert time.time() - begun < 20
    assert len(out) < 64 * len(page)


def test_no_word_is_lost_when_alignment_would_explode():
    page = "<table><tr>" + "<td rowspan=9999>held" * 300 + "<tr><td>row" * 3000 + "</table>"
    out = html.extract(page)
    assert out.count("held") == 300
    assert out.count("row") == 3000
    assert len(out) < 64 * len(page)
    deep = html.extract("<table><tr><td>a<td>b" * 200)
    assert (deep.count("a"), deep.count("b")) == (200, 200)
    items = html.extract("<ul><li>x" * 5000)
    assert items.count("x") == 5000
    assert max(map(len, items.split("\n"))) < 100


def test_empty_and_very_long_pages(spark):
    rows = spark.createDataFrame([(1, "<p>word " * 200_000), (2, "")], "page_id long, html string")
    got = {r["page_id"]: r["text"] for r in html.texts(rows).collect()}
    assert got[1].count("word") == 200_000
    assert got[2] == ""
    assert html.texts(rows.limit(0)).count() == 0
