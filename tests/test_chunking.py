"""Chunkers against notes worked out by hand and a plain search over all ends."""

import random

import pytest

from folioscope.operators.chunking import chunks, fixed_pieces, semantic_pieces


def shown(text, most, least):
    """Stripped pieces with the line of their first visible text."""
    return [(p.text.strip(), p.line + p.text[: len(p.text) - len(p.text.lstrip())].count("\n")) for p in semantic_pieces(text, most, least)]


HARBOUR = "Ships come and go.\n# Harbour\nThe quay is long.\n\n## Tides\nTwice a day.\n#### Not a cut\nStill tides.\n ## nor this"


@pytest.mark.parametrize(
    ("text", "most", "least", "want"),
    [
        # Text before a header is a section; levels above 3 and indented headers cut nothing.
        (HARBOUR, 200, 0, [("Ships come and go.", 0), ("# Harbour\nThe quay is long.", 1), ("## Tides\nTwice a day.\n#### Not a cut\nStill tides.\n ## nor this", 4)]),
        # Everything is short, so the first takes in all that fits.
        (HARBOUR, 200, 60, [(HARBOUR.replace("\n# Harbour", "\n\n\n# Harbour").replace("\n\n## Tides", "\n\n\n\n## Tides"), 0)]),
        # A long section is packed from the parts between blank lines, the separators within a piece kept.
        ("### Bread\n\nflour water\n\nsalt\n\nyeast and time", 24, 0, [("### Bread\n\nflour water", 0), ("salt\n\nyeast and time", 4)]),
        # A long part is packed from its lines.
        ("oats\nrye\nbarley\nwheat", 10, 0, [("oats\nrye", 0), ("barley", 2), ("wheat", 3)]),
        # A long line is cut at blanks, and the blanks there go.
        ("seven or  eleven geese", 9, 0, [("seven or", 0), ("eleven", 0), ("geese", 0)]),
        # Without blanks it is cut anywhere.
        ("x" * 7 + "y" * 4, 7, 0, [("x" * 7, 0), ("y" * 4, 0)]),
        # A short piece stays alone where the next one doesn't fit, and a long one takes in nothing.
        ("# a\n" + "m" * 30 + "\n# b\nn", 36, 20, [("# a\n" + "m" * 30, 0), ("# b\nn", 2)]),
        ("# b\nn\n# a\n" + "m" * 30, 36, 20, [("# b\nn", 0), ("# a\n" + "m" * 30, 2)]),
        ("\n\n  lead", 50, 0, [("lead", 2)]),
        ("", 10, 1, []),
        (" \n\t", 10, 1, []),
    ],
)
def test_semantic_by_hand(text, most, least, want):
    assert shown(text, most, least) == want


def furthest(pieces, joiner, most, alone):
    """The same runs by trying every end."""
    i = 0
    while i < len(pieces):
        fits = [j for j in range(i + 1, len(pieces) + 1) if len(joiner.join(pieces[i:j])) <= most or j == i + 1]
        reach = i + 1
        while reach + 1 in fits:
            reach += 1
        j = i + 1 if alone(pieces[i]) else reach
        yield joiner.join(pieces[i:j])
        i = j


def cut_line(line, most):
    while line:
        end = next((k for k in range(min(most, len(line)) - 1, 0, -1) if line[k] == " "), most) if len(line) > most else len(line)
        yield line[:end]
        line = line[end:].lstrip()


def plain(text, most, least):
    if not text.strip():
        return []
    sections = [""]
    for line in text.splitlines(keepends=True):
        body = line.rstrip("\r\n")
        marks = len(body) - len(body.lstrip("#"))
        rest = body[marks:]
        head = 1 <= marks <= 3 and len(rest) > 1 and rest[0].isspace()
        if head and sections[-1]:
            sections.append("")
        sections[-1] += line
    pieces = []
    for section in sections:
        if len(section) <= most:
            pieces.append(section)
            continue
        parts = section.split("\n\n")
        units = []
        for part in parts[: len(parts) - (parts[-1] == "")]:
            if len(part) <= most:
                units.append(part)
                continue
            held = []
            for line in part.splitlines(keepends=True):
                if len(line) <= most:
                    held.append(line)
                    continue
                units += furthest(held, "", most, lambda p: False)
                held = []
                units += cut_line(line, most)
            units += furthest(held, "", most, lambda p: False)
        pieces += furthest(units, "\n\n", most, lambda p: False)
    return [p for p in furthest(pieces, "\n\n", most, lambda p: len(p.strip()) >= least) if p.strip()]


def test_semantic_equals_a_plain_search():
    rng = random.Random(3)
    parts = ["kelp ", "eel", " ", "\n", "\n\n", "# top\n", "\n## in\n", "\t", "a longer run of words ", "###\n", "#no\n"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(40)))
        most = rng.randrange(2, 60)
        least = rng.randrange(most + 1)
        pieces = semantic_pieces(text, most, least)
        assert [p.text for p in pieces] == plain(text, most, least), (text, most, least)
        assert all(len(p.text) <= most for p in pieces)
        assert [p.line for p in pieces] == sorted(p.line for p in pieces)
        assert "".join("".join(p.text for p in pieces).split()) == "".join(text.split())


def test_fixed_pieces_cover_the_text():
    rng = random.Random(4)
    for _ in range(2000):
        text = "".join(rng.choice(["kelp", " ", "\n", "  ", "eel "]) for _ in range(rng.randrange(60)))
        size = rng.randrange(1, 30)
        pieces = list(fixed_pieces(text, size))
        assert all(0 < len(p.text) <= size for p in pieces)
        assert "".join("".join(p.text for p in pieces).split()) == "".join(text.split())
    assert [p.text for p in fixed_pieces("tide pool crab", 10)] == ["tide pool", " crab"]


def test_chunks_number_their_positions(spark):
    rows = spark.createDataFrame([("reef", "coral and sand " * 40), ("void", ""), ("none", None)], "k string, content string")
    out = chunks(rows, "fixed", size=64).orderBy("k", "position").collect()
    assert {r["k"] for r in out} == {"reef"}
    assert [r["position"] for r in out] == list(range(len(out)))
    assert all(r["content"] == r["content"].strip() for r in out)
