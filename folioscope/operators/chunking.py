"""Chunkers: notes in, numbered chunks with their first lines out.

The greedy packing of the semantic chunker depends on the order of pieces, so it runs in Arrow batches; header
sections, paragraphs and line offsets are plain expressions.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import accumulate, groupby, pairwise
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as fx

_HEADER = re.compile(fx.HEADER)


class Piece(NamedTuple):
    """Text with the number of its first line."""

    text: str
    line: int


@lru_cache(maxsize=64)
def _slicer(most: int, tail: str) -> re.Pattern:
    """Slices of at most `most` characters: the rest if it fits, else up to the last blank after the first character, else `most`."""
    blank = rf"|.{{1,{most - 1}}}(?= )" if most > 1 else ""
    return re.compile(rf"(?s)(?P<own>.{{1,{most}}}\Z{blank}|.{{{most}}}){tail}")


def fixed_pieces(text: str, size: int = 1000) -> Iterator[Piece]:
    """Runs of at most size characters that end at their last blank where they can; the next run begins with that blank."""
    line = 0
    for m in _slicer(size, "").finditer(text):
        if not m["own"].isspace():
            yield Piece(m["own"], line)
        line += m["own"].count("\n")


def _runs(lengths: Sequence[int], joiner: int, most: int, from_here: Callable[[int], bool] = lambda i: True) -> Iterator[tuple[int, int]]:
    """Neighbours [i, j) dealt out from the left: each run reaches as far as its joined length stays within `most`.

    A run has one member at least; from_here(i) says whether a run that begins with i may take in more.
    """
    ends = [0, *accumulate(n + joiner for n in lengths)]
    i = 0
    while i < len(lengths):
        j = max(i + 1, bisect_right(ends, ends[i] + most + joiner) - 1) if from_here(i) else i + 1
        yield i, j
        i = j


def _joined(pieces: Sequence[Piece], joiner: str, most: int, from_here: Callable[[int], bool] = lambda i: True) -> list[Piece]:
    """Runs of pieces as one piece each, which keeps the first one's line."""
    cuts = _runs([len(p.text) for p in pieces], len(joiner), most, from_here)
    return [Piece(joiner.join(p.text for p in pieces[i:j]), pieces[i].line) for i, j in cuts]


def _of_part(part: Piece, most: int) -> list[Piece]:
    """A part that is too long: runs of whole lines, and slices of the lines that are too long themselves."""
    out: list[Piece] = []
    numbered = [Piece(x, part.line + k) for k, x in enumerate(part.text.splitlines(keepends=True))]
    for too_long, group in groupby(numbered, key=lambda p: len(p.text) > most):
        if too_long:
            out += [Piece(m["own"], p.line) for p in group for m in _slicer(most, r"\s*").finditer(p.text)]
        else:
            out += _joined(list(group), "", most)
    return out


def _of_section(section: Piece, most: int) -> list[Piece]:
    """A section as it is, or runs of its parts between blank lines."""
    if len(section.text) <= most:
        return [section]
    texts = section.text.split("\n\n")
    texts = texts if texts[-1] else texts[:-1]
    first_lines = accumulate((x.count("\n") + 2 for x in texts[:-1]), initial=section.line)
    parts = [Piece(x, n) for x, n in zip(texts, first_lines, strict=True)]
    return _joined([q for p in parts for q in ([p] if len(p.text) <= most else _of_part(p, most))], "\n\n", most)


def semantic_pieces(text: str, most: int = 1000, least: int = 500) -> list[Piece]:
    """Sections that headers of level 1 to 3 begin, cut where too long; one shorter than `least` takes in those that follow while they fit."""
    if not text.strip():
        return []
    lines = text.splitlines(keepends=True)
    cuts = [0, *(n for n, x in enumerate(lines) if n and _HEADER.match(x.rstrip("\r\n"))), len(lines)]
    pieces = [q for a, b in pairwise(cuts) for q in _of_section(Piece("".join(lines[a:b]), a), most)]
    short = [len(p.text.strip()) < least for p in pieces]
    return [p for p in _joined(pieces, "\n\n", most, short.__getitem__) if p.text.strip()]


def chunks(notes: DataFrame, kind: str = "semantic", **options: int) -> DataFrame:
    """The columns of notes but content, and position, content (stripped) and offset (line of the first visible text)."""
    keep = [c for c in notes.columns if c != "content"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in notes.select(*keep).schema) + ", position int, content string, offset int"
    cut = semantic_pieces if kind == "semantic" else fixed_pieces

    def run(batches):
        for batch in batches:
            row, position, content, offset = [], [], [], []
            for i, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                for k, p in enumerate(cut(text or "", **options)):
                    lead = p.text[: len(p.text) - len(p.text.lstrip())]
                    row.append(i), position.append(k), content.append(p.text.strip()), offset.append(p.line + lead.count("\n"))
            kept = [batch.column(k).take(pa.array(row, pa.int64())) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(position, pa.int32()), pa.array(content, pa.string()), pa.array(offset, pa.int32())], names=[*batch.schema.names[:-1], "position", "content", "offset"])

    return notes.select(*keep, "content").mapInArrow(run, schema)


def lines(notes: DataFrame, key: str, content: str = "content") -> DataFrame:
    """(key, line number from 0, line)."""
    return notes.select(key, F.posexplode(F.split(F.col(content), fx.LINE_END)).alias("line_no", "line"))


def header_sections(notes: DataFrame, key: str, content: str = "content") -> DataFrame:
    """(key, section from 0, first line, text): the native header split."""
    by = Window.partitionBy(key).orderBy("line_no")
    marked = lines(notes, key, content).withColumn("head", F.when(F.col("line").rlike(fx.HEADER) & (F.col("line_no") > 0), 1).otherwise(0))
    marked = marked.withColumn("section", F.sum("head").over(by))
    parts = marked.groupBy(key, "section").agg(F.min("line_no").alias("first_line"), F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    return parts.select(key, "section", "first_line", F.array_join(F.col("l.line"), "\n").alias("text"))


def paragraphs(notes: DataFrame, key: str, content: str = "content") -> DataFrame:
    """(key, paragraph from 0, text, offset): parts between blank lines with the line that each begins in."""
    by = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    out = notes.select(key, F.posexplode(F.split(F.col(content), "\n\n")).alias("part", "text"))
    return out.withColumn("offset", F.coalesce(F.sum(fx.newlines("text") + 2).over(by), F.lit(0)))


def build(chunked: DataFrame, path: Column, extra_tags: Column) -> DataFrame:
    """Adds id, links and tags to chunks with position and content."""
    tags = F.sort_array(F.array_union(extra_tags, fx.hashtags("content")))
    return chunked.withColumns({"id": fx.chunk_id(path, "position"), "outgoing_links": fx.wikilinks("content"), "tags": tags})
