"""Markdown vaults: listing, reading, front matter, note access and renames.

Spark's file sources leave out names that begin with a dot or an underscore, so listings walk the folder themselves
and only contents are read in parallel. Paths are those of a folder that the driver and the executors share.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope import schema
from folioscope.functions import text as fx

#: Relative paths in which one of these is found are skipped.
SKIP = (r"\.git/", r"\.obsidian/", r"\.trash/", r"node_modules/", r"__pycache__/", r"\.vault_db/", r"^\..*")
LISTING = "source_path string, path string, modified_at double, file_size long"


def is_allowed(relative: str, patterns: Sequence[str] = SKIP) -> bool:
    return not any(re.search(p, relative) for p in patterns)


def allowed(relative: Column, patterns: Sequence[str] = SKIP) -> Column:
    return ~relative.rlike("|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(True)


def listing(spark: SparkSession, root: str, patterns: Sequence[str] = SKIP) -> DataFrame:
    """Markdown files under a root with their times and sizes; links to folders aren't followed, a missing root is empty."""
    rows = []
    for folder, dirs, names in os.walk(root):
        inside = os.path.relpath(folder, root)
        inside = "" if inside == "." else inside.replace(os.sep, "/") + "/"
        dirs[:] = sorted(d for d in dirs if is_allowed(f"{inside}{d}/", patterns))
        for name in sorted(names):
            if name.endswith(".md") and is_allowed(inside + name, patterns):
                try:
                    found = os.stat(os.path.join(folder, name))
                except OSError:
                    continue
                rows.append((inside + name, os.path.abspath(os.path.join(folder, name)), found.st_mtime, found.st_size))
    return spark.createDataFrame(rows, LISTING)


def front_matter(raw: str) -> tuple[dict, str]:
    """The YAML block's fields and the text after it; a block that doesn't parse stays part of the text."""
    import yaml

    m = re.match(r"\s*---[ \t]*\n(.*?)\n---[ \t]*(?:\n|\Z)", raw, re.S)
    if not m:
        return {}, raw.strip()
    try:
        fields = yaml.safe_load(m[1])
    except yaml.YAMLError:
        return {}, raw
    return (fields if isinstance(fields, dict) else {}), raw[m.end() :].strip()


def tags_of(value) -> list[str]:
    if isinstance(value, str):
        return [value]
    return sorted({str(x) for x in value}) if isinstance(value, list) else []


def notes(files: DataFrame) -> DataFrame:
    """Notes of a listing, read and parsed in parallel, each file once. `error` says why a file couldn't be read; its note is empty."""

    def run(batches):
        for batch in batches:
            out = {f.name: [] for f in [*schema.NOTE, schema.ERROR]}
            for row in batch.to_pylist():
                raw, error = "", None
                try:
                    raw = Path(row["path"]).read_bytes().decode("utf-8", "replace")
                except OSError as e:
                    error = str(e)
                fields, content = front_matter(raw)
                text = lambda k, f=fields: str(f[k]) if k in f else None
                values = {
                    "id": hashlib.md5(row["path"].encode()).hexdigest(), "content": content, "metadata": {k: text(k) for k in ("source", "description", "title")},
                    "tags": tags_of(fields.get("tags")), "source_path": row["source_path"], "wikilink_name": Path(row["path"]).stem, "file_size": row["file_size"], "modified_at": row["modified_at"], "error": error,
                }
                for k, v in values.items():
                    out[k].append(v)
            meta = pa.struct([(n, pa.string()) for n in ("source", "description", "title")])
            types = [pa.string(), pa.string(), meta, pa.list_(pa.string()), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))

    return files.mapInArrow(run, T.StructType([*schema.NOTE.fields, schema.ERROR]))


def folder(paths: DataFrame, prefix: str = "", path: str = "source_path") -> DataFrame:
    """Sorted entries of a folder: stems of its notes and its folders with a slash; dot names are hidden."""
    head = prefix.strip("/") + "/" if prefix.strip("/") else ""
    rest = F.substring(F.col(path), len(head) + 1, 1 << 20)
    first = F.split_part(rest, F.lit("/"), F.lit(1))
    entry = F.when(rest.contains("/"), F.concat(first, F.lit("/"))).when(rest.endswith(".md"), F.regexp_replace(rest, r"\.md$", ""))
    return paths.where(F.col(path).startswith(head)).select(entry.alias("entry")).where(F.col("entry").isNotNull() & ~F.col("entry").startswith(".")).distinct().orderBy("entry")


def samples(paths: DataFrame, folder_col: str, key: str, n: int, folders: int | None = None) -> DataFrame:
    """(folder, files, sample): the number of notes of each folder, and n of them by the order of their keys' hashes.

    folders: of how many folders, again by the order of their hashes; None for all. Each task keeps its n best of a folder,
    so a folder of any size is sampled without meeting in one task.
    """
    order = F.struct(F.md5(F.col(key).cast("string")).alias("h"), F.col(key).alias("key"))
    by = Window.partitionBy(folder_col, "_salt").orderBy(order)
    few = paths.select(folder_col, F.col(key), F.pmod(F.xxhash64(key), F.lit(64)).alias("_salt")).withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= n)
    few = few.groupBy(folder_col).agg(F.slice(F.sort_array(F.collect_list(order)), 1, n).alias("s")).select(folder_col, F.col("s.key").alias("sample"))
    out = paths.groupBy(folder_col).agg(F.count("*").alias("files")).join(few, folder_col)
    return out if folders is None else out.orderBy(F.md5(F.col(folder_col).cast("string")), folder_col).limit(folders)


def read_request_error(name: str, offset: int = 0, limit: int | None = None) -> str | None:
    """What is wrong with a request to read a note, if anything."""
    if offset < 0 or (limit is not None and limit < 0):
        return "offset and limit must not be negative"
    if not name.strip() or name.endswith(".md") or "\\" in name or name.startswith("/") or ".." in name.split("/"):
        return "not a note's name"
    return None


def resolve(chunks: DataFrame, name: str) -> str:
    """The path of a note by its name, or by its path without .md."""
    if "/" in name:
        return f"{name}.md"
    found = [r["source_path"] for r in chunks.where(F.col("wikilink_name") == name).select("source_path").distinct().orderBy("source_path").collect()]
    if not found:
        raise FileNotFoundError(f"no note is called {name}")
    if len(found) > 1:
        raise ValueError(f"several notes are called {name}: {', '.join(found)}")
    return found[0]


def read_note(files: DataFrame, name: str, offset: int = 0, limit: int | None = None) -> str:
    """A note's text, or some of its lines; of a listing only the one file is read."""
    if error := read_request_error(name, offset, limit):
        raise ValueError(error)
    named = files if "wikilink_name" in files.columns else files.withColumn("wikilink_name", fx.stem("source_path"))
    path = resolve(named, name)
    own = files.where(F.col("source_path") == path)
    own = own if "content" in files.columns else notes(own)
    row = own.select(fx.line_slice("content", offset, limit).alias("text"), (F.col("error") if "error" in own.columns else F.lit(None)).alias("error")).first()
    if row is None or row["error"] is not None:
        raise FileNotFoundError(path)
    return row["text"]


def renamed(all_notes: DataFrame, old: str, new: str) -> DataFrame:
    """(source_path, content) of the notes whose links to old change to new."""
    after = fx.renamed_links("content", old, new)
    return all_notes.select("source_path", "content", after.alias("after")).where("after <> content").select("source_path", F.col("after").alias("content"))


def rename_note(spark: SparkSession, root: str, old_path: str, new_path: str) -> int:
    """Moves a note and rewrites the links to it; returns how many notes changed."""
    source, target, top = Path(root, old_path), Path(root, new_path), Path(root).resolve()
    if not source.is_file():
        raise FileNotFoundError(old_path)
    if target.exists():
        raise FileExistsError(new_path)
    if top not in target.resolve().parents:
        raise ValueError("the target lies outside the vault")
    old, new = source.stem, target.stem
    rewritten = links_to(listing(spark, root), old) if old != new else []  # found before anything moves
    target.parent.mkdir(parents=True, exist_ok=True)
    source.rename(target)
    quoted = re.compile(r"\[\[" + re.escape(old) + r"(\|[^\]]+)?\]\]", re.I)
    for name in rewritten:
        path = target if name == str(source.resolve()) else Path(name)
        path.write_bytes(quoted.sub(lambda m: f"[[{new}{m[1] or ''}]]", path.read_bytes().decode("utf-8")).encode())
    return len(rewritten)


def links_to(files: DataFrame, name: str) -> list[str]:
    """The resolved paths of the files that link to a name, found in parallel; those that aren't UTF-8 or are links are left as they are."""
    quoted = re.compile(r"\[\[" + re.escape(name) + r"(\|[^\]]+)?\]\]", re.I)

    def run(batches):
        for batch in batches:
            out = []
            for raw in batch.column(0).to_pylist():
                path = Path(raw)
                try:
                    if not path.is_symlink() and quoted.search(path.read_bytes().decode("utf-8")):
                        out.append(str(path.resolve()))
                except (OSError, UnicodeDecodeError):
                    continue
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["path"])

    return sorted(r["path"] for r in files.select("path").mapInArrow(run, "path string").collect())
