"""Schemas of notes, chunks, search results and model outputs."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import types as T

METADATA = T.StructType([T.StructField(n, T.StringType()) for n in ("source", "description", "title")])

NOTE = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("content", T.StringType(), False),
    T.StructField("metadata", METADATA, False),
    T.StructField("tags", T.ArrayType(T.StringType(), False), False),
    T.StructField("source_path", T.StringType(), False),
    T.StructField("wikilink_name", T.StringType(), False),
    T.StructField("file_size", T.LongType(), False),
    T.StructField("modified_at", T.DoubleType(), False),
])

#: Why a note couldn't be read; null where it could.
ERROR = T.StructField("error", T.StringType())

CHUNK = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("outgoing_links", T.ArrayType(T.StringType())),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("source_path", T.StringType()),
    T.StructField("wikilink_name", T.StringType()),
    T.StructField("modified_at", T.DoubleType()),
    T.StructField("position", T.IntegerType()),
    T.StructField("offset", T.IntegerType()),
    T.StructField("file_size", T.LongType()),
    T.StructField("embeddings", T.ArrayType(T.FloatType())),
])

SOURCES = T.StructType([T.StructField("source_path", T.StringType()), T.StructField("modified_at", T.DoubleType())])
WEB_RESULT = T.StructType([T.StructField(n, T.StringType()) for n in ("url", "title", "snippet")])
QUERY_LIST = T.StructType([T.StructField("queries", T.ArrayType(T.StringType()))])
RELEVANT_IDS = T.StructType([T.StructField("ids", T.ArrayType(T.StringType()))])
REFLECTION = T.StructType([
    T.StructField("is_sufficient", T.BooleanType()),
    T.StructField("knowledge_gap", T.StringType()),
    T.StructField("follow_up_queries", T.ArrayType(T.StringType())),
])


class Scope(Enum):
    """Which text columns full-text search reads."""

    CONTENT = ("content",)
    TITLE = ("title",)
    DESCRIPTION = ("description",)
    ALL = ("content", "title", "description")
