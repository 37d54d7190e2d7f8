"""Models as providers: protocols for production, and deterministic stand-ins that need no network."""

from __future__ import annotations

import re
import zlib
from itertools import pairwise
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


WORD = re.compile(r"\w+")


class Embedder(Protocol):
    dimensions: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Chat(Protocol):
    def ask(self, prompt: str) -> str: ...


class FeatureEmbedder:
    """Signed feature hashing: each word and word pair adds 1 or -1 to a place that its hash names; unit length.

    Texts that share words lie near each other, so searches over it mean something without a model.
    """

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimensions))
        for row, text in zip(out, texts, strict=True):
            words = WORD.findall(text.lower())
            for weight, grams in ((1.0, words), (0.5, [f"{a} {b}" for a, b in pairwise(words)])):
                for g in grams:
                    h = zlib.crc32(g.encode())
                    row[(h >> 1) % self.dimensions] += weight if h & 1 else -weight
        lengths = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(lengths > 0, lengths, 1.0)).tolist()


class WordOverlapChat:
    """Answers a rerank prompt by the share of the question's words in the passage."""

    def ask(self, prompt: str) -> str:
        lines = dict(x.split(": ", 1) for x in prompt.split("\n") if ": " in x)
        question, passage = set(lines.get("Question", "").lower().split()), set(lines.get("Passage", "").lower().split())
        share = len(question & passage) / max(1, len(question))
        return "perfect" if share > 0.8 else "good" if share > 0.5 else "some" if share > 0.2 else "bad"


def with_embeddings(rows: DataFrame, text: str, out: str, model: Embedder | None = None) -> DataFrame:
    """Adds vectors of a text column, in Arrow batches."""
    own = model or FeatureEmbedder()

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(own.embed(texts.fillna("").tolist()))

    return rows.withColumn(out, run(F.col(text)))


def answers(rows: DataFrame, prompt: str, out: str, model: Chat) -> DataFrame:
    """Adds a model's answers; null where it fails."""

    @F.pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        def one(p):
            try:
                return model.ask(p)
            except Exception:  # noqa: BLE001  a failed answer is null, and the caller falls back
                return None

        return prompts.map(one)

    return rows.withColumn(out, run(F.col(prompt)))


def hypothetical(model: Chat, query: str) -> str | None:
    """A passage that might answer the query; the query itself if the model fails, None for a blank answer."""
    try:
        return model.ask(f"Write a short passage that answers: {query}").strip() or None
    except Exception:  # noqa: BLE001
        return query
