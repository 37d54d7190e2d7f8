"""Settings from the environment and an optional .env file."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields
from pathlib import Path

PREFIX = "FOLIOSCOPE_"


@dataclass(frozen=True)
class Config:
    vault: str = ""
    store: str = ""
    search_limit: int = 30
    min_score: float = 0.5
    neighbours: int = 1
    chunk_most: int = 1000
    chunk_least: int = 500
    poll_seconds: int = 60
    dimensions: int = 64
    rerank_weight: float = 1.0
    research_loops: int = 3
    fetch_chars: int = 15000
    proxy_reranker: str = ""
    embedding_reranker: str = ""
    chat_reranker: str = ""
    google_key: str = ""
    google_engine: str = ""

    def __post_init__(self) -> None:
        for name in ("search_limit", "chunk_most", "poll_seconds", "dimensions", "research_loops", "fetch_chars"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be positive")
        if self.neighbours < 0 or not 0 <= self.min_score <= 1 or self.rerank_weight < 0 or not 0 <= self.chunk_least <= self.chunk_most:
            raise ValueError("neighbours, min_score, rerank_weight or chunk_least is out of range")

    @property
    def store_path(self) -> str:
        """The store's folder: a hidden one in the vault unless named."""
        return self.store or f"{self.vault.rstrip('/')}/.vault_db"


def dotenv(path: str | Path) -> dict[str, str]:
    """NAME=value lines; comments, blank lines and quotes are taken off. A missing file is empty."""
    if not Path(path).is_file():
        return {}
    rows = (x.strip().removeprefix("export ") for x in Path(path).read_text("utf-8").splitlines())
    pairs = (x.partition("=") for x in rows if x and not x.startswith("#") and "=" in x)
    return {k.strip(): v.strip().strip("'\"") for k, _, v in pairs}


def load(environ: Mapping[str, str] | None = None, env_file: str | Path = ".env") -> Config:
    """The environment comes before the file, the file before the defaults."""
    found = {**dotenv(env_file), **(os.environ if environ is None else environ)}
    values = {}
    for f in fields(Config):
        raw = found.get(PREFIX + f.name.upper(), "")
        if raw != "":
            values[f.name] = type(f.default)(raw)
    return Config(**values)
