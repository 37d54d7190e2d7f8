"""python -m folioscope reindex | search QUERY | list [FOLDER] | read NAME, over the vault that the settings name."""

from __future__ import annotations

import argparse
import json
import logging

from folioscope import config
from folioscope.operators.store import ChunkStore
from folioscope.plans import engine, providers
from folioscope.session import session


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="folioscope", description=__doc__)
    parser.add_argument("command", choices=["reindex", "search", "list", "read"])
    parser.add_argument("what", nargs="?", default="")
    parser.add_argument("--vault")
    parser.add_argument("--verbose", action="store_true")
    own = parser.parse_args(args)
    logging.basicConfig(level=logging.INFO if own.verbose else logging.WARNING)
    settings = config.load()
    settings = config.Config(**{**settings.__dict__, "vault": own.vault or settings.vault})
    if not settings.vault:
        parser.error("no vault is named")
    spark = session()
    model = providers.FeatureEmbedder(settings.dimensions)
    store = ChunkStore(spark, settings.store_path, lambda rows, text, out: providers.with_embeddings(rows, text, out, model), model.dimensions).initialize()
    tools = engine.NoteTools(spark, settings.vault, store, engine.SearchEngine(store, model, limit=settings.search_limit, least=settings.min_score, neighbours=settings.neighbours))
    if own.command == "reindex":
        print(json.dumps(tools.synchronise()))
        store.reindex()
    elif own.command == "search":
        print(json.dumps(tools.search(own.what), ensure_ascii=False, indent=1))
    else:
        print(tools.list_files(own.what) if own.command == "list" else tools.read(own.what))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
