"""The corpus pipeline: five stages over documents, each written as Parquet and read again before the next.

1. quality classifier: documents that the factorisation machine scores under 0.7 go.
2. line dedup: later repeated runs of lines and sentences are deleted from the texts; texts that lose all of it go.
3. SimHash near-dedup: the document with the smallest id of each component stays.
4. mixing: documents repeat as often as their fitted rates say; none is dropped at the default targets.
5. packing: pieces of sequences of at most 2048 tokens.

Stages read labels from sf_dir. They keep the columns of documents but for the last. Nulls, empty texts, repeated rows
and empty tables are handled as each operator's module says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import common, lines, mixing, packing, quality, simhash
from folioscope.llm.registry import tokenizer_path

THRESHOLD = 0.7
#: SQL can't express the learnt scores and fingerprints; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    machine = quality.fit(docs, common.table(spark, sf_dir, "labels"))
    return quality.score(docs, machine, docs.columns, out="_folioscope_score").where(F.col("_folioscope_score") >= THRESHOLD).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.dedup(docs, drop_emptied=True)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.survivors(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply(docs, common.table(spark, sf_dir, "labels"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path(), with_ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_quality),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", dedup_near),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; what a stage has read goes once its result is written."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        with common.scratch():
            docs = common.keep(common.stored(stage(spark, before, sf_dir), name.replace(" ", "-")))
        common.discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
