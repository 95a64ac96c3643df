"""From raw documents to packed batches, in five stages.

language   documents whose language cannot be told go
near       one document of each near-duplicate group stays (five-word shingles, similarity 0.8)
repeats    strings of 200 bytes and more that occur twice are cut, everywhere
mix        sources are mixed to their target weights; a document appears once for every pass that takes it
pack       whole texts, in pieces, go into length buckets and token-budget batches; a row holds its piece's text

Each stage reads all that the one before kept, and first removes the tables that the one before staged: write a
stage's result before the next stage is called, as run() does. No stage has SQL: the first three are not
SQL-expressible, and what follows depends on them.

Defined results: a null or empty text has no language and goes with the first stage; a null doc_id, lang or source is
kept; repeated rows are near-duplicates of one another; ties keep the smallest doc_id; an empty table gives no rows;
extra columns stay as they are up to the last stage, whatever their names.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import languages, mixing, near, packing, repeats
from quarry.llm.queries import arrow_batches
from quarry.scratch import recorded, release, staged

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

REPEAT_BYTES = 200

_left = threading.local()


def _tidy(stage: Stage) -> Stage:
    """The stage, after the tables of the one that this thread called before are removed."""

    @wraps(stage)
    def called(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, getattr(_left, "paths", []))
        with recorded() as _left.paths:
            return stage(spark, docs, sf_dir)

    return called


@_tidy
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    arrow_batches(spark)
    return languages.accepted(docs, languages.learned(docs))


@_tidy
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    arrow_batches(spark)
    return near.keep_one(docs, width=5, threshold=80)


@_tidy
def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    arrow_batches(spark)
    return repeats.without_repeats(docs, REPEAT_BYTES)


@_tidy
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


@_tidy
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    arrow_batches(spark)
    return packing.pack(docs, texts=True)


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near", near_duplicates),
    ("repeats", repeated_strings),
    ("mix", mix),
    ("pack", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs, done = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        with recorded() as written:
            docs = staged(out, f"pipeline-{name}")
        release(spark, done)
        done = written
    return STAGES[-1][1](spark, docs, sf_dir)
