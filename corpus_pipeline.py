"""Corpus pipeline: quality rules, near duplicates, benchmark passages,
source mixing, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.  All but the
last return the columns of ``documents``.

  quality_rules    documents that fail a rule go
  near_duplicates  one document of each group of near copies stays
  decontamination  documents with a passage of a benchmark item go; items of
                   fewer than five words prove nothing and are not looked for
  source_mixing    every document stays; rows are put, and written, in the
                   order of the mix of sources
  sharding         one row per document with its shard and slot: documents are
                   dealt to the shards, and numbered in them, in the order of
                   the files (that of the mix), and documents that share a
                   line are drawn to one shard

Defined results, for every stage: a null text is an empty one (the quality
rules reject it); null and repeated doc_ids and repeated rows are rows like
others (of equal texts one row stays after ``near_duplicates``); extra columns,
whatever their names, are carried through up to the last stage, whose columns
are its own; ties are broken by the id, then by the row's text; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, jaccard, mixing, quality, sharding
from tessera.llm._store import saved
from tessera.session import ship_package


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return decontam.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), min_words=LINK_WORDS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.in_mix_order(docs)


def shared_line(text: str = "text"):
    """Hash of one line of at least ``LINK_WORDS`` words, the least of all such
    lines of the text (null without one): texts with a line in common are
    likely to have the same one."""
    words = f"size(array_remove(split(trim(x), '[ \\\\t\\\\r]+'), '')) >= {LINK_WORDS}"
    return F.expr(f"array_min(transform(filter(split({text}, '\\n'), x -> {words}), x -> xxhash64(x)))")


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, order = sharding.file_order(docs)
    return sharding.shard_documents(rows, link=shared_line(), order=order)


#: words of a line that links texts, and of the least benchmark item
LINK_WORDS = 5

STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("sharding", sharding_stage),
]

#: label propagation has no SQL form; tests compare run() with a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
