"""Corpus pipeline: stages that each apply one operator of kgraph.llm to all that the stage before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, with others
that there are, whatever they are called.  An empty table gives an empty table, and every stage works on whole texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kgraph.llm.common import WRITTEN, materialize, release, release_since, table
from kgraph.llm.mixing import mixed_documents
from kgraph.llm.near_copies import keep_first_copy
from kgraph.llm.packing import pack
from kgraph.llm.quality_rules import quality_rules, trusted_documents
from kgraph.llm.simhash import SimHashParams
from kgraph.llm.suffix_dedup import deduplicated

#: SQL has no XXH64, no connected components and no bin packing, so there is none for the whole pipeline.
ORACLE_SQL = None

#: Links of operator 1 that are tried first; only those of five-word similarity 0.8 or more count, and near_copies finds all
#: such pairs that six bits miss.
NEAR = SimHashParams(shingle=5, threshold=6)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep: rows with null texts, which have no words, go; null doc_ids don't matter."""
    trusted = trusted_documents(table(spark, sf_dir, "labels"))
    return quality_rules(docs, trusted, carry=True).where("kept").select("row.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest doc_id, null last; of rows that repeat, one."""
    return keep_first_copy(docs, NEAR)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without strings of 100 bytes or more that start earlier too.  A character of which only some bytes go
    goes as a whole.  Null doc_ids come first, null texts become empty, n_chars is counted anew."""
    return deduplicated(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; rows that share a doc_id share the draw, null sources are a source."""
    return mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document, with its place in a sequence."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeated_substrings", substring_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stage wrote for itself is removed when its output is written, and its input when that was an earlier output."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        mark, before = len(WRITTEN), docs
        docs = materialize(stage(spark, docs, sf_dir), name)
        release_since(spark, mark, docs)
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
