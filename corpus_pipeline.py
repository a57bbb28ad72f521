"""A corpus pipeline of five stages, each one of the operators of brindle.llm.

run() writes each stage's documents as Parquet in the shared folder and reads them again as the next one's. All but
the last stage return the columns of documents, whatever further columns there are and however they are named.

Every stage takes null ids, texts and sources, empty and very long texts, repeated rows and empty tables; what becomes
of them is said with each.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from brindle.llm.common import shared_folder, table
from brindle.llm.decontam import keep_clean
from brindle.llm.mixing import mixed_rows
from brindle.llm.quality_rules import keep_good
from brindle.llm.sharding import set_aside, sharded
from brindle.llm.simhash import keep_one


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the host rules reject go. Null and empty texts have too few words and go; a null source is a host of
    its own; repeated rows are judged alike; very long texts are counted whole; an empty table stays empty."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five-word shingles, similarity 0.8) stays: that with the smallest
    id, nulls last, ties by a hash of the row. Of repeated rows one stays; texts without words are copies of each other;
    very long texts are compared whole; an empty table stays empty."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window like a benchmark item go. Null and empty texts and items match nothing, items need no id;
    repeated rows go or stay together; very long texts are searched whole; an empty table, of documents or of items,
    loses nothing."""
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated as their sources' targets ask for. Null and wordless texts are no part of a mix; a null
    source is a source of its own; repeated rows are taken alike; where a source's words run out, the last text is cut to
    the words that its target has left; an empty table stays empty."""
    return mixed_rows(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows get a shard and a slot in it. Null texts have size 1; equal texts share a shard unless they are too many;
    columns of documents that have the name of a new one get a fresh name (size becomes size_); an empty table stays
    empty."""
    return sharded(set_aside(docs))


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs


#: SimHash components and multiset windows aren't within reach of the SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None
