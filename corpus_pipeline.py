"""From raw documents to shards for training: five stages, each one operator of ``webplan.llm`` on all that the stage
before it kept.  All but the last return the columns of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from webplan.llm import decontaminate, langid, mixing, near_copies, sharding
from webplan.llm.common import settled
from webplan.session import ship_package

SHARDS, SEED, REPEATS = 16, 0, 2.0


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language is found, or that the learned languages together do not explain, go."""
    return langid.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest doc_id.  Near copies share their five-word shingles with
    a Jaccard similarity of 0.8 or more, or are linked by such pairs; SimHash tables and MinHash bands name the pairs to compare."""
    return near_copies.drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten successive words of a benchmark item go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated, up to twice, towards equal shares; every document stays at least once."""
    plan = mixing.source_plan(docs, repeats=REPEATS, seed=SEED)
    return mixing.mix_sources(docs, plan, seed=SEED, names=("__block", "__place")).select(*[f"`{c}`" for c in docs.columns])


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in a uniform random order over shards whose sizes differ by one at most."""
    return sharding.shuffle_into_shards(docs, SHARDS, SEED)


def _stage(name: str, work):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return work(spark, docs, sf_dir)

    return name, run_stage


STAGES = [
    _stage("language_id", language_id), _stage("near_dedup", near_dedup), _stage("decontamination", decontamination),
    _stage("source_mixing", source_mixing), _stage("sharding", shards),
]
#: Language inference, fingerprints and random permutations cannot be expressed in SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = settled(docs)
    return docs
