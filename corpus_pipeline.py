"""From raw documents to token shards, in five stages.

Each stage is (spark, docs, sf_dir) -> DataFrame; `run` writes what a stage
returns to the shared folder and hands the re-read table to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reconlake.llm import decontaminate, mixing, quality, simhash, token_shards
from reconlake.llm.queries import MIX_BUDGET, MIX_SHARES, ORDER_KEY
from reconlake.plans.lineage import written
from reconlake.sources.tables import table


def _rows(docs: DataFrame, *names: str) -> DataFrame:
    """`docs` as one column `row`, beside the named ones, so that no column that a stage adds can clash."""
    return docs.select(F.struct("*").alias("row"), *names)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the word rules and their language's fertility bands."""
    return quality.judge(_rows(docs, "text", "lang")).where("kept").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the least doc_id."""
    return simhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    found = decontaminate.scan(_rows(docs, "text"), table(spark, sf_dir, "benchmark"))
    return found.where(F.size("hit_spans") == 0).select("row.*")


def sample_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens follow the target shares of sources, languages and topics."""
    mixed = mixing.mix(_rows(docs, "doc_id", "text", "lang", "source"), MIX_SHARES, MIX_BUDGET, fill=True)
    return mixed.where("sampled").select("row.*")


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards in training order."""
    return token_shards.shards(docs, ORDER_KEY)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", drop_contaminated),
    ("mixing to target weights", sample_mix),
    ("token output", write_tokens),
]

#: Fingerprints and tokenizers can't be expressed in SQL; tests/llm holds the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
