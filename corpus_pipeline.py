"""A training corpus from the table ``documents`` in five stages, each on what the one before has kept.

``STAGES`` are (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All but the last return the columns of ``documents``.

Defined results: null and empty texts fail the base quality rule, so the first stage drops them; later stages on their own
keep them, but they have no tokens. Rows without doc_id pass all stages if their quality does. Of rows that repeat a
doc_id the near-duplicate stage keeps one. A null source is a source of its own. Empty tables give an empty corpus, and
without labels the base rule alone decides. Extra columns are carried along to the last stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from skein.llm import decontaminate, mixing, near_dedup, packing, quality
from skein.llm.common import shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned decision list rejects go."""
    return quality.passed(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document of the least doc_id stays."""
    return near_dedup.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, sorted so that read in order the sources stand in proportion to their weights."""
    return mixing.mixed(docs)


def token_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed rows of token ids; read in the order of (since, row) they follow the mixture, pool by pool."""
    return packing.packed(docs, in_files=True)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source mixing", source_mixing),
    ("token packing", token_packing),
]

#: Learned rules, near duplicates and tokens are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
