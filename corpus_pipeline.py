"""A corpus pipeline: five stages from documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all rows of its predecessor and returns a DataFrame that
is written as Parquet and read again as the next one's ``docs``. All but the last keep the columns of
``documents``. Null texts and empty tables pass through every stage; see each operator for its cases.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import decontaminate, signature_join, surrogates, toxicity, vector_packing
from panelspark.llm.common import free_name, read
from panelspark.session import shared_dir

#: Documents at or above this score are rejected.
TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4, fitted on the labels of the given documents; a document that it rejects goes."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    score = free_name(docs, "_score")
    return toxicity.flag(docs, model, score_col=score).filter(F.col(score) < TOXIC).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10 on five-word shingles at similarity 0.8; the first document of each group stays."""
    return signature_join.keep_first(docs, 5, 80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2; a document that contains a benchmark item goes."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6; texts with personal data get surrogates, all documents stay."""
    count = free_name(docs, "_n_entities")
    return surrogates.replace(docs, count_col=count).drop(count)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7; one row per piece of a document in a training sequence."""
    return vector_packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("pii", replace_personal_data),
    ("packing", pack),
]

#: No SQL can express tokenization, learned scores or keyed surrogates; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; every result but the last is a table in the shared folder."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
