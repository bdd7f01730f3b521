"""Writers and table maintenance."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.operators.contracts import duplicate_keys, enforce
from panelspark.session import shared_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_by_year(
    df: DataFrame, path: str, *, date_col: str, sort: Sequence[str], mode: str = "overwrite"
) -> None:
    """Parquet in year folders, rows sorted inside each file.

    Rows are spread over (year, leading sort column) rather than year alone, so a year that holds
    most rows is still written by many tasks.
    """
    (
        df.withColumn("year", F.year(date_col))
        .repartition("year", sort[0])
        .sortWithinPartitions("year", *sort)
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("year")
        .parquet(path)
    )


def upsert(existing: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``existing`` whose key is not in ``batch``, followed by the batch."""
    return existing.join(batch.select(*keys), list(keys), "left_anti").unionByName(
        batch, allowMissingColumns=True
    )


def checked_upsert(existing: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    enforce(duplicate_keys(batch, keys), "batch has duplicate keys")
    return upsert(existing, batch, keys)
