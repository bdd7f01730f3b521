"""Scans: projected and filtered Parquet, by-suffix reads, JSON documents, binary manifests."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_SCHEMAS: dict[tuple[str, str], T.StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table; its footer schema is read once per application, not per use."""
    path = f"{sf_dir}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _SCHEMAS:
        _SCHEMAS[key] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(path)


def scan_projected(
    spark: SparkSession, path: str, columns: Sequence[str], predicate: Column | None = None
) -> DataFrame:
    """Projection and predicate stated on the scan, so both reach the Parquet reader."""
    df = spark.read.parquet(path)
    if predicate is not None:
        df = df.filter(predicate)
    return df.select(*columns)


def scan_before_cutoff(
    spark: SparkSession, path: str, columns: Sequence[str], date_col: str, cutoff: str
) -> DataFrame:
    """Rows strictly before a cutoff; the column must physically be a date or timestamp."""
    dtype = spark.read.parquet(path).schema[date_col].dataType
    if not isinstance(dtype, T.DateType | T.TimestampType | T.TimestampNTZType):
        raise TypeError(f"{date_col} must be a date or timestamp, is {dtype.simpleString()}")
    literal = F.lit(cutoff).cast(dtype)
    return scan_projected(spark, path, columns, F.col(date_col) < literal)


READERS = {".parquet": "parquet", ".csv": "csv", ".json": "json"}


def scan_by_suffix(
    spark: SparkSession, path: str, schema: T.StructType, *, required: Sequence[str] = ()
) -> DataFrame:
    """Parquet, CSV or JSON lines by file suffix with a declared schema (no inference)."""
    suffix = PurePosixPath(path).suffix.lower()
    if suffix not in READERS:
        raise ValueError(f"unsupported table suffix {suffix!r}")
    missing = [c for c in required if c not in schema.fieldNames()]
    if missing:
        raise ValueError(f"schema lacks required columns {missing}")
    reader = spark.read.format(READERS[suffix]).schema(schema)
    if suffix == ".csv":
        reader = reader.option("header", True).option("enforceSchema", False)
    return reader.load(path)


def scan_with_identity(
    df: DataFrame, registry: DataFrame, key: str, identity: Sequence[str]
) -> DataFrame:
    """Join scanned rows to their registry row and say whether their identity agrees."""
    reg = registry.select(key, *[F.col(c).alias(f"_reg_{c}") for c in identity])
    joined = df.join(reg, key, "left")
    agrees = F.lit(True)
    for c in identity:
        agrees = agrees & F.col(c).eqNullSafe(F.col(f"_reg_{c}"))
    return joined.withColumn("identity_ok", agrees).drop(*[f"_reg_{c}" for c in identity])


def file_key(prefix: str) -> Column:
    """Value of a ``prefix=value`` path segment of the file a row came from."""
    return F.regexp_extract(F.col("_metadata.file_path"), rf"{prefix}=([^/]+)/", 1)


def file_manifest(spark: SparkSession, root: str, *, glob: str = "*") -> DataFrame:
    """Inventory of the files below a root: relative path, size, sha256.

    Hashing runs in the tasks that read the files; no content reaches the driver.
    """
    base = root.rstrip("/").split(":", 1)[-1] + "/"
    after_root = F.locate(base, F.col("path")) + len(base)
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load(root)
        .select(
            F.expr("path").substr(after_root, F.length("path")).alias("rel_path"),
            F.col("length").alias("size_bytes"),
            F.sha2("content", 256).alias("sha256"),
        )
    )


def verify_manifest(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Status per path: ok, missing, extra, size_mismatch or hash_mismatch."""
    e, a = expected.alias("e"), actual.alias("a")
    status = (
        F.when(F.col("a.rel_path").isNull(), "missing")
        .when(F.col("e.rel_path").isNull(), "extra")
        .when(F.col("a.size_bytes") != F.col("e.size_bytes"), "size_mismatch")
        .when(F.col("a.sha256") != F.col("e.sha256"), "hash_mismatch")
        .otherwise("ok")
    )
    return e.join(a, F.col("e.rel_path") == F.col("a.rel_path"), "full_outer").select(
        F.coalesce("e.rel_path", "a.rel_path").alias("rel_path"), status.alias("status")
    )


def gap_index(
    expected: DataFrame, available: DataFrame, by: list[str], day: str
) -> DataFrame:
    """Expected, available and missing days per group and year, with the first missing day."""
    have = available.select(*by, day).distinct().withColumn("_have", F.lit(1))
    joined = expected.join(have, [*by, day], "left")
    absent = F.col("_have").isNull()
    return joined.groupBy(*by, F.year(day).cast("long").alias("year")).agg(
        F.count(F.lit(1)).alias("expected"),
        F.count("_have").alias("available"),
        F.sum(F.when(absent, 1).otherwise(0)).alias("missing"),
        F.min(F.when(absent, F.col(day))).alias("first_missing"),
    )
