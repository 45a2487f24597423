"""Sinks: the canonical store, appended idempotently, the import log, and tab-separated and JSON copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.ingest import UNIQUE, new_rows
from tidemark.sources.store import Store

#: The families of a store and what their files are parted by.
FAMILIES = {"measurements": "metric", "states": "kind", "unmapped": "source_type", "sessions": "activity_type", "session_stats": "metric", "routes": "shelf"}


def family_store(spark: SparkSession, store: str, family: str) -> Store:
    return Store(spark, store, family, FAMILIES[family])


def read_family(spark: SparkSession, store: str, family: str) -> DataFrame | None:
    """A family of the store, or None if it has no rows yet."""
    return family_store(spark, store, family).read()


def append(spark: SparkSession, batch: DataFrame, store: str, family: str) -> DataFrame:
    """Append what the family lacks, each account by itself, as one version; files are parted, so reads of one metric or kind skip the others."""
    held = family_store(spark, store, family)
    return held.read(held.append(lambda stored: new_rows(batch, batch.limit(0) if stored is None else stored)))


def append_measurements(spark: SparkSession, batch: DataFrame, store: str) -> DataFrame:
    return append(spark, batch, store, "measurements")


def insert_sessions(spark: SparkSession, batch: DataFrame, store: str) -> DataFrame:
    """Append sessions and return (account_id, content_key, id) for every session of the batch, new or known: a session's id is derived from its account
    and content, so that a second insert meets the first."""
    named = batch.withColumn("id", F.xxhash64("account_id", "content_key"))
    append(spark, named, store, "sessions")
    return named.select(*UNIQUE, "id").distinct()


def add_manual(spark: SparkSession, entry: DataFrame, store: str) -> DataFrame:
    """Append a manual entry; the same entry again converges on the stored one. Returns its stored row."""
    rows = entry.withColumns({"seq": F.lit(0).cast("bigint"), "id": F.xxhash64(*UNIQUE)})
    stored = append(spark, rows, store, "measurements")
    return stored.join(rows.select(*UNIQUE), list(UNIQUE), "left_semi")


def drop_manual(spark: SparkSession, store: str, account_id: int, row_id: int) -> int:
    """Delete one manual row and return how many went; rows of devices stay whatever the id. Either the new version is there or the old one is."""
    return family_store(spark, store, "measurements").delete((F.col("account_id") == account_id) & (F.col("id") == row_id) & (F.col("source") == "Manual"))


def record_import(spark: SparkSession, path: str, account_id: int, source_file: str, added: int, skipped: int, unmapped: int, at) -> None:
    row = [(account_id, source_file, added, skipped, unmapped, at)]
    spark.createDataFrame(row, "account_id bigint, source_file string, added_count bigint, skipped_count bigint, unmapped_count bigint, imported_at timestamp_ntz").write.mode("append").parquet(path)


def write_tsv(df: DataFrame, path: str) -> None:
    """df as tab-separated text with a header."""
    df.select(*(F.col(c).cast("string").alias(c) for c in df.columns)).write.mode("overwrite").option("header", True).csv(path, sep="\t")


def write_json(df: DataFrame, path: str) -> None:
    """df as a JSON object a line: days and times as ISO text, missing values as null."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)
