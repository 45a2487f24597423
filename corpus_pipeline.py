"""The corpus pipeline: reject toxic texts, reject low quality, keep one of near copies, redact secrets, pack into sequences.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import near_duplicates, packing, quality, secrets, toxicity
from tidemark.llm.common import materialize, table
from tidemark.sources.shared import scratch

#: Per cent of all shingles of two documents that they share if the stage takes them for copies.
NEAR_PERCENT = 80


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't predict as toxic. It is fitted on the labelled rows among docs."""
    model = toxicity.fit_sample(toxicity.training_sample(docs, table(spark, sf_dir, "labels")))
    return toxicity.keep_clean(docs, model)


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the threshold table keeps."""
    return quality.keep(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies, the one with the smallest id. Rows are told by a key of the stage's own, so null ids and ids that
    texts share lose nothing; null and empty texts are copies of nothing and stay. A pair at 0.80 shares no bucket with probability
    (1 - 0.8^6)^32 = 6e-5."""
    keyed = materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "keyed")
    found = near_duplicates.near_duplicates(keyed, "_row", least_percent=NEAR_PERCENT).select("_row", "component_id")
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "_row")
    kept = found.join(keyed.select("_row", "doc_id"), "_row").groupBy("component_id").agg(F.min_by("_row", first).alias("_row")).select("_row")
    return keyed.join(kept, "_row", "left_semi").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by marks and n_chars brought up to date."""
    return secrets.redact_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("quality_rules", reject_low_quality),
    ("minhash_near_dedup", drop_near_duplicates),
    ("secret_scans", redact_secrets),
    ("best_fit_packing", pack),
]

#: Trained scores, sketches and a packing can't be written as SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Each stage is written to the shared folder and read again."""
    folder = scratch(spark, "corpus")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
