"""Importance resampling towards a target: documents whose hashed word runs are likelier in the target than in the corpus are drawn more often.

Features of a text are its runs of 1 to n neighbouring words, each hashed to a bucket. A bucket's gain is the scaled, floored logarithm of how much likelier
it is in the target; a document's weight is the sum of its features' gains. A draw without replacement of likelihood proportional to exp(weight) is
the top of weight plus Gumbel noise, which comes from a hash of the seed and the id, so that it is repeatable.

Long texts are skew: a text of more than CHUNK_BYTES is split at word boundaries into chunks, each with the n - 1 words after its end as carry, and its
chunks are dealt to all tasks. A chunk owns the places where its own words start, so each run is counted once, by the chunk that owns its first word.
Chunk counts and weights are then summed by document. Short texts are one chunk, stay where they were read and are never shuffled.

Counts of buckets are summed inside each task before they are shuffled, and BUCKETS rows at most reach the driver. Ranks come from a range partition of the
narrow scores: a row's place in its partition plus the sizes of the partitions before it. No task sees more than its range.

Defined results: a null or empty text has no words, no features and weight 0; a null id hashes as an empty one and sorts behind the others; repeated rows
give repeated rows, each with its own rank; with an empty target or corpus gains are those of the smoothed counts; an empty table gives an empty result;
a word longer than a chunk is not cut, so its chunk is as long as it; other columns, also such with clashing names, are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import Memo, materialize, table

RUNS, BUCKETS, LEAST_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024
#: Texts with more bytes than this are split, into chunks of about as many.
CHUNK_BYTES = 1 << 15
#: A-Z in lower case; all other ASCII characters that are no digits or small letters become blanks. Bytes of longer characters are parts of words.
WORD_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else 32 if c <= 0x2F or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F else c for c in range(256))


def clean(text: bytes | None) -> bytes:
    """A text's words, between blanks."""
    return (text or b"").translate(WORD_BYTES)


def word_ends(words: bytes, at: int, most: int) -> int:
    """Where the next `most` words from at on have ended."""
    for _ in range(most):
        while at < len(words) and words[at] == 32:
            at += 1
        end = words.find(b" ", at)
        at = len(words) if end < 0 else end
    return at


def split(words: bytes, n: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(number of own words, own words and carry) of the chunks of a cleaned text; chunks end at the first word boundary after size bytes."""
    at = 0
    while at < len(words):
        cut = words.find(b" ", min(at + size, len(words)))
        cut = len(words) if cut < 0 else cut
        own = len(words[at:cut].split())
        if own:
            yield own, words[at : word_ends(words, cut, n - 1)]
        at = cut


def bucket_of(feature: bytes, buckets: int) -> int:
    return zlib.crc32(feature) % buckets


def features(words: bytes, own: int | None, n: int, known: Memo) -> np.ndarray:
    """The buckets of the runs of 1 to n words that start at the first own words (all if None)."""
    found = words.split()
    starts = len(found) if own is None else own
    parts = [np.fromiter(map(known.__getitem__, found[:starts]), np.int64, starts)]
    for k in range(2, n + 1):
        last = min(starts, len(found) - k + 1)
        parts.append(np.fromiter((known[b" ".join(found[i : i + k])] for i in range(last)), np.int64, max(last, 0)))
    return np.concatenate(parts) if n > 1 else parts[0]


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = RUNS, size: int = CHUNK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Short texts, one chunk each, in place; and the chunks of long ones, dealt out: (id, text_hash, first, own, words). text_hash tells long texts that
    share an id, first is 1 for the first chunk of a text, own is null where all words are the chunk's own."""
    spark = docs.sparkSession
    schema = f"id {docs.schema[key].dataType.simpleString()}, text_hash binary, first bigint, own bigint, words binary"
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("binary").alias("_raw"))
    long = F.coalesce(F.octet_length("_raw"), F.lit(0)) > size

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                words = clean(b.column(1)[k].as_py())
                for i, (own, part) in enumerate(split(words, n, size) if words.strip() else [(0, b"")]):
                    numbers = [pa.array([x], pa.int64()) for x in (int(i == 0), own)]
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), b.column(2).slice(k, 1), *numbers, pa.array([part], pa.binary())], names=["id", "text_hash", "first", "own", "words"])

    one = F.lit(1).cast("bigint")
    short = rows.filter(~long).select("id", F.lit(None).cast("binary").alias("text_hash"), one.alias("first"), F.lit(None).cast("bigint").alias("own"), F.col("_raw").alias("words"))
    dealt = rows.filter(long).withColumn("_hash", F.unhex(F.sha2("_raw", 256))).mapInArrow(pieces, schema)
    return short, dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))


def bucket_counts(docs: DataFrame, text: str = "text", n: int = RUNS, buckets: int = BUCKETS, size: int = CHUNK_BYTES) -> np.ndarray:
    """How many features of all texts lie in each bucket. Tasks sum their chunks first, so a task sends `buckets` rows at most."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, known = np.zeros(buckets, np.int64), Memo(lambda w: bucket_of(w, buckets))
        for b in batches:
            for k in range(b.num_rows):
                found = features(clean(b.column(1)[k].as_py()), b.column(0)[k].as_py(), n, known)
                np.add.at(total, found, 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    short, long = chunks(docs.withColumn("_id", F.lit(0)), "_id", text, n, size)
    parts = [c.select("own", "words").mapInArrow(count, "bucket bigint, n bigint") for c in (short, long)]
    out = np.zeros(buckets, np.int64)
    for r in parts[0].unionByName(parts[1]).groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of each bucket."""
    n = len(corpus)
    above = (target + 1).astype(np.float64) * float(corpus.sum() + n)
    below = (corpus + 1).astype(np.float64) * float(target.sum() + n)
    return np.floor(1000 * np.log(above / below)).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text", n: int = RUNS, size: int = CHUNK_BYTES) -> DataFrame:
    """(key, n_words, n_features, weight) of every row. Only chunks of long texts are grouped; rows among these that are equal are told by how many first
    chunks came, and are given back as often."""
    buckets = len(gain)
    sums = ("n_words", "n_features", "weight")

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Memo(lambda w: bucket_of(w, buckets))
        for b in batches:
            made = []
            for k in range(b.num_rows):
                own, words = b.column(3)[k].as_py(), clean(b.column(4)[k].as_py())
                found = features(words, own, n, known)
                n_words = own if own is not None else len(found) if n == 1 else len(words.split())
                made.append((n_words, len(found), int(gain[found].sum())))
            numbers = [pa.array([m[i] for m in made], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *numbers], names=["id", "text_hash", "first", *sums])

    schema = f"id {docs.schema[key].dataType.simpleString()}, text_hash binary, first bigint, n_words bigint, n_features bigint, weight bigint"
    short, long = (c.mapInArrow(weigh, schema) for c in chunks(docs, key, text, n, size))
    summed = long.groupBy("id", "text_hash").agg(F.sum("first").alias("copies"), *(F.sum(c).alias(c) for c in sums))
    each = summed.select("id", *(F.expr(f"{c} div copies").alias(c) for c in sums), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("_copy"))
    return short.select("id", *sums).unionByName(each.drop("_copy")).withColumnRenamed("id", key)


def noise(key: Column, seed: int = SEED) -> Column:
    """Scaled, floored Gumbel noise from the first 8 hex digits of sha256(seed:id)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("bigint")


def draw(weighed: DataFrame, key: str = "doc_id", least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """weighed with score and rank (null where a row isn't drawn): of the N rows with at least least_words words the floor(percent x N / 100) highest scores,
    ties to the smaller id. Rows are sorted by range over all tasks; a rank is the place in a range plus the sizes of the ranges before."""
    scored = weighed.withColumn("score", F.col("weight") + noise(F.col(key), seed))
    kind = F.col("n_words") >= least_words
    order = [F.desc("score"), F.asc_nulls_last(key)]
    sorted_rows = scored.filter(kind).repartitionByRange(*order).sortWithinPartitions(*order)
    # The id tells partition and place; written once, so that ranges and places are those that are counted.
    placed = materialize(sorted_rows.withColumn("_at", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.orderBy("_part")) - F.col("_n")
    starts = sizes.select("_part", before.alias("_before"), F.sum("_n").over(W.partitionBy()).alias("_all"))  # one row a range
    rank = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranked = placed.withColumn("_part", part).join(F.broadcast(starts), "_part").select(*scored.columns, F.when(rank <= F.floor(F.col("_all") * percent / 100), rank).alias("rank"))
    return ranked.unionByName(scored.filter(~kind).withColumn("rank", F.lit(None).cast("bigint")))


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", n: int = RUNS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED, size: int = CHUNK_BYTES) -> DataFrame:
    """(key, n_words, n_features, weight, score, rank) of every row of docs."""
    gain = gains(bucket_counts(docs, text, n, buckets, size), bucket_counts(target, target_text, n, buckets, size))
    # Narrow rows, written once: both sides of the draw read them.
    return draw(materialize(weights(docs, gain, key, text, n, size), "weights"), key, least_words, percent, seed)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")
