"""Audit of filters that are applied one after another: what each removes in each order, what others would have removed anyway, and each filter's Shapley value.

A document's outcome in all orders follows from the set of filters that it fails, its mask. So documents are counted once by part and mask: one narrow pass over
the texts, a join with the labels, and sums with map-side combining; at most 2^5 cells a part are left, whatever the number of documents. The orders of
a part are then walked by adjacent transpositions: neighbouring orders differ by one swap of neighbouring steps, so only these two steps are
told from the cells anew, and all other steps are carried over. Each filter's Shapley value is summed along the walk.

The filters are A (few words), B (few different words), C (many capitals), D (symbols) and E (the text of a smaller id again). E needs no join of texts:
equal texts share their mask of the first four, so a text's rows are summed by text and part, with the rows of its smallest id told apart, and
each text's smallest id is looked up over its parts.

Defined results: a null text is empty, and so equal to other empty ones; a null part (lang) is the empty string; a null id has no labels, never fails E and makes
no other fail; rows that share the smallest id of a text don't fail E; an id with several labels is good or toxic if any says so; labels that
are null are no labels; an empty table has no parts and gives an empty result; a long text costs memory for its own words; other
columns, also such with clashing names, are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, table

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3
CAPITALS, SYMBOLS = bytes(range(0x41, 0x5B)), b"#$%&*|"
#: Bytes of UTF-8 that begin no code point.
INNER = bytes(range(0x80, 0xC0))
AUDIT = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"


def mask_of(text: bytes) -> int:
    """The filters A to D that a text fails, as bits."""
    words = text.split()
    n, distinct = len(words), len(set(words))
    capitals = len(text) - len(text.translate(None, CAPITALS))
    points = len(text.translate(None, INNER))
    symbols = len(text.translate(None, SYMBOLS)) != len(text)
    return (n < LEAST_WORDS) | (100 * distinct < LEAST_DISTINCT * n) << 1 | (100 * capitals > MOST_CAPITALS * points) << 2 | symbols << 3


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(id, part, digest, mask) of every row; digest tells equal texts."""

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or b"" for t in rows.column(2).to_pylist()]
        digests, masks = [hashlib.sha256(t).digest() for t in texts], [mask_of(t) for t in texts]
        return pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(digests, pa.binary()), pa.array(masks, pa.int32())], names=["id", "part", "digest", "mask"])

    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).cast("binary").alias("_text"))
    return map_arrow(rows, batch, f"id {docs.schema[key].dataType.simpleString()}, part string, digest binary, mask int")


def cells(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): how many documents fail just these filters. At most 32 rows a part."""
    # Equal rows meet first, spread by id and text, so that neither a hot text nor a repeated or null id is one task's.
    rows = judged(docs, key, text, part).groupBy("id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    of = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0))
    known = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(of("quality").alias("good"), of("toxic").alias("toxic"))
    times = lambda c: F.when(F.col(c) == 1, F.col("n")).otherwise(0)
    marked = rows.join(known, "id", "left").select("id", "part", "digest", "mask", "n", times("good").alias("good"), times("toxic").alias("toxic"))
    # A text in a part: all its rows, and those of its smallest id there. Few rows are left of a hot text.
    counts = ["n", "good", "toxic"]
    least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", *counts)))
    nameless = [F.sum(F.when(F.col("id").isNull(), F.col(c)).otherwise(0)).alias(f"null_{c}") for c in counts]
    texts = marked.groupBy("digest", "part", "mask").agg(*(F.sum(c).alias(c) for c in counts), least.alias("least"), *nameless)
    texts = texts.withColumn("first", F.min("least.id").over(W.partitionBy("digest")))
    passed = lambda c: F.col(f"null_{c}") + F.coalesce(F.when(F.col("least.id") == F.col("first"), F.col(f"least.{c}")), F.lit(0))
    both = F.array(F.struct(F.col("mask").alias("mask"), *(passed(c).alias(c) for c in counts)), F.struct((F.col("mask") + 16).alias("mask"), *((F.col(c) - passed(c)).alias(c) for c in counts)))
    return texts.select("part", F.inline(both)).groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in counts))


def adjacent_orders(n: int) -> Iterator[tuple[list[int], int | None]]:
    """All orders of n items, each with the place whose swap with the next one made it from the order before (None at first): an item moves until it meets
    a larger one or the end, then the next smaller item moves one place and all larger ones turn round."""
    order, ahead = list(range(n)), [-1] * n
    yield order, None
    while True:
        movable = [v for k, v in enumerate(order) if 0 <= k + ahead[v] < n and order[k + ahead[v]] < v]
        if not movable:
            return
        v = max(movable)
        k = order.index(v)
        at = min(k, k + ahead[v])
        order[at], order[at + 1] = order[at + 1], order[at]
        for w in range(v + 1, n):
            ahead[w] = -ahead[w]
        yield order, at


def audit_cells(found: np.ndarray) -> list[tuple]:
    """(order, step, kept, removed, redundant, unique fails, good lost, toxic lost, Shapley sum) of all orders and steps. found: (masks, 3), the cells' n, good and
    toxic by mask."""
    size = len(found).bit_length() - 1
    masks = np.arange(len(found))
    total = int(found[:, 0].sum())
    fails = [int(found[masks >> f & 1 == 1, 0].sum()) for f in range(size)]
    alone = [int(found[1 << f, 0]) for f in range(size)]
    shapley, steps, rows = [0] * size, np.zeros((size, 3), np.int64), []
    for order, at in adjacent_orders(size):
        for k in range(size) if at is None else (at, at + 1):
            before = sum(1 << f for f in order[:k])
            steps[k] = found[(masks >> order[k] & 1 == 1) & (masks & before == 0)].sum(axis=0)
        name, kept = "".join(FILTERS[f] for f in order), total - np.cumsum(steps[:, 0])
        for k, f in enumerate(order):
            removed, good, toxic = map(int, steps[k])
            shapley[f] += removed
            rows.append((name, k + 1, int(kept[k]), removed, fails[f] - removed, alone[f], good, toxic, f))
    return [(*r[:-1], shapley[r[-1]]) for r in rows]


def audit(found: DataFrame) -> DataFrame:
    """All orders and steps of each part of cells. A part has at most 32 rows, which are walked in its task."""

    def walk(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        table = np.zeros((1 << len(FILTERS), 3), np.int64)
        table[pdf["mask"].to_numpy()] = pdf[["n", "good", "toxic"]].to_numpy()
        names = [c.split()[0] for c in AUDIT.split(", ")]
        return pd.DataFrame([(key[0], *r) for r in audit_cells(table)], columns=names)

    return found.groupBy("part").applyInPandas(walk, AUDIT)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


#: The same in DuckDB's dialect, by counting each order and step on its own.
OP13_SQL = """WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
  l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
  m AS (SELECT part, coalesce(good, false)::INT AS good, coalesce(toxic, false)::INT AS toxic, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask FROM t LEFT JOIN l USING (doc_id)),
  c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
  f(x, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
  o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
  s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
  r AS (SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed, sum(CASE WHEN mask & bit > 0 AND mask & before > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost FROM c, s GROUP BY ALL)
  SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r"""
