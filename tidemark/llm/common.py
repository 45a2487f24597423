"""What the training-data operators share: table access, Arrow batches, the shared folder."""

from __future__ import annotations

import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.sources.shared import scratch

#: Rows in one Arrow batch that goes to a Python worker; whole texts make larger batches heavy.
BATCH_ROWS = 512
#: Entries that a per-process memo may hold before it is emptied.
MEMO_ENTRIES = 300_000
#: The same where a missing value is computed about as fast as it is found. A stage has more workers than tasks that run, and the idle ones keep their memos.
FEW_ENTRIES = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType) -> DataFrame:
    """Apply fn to the Arrow batches of df, BATCH_ROWS rows at a time, so that what fn makes follows the longest rows, not the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty_idle_memos()
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                yield fn(batch.slice(at, BATCH_ROWS))

    return df.mapInArrow(run, schema)


def materialize(df: DataFrame, label: str, narrow: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, and a lost executor loses nothing. Narrow rows go into a few files for
    each core of the cluster instead of one for each shuffle partition."""
    spark = df.sparkSession
    if narrow:
        df = df.coalesce(4 * spark.sparkContext.defaultParallelism)
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: The memos of this process, by identity.
_memos: "weakref.WeakValueDictionary[int, Memo]" = weakref.WeakValueDictionary()


#: The stage of the last task in this process.
_stage: int | None = None


def empty_idle_memos() -> None:
    """Empty all memos if this is another stage's task than the last, else those that nothing was added to since the last call. Workers live on from stage to stage, so without it each would hold the words of all stages at once."""
    global _stage
    task = TaskContext.get()
    before, _stage = _stage, task.stageId() if task else None
    for memo in list(_memos.values()):
        if not memo.grown or _stage != before:
            memo.clear()
        memo.grown = False


class Memo(dict):
    """A dictionary that computes missing values and is emptied when it grows past its bound."""

    def __init__(self, compute: Callable, entries: int = MEMO_ENTRIES):
        super().__init__()
        self.compute, self.entries, self.grown = compute, entries, False
        _memos[id(self)] = self

    def __missing__(self, key):
        self.grown = True
        if len(self) >= self.entries:
            self.clear()
        value = self[key] = self.compute(key)
        return value
