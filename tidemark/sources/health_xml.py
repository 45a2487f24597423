"""Vendor exports: XML files of any size, scanned once in splits, with the depth and the parent of every element.

In well-formed XML a raw "<" begins a tag and nothing else, so Spark's text reader cuts an export at these: a row is one tag with its attributes, whole even where
it lies astride a split, from any store that Spark reads. Which elements are open at a tag is a scan: each split keeps its own stack, notes how many of the elements that
were open before it it has closed, and says at its end what it leaves open; a file's few splits then follow each other in order, and every element gets the
stack that its split began with put under its own. The elements are written once, and records, workouts, statistics and routes are all read from there.

Comments and character data that hold tags are told inside a split.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import vendor_types
from tidemark.functions.columns import content_key
from tidemark.operators.ingest import activity_type, convert_units, duration_seconds, vendor_time
from tidemark.sources.shared import written

#: The elements that are kept, and the one that they stand in.
WANTED = ("Record", "Workout", "WorkoutStatistics", "WorkoutRoute", "FileReference")
ROOT = "HealthData"
ATTRIBUTES = {"type": "type", "unit": "unit", "value": "value", "sourceName": "source", "startDate": "start_raw", "endDate": "end_raw"}
#: What a scan says: of an element its tag, attributes, the elements of this split that it stands in, and how many of earlier splits' are closed; at the end of a split
#: (tag "") the elements that it leaves open.
SCANNED = "file string, split bigint, row bigint, tag string, attributes map<string, string>, inside array<struct<tag: string, split: bigint, row: bigint>>, closed int"
SPACE = re.compile(r"[\t\r\n]")
NAME = re.compile(r"/?[^\s/>]+")
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*("[^"]*"|'[^']*')""")
#: Everything of a tag behind its name, up to the ">" that ends it: none within quotes does.
BODY = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*""")


class Scan:
    """The elements that are open at a place of one split."""

    def __init__(self, file: str, split: int):
        self.file, self.split, self.row, self.closed, self.open, self.until = file, split, 0, 0, [], None

    def read(self, piece: str) -> tuple | None:
        """What stands between two "<": a row if it is a wanted element."""
        if self.until:
            self.until = None if self.until in piece else self.until
            return None
        for start, end in (("!--", "-->"), ("![CDATA[", "]]>")):
            if piece.startswith(start):
                self.until = None if end in piece else end
                return None
        name = NAME.match(piece)
        if name is None or piece[0] in "!?":
            return None
        tag, found = name[0].rpartition(":")[2], None
        if piece[0] == "/":
            if self.open:
                self.open.pop()
            else:
                self.closed += 1
            return None
        body = BODY.match(piece, name.end())
        if tag in WANTED:
            attributes = {k.rpartition(":")[2]: unescape(SPACE.sub(" ", v[1:-1])) for k, v in ATTRIBUTE.findall(body[0])}
            found = (self.file, self.split, self.row, tag, attributes, list(self.open), self.closed)
        if not body[0].endswith("/"):
            self.open.append((tag, self.split, self.row))
        self.row += 1
        return found

    def end(self) -> tuple:
        return self.file, self.split, self.row, "", {}, list(self.open), self.closed


def _frame(rows: list[tuple]) -> pd.DataFrame:
    named = [(*r[:4], r[4], [{"tag": t, "split": s, "row": k} for t, s, k in r[5]], r[6]) for r in rows]
    return pd.DataFrame(named, columns=["file", "split", "row", "tag", "attributes", "inside", "closed"])


def scan(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The wanted elements of pieces (file, split, piece), which come split by split and in order."""
    at: Scan | None = None
    for frame in frames:
        rows = []
        for file, split, piece in frame.itertuples(index=False):
            if at is None or (at.file, at.split) != (file, split):
                rows += [at.end()] if at else []
                at = Scan(file, split)
            found = at.read(piece)
            if found:
                rows.append(found)
        yield _frame(rows)
    if at:
        yield _frame([at.end()])


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """(seq, tag, attributes, inside) of the wanted elements of all exports under path: seq (file, split, row) is their order, inside the elements that they stand in, outermost first.
    The files are parsed once, whatever is read of them."""
    pieces = spark.read.text(path, lineSep="<").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")
    scanned = written(pieces.mapInPandas(scan, SCANNED), "elements")

    def begin(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """The stack that each split of a file begins with."""
        stack, rows = [], []
        for r in pdf.sort_values("split").itertuples():
            rows.append((key[0], r.split, list(stack)))
            stack = stack[: len(stack) - r.closed] + [dict(x.asDict() if hasattr(x, "asDict") else x) for x in r.inside]
        return pd.DataFrame(rows, columns=["file", "split", "before"])

    begun = scanned.filter("tag = ''").groupBy("file").applyInPandas(begin, "file string, split bigint, before array<struct<tag: string, split: bigint, row: bigint>>")
    met = scanned.filter("tag <> ''").join(begun, ["file", "split"])
    under = F.slice("before", F.lit(1), F.greatest(F.size("before") - F.col("closed"), F.lit(0)))
    return met.select(F.struct("file", "split", "row").alias("seq"), "tag", "attributes", F.concat(under, "inside").alias("inside"))


def attribute(name: str) -> Column:
    return F.try_element_at("attributes", F.lit(name))


def _parent() -> Column:
    return F.try_element_at("inside", F.lit(-1))["tag"]


def _owner() -> Column:
    """The place of the workout that an element stands in, at any depth; workouts stand under the root."""
    found = F.filter("inside", lambda x: x["tag"] == "Workout")
    return F.when(F.try_element_at("inside", F.lit(1))["tag"] == ROOT, F.try_element_at(found, F.lit(1)))


def records(elements: DataFrame) -> DataFrame:
    """The records that stand directly under the root; those inside correlations repeat others and don't count."""
    rows = elements.filter((F.col("tag") == "Record") & (_parent() == ROOT) & (F.size("inside") == 1))
    return rows.select(*(attribute(a).alias(n) for a, n in ATTRIBUTES.items()), "seq")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return records(read_elements(spark, path))


def workouts(elements: DataFrame) -> dict[str, DataFrame]:
    """sessions (with promoted totals), session_stats and routes of an export. Statistics and files count at any depth of their workout."""
    spark = elements.sparkSession
    place = F.struct(F.col("seq.file").alias("file"), F.col("seq.split").alias("split"), F.col("seq.row").alias("row"))
    key = content_key(F.lit("session"), activity_type(attribute("workoutActivityType")), attribute("sourceName"), attribute("startDate"), attribute("endDate"))
    raw = elements.filter((F.col("tag") == "Workout") & (_parent() == ROOT) & (F.size("inside") == 1))
    sessions = raw.select(
        place.alias("owner"), key.alias("content_key"), activity_type(attribute("workoutActivityType")).alias("activity_type"), vendor_time(attribute("startDate")).alias("start_at"), vendor_time(attribute("endDate")).alias("end_at"),
        duration_seconds(attribute("duration"), attribute("durationUnit")).alias("duration"), attribute("sourceName").alias("source"),
    )
    owned = elements.withColumn("_owner", _owner()).filter(F.col("_owner").isNotNull())
    owned = owned.withColumn("owner", F.struct(F.col("seq.file").alias("file"), F.col("_owner.split").alias("split"), F.col("_owner.row").alias("row")))
    keys = sessions.select("owner", "content_key")
    values = {"sum": "sum", "average": "average", "min": "minimum", "max": "maximum"}
    each = F.inline(F.array(*(F.struct(F.lit(stat).alias("stat"), attribute(a).try_cast("double").alias("number")) for stat, a in values.items())))
    stats = owned.filter("tag = 'WorkoutStatistics'").select("owner", "seq", attribute("type").alias("type"), attribute("unit").alias("unit"), each).filter(F.col("number").isNotNull())
    number = stats.join(keys, "owner")
    mapped = number.join(F.broadcast(vendor_types(spark)).withColumnRenamed("unit", "to_unit"), F.col("type") == F.col("vendor_type"))
    kept = convert_units(spark, mapped, "number", "unit", "to_unit", "v").filter(F.col("v").isNotNull())
    session_stats = kept.groupBy("content_key", "metric", "stat").agg(F.max_by("v", "seq").alias("value"))
    sums = number.filter("stat = 'sum'").withColumn("_km", F.lit("km")).withColumn("_kcal", F.lit("kcal"))
    sums = convert_units(spark, convert_units(spark, sums, "number", "unit", "_km", "km"), "number", "unit", "_kcal", "kcal")
    distance = F.col("type").contains("Distance") & F.col("km").isNotNull()
    energy = F.col("type").endswith("ActiveEnergyBurned") & F.col("kcal").isNotNull()
    promoted = sums.groupBy("owner").agg(F.max_by(F.when(distance, F.col("km")), F.when(distance, F.col("seq"))).alias("total_distance"), F.max_by(F.when(energy, F.col("kcal")), F.when(energy, F.col("seq"))).alias("total_energy"))
    # A route's times and source stand on the element around its file.
    around = F.element_at(F.filter("inside", lambda x: x["tag"] == "WorkoutRoute"), -1)
    files = owned.filter("tag = 'FileReference'").select("owner", "seq", attribute("path").alias("route_path"), F.struct(F.col("seq.file").alias("file"), around["split"].alias("split"), around["row"].alias("row")).alias("around"))
    spans = owned.filter("tag = 'WorkoutRoute'").select(place.alias("around"), vendor_time(attribute("startDate")).alias("start_at"), vendor_time(attribute("endDate")).alias("end_at"), attribute("sourceName").alias("source"))
    routes = files.join(keys, "owner").join(spans, "around", "left").select("content_key", "route_path", "start_at", "end_at", "source", "seq")
    return {"sessions": sessions.join(promoted, "owner", "left").drop("owner"), "session_stats": session_stats, "routes": routes}


def read_workouts(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return workouts(read_elements(spark, path))
