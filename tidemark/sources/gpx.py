"""GPX routes: all track points of a file in order; missing heights and times are kept as nulls, a malformed file is an error."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime
from io import BytesIO
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def track(content: bytes) -> list[tuple]:
    """(seq, lat, lon, ele, at) of one file."""
    out, text = [], lambda e: e.text.strip() if e is not None and e.text else None
    for _, e in ElementTree.iterparse(BytesIO(content)):
        if e.tag.rpartition("}")[2] == "trkpt":
            parts = {c.tag.rpartition("}")[2]: c for c in e}
            ele, at = text(parts.get("ele")), text(parts.get("time"))
            moment = datetime.fromisoformat(at) if at else None
            moment = moment.astimezone(UTC).replace(tzinfo=None) if moment is not None and moment.tzinfo else moment
            out.append((len(out), float(e.get("lat")), float(e.get("lon")), float(ele) if ele else None, moment))
            e.clear()
    return out


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """(route_id, seq, lat, lon, ele, at) of all files under path. A file is one recording of some hours; files are spread over tasks."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gpx").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                points = track(content)
                if points:
                    yield pd.DataFrame([(name, *p) for p in points], columns=["route_id", "seq", "lat", "lon", "ele", "at"])

    return files.mapInPandas(read, "route_id string, seq int, lat double, lon double, ele double, at timestamp_ntz")
