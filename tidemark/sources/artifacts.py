"""Route files of exports, from folders and archives, into a content-addressed store: a file is named by the digest of its bytes, so equal files are one, and a second
import writes nothing."""

from __future__ import annotations

import hashlib
import io
import os
import shutil
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.shared import written

SUFFIX = ".gpx"
ENTRIES = "file string, entry string, content binary"


def entries(spark: SparkSession, path: str, suffix: str = SUFFIX) -> DataFrame:
    """(file, entry, content) of the files under path that end with suffix, and of such entries of the archives (.zip) there. An archive is opened by the task that reads it, in
    memory; its entries are unpacked one by one."""

    def unpack(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, content in frame.itertuples(index=False):
                if not file.endswith(".zip"):
                    yield pd.DataFrame([(file, file, content)], columns=["file", "entry", "content"])
                    continue
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        if name.endswith(suffix):
                            yield pd.DataFrame([(file, name, z.read(name))], columns=["file", "entry", "content"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{{{suffix},.zip}}").load(path)
    return files.select("path", "content").mapInPandas(unpack, ENTRIES)


def _shared_path(folder: str) -> str:
    url = urlparse(folder)
    if url.scheme not in ("", "file"):
        raise ValueError(f"{folder}: artifacts are placed by rename in a folder that all executors mount")
    return unquote(url.path) if url.scheme else folder


def place(folder: str, content: bytes, suffix: str = SUFFIX) -> tuple[str, bool]:
    """(name, whether it was written): bytes go to a file of their own first and then get their name at once, so no reader ever sees half a file, and of tasks with equal
    bytes the last one's rename changes nothing."""
    name = hashlib.sha256(content).hexdigest() + suffix
    final = os.path.join(folder, name)
    if os.path.exists(final):
        return name, False
    part = os.path.join(folder, f".{uuid.uuid4().hex}.tmp")
    try:
        with open(part, "wb") as out:
            out.write(content)
            out.flush()
            os.fsync(out.fileno())
        os.replace(part, final)
    finally:
        if os.path.exists(part):
            os.remove(part)
    return name, True


def store_artifacts(spark: SparkSession, path: str, folder: str, suffix: str = SUFFIX) -> DataFrame:
    """(file, entry, artifact, content_key, written) of the route files and archive entries under path, placed in folder by the tasks that read them. folder is one that all executors
    mount."""
    target = _shared_path(folder)
    os.makedirs(target, exist_ok=True)

    def put(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(file, entry, *place(target, bytes(content), suffix)) for file, entry, content in frame.itertuples(index=False)]
            yield pd.DataFrame([(f, e, n, n.removesuffix(suffix), w) for f, e, n, w in rows], columns=["file", "entry", "artifact", "content_key", "written"])

    # An import happens once, here, not whenever its rows are read.
    return written(entries(spark, path, suffix).mapInPandas(put, "file string, entry string, artifact string, content_key string, written boolean"), "artifacts")


def routes_of_export(routes: DataFrame, stored: DataFrame) -> DataFrame:
    """routes (route_path as the export says it, and more) with their artifact: the stored entry whose name ends with the path; of several the first by name. Names are joined by their last
    part, so no path is compared with every entry. A route without a file has no artifact."""
    clean = F.regexp_replace(F.regexp_replace("route_path", "^(\\./|/)+", ""), "/(\\./|/)+", "/")
    named = routes.withColumns({"_want": clean, "_base": F.element_at(F.split(clean, "/"), -1)})
    held = stored.select("entry", "artifact", F.col("content_key").alias("artifact_key"), F.element_at(F.split("entry", "/"), -1).alias("_base"))
    met = named.join(held, "_base", "left").withColumn("_fits", F.endswith(F.col("entry"), F.col("_want")))
    first = F.min(F.when(F.col("_fits"), F.struct("entry", "artifact", "artifact_key"))).alias("_found")
    return met.groupBy(*routes.columns).agg(first).select(*routes.columns, "_found.artifact", "_found.artifact_key")




def unpack_exports(spark: SparkSession, path: str, folder: str, name: str = "export.xml") -> list[str]:
    """The export files under path: XML files as they are, and the entry of that name out of each archive, streamed into folder by a task and named at once when it is whole. folder and
    path are mounted by all executors; an archive without such an entry is an error."""
    target = _shared_path(folder)
    os.makedirs(target, exist_ok=True)

    def unpack(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file in frame["path"]:
                if not file.endswith(".zip"):
                    yield pd.DataFrame({"export": [file]})
                    continue
                with zipfile.ZipFile(_shared_path(file)) as z:
                    entry = next((n for n in z.namelist() if n.rpartition("/")[2] == name), None)
                    if entry is None:
                        raise FileNotFoundError(f"{file} holds no {name}")
                    final = os.path.join(target, f"{hashlib.sha256(file.encode()).hexdigest()[:16]}-{z.getinfo(entry).CRC:08x}-{name}")
                    part = f"{final}.{uuid.uuid4().hex}.tmp"
                    with z.open(entry) as source, open(part, "wb") as out:
                        shutil.copyfileobj(source, out, 1 << 20)
                    os.replace(part, final)
                yield pd.DataFrame({"export": [final]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*{.xml,.zip}").load(path).select("path")
    return [r["export"] for r in files.mapInPandas(unpack, "export string").collect()]
