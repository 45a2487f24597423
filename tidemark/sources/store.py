"""A store of families with versions: Parquet files, and a manifest of the files that each version consists of.

A write puts new files beside the others and then commits a manifest that names them, under the next number, by a rename that fails where that number is taken. Readers take the
highest number and see its files only: nothing is overwritten in place, and a job that is lost at any moment leaves files that no manifest names, and the version
before. A commit that meets another one's number begins again on top of it.

A manifest has a line for each file and the rows' schema: it grows with files, not with rows, and compact() makes few files of many.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another commit has taken the number."""


@dataclass
class Manifest:
    """files: paths below the family's data folder; notes: what a writer wants to be committed with them."""

    version: int = 0
    schema: str | None = None
    files: list[str] = field(default_factory=list)
    notes: dict = field(default_factory=dict)


class Store:
    """One family of a store: rows parted by a column into folders, so reads of one value skip the others."""

    def __init__(self, spark: SparkSession, path: str, family: str, part: str):
        self.spark, self.part = spark, part
        self.root = f"{path.rstrip('/')}/{family}"
        self.data, self.manifests = f"{self.root}/data", f"{self.root}/manifests"
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)
        self._jvm = jvm

    def _children(self, folder: str) -> list:
        path = self._path(folder)
        return list(self._fs.listStatus(path)) if self._fs.exists(path) else []

    def versions(self) -> list[int]:
        return sorted(int(s.getPath().getName().removesuffix(".json")) for s in self._children(self.manifests) if s.getPath().getName().endswith(".json") and not s.getPath().getName().startswith("."))

    def manifest(self, version: int | None = None) -> Manifest:
        """The newest manifest, or that of a version; an empty one for an empty store."""
        number = version if version is not None else max(self.versions(), default=0)
        if not number:
            return Manifest()
        stream = self._fs.open(self._path(f"{self.manifests}/{number}.json"))
        try:
            return Manifest(**json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def read(self, manifest: Manifest | None = None, files: list[str] | None = None, file: str | None = None) -> DataFrame | None:
        """The rows of a manifest (the newest one), or of some of its files; None for a family that never had a row. file: a column for the path of each row's file."""
        manifest = manifest or self.manifest()
        if manifest.schema is None:
            return None
        schema = StructType.fromJson(json.loads(manifest.schema))
        wanted = manifest.files if files is None else files
        if not wanted:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(StructType([f for f in schema if f.name != self.part] + [schema[self.part]])).option("basePath", self.data)
        return reader.parquet(*(f"{self.data}/{f}" for f in wanted)).select(*schema.names, *([F.col("_metadata.file_path").alias(file)] if file else []))

    def _written(self, rows: DataFrame) -> list[str]:
        """Write rows to a folder of their own and name its files."""
        own = f"commit={uuid.uuid4().hex}"
        rows.write.partitionBy(self.part).parquet(f"{self.data}/{own}")
        found, names, at = [], self._fs.listFiles(self._path(f"{self.data}/{own}"), True), len(self._fs.makeQualified(self._path(self.data)).toString()) + 1
        while names.hasNext():
            name = names.next().getPath().toString()
            if name.endswith(".parquet"):
                found.append(name[at:])
        return sorted(found)

    def _commit(self, manifest: Manifest) -> None:
        """Give a manifest its number, or fail with Conflict."""
        self._fs.mkdirs(self._path(self.manifests))
        part = self._path(f"{self.manifests}/.{uuid.uuid4().hex}.tmp")
        out = self._fs.create(part, False)
        try:
            out.write(json.dumps(manifest.__dict__).encode())
        finally:
            out.close()
        options = self._jvm.org.apache.hadoop.fs.Options.Rename
        plain = self.spark.sparkContext._gateway.new_array(options, 1)
        plain[0] = options.NONE
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri() if part.toUri().getScheme() else self._fs.getUri(), self._conf)
        try:
            files.rename(self._fs.makeQualified(part), self._fs.makeQualified(self._path(f"{self.manifests}/{manifest.version}.json")), plain)
        except Py4JJavaError as e:
            self._fs.delete(part, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise Conflict(str(manifest.version)) from e
            raise

    def change(self, rows_of: Callable[[Manifest], tuple[DataFrame | None, list[str], dict]], attempts: int = 8) -> Manifest:
        """Commit a change: rows_of(the newest manifest) says what rows are added, which files go, and the notes. It is asked again where another commit comes first."""
        for _ in range(attempts):
            base = self.manifest()
            rows, gone, notes = rows_of(base)
            new = self._written(rows) if rows is not None else []
            left = set(gone)
            made = Manifest(base.version + 1, rows.schema.json() if rows is not None else base.schema, [f for f in base.files if f not in left] + new, base.notes | notes)
            if not new and not left and made.schema == base.schema and made.notes == base.notes:
                return base
            try:
                self._commit(made)
                return made
            except Conflict:
                continue
        raise Conflict(f"{self.root}: no number was free in {attempts} attempts")

    def append(self, fresh: Callable[[DataFrame | None], DataFrame], notes: dict | None = None) -> Manifest:
        """Add what fresh says of the stored rows."""
        return self.change(lambda base: (fresh(self.read(base)), [], notes or {}))

    def touched(self, manifest: Manifest, rows: Column) -> list[str]:
        """The files that hold such rows: at most as many names as the manifest has."""
        if not manifest.files:
            return []
        hit = self.read(manifest, file="_file").filter(rows).select("_file").distinct().collect()
        # A folder of a commit and one of a part, then the name; special characters are escaped once in the names and once more in the path.
        names = {"/".join(r["_file"].split("/")[-3:]) for r in hit}
        return [f for f in manifest.files if f in names or quote(f, safe="/=") in names]

    def delete(self, rows: Column) -> int:
        """Delete such rows and say how many went: the files that hold any are written anew without them, others aren't touched."""
        gone = 0

        def without(base: Manifest) -> tuple[DataFrame | None, list[str], dict]:
            nonlocal gone
            files = self.touched(base, rows)
            if not files:
                gone = 0
                return None, [], {}
            held = self.read(base, files)
            gone = held.filter(rows).count()
            return held.filter(~F.coalesce(rows, F.lit(False))), files, {}

        self.change(without)
        return gone

    def compact(self) -> Manifest:
        """The same rows in few files for each part."""
        return self.change(lambda base: (self.read(base).repartition(self.part), base.files, {}) if base.files else (None, [], {}))
