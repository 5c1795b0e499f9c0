"""The stored index of folders: units and postings that are written once, kept up to date by file, and searched many times.

The index is a row of segments, one for each refresh that found something to do. A segment holds the units and
postings of the files that were new or changed, and a manifest of them and of those that were gone. It counts
from the moment an empty file of its number stands in ``commits``; what a dead writer left is written over. A
file's newest segment wins.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import materialize
from ..query.parser import Query
from ..sources import reading
from . import index
from .search import prepare_units

_KEY = ["path", "root_folder"]
_MANIFEST = "path string, root_folder string, size bigint, mtime timestamp, gone boolean, error string, segment bigint"
_UNITS = "path string, unit_ord int, location string, unit_kind string, root_folder string, text string, norm string, tokens array<string>, stems array<string>, segment bigint"
_POSTINGS = "term string, path string, unit_ord int, positions array<int>, root_folder string, segment bigint, bucket int"


class IndexStore:
    """In ``folder``, apart for each pair of flags; to search it with others builds another."""

    def __init__(self, spark: SparkSession, folder: str, accent_fold: bool = True, stemming: bool = True, buckets: int = 64):
        self.spark, self.accent_fold, self.stemming, self.buckets = spark, accent_fold, stemming, buckets
        self.at = f"{folder.rstrip('/')}/fold={int(accent_fold)}-stem={int(stemming)}"
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.at).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def segments(self) -> list[int]:
        p = self._path(f"{self.at}/commits")
        names = [s.getPath().getName() for s in self._fs.listStatus(p)] if self._fs.exists(p) else []
        return sorted(int(n) for n in names if n.isdigit())

    def _read(self, part: str, schema: str) -> DataFrame:
        found = self.segments()
        if not found:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.at}/{part}/segment={n}" for n in found]
        return self.spark.read.schema(schema).option("basePath", f"{self.at}/{part}").parquet(*paths)

    def manifest(self) -> DataFrame:
        """``(path, root_folder, size, mtime, gone, error, segment)`` of every file's newest segment, also of those that are gone."""
        rows = self._read("manifest", _MANIFEST)
        last = F.max(F.struct("segment", "size", "mtime", "gone", "error")).alias("m")
        return rows.groupBy(*_KEY).agg(last).select(*_KEY, "m.size", "m.mtime", "m.gone", "m.error", "m.segment")

    def current(self) -> DataFrame:
        return self.manifest().filter("not gone").select(*_KEY, "segment")

    def changes(self, files: DataFrame) -> DataFrame:
        """``files`` that are new or differ in size or time from what is indexed."""
        known = self.manifest().filter("not gone").select(*_KEY, "size", "mtime")
        return files.join(known, [*_KEY, "size", "mtime"], "left_anti")

    def refresh(self, files: DataFrame, plugins: Mapping[str, Callable] | None = None, file_timeout: float = 0) -> dict[str, int]:
        """Bring the index up to ``files(path, ext, root_folder, size, mtime)``; only files that are new or changed are opened.

        Gives the numbers of files indexed and gone. A file that can't be read is in the manifest with its error, and is
        tried again when it changes.
        """
        todo = materialize(self.changes(files), "index-todo")
        gone = materialize(self.manifest().filter("not gone").join(files.select(*_KEY), _KEY, "left_anti").select(*_KEY), "index-gone")
        n_new, n_gone = todo.count(), gone.count()
        if n_new + n_gone == 0:
            return {"indexed": 0, "gone": 0}
        segment = max(self.segments(), default=-1) + 1
        to = lambda part: f"{self.at}/{part}/segment={segment}"
        raw = materialize(reading.read_units(reading.fetch(todo), plugins, file_timeout), "index-raw")
        units = prepare_units(raw.filter("text is not null"), self.accent_fold, self.stemming)
        units = units if self.stemming else units.withColumn("stems", F.lit(None).cast("array<string>"))
        units.select(*[c.split()[0] for c in _UNITS.split(", ")[:-1]]).write.mode("overwrite").parquet(to("units"))
        written = self.spark.read.schema(_UNITS.rsplit(", ", 1)[0]).parquet(to("units"))
        index.write_postings(index.build_postings(written, self.stemming), to("postings"), self.buckets)
        errors = reading.skipped(raw).groupBy("path").agg(F.min("reason").alias("error"))
        new = todo.join(errors, "path", "left").select(*_KEY, "size", "mtime", F.lit(False).alias("gone"), "error")
        none = F.lit(None)
        lost = gone.select(*_KEY, none.cast("bigint").alias("size"), none.cast("timestamp").alias("mtime"), F.lit(True).alias("gone"), none.cast("string").alias("error"))
        new.unionByName(lost).write.mode("overwrite").parquet(to("manifest"))
        self._fs.create(self._path(f"{self.at}/commits/{segment}"), True).close()
        return {"indexed": n_new, "gone": n_gone}

    def units(self) -> DataFrame:
        return self._read("units", _UNITS).join(self.current(), [*_KEY, "segment"], "left_semi")

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """Current postings, of ``terms`` only those buckets and terms are read."""
        rows = self._read("postings", _POSTINGS)
        if terms is not None:
            rows = rows.filter(F.col("bucket").isin(index.bucket_numbers(self.spark, terms, self.buckets)) & F.col("term").isin(terms))
        return rows.join(self.current(), [*_KEY, "segment"], "left_semi")

    def candidates(self, query: Query) -> DataFrame:
        """The units that may match: those the postings of the query's terms leave, all where the index can't narrow."""
        found = index.candidate_units(self.postings, query, self.accent_fold, self.stemming)
        units = self.units()
        return units if found is None else units.join(found, ["path", "unit_ord"], "left_semi")

    def skipped(self) -> DataFrame:
        return self.manifest().filter("not gone and error is not null").select("path", F.col("error").alias("reason"))

    def statistics(self) -> DataFrame:
        return index.statistics(self.postings())

    def clear(self) -> None:
        """Delete the index of these flags; the commits go first, so that no half of it is ever read."""
        for part in ("commits", "manifest", "postings", "units"):
            self._fs.delete(self._path(f"{self.at}/{part}"), True)
