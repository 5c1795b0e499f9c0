"""Finding files: scans of one or several roots, type gates and skip lists."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

def files_under_roots(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Each file once for each root it lies under (nested roots give it twice), with ``root_folder``; files under none are left out.

    The folders above a file are a handful of prefixes of its path: an equi-join, no comparison with every root.
    """
    parts = F.split(F.rtrim("path", F.lit("/")), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    above = F.when(F.size(parts) > 1, above)
    rows = files.drop("root_folder").withColumn("root_folder", F.explode(above))
    names = roots.filter("root_folder is not null").select(F.regexp_replace("root_folder", "/+$", "").alias("root_folder")).distinct()
    return rows.join(names, "root_folder")


def longest_root(files: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """``(key, root_folder)``: the deepest root of each file."""
    return files_under_roots(files, roots).groupBy(key).agg(F.max_by("root_folder", F.length("root_folder")).alias("root_folder"))


def _type_glob(types: Iterable[str]) -> str:
    exts = sorted({e for t in types for e in T.FILE_TYPES.get(t, ())}) or ["."]
    return "*{" + ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e) for e in exts) + "}"


def scan(spark: SparkSession, roots: Iterable[str], types: Iterable[str] | None = None, recursive: bool = True, content: bool = True) -> DataFrame:
    """``(path, ext, root_folder, size, mtime[, content])`` of the files below ``roots``, those of the given types.

    Roots that don't exist are dropped; none gives an empty table. A file below two roots appears twice.
    Names beginning with '_' or '.' are hidden by Spark's file sources. Files above 2 GB can't be read.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = None
    for root in roots:
        p = jvm.org.apache.hadoop.fs.Path(root)
        fs = p.getFileSystem(conf)
        if not fs.exists(p) or not fs.getFileStatus(p).isDirectory():
            continue
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
        if types is not None:  # other files are left out while listing, whatever the case of their names
            reader = reader.option("pathGlobFilter", _type_glob(types))
        df = reader.load(root if recursive else f"{root.rstrip('/')}/*")
        path = F.regexp_replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "^file:/*", "/")
        cols = [path.alias("path"), T.extension(path).alias("ext"), F.lit(root).alias("root_folder"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime")]
        if not recursive:  # the pattern also lists one level further down
            df = df.filter(F.regexp_replace(path, "/[^/]*$", "") == re.sub("^file:/*", "/", root.rstrip("/")))
        df = df.select(*cols, *(["content"] if content else []))
        out = df if out is None else out.unionByName(df)
    if out is None:
        return spark.createDataFrame([], "path string, ext string, root_folder string, size bigint, mtime timestamp" + (", content binary" if content else ""))
    if types is not None:
        out = out.filter(T.type_of("ext").isin(*types))
    return out


def skip(files: DataFrame, paths: DataFrame) -> DataFrame:
    """Files that are not on a list of paths."""
    return files.join(paths.select("path").distinct(), "path", "left_anti")


def ocr_candidates(files: DataFrame, pages: DataFrame, max_pages: int = 2) -> DataFrame:
    """``(path)``: all images, and PDFs whose first pages together have a poor text layer (or none)."""
    images = files.filter(T.type_of("ext") == "image").select("path")
    head = pages.filter(F.col("page") <= max_pages).groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "text"))), lambda p: F.coalesce(p["text"], F.lit(""))), "\n").alias("head"))
    pdfs = files.filter(F.col("ext") == ".pdf").select("path").distinct().join(head, "path", "left")
    return images.unionByName(pdfs.filter(T.is_poor(F.trim(F.coalesce("head", F.lit(""))))).select("path")).distinct()
