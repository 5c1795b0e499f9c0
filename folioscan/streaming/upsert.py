"""Keeping an index up to date from a stream of documents (new files, or new versions of known ones).

The index is a row of segments, one for each micro-batch, with a manifest of which paths each holds. A
path's newest segment wins, so an update writes only what changed and a reader needs one join with the
manifest. Segments are numbered in the order in which their batches begin, over all streams and checkpoints
that feed the index. A batch that is run again writes the same folders again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index import build_postings
from ..operators.search import prepare_units

_POSTINGS = "term string, path string, unit_ord bigint, positions array<int>, root_folder string, batch bigint"
_MANIFEST = "path string, modified timestamp, batch bigint"


def write_segment(batch: DataFrame, batch_id: int, folder: str, stemming: bool = True) -> None:
    """Index one batch of ``(path, unit_ord, root_folder, modified, text)``; of several versions of a path in it the latest is taken."""
    latest = batch.filter("path is not null").groupBy("path").agg(F.max("modified").alias("latest"))
    rows = batch.join(latest, "path").filter(F.col("modified").eqNullSafe(F.col("latest"))).drop("latest").dropDuplicates(["path", "unit_ord", "root_folder"])
    postings = build_postings(prepare_units(rows, stemming=stemming), stemming)
    postings.withColumn("unit_ord", F.col("unit_ord").cast("bigint")).write.mode("overwrite").parquet(f"{folder}/postings/batch={batch_id}")
    rows.groupBy("path").agg(F.max("modified").cast("timestamp").alias("modified")).write.mode("overwrite").parquet(f"{folder}/manifest/batch={batch_id}")


def current_paths(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, batch)``: the segment that holds each path's newest version."""
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest").groupBy("path").agg(F.max("batch").alias("batch"))


def current_postings(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.schema(_POSTINGS).parquet(f"{folder}/postings")
    return rows.join(current_paths(spark, folder), ["path", "batch"], "left_semi").drop("batch")


def segment_number(spark: SparkSession, folder: str, checkpoint: str, batch_id: int) -> int:
    """The segment of a micro-batch: what its checkpoint has on record for it, else the next free number of the index.

    A number is claimed by creating a marker file, which succeeds for one stream only.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()

    def at(path: str):
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(conf), p

    def names(path: str) -> list[str]:
        fs, p = at(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    # one marker for each batch, its number in the name, so that none is ever half written
    records = f"{checkpoint.rstrip('/')}/segments"
    known = [n.split("-") for n in names(records) if not n.startswith(".")]
    for batch, number in known:
        if int(batch) == batch_id:
            return int(number)
    taken = [int(n) for n in names(f"{folder}/segments") if n.isdigit()]
    taken += [int(n.removeprefix("batch=")) for part in ("postings", "manifest") for n in names(f"{folder}/{part}") if n.startswith("batch=")]
    number = max(taken, default=-1) + 1
    while True:
        fs, p = at(f"{folder}/segments/{number}")
        try:
            fs.create(p, False).close()
            break
        except Exception:
            if not fs.exists(p):
                raise
            number += 1
    fs, p = at(f"{records}/{batch_id}-{number}")
    fs.create(p, False).close()
    return number


def index_stream(stream: DataFrame, folder: str, checkpoint: str, stemming: bool = True):
    """Start indexing a stream; runs until all that is there is done (``availableNow``)."""

    def upsert(batch: DataFrame, batch_id: int) -> None:
        write_segment(batch, segment_number(batch.sparkSession, folder, checkpoint, batch_id), folder, stemming)

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def compact(spark: SparkSession, folder: str, into: str) -> None:
    """All newest versions as one segment in another folder."""
    current_postings(spark, folder).write.mode("overwrite").parquet(f"{into}/postings/batch=0")
    spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest").groupBy("path").agg(F.max_by("modified", "batch").alias("modified")).write.mode("overwrite").parquet(f"{into}/manifest/batch=0")
