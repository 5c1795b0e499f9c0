"""Shared working storage: where lineage is cut and tables are written for reuse."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[str] = []
_hooked = False


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only where nothing is set (tests, a laptop) a local folder is made and recorded in the session.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        jdir = sc._jsc.sc().getCheckpointDir()
        found = jdir.get() if jdir.isDefined() else None
    if not found:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="folioscan-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below :func:`shared_dir`; it is removed when the driver's interpreter ends."""
    global _hooked
    path = f"{shared_dir(spark)}/folioscan-work/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    if not _hooked:
        _hooked = True
        atexit.register(_sweep)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: reliable against lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.__dict__["scratch_path"] = path
    return back


def _sweep() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    try:
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for p in _written:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)
    except Exception:  # the JVM may be gone already; the folder is then the cluster's to clean
        pass


def fixed_columns(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once for each row, whatever is asked of them later.

    Catalyst moves filters below a projection and writes a column's expression in the place of its name, also
    inside lambdas, where it would run again for each element. It moves nothing through a generator.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a small table evenly over all cores; a larger one fills them by itself.

    A file of one row group is one task, however long its texts take. Small is less than one scan partition for each core,
    by the optimizer's estimate of the size.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    limit = cores * int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return df.repartition(cores) if cores > 1 and size < limit else df


def discard(df: DataFrame) -> None:
    """Delete a table of :func:`materialize` that nothing will read again."""
    path = df.__dict__.pop("scratch_path", None)
    if path:
        spark = df.sparkSession
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        _written.remove(path)
