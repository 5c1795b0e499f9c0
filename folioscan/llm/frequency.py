"""Problem 5: how often every distinct term occurs and in how many files.

Recursive radix spilling: Spark's shuffle deals the rows to tasks by hash bits of (term, path), so that
a term that holds a third of all rows is spread over all tasks. A task keeps its rows in memory up to a
bound; beyond it, it writes them to disk by the next bits of the hash, and what is still too large is
split again by the bits after those. Each piece is aggregated by DuckDB, which itself goes out of core
for a piece whose hash bits are used up. The tasks give partial counts per term (files add up, since a
(term, path) lies in one piece), and those are summed by term.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import shared_dir
from .postings import counted

#: Rows that a task aggregates at once, DuckDB's memory for it, and bits per split.
PIECE_ROWS = 1_000_000
PIECE_MEMORY = "256MB"
RADIX_BITS = 4
COMMON_SHARE = 0.2

_SCHEMA = pa.schema([("term", pa.string()), ("path", pa.string()), ("unit_ord", pa.int32()), ("n", pa.int64()), ("h", pa.int64())])
_SUMS = """select term, sum(n)::bigint occurrences, count(distinct path)::bigint files from (
    select term, path, unit_ord, max(n) n from piece group by all) group by term"""


def _aggregate(piece, scratch: str) -> pa.Table:
    """Counts per term of one piece: an Arrow table or a list of spilled files."""
    import duckdb

    con = duckdb.connect(config={"memory_limit": PIECE_MEMORY, "threads": 1, "temp_directory": f"{scratch}/duckdb", "preserve_insertion_order": False})
    try:
        if isinstance(piece, list):
            con.execute("create view piece as select * from read_parquet($files)".replace("$files", repr(piece)))
        else:
            con.register("piece", piece)
        found = con.sql(_SUMS).to_arrow_table()
        return found.cast(pa.schema([("term", pa.string()), ("occurrences", pa.int64()), ("files", pa.int64())]))
    finally:
        con.close()


class _Spill:
    """Rows of one task or piece, split by the hash bits above ``used``."""

    def __init__(self, scratch: str, used: int, limit: int):
        self.scratch, self.used, self.limit = scratch, used, limit
        self.batches: list[pa.RecordBatch] = []
        self.rows = 0
        self.files: dict[int, tuple[list[str], int]] = {}

    def add(self, batch: pa.RecordBatch) -> None:
        self.batches.append(batch)
        self.rows += batch.num_rows
        if self.rows >= self.limit:
            self.write()

    def write(self) -> None:
        import numpy as np
        import pyarrow.parquet as pq

        table = pa.Table.from_batches(self.batches, _SCHEMA)
        h = table.column("h").to_numpy().view(np.uint64)
        bits = (h >> np.uint64(self.used)) & np.uint64((1 << RADIX_BITS) - 1)
        order = np.argsort(bits, kind="stable")
        cuts = np.searchsorted(bits[order], np.arange((1 << RADIX_BITS) + 1, dtype=np.uint64))
        table = table.take(pa.array(order))
        os.makedirs(self.scratch, exist_ok=True)
        for b in range(1 << RADIX_BITS):
            part = table.slice(cuts[b], cuts[b + 1] - cuts[b])
            if part.num_rows:
                path = f"{self.scratch}/{uuid.uuid4().hex}.parquet"
                pq.write_table(part, path)
                files, n = self.files.get(b, ([], 0))
                self.files[b] = (files + [path], n + part.num_rows)
        self.batches, self.rows = [], 0

    def results(self) -> Iterator[pa.Table]:
        import pyarrow.parquet as pq

        if not self.files:
            if self.rows:
                os.makedirs(self.scratch, exist_ok=True)
                yield _aggregate(pa.Table.from_batches(self.batches, _SCHEMA), self.scratch)
            return
        if self.rows:
            self.write()
        for files, n in self.files.values():
            if n > self.limit and self.used + 2 * RADIX_BITS <= 64:
                deeper = _Spill(f"{self.scratch}/{uuid.uuid4().hex}", self.used + RADIX_BITS, self.limit)
                for f in files:
                    for batch in pq.ParquetFile(f).iter_batches(65_536):
                        deeper.add(batch)
                    os.remove(f)
                yield from deeper.results()
            else:
                yield _aggregate(files, self.scratch)
                for f in files:
                    os.remove(f)


def _radix(base: str | None, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # only the shared folder, or the folders Spark gives its executors; elsewhere a task may not spill
        root = base or os.environ.get("SPARK_EXECUTOR_DIRS", "").split(":")[0] or os.environ.get("LOCAL_DIRS", "").split(",")[0] or os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
        if not root:
            raise ValueError("no folder to spill to: spark.checkpoint.dir is no file path and Spark names no local folder")
        scratch = f"{root}/folioscan-radix-{uuid.uuid4().hex}"
        try:
            spill = _Spill(scratch, 0, limit)
            for batch in batches:
                spill.add(pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, _SCHEMA)], schema=_SCHEMA))
            for table in spill.results():
                yield from table.to_batches(max_chunksize=10_000)
        finally:
            shutil.rmtree(scratch, ignore_errors=True)

    return run


def term_frequencies(postings: DataFrame, common_share: float = COMMON_SHARE, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """``(term, occurrences, files, n_files, mark)`` of every distinct term of the whole table.

    ``mark`` is 'rare' for a term of exactly one file, else 'common' for one in more than ``common_share`` of
    the files, else null. Which rows count is told in :mod:`.postings`; repeated rows count once. An empty
    table gives no rows.

    The scratch files of a task lie in the shared folder, or where that is no file system path (an object
    store), in Spark's own local folder of the executor; only the task that wrote them reads them.
    """
    rows = counted(postings).withColumn("h", F.xxhash64("term", "path"))
    folder = shared_dir(postings.sparkSession)
    base = folder.removeprefix("file:") if folder.startswith(("file:", "/")) else None
    base = base and "/" + base.lstrip("/")
    dealt = rows.repartition("term", "path")
    partial = dealt.mapInArrow(_radix(base, piece_rows), "term string, occurrences bigint, files bigint")
    terms = partial.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("files").alias("files"))
    n_files = rows.select("path").distinct().count()
    n = F.lit(n_files).cast("bigint")
    mark = F.when(F.col("files") == 1, "rare").when(F.col("files") > common_share * n, "common")
    return terms.select("term", "occurrences", "files", n.alias("n_files"), mark.alias("mark"))
