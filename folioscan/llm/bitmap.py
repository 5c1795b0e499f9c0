"""A bitmap of fixed size that lets most rows without a partner fall away before a join shuffles them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the bitmap: 16 MB at most come to the driver and go to the tasks, whatever the size of the tables.
BITS = 1 << 27


def likely_in(df: DataFrame, column: str, keys: DataFrame, bits: int = BITS) -> DataFrame:
    """Rows of ``df`` whose bigint ``column`` may be among those of ``keys(column)``: all that are, and few others.

    A key stands for the bit of its lowest digits, so hashes and dense numbers both spread well. With very many keys
    the bitmap fills and lets all rows pass; the join that follows decides in any case. Null keys don't pass.
    """
    bit = keys.filter(F.col(column).isNotNull()).select(F.col(column).bitwiseAND(F.lit(bits - 1).cast("bigint")).alias("bit"))
    words = bit.select(F.shiftright("bit", 6).alias("w"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("m"))
    found = words.groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    shared = df.sparkSession.sparkContext.broadcast((found.column("w").to_numpy(), found.column("m").to_numpy().view(np.uint64)))
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, mask = shared.value
        table = np.zeros(-(-bits // 64), np.uint64)
        table[where] = mask
        for batch in batches:
            keys = batch.column(at)
            x = keys.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64) & np.uint64(bits - 1)
            hit = (table[(x >> np.uint64(6)).astype(np.int64)] >> (x & np.uint64(63))) & np.uint64(1)
            yield batch.filter(pa.array(hit.astype(bool) & keys.is_valid().to_numpy(zero_copy_only=False)))

    return df.mapInArrow(run, df.schema)
