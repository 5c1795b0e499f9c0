"""Problem 8: fill containers of fixed capacity with texts, measured in tokens.

Best-fit decreasing over all items at once: items by falling size, each into the open container with the least
room that still takes it, found in logarithmic time by a segment tree over the remaining capacities. Which
containers come about depends only on how many items there are of each size, and sizes are whole numbers up
to the capacity; so the packing is computed on these counts, for all items of a size and all containers of
equal room together, and is exactly the one that item after item would give. It leaves a list of runs: the
items of one size with the ranks a..b go to the containers from number c on, k to each. The items are ranked
within their size by a distributed numbering and find their container by the run their rank lies in. The
result doesn't depend on partitions, and no task holds more than the counts.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.search import number_rows
from ..plans.scratch import materialize
from .tokens import count_tokens

#: Kinds of containers; every item is multiplied by them.
MAX_SPECS = 1000
#: Capacities above this are refused, as the counts of all sizes of a container are held in one place.
MAX_CAPACITY = 1 << 22


class CapacityTree:
    """Segment tree over remaining capacities 0..capacity; a leaf tells whether containers with that room are open."""

    def __init__(self, capacity: int):
        self.base = 1
        while self.base < capacity + 1:
            self.base *= 2
        self.any = bytearray(2 * self.base)

    def put(self, room: int, there: bool) -> None:
        i = self.base + room
        while i and self.any[i] != there:
            self.any[i] = there
            i //= 2
            there = there or bool(self.any[2 * i] or self.any[2 * i + 1]) if i else there

    def tightest(self, size: int) -> int:
        """The least room >= size among the open containers, -1 if there is none."""
        i, open_ = self.base + size, self.any
        if open_[i]:
            return size
        while i > 1:  # climb until a right sibling has an open container
            if not i & 1 and open_[i + 1]:
                i += 1
                while i < self.base:
                    i *= 2
                    if not open_[i]:
                        i += 1
                return i - self.base
            i //= 2
        return -1


#: A run: items of ``size`` with ranks ``start`` .. ``start + count - 1`` go to containers from ``container`` on, ``each`` to one.
Run = tuple[int, int, int, int, int]


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> tuple[list[Run], int]:
    """The runs of a packing of ``counts`` (items by size, none above the capacity), and how many containers it takes.

    Containers are numbered from 0 in order of opening; of containers with equal room the one that reached it last is
    taken first. Items of size 0 go to the fullest container. Containers of equal room stand as ranges of numbers, so
    that the work is one step for each range that items of a size meet, whatever the number of items.
    """
    tree, by_room, runs, opened = CapacityTree(capacity), {}, [], 0

    def open_(room: int, first: int, n: int) -> None:
        if n:
            by_room.setdefault(room, []).append((first, n))
            tree.put(room, True)

    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        while left:
            room = tree.tightest(size)
            if room < 0:
                each = capacity // size if size else left
                n = -(-left // each)
                first, opened, room = opened, opened + n, capacity
            else:
                first, n = by_room[room].pop()
                if not by_room[room]:
                    tree.put(room, False)
                each = room // size if size else left
            full = min(n, left // each)  # each of these takes all it can before the next is touched
            if full:
                runs.append((size, rank, full * each, first, each))
                open_(room - each * size, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n:
                if left and left < each:
                    runs.append((size, rank, left, first + full, left))
                    open_(room, first + full + 1, n - full - 1)
                    open_(room - left * size, first + full, 1)
                    rank, left = rank + left, 0
                else:
                    open_(room, first + full, n - full)
    return runs, opened


_OUT = ["spec_id", "container_id", "doc_id", "piece", "token_start", "n_tokens"]


def pack_sizes(sizes: DataFrame, specs: DataFrame) -> DataFrame:
    """Pack items ``(doc_id, n_tokens)`` into containers of every capacity of ``specs(spec_id, capacity_tokens)``.

    Gives ``(spec_id, container_id, doc_id, piece, token_start, n_tokens)``. An item above the capacity is cut into
    pieces that fill a container each, and a rest that is packed like an item; no other is cut. Null and
    negative sizes count as 0; items of size 0 take a place in the fullest container. Repeated rows are items of
    their own. Specs with null or non-positive capacity are left out, of a spec_id that stands twice the greater
    capacity counts; no items give no rows. Items of one size are ranked by (doc_id, piece), so equal
    input gives equal containers.

    To the driver come the kinds of containers (at most ``MAX_SPECS``) and the number of items of each size (at most
    the capacity for each kind); back go the runs, about as many.
    """
    spark = sizes.sparkSession
    valid = specs.filter("capacity_tokens > 0 and spec_id is not null").groupBy("spec_id").agg(F.max("capacity_tokens").alias("c"))
    kinds = {r[0]: r[1] for r in valid.limit(MAX_SPECS + 1).collect()}
    if len(kinds) > MAX_SPECS or max(kinds.values(), default=0) > MAX_CAPACITY:
        raise ValueError(f"more than {MAX_SPECS} kinds of containers, or one above {MAX_CAPACITY} tokens")
    n = F.greatest(F.coalesce("n_tokens", F.lit(0)), F.lit(0)).cast("bigint")
    items = sizes.select("doc_id", n.alias("total"))
    if not kinds:
        return items.filter("false").selectExpr("0L spec_id", "'' container_id", "doc_id", "0L piece", "0L token_start", "0L n_tokens")
    each = F.array(*[F.struct(F.lit(k).cast("bigint").alias("spec_id"), F.lit(c).cast("bigint").alias("capacity")) for k, c in sorted(kinds.items())])
    items = items.select("doc_id", "total", F.inline(each))
    whole = F.floor(F.greatest(F.col("total") - 1, F.lit(0)) / F.col("capacity")).cast("bigint")
    pieces = items.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), whole)))
    start = F.col("piece") * F.col("capacity")
    pieces = materialize(pieces.select("spec_id", "doc_id", "piece", start.alias("token_start"), F.least(F.col("capacity"), F.col("total") - start).alias("n_tokens")), "pieces")

    counts: dict[int, dict[int, int]] = {k: {} for k in kinds}
    for r in pieces.groupBy("spec_id", "n_tokens").count().toLocalIterator():
        counts[r[0]][r[1]] = r[2]
    # where each (spec, size) has its runs, by the rank they begin at
    plan: dict[tuple[int, int], tuple[list[int], list[int], list[int]]] = {}
    for k, capacity in kinds.items():
        for size, rank, _, first, per in best_fit_decreasing(counts[k], capacity)[0]:
            for column, value in zip(plan.setdefault((k, size), ([], [], [])), (rank, first, per)):
                column.append(value)
    shared = spark.sparkContext.broadcast(plan)

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared.value
        for batch in batches:
            spec, size, rank = (batch.column(i).to_numpy() for i in (0, 4, 5))
            at = np.empty(len(spec), np.int64)
            for i, (k, s, r) in enumerate(zip(spec.tolist(), size.tolist(), rank.tolist())):
                begins, first, per = runs[k, s]
                j = bisect_right(begins, r - 1) - 1
                at[i] = first[j] + (r - 1 - begins[j]) // per[j]
            names = pa.array([f"{k}-{c}" for k, c in zip(spec.tolist(), at.tolist())], pa.string())
            yield pa.record_batch([batch.column(0), names, *(batch.column(i) for i in (1, 2, 3, 4))], names=_OUT)

    ranked = number_rows(pieces.withColumn("size_key", F.struct("spec_id", "n_tokens")), [F.asc("doc_id"), F.asc("piece")], "rank", "size_key")
    kind = pieces.schema["doc_id"].dataType.simpleString()
    ranked = ranked.select("spec_id", "doc_id", "piece", "token_start", "n_tokens", F.col("rank").cast("bigint").alias("rank"))
    return ranked.mapInArrow(locate, f"spec_id bigint, container_id string, doc_id {kind}, piece bigint, token_start bigint, n_tokens bigint")


def pack_documents(docs: DataFrame, specs: DataFrame, rank_file: str | None = None) -> DataFrame:
    """:func:`pack_sizes` over the token counts of ``docs(doc_id, text)``; null and empty texts have 0 tokens."""
    return pack_sizes(materialize(count_tokens(docs, rank_file=rank_file), "sizes"), specs)
