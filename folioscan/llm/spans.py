"""Problem 9: long stretches that stand verbatim in more than one document.

Units are hashed and their digests grouped globally, as in line hashing, but a line is too coarse a
unit: a shared stretch may begin and end within a line, and every character counts. The units here are
content-defined: in every window of ``min_chars`` characters the k-gram with the least hash is the
window's anchor (winnowing), and a unit is a maximal row of consecutive windows with one anchor. Equal
windows have equal anchors at equal places, so

1. units whose anchor occurs in one document only are dropped;
2. units equal in anchor, place and content are grouped by digest; a group with two documents is
   shared as a whole (the earliest occurrence stands for the group from here on);
3. where an anchor has several different units (the edges of a shared stretch), the windows of one
   representative of each are hashed and compared: the texts of the few units of an anchor meet in one
   task, and where an anchor has very many units, every window is a group of its own;
4. the ranges of shared windows go back to every occurrence, with its own offsets, and are merged.

No pairs are formed, and a group of copies costs one row for each unit and map task. Before units and texts
are shuffled, a bitmap of fixed size drops most of those that no join would keep (:mod:`.bitmap`).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.scratch import discard, materialize
from .bitmap import likely_in

MIN_CHARS = 200
#: Length of the k-grams that serve as anchors.
ANCHOR_CHARS = 64
#: Different units of one anchor whose windows one task compares; those of anchors with more are spread over all.
FEW_UNITS = 1000
#: Characters that are hashed at once; longer texts are cut into overlapping blocks.
BLOCK = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.full(n, _BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def prefix_sums(text: str) -> tuple[np.ndarray, int]:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(codes)
    up, _ = _powers(2 * BLOCK)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(codes + np.uint64(1)) * up[:n], out=sums[1:])
    return sums, n


def gram_hashes(sums: np.ndarray, n: int, size: int) -> np.ndarray:
    """Hashes of all ``size``-grams of the text behind ``sums``."""
    _, down = _powers(2 * BLOCK)
    m = n - size + 1
    return mix((sums[size:] - sums[:m]) * down[:m])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values, by minima from both ends of blocks of ``w``."""
    n = len(x)
    pad = -n % w
    padded = np.concatenate([x, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    head = np.minimum.accumulate(padded, axis=1).ravel()
    tail = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[: n - w + 1], head[w - 1 : n])


def _blocks(text: str, t: int) -> Iterator[tuple[int, str]]:
    """Overlapping blocks of a text such that each window of ``t`` characters lies in exactly one."""
    step = BLOCK - t + 1
    for start in range(0, max(1, len(text) - t + 1), step):
        yield start, text[start : start + BLOCK]


def _units(pieces: list[str], t: int, k: int) -> tuple[np.ndarray, ...]:
    """Of joined pieces: piece number, anchor, first and last window of each unit, hashes of anchor and content."""
    sums, n = prefix_sums("".join(pieces))
    grams = gram_hashes(sums, n, k)
    low = np.uint64(0xFFFFFF)
    key = (grams & ~low) | (low - np.arange(len(grams), dtype=np.uint64))  # of equal hashes the last in the window
    least = sliding_min(key, t - k + 1)
    anchor = (low - (least & low)).astype(np.int64)
    lens = np.array([len(p) for p in pieces])
    ends = np.cumsum(lens)
    number = np.repeat(np.arange(len(pieces)), lens)[: len(anchor)]
    inside = np.arange(len(anchor)) + t <= ends[number]
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (number[1:] != number[:-1])
    first = np.flatnonzero(new & inside)
    stop = np.flatnonzero(inside & np.append((new | ~inside)[1:], True))
    at = anchor[first]
    _, down = _powers(2 * BLOCK)
    content = (sums[stop + t] - sums[first]) * down[first]
    shape = (at - first).astype(np.uint64) * np.uint64(0x9E3779B1) + (stop - first).astype(np.uint64) * np.uint64(0x85EBCA77C2B2AE63)
    base = (ends - lens)[number[first]]
    return number[first], grams[at], mix(mix(content) + shape), first - base, stop - base


def _find_units(t: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(owners, offsets, pieces):
            number, ah, sh, a, b = _units(pieces, t, k)
            ids, off = np.array(owners, np.int64)[number], np.array(offsets, np.int64)[number]
            return pa.record_batch([pa.array(ah.view(np.int64)), pa.array(sh.view(np.int64)), pa.array(ids), pa.array(a + off), pa.array(b + off)], names=["ah", "sh", "doc_id", "a", "b"])

        for batch in batches:
            owners, offsets, pieces, chars = [], [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if doc_id is None or text is None or len(text) < t:
                    continue
                for start, piece in _blocks(text, t):
                    owners.append(doc_id)
                    offsets.append(start)
                    pieces.append(piece)
                    chars += len(piece)
                    if chars >= BLOCK:
                        yield flush(owners, offsets, pieces)
                        owners, offsets, pieces, chars = [], [], [], 0
            if pieces:
                yield flush(owners, offsets, pieces)

    return run


def _cut_units():
    """The texts of units, from the texts of their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, units in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                units = [u for u in units if u["e"] <= len(text)]
                column = lambda c: pa.array([u[c] for u in units], pa.int64())
                yield pa.record_batch([column("ah"), column("sh"), column("mn"), column("mx"), pa.array([text[u["a"] : u["e"]] for u in units], pa.string())], names=["ah", "sh", "mn", "mx", "text"])

    return run


def _window_hashes(texts: list[str], t: int) -> tuple[np.ndarray, np.ndarray]:
    """Of texts of at least ``t`` characters: number of the text and hash of every window."""
    lens = np.array([len(x) for x in texts])
    numbers, hashes, at = [], [], 0
    while at < len(texts):  # as many at once as the powers reach
        n = max(1, int(np.searchsorted(np.cumsum(lens[at:]), BLOCK, side="right")))
        part = texts[at : at + n]
        sums, total = prefix_sums("".join(part))
        wh = gram_hashes(sums, total, t)
        ends = np.cumsum(lens[at : at + n])
        number = np.repeat(np.arange(n), lens[at : at + n])[: len(wh)]
        inside = np.arange(len(wh)) + t <= ends[number]
        numbers.append(number[inside] + at)
        hashes.append(wh[inside])
        at += n
    return np.concatenate(numbers), np.concatenate(hashes)


def _find_windows(t: int):
    """Every window of units as a row, for anchors with very many units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            number, wh = _window_hashes(batch.column(4).to_pylist(), t)
            first = np.searchsorted(number, np.arange(batch.num_rows))
            off = (np.arange(len(number)) - first[number]).astype(np.int32)
            take = pa.array(number)
            yield pa.record_batch([batch.column(0).take(take), batch.column(1).take(take), pa.array(off), pa.array(wh.view(np.int64)), batch.column(2).take(take), batch.column(3).take(take)], names=["ah", "sh", "off", "wh", "mn", "mx"])

    return run


_RANGES = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))


def _compare_units(t: int):
    """Shared windows of units sorted by anchor, as ranges; an anchor's units lie together."""

    def compare(rows: pa.Table) -> pa.RecordBatch:
        ah, sh, mn, mx = (rows.column(i).to_numpy() for i in range(4))
        number, wh = _window_hashes(rows.column(4).to_pylist(), t)
        order = np.lexsort((wh, ah[number]))
        own, h = number[order], wh[order]
        new = np.ones(len(own), bool)
        new[1:] = (h[1:] != h[:-1]) | (ah[own[1:]] != ah[own[:-1]])
        starts = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        shared = np.minimum.reduceat(mn[own], starts) < np.maximum.reduceat(mx[own], starts)
        hit = np.zeros(len(number), bool)
        hit[order] = shared[group]
        hit &= (mn == mx)[number]  # other units are shared as a whole already
        begin = hit & np.concatenate([[True], ~hit[:-1] | (number[1:] != number[:-1])])
        end = hit & np.concatenate([~hit[1:] | (number[1:] != number[:-1]), [True]])
        first = np.searchsorted(number, np.arange(len(ah)))
        lo, hi = np.flatnonzero(begin), np.flatnonzero(end)
        owner = number[lo]
        lists = np.searchsorted(owner, np.arange(len(ah) + 1)).astype(np.int32)
        pairs = pa.StructArray.from_arrays([pa.array(lo - first[owner], pa.int64()), pa.array(hi - first[owner], pa.int64())], ["lo", "hi"])
        found = pa.record_batch([pa.array(ah), pa.array(sh), pa.ListArray.from_arrays(pa.array(lists), pairs).cast(_RANGES)], names=["ah", "sh", "ranges"])
        return found.filter(pa.array(lists[1:] > lists[:-1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            kept.append(batch)
            anchors = batch.column(0).to_numpy()
            last = int(np.flatnonzero(anchors != anchors[-1])[-1]) + 1 if anchors[0] != anchors[-1] else 0
            if last:  # all but the last anchor's units are there
                yield compare(pa.Table.from_batches([*kept[:-1], batch.slice(0, last)]))
                kept = [batch.slice(last)]
        if kept:
            yield compare(pa.Table.from_batches(kept))

    return run


def shared_spans(docs: DataFrame, min_chars: int = MIN_CHARS, anchor_chars: int = ANCHOR_CHARS, few_units: int = FEW_UNITS) -> DataFrame:
    """``(doc_id, span_start, span_end)``: the maximal stretches of shared characters of every text.

    A character is shared if it lies in a run of at least ``min_chars`` characters that also occurs in the
    text of another doc_id. Null, empty and shorter texts have none; a run repeated within one text only is
    not shared; rows repeated under one doc_id count as one document; an empty table gives no rows. Only
    ``doc_id`` and ``text`` are read. Digests have 128 bits, so chance collisions can be neglected.
    """
    t, k = min_chars, min(anchor_chars, min_chars)
    docs = docs.select("doc_id", "text")
    units = materialize(docs.mapInArrow(_find_units(t, k), "ah bigint, sh bigint, doc_id bigint, a bigint, b bigint"), "units")
    anchors = materialize(units.groupBy("ah").agg(F.min("doc_id").alias("mn"), F.max("doc_id").alias("mx")).filter("mn < mx").select("ah"), "shared-anchors")
    shared = materialize(likely_in(units, "ah", anchors).join(anchors, "ah", "left_semi"), "shared-units")
    discard(units)

    earliest = F.min(F.struct("doc_id", "a", "b")).alias("rep")
    groups = shared.groupBy("ah", "sh").agg(F.min("doc_id").alias("mn"), F.max("doc_id").alias("mx"), earliest)
    groups = materialize(groups, "unit-groups")
    whole = groups.filter("mn < mx").select("ah", "sh", F.expr("array(named_struct('lo', 0L, 'hi', rep.b - rep.a))").alias("ranges"))

    mixed = materialize(groups.groupBy("ah").agg(F.count("*").alias("n")).filter("n > 1"), "mixed-anchors")
    edges = groups.join(mixed, "ah").select("n", "ah", "sh", "mn", "mx", F.col("rep.doc_id").alias("doc_id"), F.col("rep.a").alias("a"), (F.col("rep.b") + t).alias("e"))
    ranges = whole.unionByName(_windows_by_anchor(_edge_texts(docs, edges.filter(F.col("n") <= few_units), t), t))
    if not mixed.filter(F.col("n") > few_units).isEmpty():
        ranges = ranges.unionByName(_ranges(_windows_one_by_one(_edge_texts(docs, edges.filter(F.col("n") > few_units), t).mapInArrow(_find_windows(t), "ah bigint, sh bigint, off int, wh bigint, mn bigint, mx bigint"))))
    spans = shared.join(ranges, ["ah", "sh"]).select("doc_id", "a", F.inline("ranges"))
    spans = spans.select("doc_id", (F.col("a") + F.col("lo")).alias("s"), (F.col("a") + F.col("hi") + t).alias("e"))
    return merge_ranges(spans)


def _edge_texts(docs: DataFrame, edges: DataFrame, t: int) -> DataFrame:
    """``(ah, sh, mn, mx, text)``: the texts of the units in ``edges``; only documents that hold some are shuffled."""
    by_doc = materialize(edges.groupBy("doc_id").agg(F.collect_list(F.struct("ah", "sh", "mn", "mx", "a", "e")).alias("units")), "edges")
    long = docs.filter(F.length("text") >= t)
    at = likely_in(long, "doc_id", by_doc.select("doc_id")).join(by_doc, "doc_id").select("text", "units")
    return at.mapInArrow(_cut_units(), "ah bigint, sh bigint, mn bigint, mx bigint, text string")


def _windows_by_anchor(texts: DataFrame, t: int) -> DataFrame:
    """``(ah, sh, ranges)``: shared windows of units not shared as a whole; all units of an anchor in one task (few of them)."""
    return texts.repartition("ah").sortWithinPartitions("ah").mapInArrow(_compare_units(t), "ah bigint, sh bigint, ranges array<struct<lo:bigint,hi:bigint>>")


def _windows_one_by_one(windows: DataFrame) -> DataFrame:
    """The same for anchors with many units: every window is a group of its own, with counts taken on the map side."""
    windows = materialize(windows, "edge-windows")
    hit = windows.groupBy("ah", "wh").agg(F.min("mn").alias("mn"), F.max("mx").alias("mx")).filter("mn < mx").select("ah", "wh")
    # at most min_chars offsets for each unit
    return windows.filter("mn = mx").join(hit, ["ah", "wh"], "left_semi").groupBy("ah", "sh").agg(F.collect_set("off").alias("offs"))


def _ranges(part: DataFrame) -> DataFrame:
    """Offsets of windows to ranges of consecutive ones."""
    first = F.sort_array(F.filter("offs", lambda x: ~F.array_contains(F.col("offs"), x - 1)))
    last = F.sort_array(F.filter("offs", lambda x: ~F.array_contains(F.col("offs"), x + 1)))
    both = F.zip_with(first, last, lambda a, b: F.struct(a.cast("bigint").alias("lo"), b.cast("bigint").alias("hi")))
    return part.select("ah", "sh", both.alias("ranges"))


def merge_ranges(spans: DataFrame) -> DataFrame:
    """Union of the ranges ``[s, e)`` of each doc_id as maximal stretches."""
    order = Window.partitionBy("doc_id").orderBy("s", "e")
    before = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col("s") > before), 1).otherwise(0)
    run = F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    runs = spans.withColumn("new", new).withColumn("run", run)
    return runs.groupBy("doc_id", "run").agg(F.min("s").alias("span_start"), F.max("e").alias("span_end")).drop("run")


def shared_share(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``(doc_id, n_chars, shared_chars, share)`` of every document; null and empty texts have 0 and a null share."""
    per_doc = spans.groupBy("doc_id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    n = F.coalesce(F.length("text"), F.lit(0)).cast("bigint")
    out = docs.select("doc_id", n.alias("n_chars")).join(per_doc, "doc_id", "left")
    shared = F.coalesce("shared_chars", F.lit(0)).cast("bigint")
    share = F.round(F.when(F.col("n_chars") > 0, shared / F.col("n_chars")), 6)
    return out.select("doc_id", "n_chars", shared.alias("shared_chars"), share.alias("share"))


def repeated_paragraphs(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(doc_id, unit_start, unit_end, keeper_doc, keeper_start)``: paragraphs to remove.

    A paragraph (text between blank lines) of at least ``min_chars`` characters is normalised (lower case,
    white space collapsed); digests are grouped over all documents and the earliest occurrence by
    (doc_id, offset) is kept. Every other is returned with its original offsets. Null and empty texts have none.
    """
    # the offset of a paragraph is the length of all before it plus their separators
    parts = docs.select("doc_id", F.posexplode(F.split("text", "\n\n", -1)).alias("i", "part"))
    order = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("part") + 2).over(order), F.lit(0)).cast("bigint")
    norm = F.lower(F.trim(F.regexp_replace("part", r"\s+", " ")))
    units = parts.select("doc_id", start.alias("unit_start"), F.length("part").alias("n"), F.sha2(norm, 256).alias("digest"))
    units = units.filter(F.col("n") >= min_chars)
    keep = units.groupBy("digest").agg(F.min(F.struct("doc_id", "unit_start")).alias("keep"), F.count("*").alias("m")).filter("m > 1")
    out = units.join(keep, "digest").filter("keep.doc_id != doc_id or keep.unit_start != unit_start")
    return out.select("doc_id", "unit_start", (F.col("unit_start") + F.col("n")).alias("unit_end"), F.col("keep.doc_id").alias("keeper_doc"), F.col("keep.unit_start").alias("keeper_start"))
