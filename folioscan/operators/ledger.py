"""Problem 3: process only what is new or changed since the last successful run.

A ledger of work items with the states pending, leased and done. An item is a key (a path) with a version
(its fingerprint). The ledger is a log of events that is only ever added to; the state of a key is the fold
of its events:

* a lease takes items for a worker up to a time; it carries a fencing token, greater than those before it;
* a lease ends as done or as released (a run that failed), as a whole or item by item;
* of the versions done for a key the one with the greatest token counts, so a stale writer that comes late
  changes nothing; a lease that is released or over no longer holds, and its items are pending again.

Every addition is a segment of its own, written under a name that tells its meaning (``lease-7``, ``end-7``), and
counts from the moment an empty file of that name stands in ``commits``. A writer that dies before that leaves
nothing that is read, and its retry writes the same place again; one that dies after it has done its work. No
file's content decides over a commit, and none is ever half there.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, TimestampNTZType

from ..plans.scratch import new_path

PENDING, LEASED, DONE = "pending", "leased", "done"
_LEASE, _DONE, _RELEASED = "lease", "done", "released"

#: An event; with a null key it ends everything leased under its token. ``writer`` tells equal tokens apart.
EVENTS = "kind string, key string, version string, token bigint, writer string, until timestamp"
_COLUMNS = [c.split()[0] for c in EVENTS.split(", ")]


class StaleLease(Exception):
    """A writer came with the fencing token of a lease that is no longer in force."""


def item_id(*key: Column) -> Column:
    """A deterministic id of a work item; nulls have their own mark, so null and '' differ."""
    parts = [F.coalesce(F.concat(F.lit("="), k.cast("string")), F.lit("-")) for k in key]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def file_version(size: Column | str, modified: Column | str) -> Column:
    """The fingerprint of a file, to the microsecond; null if size or time is null. Sorts as (size, modified) does."""
    size, modified = (F.col(c) if isinstance(c, str) else c for c in (size, modified))
    return F.concat(F.lpad(size.cast("string"), 20, "0"), F.lit("@"), modified.cast("string"))


def micros(c: str, kind: DataType) -> Column:
    """Microseconds of a time with or without zone."""
    if isinstance(kind, TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(c))
    return F.unix_micros(F.col(c).cast("timestamp"))


def fold(events: DataFrame) -> DataFrame:
    """``(key, done_version, done_token, lease_token, lease_version, owner, until)``: what the events left for each key.

    ``lease_token`` is null unless the key's newest lease is open (neither done nor released; it may be over). One
    grouping by key with all maxima taken on the map side, and one join of the leases with the ends of tokens,
    one row for each run.
    """
    by = F.struct("token", "writer")
    ends = events.filter("kind != 'lease' and key is null").groupBy("token", "writer").agg(F.min("kind").alias("ended"))
    items = events.filter("key is not null")
    leases = items.filter("kind = 'lease'").join(ends, ["token", "writer"], "left").withColumn("kind", F.coalesce("ended", "kind"))
    rows = leases.select(*_COLUMNS).unionByName(items.filter("kind != 'lease'").select(*_COLUMNS))
    best = lambda kind, *cols: F.max(F.when(F.col("kind") == kind, F.struct(by.alias("by"), *cols)))
    keys = rows.groupBy("key").agg(best(_DONE, "version").alias("d"), best(_RELEASED).alias("r"), best(_LEASE, "version", "until").alias("l"))
    newer = lambda other: F.coalesce(F.col("l.by") > F.col(f"{other}.by"), F.lit(True))
    open_lease = F.when(newer("d") & newer("r"), F.col("l"))
    keys = keys.withColumn("l", open_lease)
    return keys.select("key", F.col("d.version").alias("done_version"), F.col("d.by.token").alias("done_token"), F.col("l.by.token").alias("lease_token"), F.col("l.version").alias("lease_version"), F.col("l.by.writer").alias("owner"), F.col("l.until").alias("until"))


class WorkLedger:
    """The ledger in a folder that all workers share.

    All methods take the time as an argument, so that tests and replays are exact. Two workers that lease at once get
    different tokens; should a store let both create one file, the names of the workers tell their leases apart.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for part in ("segments", "commits", "tokens"):
            self._fs.mkdirs(self._path(f"{self.folder}/{part}"))

    # Storage

    def _names(self, part: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.folder}/{part}"))]

    def _create(self, name: str) -> bool:
        """Create an empty file; False if it stands already."""
        p = self._path(f"{self.folder}/{name}")
        try:
            self._fs.create(p, False).close()
            return True
        except Exception:
            if self._fs.exists(p):
                return False
            raise

    def committed(self) -> list[str]:
        """Names of the segments that count: all that are committed, less those a compaction has taken in."""
        names = [n for n in self._names("commits") if not n.startswith((".", "_"))]
        gone: set[str] = set()
        for n in names:
            if n.startswith("compact-"):
                gone |= {r[0] for r in self.spark.read.schema("name string").parquet(f"{self.folder}/segments/{n}/covers").collect()}
        return sorted(set(names) - gone)

    def append(self, name: str, events: DataFrame) -> None:
        """Add a segment. A name that is committed already is done, and stays as it is."""
        if self._fs.exists(self._path(f"{self.folder}/commits/{name}")):
            return
        events.select(*_COLUMNS).write.mode("overwrite").parquet(f"{self.folder}/segments/{name}/events")
        self._create(f"commits/{name}")

    def events(self) -> DataFrame:
        paths = [f"{self.folder}/segments/{n}/events" for n in self.committed()]
        return self.spark.read.schema(EVENTS).parquet(*paths) if paths else self.spark.createDataFrame([], EVENTS)

    def compact(self) -> None:
        """Fold all segments into one: for each key what is done, and its open lease. The old ones are deleted after the commit."""
        names = self.committed()
        if len(names) < 2:
            return
        new = f"compact-{uuid.uuid4().hex}"
        state = fold(self.events())
        none = F.lit(None)
        rows = F.array(
            F.struct(F.lit(_DONE).alias("kind"), "key", F.col("done_version").alias("version"), F.col("done_token").alias("token"), F.lit("").alias("writer"), none.cast("timestamp").alias("until")),
            F.struct(F.lit(_LEASE).alias("kind"), "key", F.col("lease_version").alias("version"), F.col("lease_token").alias("token"), F.col("owner").alias("writer"), F.col("until").alias("until")),
        )
        state.select(F.inline(rows)).filter("token is not null").write.parquet(f"{self.folder}/segments/{new}/events")
        older = [n for n in self._names("commits") if n.startswith("compact-")]
        self.spark.createDataFrame([(n,) for n in sorted({*names, *older})], "name string").coalesce(1).write.parquet(f"{self.folder}/segments/{new}/covers")
        self._create(f"commits/{new}")
        for n in {*names, *older}:
            for part in ("commits", "segments"):
                self._fs.delete(self._path(f"{self.folder}/{part}/{n}"), True)

    # Work

    def _wanted(self, wanted: DataFrame, now: datetime) -> DataFrame:
        """``wanted`` with its state; wanted keys meet the folded events in one join."""
        rows = wanted.join(fold(self.events()).withColumnRenamed("key", "_key"), F.col("key") == F.col("_key"), "left")
        done = F.coalesce(F.col("version") == F.col("done_version"), F.lit(False))
        held = F.col("lease_token").isNotNull() & (F.col("until").isNull() | (F.col("until") > F.lit(now)))
        state = F.when(done, DONE).when(held, LEASED).otherwise(PENDING)
        return rows.withColumn("state", state)

    def states(self, wanted: DataFrame, now: datetime) -> DataFrame:
        """``wanted(key, version, ...)`` with ``state`` and ``token``.

        Done if the version done last for the key is this one; leased while the key's newest lease is open and not over;
        pending otherwise, also for a null key or version. Repeated rows stay repeated.
        """
        token = F.when(F.col("state") == LEASED, F.col("lease_token")).when(F.col("state") == DONE, F.col("done_token"))
        return self._wanted(wanted, now).select(*wanted.columns, "state", token.alias("token"))

    def pending(self, wanted: DataFrame, now: datetime) -> DataFrame:
        return self.states(wanted, now).filter(F.col("state") == PENDING).drop("state", "token")

    def next_token(self) -> int:
        """A token greater than all before it. One whose owner dies at once is only a gap."""
        token = max((int(n) for n in self._names("tokens") if n.isdigit()), default=0) + 1
        while not self._create(f"tokens/{token}"):
            token += 1
        return token

    def lease(self, wanted: DataFrame, owner: str, now: datetime, until: datetime | None, limit: int | None = None) -> int:
        """Lease the pending items of ``wanted`` (all, or ``limit`` by key) to ``owner``; returns the fencing token. Items with a null key or version can't be leased."""
        token = self.next_token()
        take = self.pending(wanted, now).filter("key is not null and version is not null").groupBy("key").agg(F.max("version").alias("version"))
        if limit is not None:
            take = take.orderBy("key").limit(limit)
        rows = take.select(F.lit(_LEASE).alias("kind"), "key", "version", F.lit(token).cast("bigint").alias("token"), F.lit(owner).alias("writer"), F.lit(until).cast("timestamp").alias("until"))
        self.append(f"lease-{token}", rows)
        return token

    def leased(self, token: int, now: datetime) -> DataFrame:
        """``(key, version)`` that the lease still holds."""
        rows = fold(self.events()).filter(F.col("lease_token") == token)
        return rows.filter(F.col("until").isNull() | (F.col("until") > F.lit(now))).select("key", F.col("lease_version").alias("version"))

    def complete(self, token: int, now: datetime, items: DataFrame | None = None, part: str = "0") -> None:
        """Mark what is leased under ``token`` done: all, or the keys in ``items`` under the name ``part``.

        A retry of a completion that was committed does nothing. Raises :class:`StaleLease` if the lease is over, or
        an item of it (of ``items``) is not held under this token.
        """
        name = f"end-{token}" if items is None else f"done-{token}-{part}"
        if self._fs.exists(self._path(f"{self.folder}/commits/{name}")):
            return
        held = self.leased(token, now)
        if items is None:
            mine = self.events().filter((F.col("kind") == _LEASE) & (F.col("token") == token)).select("key", "writer")
            done = self.events().filter((F.col("kind") == _DONE) & (F.col("token") == token)).select("key")
            if mine.isEmpty() or not mine.join(held, "key", "left_anti").join(done, "key", "left_anti").isEmpty():
                raise StaleLease(f"the lease under token {token} is no longer in force")
            self.append(name, self._end(mine, token, _DONE))
            return
        keys = items.select("key").distinct()
        if not keys.join(held, "key", "left_anti").isEmpty():
            raise StaleLease(f"an item isn't leased under token {token}")
        owner = self.events().filter((F.col("kind") == _LEASE) & (F.col("token") == token)).select("key", "version", "writer")
        self.append(name, owner.join(keys, "key", "left_semi").select(F.lit(_DONE).alias("kind"), "key", "version", F.lit(token).cast("bigint").alias("token"), "writer", F.lit(None).cast("timestamp").alias("until")))

    def release(self, token: int) -> None:
        """Give back what is leased under ``token``; it is pending again at once."""
        mine = self.events().filter((F.col("kind") == _LEASE) & (F.col("token") == token)).select("writer")
        self.append(f"end-{token}", self._end(mine, token, _RELEASED))

    def _end(self, mine: DataFrame, token: int, kind: str) -> DataFrame:
        none = F.lit(None)
        return mine.select("writer").distinct().select(F.lit(kind).alias("kind"), none.cast("string").alias("key"), none.cast("string").alias("version"), F.lit(token).cast("bigint").alias("token"), "writer", none.cast("timestamp").alias("until"))

    def output_path(self, base: str, ident: str) -> str:
        """Where the result of an item goes: the same place for every retry."""
        return f"{base.rstrip('/')}/{ident[:2]}/{ident}"

    def import_runs(self, manifest: DataFrame, runs: DataFrame) -> None:
        """Enter a history of runs: what a run recorded it had leased, under the time of its start as the token.

        A run with status 'ok' (in any case, trimmed) finished its lease; every other one released it, whenever its
        records arrived, so that what it left is pending again. A run_id that stands several times counts as
        successful if one of its rows is, at that row's latest start. Records with a null path or of an unknown
        run don't count; of differing records of a run for one path the greatest version counts.
        """
        ok = F.lower(F.trim("status")) == "ok"
        start = F.coalesce(micros("started_at", runs.schema["started_at"].dataType), F.lit(-(2**63)))
        known = runs.filter("run_id is not null").groupBy("run_id").agg(F.max(F.struct(F.coalesce(ok, F.lit(False)).alias("ok"), start.alias("token"))).alias("r"))
        known = known.select("run_id", "r.ok", "r.token", F.lpad(F.col("run_id").cast("string"), 20, "0").alias("writer"))
        none = F.lit(None)
        records = manifest.filter("path is not null").select("run_id", F.col("path").alias("key"), file_version("size", "mtime").alias("version"))
        leases = records.join(known, "run_id").select(F.lit(_LEASE).alias("kind"), "key", "version", "token", "writer", none.cast("timestamp").alias("until"))
        self.append("lease-history", leases)
        ends = known.select(F.when(F.col("ok"), _DONE).otherwise(_RELEASED).alias("kind"), none.cast("string").alias("key"), none.cast("string").alias("version"), "token", "writer", none.cast("timestamp").alias("until"))
        self.append("end-history", ends)


def work_items(documents: DataFrame, manifest: DataFrame, runs: DataFrame, key: str = "doc_id", now: datetime = datetime(1970, 1, 1)) -> DataFrame:
    """``(key, path, item_id, state)``: every row of ``documents`` as an item of a ledger that holds the history of runs.

    Done if size and modified are known and equal, to the microsecond, what the latest successful run recorded for
    the path; pending otherwise. Rows with a null path are pending. Repeated rows stay repeated. With an empty
    manifest or without successful runs everything is pending; an empty table gives no rows.
    """
    ledger = WorkLedger(documents.sparkSession, new_path(documents.sparkSession, "ledger"))
    ledger.import_runs(manifest, runs)
    wanted = documents.select(F.col(key).alias("id"), F.col("path").alias("key"), file_version("size", "modified").alias("version"))
    rows = ledger.states(wanted, now)
    return rows.select(F.col("id").alias(key), F.col("key").alias("path"), item_id(F.col("key"), F.col("version")).alias("item_id"), "state")


def files_to_process(documents: DataFrame, manifest: DataFrame, runs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The keys of the pending items of :func:`work_items`."""
    return work_items(documents, manifest, runs, key).filter(F.col("state") == PENDING).select(key)


def counts_by_state(items: DataFrame, states: Sequence[str] = (PENDING, LEASED, DONE)) -> DataFrame:
    """``(state, n)`` for each state, also those without items."""
    spark = items.sparkSession
    all_states = spark.createDataFrame([(s,) for s in states], "state string")
    n = items.groupBy("state").agg(F.count("*").alias("n"))
    return all_states.join(n, "state", "left").select("state", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
