from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from folioscan.operators import ledger

T0 = datetime(2024, 1, 1)
HOUR = timedelta(hours=1)
DOCS = "doc_id bigint, path string, size bigint, modified timestamp_ntz, token string"


def plan(spark, docs, manifest, runs):
    d = spark.createDataFrame([(*x, "clash") for x in docs], DOCS)
    m = spark.createDataFrame(manifest, "path string, size bigint, mtime timestamp_ntz, run_id bigint, state string")
    r = spark.createDataFrame(runs, "run_id bigint, started_at timestamp_ntz, status string")
    return sorted(x.doc_id for x in ledger.files_to_process(d, m, r).collect())


def test_files_to_process(spark):
    later = T0 + timedelta(microseconds=1)
    runs = [(1, T0, "OK"), (2, T0 + timedelta(days=1), "failed"), (3, T0 + HOUR, "ok"), (4, T0 + timedelta(days=2), None), (5, None, "ok")]
    docs = [(1, "same", 5, T0), (2, "new", 5, T0), (3, "moved", 5, later), (4, "grown", 6, T0), (5, "nosize", None, T0), (6, "nodate", 5, None), (7, "failed", 5, T0), (8, "older", 5, T0), (9, "same", 5, T0), (10, None, 5, T0), (11, "twice", 5, T0), (11, "twice", 6, T0), (12, "undated", 5, T0), (13, "both", 10, T0)]
    manifest = [(p, 5, T0, 1, "") for p in ("same", "moved", "grown", "nosize", "nodate", "twice", "twice")]
    manifest += [("failed", 5, T0, 2, ""), ("failed", 5, T0, 4, ""), ("older", 5, T0, 1, ""), ("older", 9, T0, 3, ""), (None, 5, T0, 1, ""), ("same", 9, T0, 2, ""), ("gone", 1, T0, 1, ""), ("undated", 5, T0, 5, ""), ("both", 9, T0, 3, ""), ("both", 10, T0, 3, ""), ("new", 5, T0, 99, "")]
    assert plan(spark, docs, manifest, runs) == [2, 3, 4, 5, 6, 7, 8, 10, 11]
    assert plan(spark, docs[:2], manifest, []) == [1, 2] and plan(spark, [], [], runs) == []


def test_item_ids(spark):
    df = spark.createDataFrame([("a", None), ("a", ""), (None, "a"), ("a=", "")], "p string, s string")
    assert len({r[0] for r in df.select(ledger.item_id(F.col("p"), F.col("s"))).collect()}) == 4


@pytest.fixture
def book(spark, tmp_path):
    return ledger.WorkLedger(spark, str(tmp_path / "ledger"))


def wanted(spark, *items):
    quoted = lambda x: "cast(null as string)" if x is None else f"'{x}'"
    return spark.sql("select * from values " + ", ".join(f"({quoted(k)}, {quoted(v)}, 'x')" for k, v in items) + " t(key, version, state_)")


def states(book, want, now):
    return {(r.key, r.version): r.state for r in book.states(want, now).collect()}


def keys(df):
    return {r[0] for r in df.collect()}


def test_ledger_life(spark, book):
    want = wanted(spark, ("a", "1"), ("b", "1"), ("c", "1"), ("a", "1"), (None, "1"), ("d", None))
    assert set(states(book, want, T0).values()) == {"pending"} and book.events().count() == 0
    first = book.lease(want, "w1", T0, T0 + HOUR, limit=2)
    assert keys(book.leased(first, T0)) == {"a", "b"} and states(book, want, T0)["c", "1"] == "pending"
    book.complete(first, T0, wanted(spark, ("a", "1")))
    assert states(book, want, T0)["a", "1"] == "done" and keys(book.leased(first, T0)) == {"b"}
    late = T0 + 2 * HOUR  # the lease is over: b is pending again, a stays done
    assert keys(book.pending(want, late).filter("key is not null and version is not null")) == {"b", "c"}
    with pytest.raises(ledger.StaleLease):
        book.complete(first, late)
    second = book.lease(want, "w2", late, late + HOUR)
    assert second > first and keys(book.leased(second, late)) == {"b", "c"}
    with pytest.raises(ledger.StaleLease):
        book.complete(first, T0, wanted(spark, ("b", "1")), part="1")
    book.complete(second, late)
    assert set(states(book, want.filter("key is not null and version is not null"), late).values()) == {"done"}
    again = wanted(spark, ("a", "1"), ("b", "2"))
    assert keys(book.pending(again, late)) == {"b"}  # a new version of b only
    third = book.lease(again, "w3", late, None)
    book.release(third)
    assert keys(book.pending(again, late)) == {"b"}
    assert book.output_path("/out/", "abcd") == "/out/ab/abcd"


def test_compaction_keeps_states(spark, book):
    want = wanted(spark, ("a", "1"), ("b", "1"), ("c", "1"))
    one = book.lease(want, "w1", T0, T0 + HOUR, limit=1)
    book.complete(one, T0)
    two = book.lease(want, "w2", T0, T0 + HOUR, limit=1)
    before = states(book, want, T0)
    book.compact()
    assert len(book.committed()) == 1 and states(book, want, T0) == before == {("a", "1"): "done", ("b", "1"): "leased", ("c", "1"): "pending"}
    assert book.lease(want, "w3", T0, T0, limit=1) > two  # over at once
    book.compact()
    assert len(book.committed()) == 1 and states(book, want, T0) == before


class Killed(Exception):
    pass


@pytest.mark.parametrize("action,place", [("complete", "before the data"), ("complete", "before the commit"), ("complete", "after the commit"), ("lease", "before the commit"), ("lease", "after the commit"), ("release", "before the commit")])
def test_killed_writers_lose_and_repeat_nothing(spark, book, monkeypatch, action, place):
    want = wanted(spark, ("a", "1"), ("b", "1"))
    token = None if action == "lease" else book.lease(want, "w", T0, T0 + HOUR)
    work = {"lease": lambda: book.lease(want, "w", T0, T0 + HOUR), "complete": lambda: book.complete(token, T0), "release": lambda: book.release(token)}[action]
    create, append = book._create, book.append

    def dying_create(name):
        if name.startswith("commits/"):
            if place == "after the commit":
                create(name)
            raise Killed
        return create(name)

    def dying_append(name, events):
        raise Killed

    if place == "before the data":
        monkeypatch.setattr(book, "append", dying_append)
    else:
        monkeypatch.setattr(book, "_create", dying_create)
    with pytest.raises(Killed):
        work()
    monkeypatch.setattr(book, "_create", create)
    monkeypatch.setattr(book, "append", append)
    reborn = ledger.WorkLedger(spark, book.folder)  # a worker that knows nothing of the dead one
    committed = place == "after the commit"
    expected = {"lease": "leased" if committed else "pending", "complete": "done" if committed else "leased", "release": "pending" if committed else "leased"}[action]
    assert set(states(reborn, want, T0).values()) == {expected}
    if action != "lease":
        (reborn.complete if action == "complete" else lambda t, now: reborn.release(t))(token, T0)  # the retry
        assert set(states(reborn, want, T0).values()) == {"done" if action == "complete" else "pending"}


def test_two_workers_at_once(spark, book):
    """Both saw the items pending; the greater token holds, the other writer is refused."""
    want = wanted(spark, ("a", "1"))
    one = book.lease(want, "w1", T0, T0 + HOUR)
    two = book.next_token()
    book.append(f"lease-{two}", book.events().withColumns({"token": F.lit(two).cast("bigint"), "writer": F.lit("w2")}))
    with pytest.raises(ledger.StaleLease):
        book.complete(one, T0)
    book.complete(two, T0)
    book.complete(two, T0)
    assert states(book, want, T0) == {("a", "1"): "done"}
    assert one < two < book.next_token()
