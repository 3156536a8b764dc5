"""A keyed store against a plain dictionary: merges, concurrent writers, readers during a removal."""

import random

import pytest
from pyspark.sql import functions as F

from orbweave.sources.store import Conflict, Store

HOW = {"overwrite": ["title"], "coalesce": ["genre"], "least": ["seed"], "first": ["blocked_at"]}
COLUMNS = "id long, title string, genre string, seed long, blocked_at string"
CHANGES = COLUMNS + ", n long"


def plain(state, changes, gone=()):
    for i in gone:
        state.pop(i, None)
    for i, title, genre, seed, at, _ in sorted(changes, key=lambda c: c[5]):
        old = state.get(i, (None, None, None, None))
        seeds = [x for x in (old[2], seed) if x is not None]
        state[i] = (title, genre if genre is not None else old[1], min(seeds) if seeds else None, old[3] if old[3] is not None else at)
    return state


def rows_of(df):
    return {r["id"]: (r["title"], r["genre"], r["seed"], r["blocked_at"]) for r in df.collect()}


def test_store_merges(spark, tmp_path):
    rng = random.Random(3)
    store = Store(spark, str(tmp_path), COLUMNS, ["id"], HOW, buckets=4)
    assert store.version() == 0 and store.read().count() == 0 and store.read().columns == ["id", "title", "genre", "seed", "blocked_at"]
    some = lambda *x: rng.choice((None, *x))
    state, history = {}, []
    for turn in range(6):
        changes = [(rng.randrange(12), some("a", "b", "c"), some("x", "y"), some(1, 2, 3, 4), some("t1", "t2"), n) for n in range(8)]
        gone = rng.sample(range(12), 2) if turn % 2 else []
        version = store.commit(spark.createDataFrame(changes, CHANGES), "n", store.version(), spark.createDataFrame([(i,) for i in gone], "id long") if gone else None)
        plain(state, changes, gone)
        history.append((version, dict(state)))
        assert rows_of(store.read()) == state
        if turn == 3:
            assert store.compact() == version + 1 and rows_of(store.read()) == state
    for version, then in history:
        assert rows_of(store.read(version)) == then
    few = spark.createDataFrame([(3,), (5,), (99,)], "id long")
    part = store.read(keys=few)
    assert rows_of(part) == {i: r for i, r in state.items() if i in (3, 5)} and "PartitionFilters: [_bucket" in part._jdf.queryExecution().toString().replace("isnotnull(_bucket", "_bucket")


def test_store_writers_and_readers(spark, tmp_path):
    one, two = (Store(spark, str(tmp_path), COLUMNS, ["id"], HOW) for _ in range(2))
    row = lambda i, title: spark.createDataFrame([(i, title, None, i, None, 0)], CHANGES)
    one.commit(row(1, "first"), "n", 0)
    seen = two.version()
    one.commit(row(2, "one's"), "n", seen)
    with pytest.raises(Conflict):
        two.commit(row(2, "two's"), "n", seen)
    tries = []

    def slow(now):
        """Its first try meets another writer's commit."""
        tries.append(now.count())
        if len(tries) == 1:
            one.commit(row(3, "between"), "n", one.version())
        return now.where("id = 2").withColumn("title", F.concat("title", F.lit("!"))).withColumn("n", F.lit(0))

    assert two.change(slow, "n") == 4 and tries == [2, 3]
    assert rows_of(two.read()) == {1: ("first", None, 1, None), 2: ("one's!", None, 2, None), 3: ("between", None, 3, None)}
    with one.pinned() as (version, rows):
        two.compact()
        two.commit(row(9, "later"), "n", two.version())
        assert two.expire() == [] and len(rows_of(rows)) == 3 and version == 4
        assert len(rows_of(two.read())) == 4
    assert len(two.expire()) == 4 and two.expire() == [] and len(rows_of(one.read())) == 4
    assert not [p for p in tmp_path.iterdir() if p.name.startswith(".making")]
    with one.pinned(seconds=-1):
        pass
