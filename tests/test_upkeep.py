"""The crawl, changes to the catalogue and payload columns on small inputs."""

import time

import pytest
from pyspark.sql import functions as F

from orbweave.functions import expr
from orbweave.operators import crawl, merge, relational
from orbweave.streaming import crawl_log


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head()["x"]


FRONTIER = "kind string, ref_id string, priority long, state string"


def test_frontier(spark):
    empty = spark.createDataFrame([], FRONTIER)
    for priority in (2, 1, 3):
        empty = crawl.enqueue(empty, spark.createDataFrame([("artist", "7", priority)], "kind string, ref_id string, priority long"))
    assert empty.collect() == [("artist", "7", 1, "pending")]
    done = crawl.mark(empty, empty, "done")
    again = crawl.enqueue(done, spark.createDataFrame([("artist", "7", 0), ("album", "a", 0)], "kind string, ref_id string, priority long"))
    assert sorted(map(tuple, again.collect())) == [("album", "a", 0, "pending"), ("artist", "7", 0, "done")]
    both = spark.createDataFrame([("album", "a", 0, "pending"), ("artist", "9", 0, "pending"), ("artist", "1", 0, "done")], FRONTIER)
    assert crawl.pop(both).head()["ref_id"] == "9"


def plain_crawl(seeds, albums, similar, items, blocked, dead, far, most):
    """Entry by entry, by distance, artists before albums, then by ref_id."""
    frontier, tracks = {e: [0, "pending"] for e in seeds}, {}
    filed = {b: a for a, b in albums}

    def ask(entry, priority):
        known = frontier.setdefault(entry, [priority, "pending"])
        known[0] = min(known[0], priority)

    while len(tracks) < (most or 10**9):
        due = sorted((p, e[0] != "artist", e) for e, (p, s) in frontier.items() if s == "pending")
        if not due:
            break
        p, _, (kind, ref) = due[0]
        artist = int(ref) if kind == "artist" and ref.isdigit() else filed.get(ref)
        if p > far or (artist in blocked):
            frontier[kind, ref][1] = "skipped"
            continue
        if (kind, ref) in dead or (kind == "artist" and not ref.isdigit()):
            frontier[kind, ref][1] = "failed"
            continue
        if kind == "artist":
            for a, b in albums:
                if a == artist:
                    ask(("album", b), p)
            for a, b in similar:
                if a == artist and p < far and b not in blocked:
                    ask(("artist", str(b)), p + 1)
        else:
            for b, t in items:
                if b == ref:
                    tracks[t] = min(tracks.get(t, p), p)
        frontier[kind, ref][1] = "done"
    return {(k, r, p, s) for (k, r), (p, s) in frontier.items()}, tracks


@pytest.mark.parametrize(("far", "most"), [(2, None), (0, None), (2, 14), (5, 22)])
def test_crawl(spark, tmp_path, monkeypatch, far, most):
    albums = [(a, f"b{a}{i}") for a in range(12) for i in range(a % 3 + 1)]
    similar = [(a, (a * 3 + 1) % 12) for a in range(12)] + [(a, (a + 5) % 12) for a in range(12)]
    items = [(b, 100 * a + int(b[-1]) * 10 + i) for a, b in albums for i in range(3)]
    seeds, blocked, dead = [("artist", "0"), ("artist", "x"), ("album", "b42"), ("artist", "5")], {1}, {("album", "b20")}
    sources = crawl.Sources(
        spark.createDataFrame(albums, "artist_id long, album_id string"), spark.createDataFrame(similar, "artist_id long, similar_id long"), spark.createDataFrame([(b, a) for a, b in albums], "album_id string, artist_id long"),
        spark.createDataFrame(items, "album_id string, track_id long"), spark.createDataFrame(list(dead), "kind string, ref_id string"),
    )
    log, gone = crawl_log.CrawlLog(spark, str(tmp_path)), spark.createDataFrame([(b,) for b in blocked], "artist_id long")
    crawl_log.seed(log, spark.createDataFrame([(*e, 0) for e in seeds], "kind string, ref_id string, priority long"))
    monkeypatch.setattr(crawl_log, "MANY", 3)
    whole, cut = crawl_log.CrawlLog.commit, iter(range(100))

    def stopped(self, frontier, *rest, **kw):
        """Every other round stops half way: its data is written in part and never committed."""
        if next(cut) % 2:
            frontier.write.parquet(f"{self.folder}/.making-stopped{time.time_ns()}/frontier")
            raise RuntimeError("stopped")
        whole(self, frontier, *rest, **kw)

    monkeypatch.setattr(crawl_log.CrawlLog, "commit", stopped)
    for _ in range(40):
        try:
            crawl_log.run(crawl_log.CrawlLog(spark, str(tmp_path)), gone, sources, far, most)
            break
        except RuntimeError:
            pass
    monkeypatch.setattr(crawl_log.CrawlLog, "commit", whole)
    want, found = plain_crawl(seeds, albums, similar, items, blocked, dead, far, most)
    for _ in range(2):
        assert {(r["kind"], r["ref_id"], r["priority"], r["state"]) for r in log.entries().collect()} == want
        assert {r["track_id"]: r["seed_distance"] for r in log.tracks().collect()} == found
        log.compact()
        log.clean()
        assert len(log.rounds()) == 1 and [p.name for p in tmp_path.iterdir()] == ["rounds"]


def test_crawl_log_conflicts_and_lesser_priorities(spark, tmp_path):
    log = crawl_log.CrawlLog(spark, str(tmp_path))
    entry = lambda *rows: spark.createDataFrame(rows, "kind string, ref_id string, priority long")
    assert log.entries().count() == 0 == log.tracks().count()
    crawl_log.seed(log, entry(("artist", "7", 3), ("artist", "8", 1), ("artist", "7", 2)))
    crawl_log.seed(log, entry(("artist", "7", 1), ("artist", "8", 4)))
    assert sorted(map(tuple, log.entries().collect())) == [("artist", "7", 1, "pending"), ("artist", "8", 1, "pending")]
    assert log.entries(2).count() == 0 and "PartitionFilters: [isnotnull(priority" in log.entries(2)._jdf.queryExecution().toString()
    other, at = crawl_log.CrawlLog(spark, str(tmp_path)), log.next_round()
    log.commit(entry(("artist", "7", 1)).withColumn("state", F.lit("done")), None, at)
    with pytest.raises(crawl_log.Conflict):
        other.commit(entry(("artist", "7", 1)).withColumn("state", F.lit("failed")), None, at)
    assert {r["state"] for r in log.entries(1).where("ref_id = '7'").collect()} == {"done"} and len(list((tmp_path / "rounds").iterdir())) == 3


def test_upsert_with_any_order(spark):
    """A struct serves as order; the table's rows come before all changes."""
    known = spark.createDataFrame([(1, "old"), (2, "kept")], "id long, name string")
    new = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (3, None, 0)], "id long, name string, n int").withColumn("seq", F.struct("n", "name")).drop("n")
    got = {r["id"]: r["name"] for r in merge.upsert(known, new, ["id"], "seq", overwrite=["name"]).collect()}
    assert got == {1: "b", 2: "kept", 3: None}


def test_features_and_failures(spark):
    features, failures = spark.createDataFrame([(1, "v1")], "track_id long, version string"), spark.createDataFrame([(1, "fetch", "old"), (2, "fetch", "x")], "track_id long, stage string, reason string")
    new = spark.createDataFrame([(2, "v2", 5), (1, "v2", 6)], "track_id long, version string, seq int")
    left, kept = merge.record_features(features, failures, new, "seq")
    assert sorted(map(tuple, left.collect())) == [(1, "v2"), (2, "v2")] and kept.count() == 0
    failed = merge.record_failures(failures, spark.createDataFrame([(2, "decode", "y" * 900, 1)], "track_id long, stage string, reason string, seq int"), "seq")
    assert {r["track_id"]: (r["stage"], len(r["reason"])) for r in failed.collect()} == {1: ("fetch", 3), 2: ("decode", 500)}


def test_block_and_unblock(spark):
    none, frontier = spark.createDataFrame([], "artist_id long, name string, reason string, blocked_at string"), spark.createDataFrame([("artist", "7"), ("album", "7")], "kind string, ref_id string")
    asked = spark.createDataFrame([(7, "Seven", "too loud", "t1", 1), (7, "Seven", None, "t2", 2)], "artist_id long, name string, reason string, blocked_at string, seq int")
    blocked, left = merge.block(none, frontier, asked, "seq")
    assert blocked.select("artist_id", "name", "reason", "blocked_at").collect() == [(7, "Seven", "too loud", "t1")]
    assert left.collect() == [("album", "7")]
    assert merge.unblock(blocked, relational.matching_blocks(blocked, "SEV")).count() == 0 and merge.unblock(blocked, relational.matching_blocks(blocked, "70")).count() == 1


def test_purge(spark):
    tracks = spark.createDataFrame([(1, 7), (2, 8), (3, None)], "track_id long, artist_id long")
    ids = tracks.select("track_id")
    every = {"tracks": tracks, "albums": spark.createDataFrame([("a", 7), ("b", 8)], "album_id string, artist_id long"), "features": ids, "layout": ids, "failures": ids, "frontier": spark.createDataFrame([("artist", "7"), ("album", "7")], "kind string, ref_id string")}
    left, counts = merge.purge_artists(every, spark.createDataFrame([(7,)], "artist_id long"))
    assert {r["what"]: r["removed"] for r in counts.collect()} == dict.fromkeys(("features", "layout", "failures", "tracks", "albums", "frontier"), 1)
    assert sorted(r["track_id"] for r in left["features"].collect()) == [2, 3] and left["frontier"].collect() == [("album", "7")]


def test_payload_columns(spark):
    ids = lambda text: (one(spark, expr.number_id(F.lit(text), "$.id")), one(spark, expr.text_id(F.lit(text), "$.id")))
    assert [ids(t) for t in ('{"id":12}', '{"id":"12"}', '{"id":"a"}', '{"id":""}', '{"id":null}', '{"id":[1]}', "{}", "odd", None)] == [(12, "12"), (12, "12"), (None, "a"), *[(None, None)] * 6]
    image = lambda text: one(spark, expr.image(F.lit(text)))
    assert image('{"image":"u"}') == "u" and image('{"image":{"mega":"m","small":"s"}}') == "s" and image('{"image":""}') is None
    assert image('{"images":{"portrait":{"hash":"h"}}}') == expr.PORTRAITS + "h.jpg"
    window = lambda n, s: tuple(one(spark, expr.byte_window(F.lit(n), F.lit(s).cast("int"))))
    assert window(1000, None) == (0, 1000) == window(1000, 0) and window(18_000, 180) == (4500, 13_800) and window(600, 60) == (0, 600)
    found = one(spark, expr.first_artist((F.lit(None).cast("string"), F.lit(1)), (F.lit(""), F.lit(2)), (F.lit("Z"), F.lit(3))))
    assert tuple(found) == ("Z", 3) and tuple(one(spark, expr.first_artist())) == ("Unknown Artist", None)


def test_places_and_totals(spark):
    rows = spark.range(100).repartition(7).select(F.col("id").alias("i"), (F.col("id") % 5).alias("v"))
    got = relational.running_total(rows, ["i"], "v", "upto").orderBy("i").collect()
    assert [r["upto"] for r in got] == [sum(j % 5 for j in range(i + 1)) for i in range(100)]
    left = relational.places_left(rows, rows.where("i % 2 = 0"), "i", ["i"])
    assert all(r["place"] == r["i"] for r in left.collect()) and left.count() == 50


def test_crawl_rounds_by_many_tasks(spark, tmp_path, monkeypatch):
    """A round's entries aren't written by one task for each priority, and rounds of artists don't read which artists albums are filed under."""
    log = crawl_log.CrawlLog(spark, str(tmp_path))
    many = spark.range(0, 4000, 1, 4).select(F.lit("artist").alias("kind"), F.col("id").cast("string").alias("ref_id"), F.lit(0).cast("long").alias("priority"), F.lit("pending").alias("state"))
    log.commit(many, None, 0)
    assert len(list((tmp_path / "rounds/000000/frontier/priority=0").glob("*.parquet"))) == 4 and log.entries().count() == 4000
    none = spark.createDataFrame([], "artist_id long, album_id long")
    sources = crawl.Sources(none, none.select("artist_id", F.col("artist_id").alias("similar_id")), None, none.select("album_id", F.col("artist_id").alias("track_id")))
    assert crawl_log.step(log, spark.createDataFrame([(5,)], "artist_id long"), sources, 0)
    assert {(r["state"], r["n"]) for r in log.entries().groupBy("state").agg(F.count("*").alias("n")).collect()} == {("done", 3999), ("skipped", 1)}
