"""Exact neighbours by cells, what is kept of a space, paths over it and the layout's rotation, against plain numpy."""

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave.functions import vectors
from orbweave.operators import cells, knn, many_walks, paths, rotation, walks
from orbweave.plans import derived


def frame(spark, v, albums=3):
    return spark.createDataFrame([(i, x.tolist(), i // albums if i % 7 else None) for i, x in enumerate(v)], "track_id long, u array<double>, album_id long").repartition(4)


def clustered(seed, groups=20, each=40, width=12):
    rng = np.random.default_rng(seed)
    v = np.concatenate([c + 0.05 * rng.normal(size=(each, width)) for c in rng.normal(size=(groups, width))])
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def even(seed, n=250, width=12):
    v = np.random.default_rng(seed).normal(size=(n, width))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def odd():
    """Rows that are nothing, shorter than 1 or alike."""
    v = clustered(3, 6, 30)
    v[5], v[6], v[77], v[40:80] = 0, 0, v[77] * 0.3, v[40]
    return v


def ordered(v, cosine=True):
    s = np.round(v @ v.T, 9) if cosine else -((v[:, None] - v[None]) ** 2).sum(2)
    return [[j for j in np.argsort(-s[i], kind="stable") if j != i] for i in range(len(v))], s


@pytest.mark.parametrize(("v", "k", "cell"), [(clustered(1), 6, 40), (even(2), 30, 40), (odd(), 5, 20), (even(4, 6), 10, 2048), (even(5, 9), 3, 2)])
def test_nearest_and_ranks(spark, v, k, cell):
    rows = frame(spark, v)
    want, s = ordered(v)
    report = {}
    got = knn.knn_graph(rows, k, None, cell, report).orderBy("src", "rank").collect()
    found = {}
    for r in got:
        found.setdefault(r["src"], []).append(r["dst"])
        assert r["dist"] == pytest.approx(1 - s[r["src"], r["dst"]], abs=1e-8)
    assert [found[i] for i in range(len(v))] == [w[:k] for w in want]
    ranks = {}
    for i in range(len(v)):
        hits = [n for n, j in enumerate(want[i], 1) if i % 7 and j % 7 and i // 3 == j // 3]
        if hits:
            ranks[i] = hits[0]
    assert dict(map(tuple, knn.evaluate(rows, cell).collect())) == ranks
    if k == 6:
        assert report["met"] < 0.2 * report["pairs"]


def test_nearest_places(spark):
    v = np.random.default_rng(6).random((500, 2)) * 50
    report = {}
    rows = frame(spark, v)
    got = cells.nearest(rows, rows.where("track_id % 2 = 0"), 4, "u", False, 25, report).orderBy("src", "rank").collect()
    want = [[j for j in w if j % 2 == 0][:4] for w in ordered(v, False)[0]]
    assert [[r["dst"] for r in got[4 * i : 4 * i + 4]] for i in range(500)] == want and report["met"] < 0.5 * report["pairs"]
    assert cells.nearest(rows.limit(0), rows, 4, "u", False, 25).count() == 0 == cells.nearest(rows, rows.limit(0), 4, "u", False, 25).count()


def test_large_albums_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(knn, "ALBUM_ROWS", 4)
    monkeypatch.setattr(cells, "QUERY_ROWS", 7)
    v = even(8, 60)
    best = {r["track_id"]: (r["s"], r["o"]) for r in knn.album_best(frame(spark, v, albums=30)).collect()}
    s = np.round(v @ v.T, 9)
    for i in range(60):
        others = [(-s[i, j], j) for j in range(60) if j != i and i % 7 and j % 7 and i // 30 == j // 30]
        assert best.get(i) == ((-min(others)[0], min(others)[1]) if others else None)


def test_rank_summary(spark):
    ranked = spark.createDataFrame([(i, r) for i, r in enumerate([1, 1, 3, 4, 4, 9])], "track_id long, rank long")
    assert tuple(knn.rank_summary(ranked).head()) == (6, round(2 / 6, 9), 4, round(22 / 6, 6))


def dijkstra(edges, start, goal):
    out, done, heap = {}, {}, [(0.0, start)]
    for a, b, c in edges:
        out.setdefault(a, []).append((b, c))
    while heap:
        cost, node = heapq.heappop(heap)
        if node not in done:
            done[node] = cost
            for other, c in out.get(node, []):
                heapq.heappush(heap, (cost + c, other))
    return done.get(goal)


@pytest.mark.parametrize("seed", range(2))
def test_paths(spark, seed):
    rng = np.random.default_rng(seed)
    n, edges = 80, {}
    for a in range(n):
        for b in rng.choice([(a + d) % n for d in range(1, 9)], 3, replace=False):
            edges[a, int(b)] = round(float(rng.random()), 6)
    edges.update({(90, 91): 1.0})
    rows = [(a, b, c) for (a, b), c in edges.items()]
    artists = spark.createDataFrame([(i, i % 5) for i in range(92)], "track_id long, artist_id long")
    priced = [(a, b, c + (0.05 if a % 5 == b % 5 else 0)) for a, b, c in rows]
    every = paths.by_node(paths.steps(spark.createDataFrame(rows, "src long, dst long, dist double"), artists)).cache()
    bounds = paths.landmarks(every, 3).cache()
    for r in bounds.collect():
        assert len(r["away"]) == len(r["home"]) == 3
    offers = []
    for start, goal in ((0, 40), (3, 2), (5, 5), (0, 91), (90, 91), (91, 90), (0, 99)):
        want = dijkstra(priced, start, goal) if {start, goal} <= {x for e in edges for x in e} else None
        for marks in (None, bounds):
            report = {}
            got = paths.shortest(every, start, goal, marks, report).orderBy("step").collect()
            if want is None:
                assert got == []
                continue
            assert got[0]["track_id"] == start and got[-1]["track_id"] == goal and got[-1]["cost"] == pytest.approx(want, abs=1e-9)
            for x, y in zip(got, got[1:], strict=False):
                assert y["cost"] - x["cost"] == pytest.approx(edges[x["track_id"], y["track_id"]] + (0.05 if x["track_id"] % 5 == y["track_id"] % 5 else 0), abs=1e-8)
            if (start, goal) == (0, 40):
                offers.append(report["offered"])
    assert offers[1] <= offers[0] < 2 * len(rows)


def test_kept_tables(spark, tmp_path):
    """One build for two calls, and again after each change that asks for one."""
    rng = np.random.default_rng(9)
    rows = spark.createDataFrame([(i, i % 6, i // 4, 100.0, x.tolist()) for i, x in enumerate(rng.normal(size=(60, 8)))], "track_id long, artist_id long, album_id long, bpm double, vec array<double>")
    blocks = [(name, i, i + 1, weight) for i, (name, weight) in enumerate(zip(vectors.BLOCKS, vectors.WEIGHTS, strict=True))]
    nav = derived.Navigator(rows, blocks, "v1", str(tmp_path), k=4)
    graph = lambda: sorted((r["src"], r["dst"]) for r in nav.graph().collect())
    first = graph()
    assert graph() == first and nav.path(0, 33).count() == nav.path(0, 33, landmarks=2).count()
    assert nav.made == {"rows": 1, "graph": 1, "steps": 1, "landmarks": 1}
    nav.set_blocked(spark.createDataFrame([(2,), (2,), (None,)], "artist_id long"))
    blocked = graph()
    assert blocked != first and not any(b % 6 == 2 for _, b in blocked) and any(a % 6 == 2 for a, _ in blocked)
    assert nav.made["rows"] == 1 and nav.made["graph"] == 2
    nav.set_weights({"semantic": 9.0})
    assert graph() != blocked and (nav.made["rows"], nav.made["graph"]) == (2, 3)
    nav.set_weights(None)
    nav.set_blocked(None)
    assert graph() == first and (nav.made["rows"], nav.made["graph"]) == (2, 3)
    other = derived.Navigator(rows, blocks, "v1", str(tmp_path), k=4)
    assert sorted((r["src"], r["dst"]) for r in other.graph().collect()) == first and not +other.made
    assert derived.Navigator(rows, blocks, "v2", str(tmp_path), k=4).rows_key != nav.rows_key
    nav.forget()
    assert len([p for p in tmp_path.iterdir()]) == 3 and graph() == first


def test_digests_of_sets(spark):
    ids = lambda *x: derived.set_digest(spark.createDataFrame([(i,) for i in x], "artist_id long"), "artist_id")
    assert ids(1, 2, 3) == ids(3, 1, 2, 2, None) != ids(1, 2) and ids(1, 2) != ids(12)


@pytest.mark.parametrize("blocks", [2, 4, 10])
def test_tournament(spark, blocks):
    """Each round pairs all blocks, and two blocks meet in one round."""
    last = blocks - 1
    pairs = spark.range(blocks).select(F.col("id").cast("int").alias("a")).crossJoin(spark.range(last).select(F.col("id").cast("int").alias("r")))
    got = [(r["a"], r["r"], r["b"]) for r in pairs.withColumn("b", rotation.partner(F.col("a"), F.col("r"), blocks)).collect()]
    met = {(a, r): b for a, r, b in got}
    assert all(a != b and met[b, r] == a for a, r, b in got)
    when = pairs.withColumn("b", rotation.partner(F.col("a"), F.col("r"), blocks)).withColumn("m", rotation.meeting(F.col("a"), F.col("b"), blocks))
    assert when.where("m <> r").count() == 0 and len({(a, b) for a, _, b in got}) == blocks * last


def test_descent_pulls_and_pushes():
    rng = np.random.default_rng(0)
    at = np.array([[0.0, 0.0], [8.0, 0.0], [0.0, 0.1], [5.0, 5.0]])
    before = at.copy()
    rotation.descend(at, np.array([0]), np.array([1]), np.array([1.0]), 0, 40, 40, (1.577, 0.895), 0, 1.0, rng)
    assert np.linalg.norm(at[0] - at[1]) < 2 and (at[2:] == before[2:]).all()
    twice = [before.copy() for _ in range(2)]
    for x in twice:
        rotation.descend(x, np.array([0, 1]), np.array([1, 2]), np.array([1.0, 0.3]), 0, 30, 30, (1.577, 0.895), 5, 1.0, np.random.default_rng(5))
    assert (twice[0] == twice[1]).all()


@pytest.mark.parametrize(("k", "penalty", "rules"), [(30, 0.1, {}), (3, 0.3, {"exclude": [4, 5], "cooldown": 2}), (5, 0.0, {"cooldown": 0, "same_album": True, "max_bpm_step": 6.0})])
def test_radios(spark, k, penalty, rules):
    """All at once as one by one, whether the graph has enough neighbours or not."""
    v = clustered(11, 6, 10, 6)
    rows = spark.createDataFrame([(i, None if i == 7 else i % 9 - 1, i // 4, None if i == 3 else float(i % 20), x.tolist()) for i, x in enumerate(v)], "track_id long, artist_id long, album_id long, bpm double, u array<double>").repartition(3).cache()
    own, report = walks.Constraints(**rules), {}
    near = many_walks.candidates(knn.knn_graph(rows, k), rows, k)
    got = {}
    for r in many_walks.radios(rows.where("track_id % 13 = 0").unionByName(rows.where("track_id = 7")), near, rows, 6, penalty, own, report).orderBy("start", "step").collect():
        got.setdefault(r["start"], []).append((r["step"], r["track_id"], r["similarity"]))
    assert set(got) == {7, *range(0, 60, 13)} and (report["scanned"] > 0) == (k < 30)
    for start, walk in got.items():
        assert walk == [tuple(r) for r in walks.radio(rows, start, 6, penalty, own).orderBy("step").collect()]


def test_what_is_sent_grows_as_the_rows(spark, monkeypatch):
    """A query goes to a tile once, however many cells there are, and there are no more tiles and blocks for more rows."""
    sent, meet = [], cells.meet

    def counted(asked, targets, of, score, schema):
        rows = asked.withColumn("tile", F.explode("tiles"))
        sent.append(rows.count() + targets.count() * rows.select("tile").distinct().count() / cells.SIDE)
        assert int((of.tile + of.parts).max()) <= cells.SIDE + 2
        return meet(asked, targets, of, score, schema)

    monkeypatch.setattr(cells, "meet", counted)
    for n in (400, 1600):
        rows = frame(spark, even(21, n))
        assert knn.knn_graph(rows, 3, None, 20).count() == 3 * n
        assert knn.evaluate(rows, 20).count() > 0
        assert sum(sent) <= 4 * (cells.SIDE + 3) * n
        sent.clear()


def test_cells_larger_than_a_tile(spark, monkeypatch):
    """Copies make a cell that takes several tiles, and of copies the least ids are nearest."""
    monkeypatch.setattr(cells, "MOST_ROWS", 25)
    v = np.concatenate([np.repeat(even(22, 1), 70, axis=0), even(23, 50)])
    want, _ = ordered(v)
    found = {}
    for r in knn.knn_graph(frame(spark, v), 4, None, 10).orderBy("src", "rank").collect():
        found.setdefault(r["src"], []).append(r["dst"])
    assert [found[i] for i in range(len(v))] == [w[:4] for w in want]
    s = np.round(v @ v.T, 9)
    for track, n in knn.evaluate(frame(spark, v), 10).collect():
        assert n == min(want[track].index(j) + 1 for j in range(len(v)) if j != track and j % 7 and j // 3 == track // 3) and s[track, track]


def test_radios_in_parts(spark, monkeypatch):
    """Rows and walks are dealt to as many parts however many there are; in parts it is the same walks."""
    assert many_walks.dealt(720_000, 36_000) == many_walks.dealt(120_000, 6_000) == (8, 8) and many_walks.dealt(60, 5) == (1, 1)
    monkeypatch.setattr(many_walks, "PART_ROWS", 7)
    monkeypatch.setattr(many_walks, "PART_WALKS", 2)
    test_radios(spark, 3, 0.3, {"exclude": [4, 5], "cooldown": 2})
