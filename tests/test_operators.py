"""Operators on small inputs with known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave import catalogue_queries as catalogue
from orbweave.functions import expr, signal, vectors
from orbweave.operators import knn, map2d, merge, paths, relational, rotation, walks
from orbweave.sources import tables


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head()["x"]


@pytest.fixture(scope="module")
def circle(spark):
    """Ids 10 to 15 at 0, 10, ... 50 degrees."""
    rows = [(10 + i, i, i, 100.0, [math.cos(math.radians(10 * i)), math.sin(math.radians(10 * i))]) for i in range(6)]
    return spark.createDataFrame(rows, "track_id long, artist_id long, album_id long, bpm double, u array<double>")


def test_fold_bpm(spark):
    fold = lambda x: one(spark, expr.fold_bpm(F.lit(x).cast("double")))
    assert fold(172.0) == pytest.approx(fold(86.0)) and fold(60.0) == pytest.approx(fold(120.0)) and fold(140.0) == pytest.approx(math.log2(70))
    assert fold(0.0) is None and fold(None) is None and fold(float("nan")) is None


def test_keys(spark):
    at = lambda k: np.array(one(spark, expr.key_coordinates(F.lit(k).cast("string"), F.lit("major"), F.lit(None).cast("double"))))
    assert np.linalg.norm(at("C") - at("G")) < np.linalg.norm(at("C") - at("F#"))
    assert at(None).tolist() == [0, 0, 0] == at("H").tolist()


def test_labels(spark):
    assert one(spark, expr.duration_label(F.lit(125))) == "2:05" and one(spark, expr.duration_label(F.lit(0))) == ""
    assert one(spark, expr.cover_path(F.lit("3610159663848"))).startswith("48/38/") and one(spark, expr.cover_path(F.lit("a-1"))) is None
    assert one(spark, expr.release_year(F.lit("1999-01-01"))) == 1999 and one(spark, expr.release_year(F.lit("199"))) is None
    assert one(spark, expr.recording(F.lit(" ab1 "), F.lit(4))) == "AB1" and one(spark, expr.recording(F.lit("  "), F.lit(4))) == "id:4"
    assert one(spark, expr.split_credits(F.lit("a; b;;c "))) == ["a", "b", "c"]
    assert one(spark, expr.slim_json(F.lit('{"bpm": 120.0, "x": 1}'), "bpm")) == '{"bpm":120.0}' and one(spark, expr.slim_json(F.lit("{}"), "bpm")) == '{"bpm":null}'


def test_impute_and_normalise(spark):
    rows = spark.createDataFrame([(1, 1.0), (2, None), (3, 5.0), (4, 3.0)], "i int, x double")
    assert [r["x"] for r in vectors.impute(rows, ["x"]).orderBy("i").collect()] == [1, 3, 5, 3]
    none = spark.createDataFrame([(1, None)], "i int, x double")
    assert vectors.impute(none, ["x"]).head()["x"] == 0
    block = spark.createDataFrame([(1.0, 100.0), (2.0, 300.0), (3.0, float("nan"))], "a double, b double")
    for r in vectors.normalise_block(block, ["a", "b"], "v").collect():
        n = math.hypot(*r["v"])
        assert n == pytest.approx(1) or n < 1e-6


def test_pca_of_a_line(spark):
    rows = spark.createDataFrame([([float(i), float(i), 3.0],) for i in range(200)], "v array<double>")
    mean, axes = vectors.fit_pca(rows, "v", 3, 2)
    assert mean[2] == pytest.approx(3) and np.allclose(axes[0], [2**-0.5, 2**-0.5, 0])


def test_neighbours_and_graph(spark, circle):
    assert [r["track_id"] for r in knn.neighbours(circle, 10, 3).orderBy("rank").collect()] == [11, 12, 13]
    assert knn.neighbours(circle, 99, 3).count() == 0
    graph = {(r["src"], r["rank"]): r["dst"] for r in knn.knn_graph(circle, 2).collect()}
    assert graph[10, 1] == 11 and graph[12, 1] == 11 and graph[12, 2] == 13


def test_walks(spark, circle):
    loose = walks.Constraints(cooldown=0, same_album=True)
    assert [r["track_id"] for r in walks.radio(circle, 10, 4, 0.0, loose).orderBy("step").collect()] == [10, 11, 12, 13]
    assert [r["track_id"] for r in walks.radio(circle, 10, 1).collect()] == [10] and walks.radio(circle, 99, 5).count() == 0
    assert [r["track_id"] for r in walks.interpolate(circle, 10, 15, 4, loose).orderBy("step").collect()] == [10, 12, 13, 15]
    assert [r["track_id"] for r in walks.drift(circle, 10, [math.cos(math.radians(50)), math.sin(math.radians(50))], 3, loose).orderBy("step").collect()] == [10, 12, 15]


def test_graph_path(spark, circle):
    path = paths.graph_path(knn.knn_graph(circle, 2), circle, 10, 15)
    assert [r["track_id"] for r in path.orderBy("step").collect()][0] == 10 and path.orderBy(F.desc("step")).head()["track_id"] == 15
    assert paths.graph_path(knn.knn_graph(circle, 2), circle, 10, 99).count() == 0
    assert [r["track_id"] for r in paths.graph_path(knn.knn_graph(circle, 2), circle, 10, 10).collect()] == [10]


def test_queue_order(spark, circle):
    def ordered(ids, anchor=None):
        rows = [(1, i, t, t == anchor) for i, t in enumerate(([anchor] if anchor else []) + ids)]
        queue = spark.createDataFrame(rows, "queue_id long, place long, track_id long, anchor boolean").join(circle.select("track_id", "u"), "track_id", "left")
        return [r["track_id"] for r in walks.queue_order(queue).orderBy("place").collect()]

    assert ordered([13, 11, 15, 12, 14], anchor=10) == [11, 12, 13, 14, 15]
    free = ordered([13, 11, 15, 12, 14])
    assert free[0] == 13 and sorted(free) == [11, 12, 13, 14, 15]
    assert ordered([11, 999, 12, 998, 14], anchor=10) == [11, 12, 14]
    twice = ordered([14, 11, 14, 12], anchor=10)
    assert abs(twice.index(14) - (len(twice) - 1 - twice[::-1].index(14))) == 1
    assert ordered([15, 11]) == [15, 11]


def test_upserts(spark):
    old = spark.createDataFrame([(1, "One", "X", 2)], "id long, title string, genre string, seed long")
    new = spark.createDataFrame([(1, "Uno", None, 1, 0), (1, "Eins", None, 3, 1), (2, "Two", None, 5, 2)], "id long, title string, genre string, seed long, seq long")
    got = {r["id"]: r for r in merge.upsert(old, new, ["id"], "seq", overwrite=["title"], coalesce=["genre"], least=["seed"]).collect()}
    assert (got[1]["title"], got[1]["genre"], got[1]["seed"]) == ("Eins", "X", 1) and got[2]["genre"] is None


def test_blocked_keeps_null(spark):
    rows = spark.createDataFrame([(1, 7), (2, None), (3, 8)], "id int, artist_id int")
    blocked = spark.createDataFrame([(7,), (None,)], "artist_id int")
    assert sorted(r["id"] for r in relational.not_blocked(rows, blocked, "artist_id").collect()) == [2, 3]


def test_resolve(spark):
    artists = spark.createDataFrame([(7, "Seven"), (8, "Eight")], "id long, name string")
    tracks = spark.createDataFrame([(7,)], "artist_id long")
    found = lambda q: [(r["id"], r["tracks"]) for r in relational.resolve(artists, tracks, q).collect()]
    assert found("sev") == [(7, 1)] == found("7") and found("nobody") == []


def test_curve_and_union(spark):
    a, b = map2d.fit_curve()
    assert a == pytest.approx(1.577, abs=0.02) and b == pytest.approx(0.895, abs=0.01)
    w = spark.createDataFrame([(1, 2, 0.5), (2, 1, 0.5), (3, 1, 0.25)], "src long, dst long, w double")
    assert {(r["a"], r["b"]): r["w"] for r in map2d.fuzzy_union(w).collect()} == {(1, 2): 0.75, (1, 3): 0.25}


def test_layout_keeps_clusters_apart(spark):
    rng = np.random.default_rng(1)
    rows = []
    for c in range(3):
        for i in range(20):
            v = np.eye(6)[2 * c] * 5 + rng.normal(size=6) * 0.3
            rows.append((20 * c + i, (v / np.linalg.norm(v)).tolist()))
    space = spark.createDataFrame(rows, "track_id long, u array<double>")
    start = space.select("track_id", F.col("u")[0].alias("x"), F.col("u")[2].alias("y"))
    edges = map2d.fuzzy_union(map2d.fuzzy_weights(knn.knn_graph(space, 5), 5))
    at = {r["track_id"]: (r["x"], r["y"]) for r in rotation.layout(edges, start, epochs=60, sweeps=4).collect()}
    groups = [np.array([at[20 * c + i] for i in range(20)]) for c in range(3)]
    spread = max(np.linalg.norm(g - g.mean(0), axis=1).mean() for g in groups)
    gaps = [np.linalg.norm(groups[i].mean(0) - groups[j].mean(0)) for i, j in ((0, 1), (0, 2), (1, 2))]
    assert min(gaps) > 2 * spread


def test_layout_repels_at_every_size(spark):
    """All points of a million move, in as many jobs as the blocks have rounds."""
    n = 1_000_000
    start = spark.range(n).select(F.col("id").alias("track_id"), (F.col("id") % 100 / 100).alias("x"), (F.col("id") % 97 / 97).alias("y"))
    ring = spark.range(n).select(F.col("id").alias("a"), ((F.col("id") + 1) % n).alias("b"), F.lit(1.0).alias("w"))
    moved = rotation.layout(ring, start, epochs=2, blocks=4, sweeps=1).join(start.withColumnsRenamed({"x": "sx", "y": "sy"}), "track_id")
    assert moved.where("x <> sx or y <> sy").count() > 0.99 * n and moved.where("isnan(x) or isnan(y) or abs(x) > 100").count() == 0


def test_layout_start_and_epochs(spark):
    points = spark.createDataFrame([(1, 0.0, 5.0), (2, 1.0, 5.0), (3, 1.0, 5.0), (4, 0.5, 7.0)], "track_id long, x double, y double")
    at = {r["track_id"]: (r["x"], r["y"]) for r in map2d.spread_start(points).collect()}
    want = {1: (-10, -10), 2: (10, -10), 3: (10, -10), 4: (0, 10)}
    assert all(at[i] == pytest.approx(want[i], abs=1e-4) for i in want) and len(set(at.values())) == 4
    assert [rotation.epochs_for(n) for n in (3, 10_000, 10_001, 1_000_001)] == [500, 500, 200, 200]
    ends = {r["track_id"]: (r["x"], r["y"]) for r in rotation.layout(spark.createDataFrame([(1, 2, 1.0), (1, 4, 0.1)], "a long, b long, w double"), map2d.spread_start(points), epochs=5).collect()}
    assert ends[2] != ends[3] and ends[1] != at[1] and ends[3] == at[3] and ends[4] == at[4]  # the weak edge is under a fifth
    with pytest.raises(ValueError):
        rotation.layout(spark.createDataFrame([], "a long, b long, w double"), points.limit(2))


def test_mixed_list_is_whole(spark, tmp_path):
    sizes = {"customer": ("c_custkey", "c_name", 130), "part": ("p_partkey", "p_name", 90), "supplier": ("s_suppkey", "s_name", 70)}
    for name, (key, label, n) in sizes.items():
        spark.range(n, 0, -1, 3).select(F.col("id").alias(key), F.concat(F.lit(name), "id").alias(label)).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = sorted(tuple(r[c] for c in ("place", "kind", "id", "label")) for r in catalogue.QUERIES["mixed_list"](spark, str(tmp_path)).collect())
    want = [(kind, i, f"{name}{i}") for kind, (name, (_, _, n)) in enumerate(sizes.items()) for i in range(1, n + 1)]
    assert got == [(place, *row) for place, row in enumerate(want, 1)]


def test_numbered_over_many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = relational.numbered(spark.range(1000).select((F.col("id") * 7 % 1000).alias("id")), [F.desc("id")], "n")
        assert got.rdd.getNumPartitions() > 1
        assert sorted((r["n"], r["id"]) for r in got.collect()) == [(n, 1000 - n) for n in range(1, 1001)]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert relational.numbered(spark.range(0), ["id"], "n").count() == 0


def test_publish_and_load(spark, tmp_path):
    rows = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0])], "track_id long, vec array<double>")
    tables.publish(rows, str(tmp_path), [("a", 0, 1, 1.0), ("b", 1, 2, 0.5)])
    assert tables.load(spark, str(tmp_path)).count() == 2
    tables.publish(rows, str(tmp_path), [("a", 0, 1, 1.0), ("b", 1, 3, 0.5)])
    with pytest.raises(ValueError):
        tables.load(spark, str(tmp_path))


def test_in_order(spark):
    ids = spark.createDataFrame([(0, 99), (1, 2)], "row_idx long, track_id long")
    rows = spark.createDataFrame([(2, "Two", 8)], "track_id long, title string, artist_id long")
    got = tables.in_order(ids, rows, {"artist_id": 0}).orderBy("row_idx").collect()
    assert [(r["title"], r["artist_id"]) for r in got] == [("<missing 99>", 0), ("Two", 8)]


def test_onset_rate(spark):
    values = [0.0] * 40
    for place, v in ((5, 3.0), (9, 3.0), (10, 3.0), (20, 2.0), (21, 3.0)):  # 9 is too soon after 5, 20 isn't a peak
        values[place] = v
    rows = [("a", t, v) for t, v in enumerate(values)] + [("b", t, 1.0) for t in range(5)] + [("c", 0, 9.0), ("d", 0, None)]
    got = signal.onset_rate(spark.createDataFrame(rows, "key string, t int, v double"), "key", ["t"], "v").collect()
    assert {r["key"]: round(r["onset_rate"], 9) for r in got} == {"a": 7.5, "b": 0.0, "c": 0.0, "d": 0.0}


def test_slim_catalogue(spark, tmp_path):
    features = spark.createDataFrame(
        [(1, "v", '{"bpm": 120.0, "key": "C"}', bytearray(b"x"), "now"), (2, "v", None, None, "now"), (3, "v", "{}", None, "now"), (4, "v", "odd", None, "now")],
        "track_id long, extractor_version string, descriptors_json string, clap_f32 binary, analysed_at string",
    )
    artists = spark.createDataFrame([(7, "Seven", "{}")], "id long, name string, payload string")
    tables.publish_catalogue({"artists": artists, "features": features}, str(tmp_path))
    version = tables.newest(spark, str(tmp_path))
    home = f"{tmp_path}/versions/{version}"
    got = spark.read.parquet(f"{home}/features")
    assert {r["track_id"]: r["descriptors_json"] for r in got.collect()} == {1: '{"bpm":120.0}', 2: None, 3: '{"bpm":null}', 4: '{"bpm":null}'}
    assert spark.read.parquet(f"{home}/artists").columns == ["id", "name"]
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/manifests/{version}").collect()} == {("artists", 1), ("features", 4)}


def test_memberships():
    rng = np.random.default_rng(4)
    d = np.sort(rng.random((40, 6)), axis=1)
    d[3, :4], d[5, 4:], d[7] = 0.0, np.nan, 0.0
    got = map2d.memberships(d, 6)
    for row, w in zip(d, got, strict=True):
        x = row[~np.isnan(row)]
        positive = x[x > 0]
        gaps = x - (positive.min() if len(positive) else 0)
        low, high, sigma, goal = 0.0, math.inf, 1.0, math.log2(7) - 1
        for _ in range(64):
            over = sum(math.exp(-g / sigma) if g > 0 else 1.0 for g in gaps) - 1 - goal
            if abs(over) < 1e-5:
                break
            low, high = (low, sigma) if over > 0 else (sigma, high)
            sigma = sigma * 2 if high == math.inf else (low + high) / 2
        sigma = max(sigma, 1e-3 * x.mean(), 1e-12)
        assert w[: len(x)].tolist() == pytest.approx([math.exp(-g / sigma) if g > 0 else 1.0 for g in gaps]) and not w[len(x) :].any()
