"""Exact medians and the map's index against plain Python, and what scans of the index read."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from orbweave.functions import selection
from orbweave.operators import map_index, search
from orbweave.plans import derived


@pytest.mark.parametrize("few", [2048, 2])
def test_medians(spark, monkeypatch, few):
    monkeypatch.setattr(selection, "FEW", few)
    monkeypatch.setattr(selection, "BINS", 16 if few == 2 else 4096)
    rng = random.Random(few)
    columns = {
        "even": [float(i) for i in range(400)], "odd": [rng.gauss(0, 1e-9) for _ in range(399)] + [None], "same": [7.5] * 400, "two": [1.0, 2.0] * 200,
        "wide": [rng.choice((-1, 1)) * 10 ** rng.uniform(-300, 308) for _ in range(400)], "near": [1.0 + i * 2**-52 for i in range(400)], "none": [None] * 400,
        "infinite": [math.inf, -math.inf, math.nan, None] * 99 + [3.0, 1.0, 2.0, 9.0], "tiny": [5e-324 * (i % 3) for i in range(400)], "huge": [1.7e308, -1.7e308] * 200,
        "zeros": [0.0, -0.0] * 200, "one": [None] * 399 + [4.0],
    }
    rows = spark.createDataFrame(list(zip(*columns.values(), strict=True)), ", ".join(f"{c} double" for c in columns)).repartition(3).cache()
    got = selection.medians(rows, list(columns))
    for c, values in columns.items():
        own = [v for v in values if v is not None and math.isfinite(v)]
        want = (statistics.median(own) if c != "huge" else 0.0) if own else None
        assert got[c] == want, c
    assert selection.medians(rows.limit(0), ["even"]) == {"even": None} and selection.medians(rows, []) == {}


def points_of(spark, rows):
    return spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(rows)], "track_id long, x double, y double").repartition(4)


def invented(n):
    rng = random.Random(n)
    spots = [(rng.uniform(-3, 3), rng.uniform(-3, 3)) for _ in range(9)]
    rows = [(rng.gauss(x, 0.3), rng.gauss(y, 0.3)) for x, y in (rng.choice(spots) for _ in range(n))]
    return [*rows, *[(0.5, 0.5)] * (n // 3), (None, 1.0), (1.0, None)]


def test_ranges_hold_the_rectangle():
    grid = map_index.Grid(0.0, 0.0, 64.0, 64.0, 6)
    rng = random.Random(2)

    def z(x, y):
        return sum(((x >> b & 1) << 2 * b) | ((y >> b & 1) << 2 * b + 1) for b in range(6))

    for most in (4, 32, 4096):
        for _ in range(20):
            x0, x1, y0, y1 = *sorted((rng.uniform(-5, 70), rng.uniform(-5, 70))), *sorted((rng.uniform(-5, 70), rng.uniform(-5, 70)))
            ranges = grid.ranges(x0, y0, x1, y1, most)
            assert len(ranges) <= most and all(a <= b for a, b in ranges) and all(b < c for (_, b), (c, _) in zip(ranges, ranges[1:], strict=False))
            held = {n for a, b in ranges for n in range(a, b + 1)}
            need = {z(x, y) for x in range(max(0, int(x0)), min(63, int(x1)) + 1) for y in range(max(0, int(y0)), min(63, int(y1)) + 1) if x1 >= 0 and y1 >= 0}
            assert need <= held
            if most == 4096 and need:
                assert len(held) <= len(need) + 4 * (max(0, int(x1 - x0)) + max(0, int(y1 - y0)) + 8)
    assert grid.ranges(70, 0, 80, 5) == [] == grid.ranges(5, 5, 4, 6)


@pytest.mark.parametrize("n", [3000, 40, 1])
def test_map_index(spark, tmp_path, n):
    rows = invented(n)
    index, grid = derived.map_of(points_of(spark, rows), str(tmp_path), "v")
    placed = [(i, x, y) for i, (x, y) in enumerate(rows) if x is not None and y is not None]
    assert index.count() == len(placed)
    rng = random.Random(5)
    for _ in range(6):
        x0, x1, y0, y1 = *sorted((rng.uniform(-4, 4), rng.uniform(-4, 4))), *sorted((rng.uniform(-4, 4), rng.uniform(-4, 4)))
        got = sorted(r["track_id"] for r in map_index.rectangle(index, grid, x0, y0, x1, y1).collect())
        assert got == [i for i, x, y in placed if x0 <= x <= x1 and y0 <= y <= y1]
        x, y, radius = rng.uniform(-4, 4), rng.uniform(-4, 4), rng.choice((0.01, 0.4, 3.0, 50.0))
        near = sorted(((px - x) ** 2 + (py - y) ** 2, i) for i, px, py in placed)
        want = [(near[0][1], round(math.sqrt(near[0][0]), 9))] if near and near[0][0] < radius * radius else []
        assert [tuple(r) for r in map_index.nearest(index, grid, x, y, radius).collect()] == want
    x, y = placed[0][1:]
    assert map_index.nearest(index, grid, x, y, 0.0).count() == 0


def test_map_index_reads_little(spark, tmp_path):
    """A small rectangle is pushed to the scan as ranges, and takes files of few folders; the index is made once."""
    rng = random.Random(8)
    points = points_of(spark, [(rng.random(), rng.random()) for _ in range(8000)])
    index, grid = derived.map_of(points, str(tmp_path), "v")
    again, _ = derived.map_of(points.where("1 / (track_id - track_id) > 0"), str(tmp_path), "v")
    part = map_index.rectangle(again, grid, 0.2, 0.2, 0.25, 0.25)
    plan = part._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(z," in plan and "LessThanOrEqual(z," in plan and "PartitionFilters: [tile" in plan.replace("isnotnull(tile#", "tile#")
    files = lambda df: df.select(F.input_file_name().alias("f")).distinct().count()
    assert part.count() == points.where("x between 0.2 and 0.25 and y between 0.2 and 0.25").count()
    assert 0 < files(part) < files(index) / 4


def test_search(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    words = ["Blue", "bluebird", "ÄRGER", "a", "of", "the", "Night", "nightly", "x-ray", "日本", None]
    some = lambda: None if rng.random() < 0.1 else " ".join(w for w in (rng.choice(words) for _ in range(rng.randint(0, 4))) if w)
    rows = [(i, some(), some()) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, title string, artist string").repartition(3)
    index = derived.search_index(df, "id", ["title", "artist"], str(tmp_path), "v")
    for query in ("", "blue", "BLUE night", "a", "of th", "ärg", "rd", "bluebirds", "zz", "bluenight", "-r 日", "nightl blueb", "night night"):
        terms = query.lower().split()
        fields = [[(f or "").lower() for f in r[1:]] for r in rows]
        want = sorted((r[0], 0 if terms and any(f.startswith(terms[0]) for f in own) else 1) for r, own in zip(rows, fields, strict=True) if all(any(t in f for f in own) for t in terms))
        for few in (1000, 3):
            monkeypatch.setattr(search, "LOOKED_UP", few)
            assert sorted((r["id"], r["rank"]) for r in index.search(query).collect()) == want, query
    plan = index.candidates("bluebird night")._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "gram" in plan.split("PushedFilters: [")[1].split("]")[0]
    assert search.needed("ab abcd AB") == [["ab"], ["abc", "bcd"]] and derived.search_index(df.limit(0), "id", ["title"], str(tmp_path), "w").search("a").count() == 0
