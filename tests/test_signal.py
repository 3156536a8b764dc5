"""Descriptors on tones and clicks, spaces assembled from them, and their sinks."""

import math

import numpy as np
import pytest
from orbweave.functions import descriptors as d
from orbweave.operators import analyse, map2d, rotation, walks
from orbweave.plans import assemble
from orbweave.sources import tables

RATE = 48_000
TIME = np.arange(RATE * 10) / RATE


def tone(hz):
    return np.sin(2 * np.pi * hz * TIME)


def clicks(bpm, seconds=20):
    x, noise = np.zeros(RATE * seconds), 0.5 * np.random.default_rng(1).standard_normal(200)
    for at in np.arange(0, seconds - 0.1, 60 / bpm):
        x[int(at * RATE) : int(at * RATE) + 200] = noise
    return x


def test_loudness():
    loud, spread = d.loudness(0.1 * tone(997), RATE)
    assert loud == pytest.approx(-23, abs=0.3) and spread == pytest.approx(0, abs=0.1)
    assert d.loudness(np.zeros(RATE * 5), RATE) == (None, None)


@pytest.mark.parametrize("bpm", [90, 128, 174])
def test_tempo(bpm):
    envelope = d.onset_envelope(d.spectral(clicks(bpm), RATE)[1])
    fold = lambda x: math.log2(x) - math.floor(math.log2(x / 70))
    assert 2 ** fold(d.tempo(envelope, 100)) == pytest.approx(2 ** fold(bpm), abs=2)
    assert d.onset_rate(envelope, 100) == pytest.approx(bpm / 60, rel=0.1)
    assert d.tempo(np.zeros(1000), 100) is None and d.onset_rate(np.zeros(2), 100) == 0


def test_key():
    assert d.key(sum(map(tone, (440, 523.25, 659.25))), RATE)[:2] == ("A", "minor")
    assert d.key(sum(map(tone, (392, 493.88, 587.33))), RATE)[:2] == ("G", "major")
    assert d.key(np.zeros(100), RATE) is None and d.key(np.zeros(20_000), RATE) is None


def test_spectral_against_plain_sums():
    x = np.random.default_rng(3).standard_normal(2048 + 480 * 3)
    want = []
    for t in range(4):
        power = np.abs(np.fft.rfft(x[480 * t : 480 * t + 2048] * d.hann(2048)))[1:] ** 2
        hz = np.arange(1, 1025) * RATE / 2048
        running, at = 0.0, 0
        while running + power[at] < 0.85 * power.sum():
            running, at = running + power[at], at + 1
        want.append([(hz * power).sum() / power.sum(), hz[at], 10 * math.log10(np.exp(np.log(power + 1e-12).mean()) / power.mean())])
    got = d.spectral(x, RATE)[0]
    assert list(got.values()) == pytest.approx(np.mean(want, axis=0).tolist())


def test_resample_and_windows():
    y = d.resample(np.sin(2 * np.pi * 1000 * np.arange(44_100) / 44_100), 44_100, RATE)
    assert len(y) == RATE and np.abs(y - tone(1000)[:RATE])[100:-100].max() < 2e-3
    assert [len(d.windows(np.ones(n))) for n in (2 * 480_000 + 1000, 1_200_000, 1000, 0)] == [2, 3, 1, 0]
    assert d.windows(np.ones(300_000)).sum() == 300_000 and d.windows(np.ones(100_000)).sum() == 400_000
    x = tone(1000)
    levels, at = d.log_mel(x), 500 * 480 - 512
    power = np.abs(np.fft.rfft(x[at : at + 1024] * d.hann(1024))) ** 2
    assert levels.shape == (1001, 64) and np.allclose(levels[500], 10 * np.log10(np.maximum(d.mel_filters().T @ power, 1e-10)))


def test_excerpts():
    assert len(d.excerpt(np.zeros(100 * 100), 100)) == 9000
    for x, seconds in ((np.zeros(1000), None), (np.zeros(9000), 44.0)):
        with pytest.raises(ValueError, match="too short"):
            d.excerpt(x, 100, seconds)


def test_describe(spark):
    rows = [(1, RATE, tone(440)[:20_000].tolist()), (2, RATE, [0.0] * 10), (3, None, [0.0] * 9000), (4, RATE, None), (5, RATE, [0.0] * 9000)]
    got = {r["track_id"]: r for r in analyse.describe(spark.createDataFrame(rows, "track_id long, rate int, samples array<double>")).collect()}
    assert got[1]["reason"] is None and got[1]["spectral_centroid"] == pytest.approx(440, abs=5) and got[1]["key"] == "A"
    assert all(got[i]["reason"] for i in (2, 3, 4)) and got[5]["reason"] is None and got[5]["loudness_integrated"] is None
    levels = analyse.mel_windows(spark.createDataFrame(rows[:1], "track_id long, rate int, samples array<double>"), 1).collect()
    assert [(r["window"], len(r["levels"])) for r in levels] == [(0, 101 * 64)]


def test_invented_corpus(spark):
    """Tracks of one invented album are nearest to each other."""
    rows = {r["track_id"]: r for r in analyse.describe(analyse.synthetic(spark, 4, 2, seconds=8.0)).collect()}
    x = np.array([[math.log2(r["bpm"]), r["spectral_centroid"], r["spectral_flatness"], r["zero_crossing_rate"], r["loudness_integrated"]] for _, r in sorted(rows.items())])
    x = (x - x.mean(0)) / x.std(0)
    far = np.linalg.norm(x[:, None] - x[None], axis=2) + np.eye(8) * 99
    assert (far.argmin(1) // 2 == np.arange(8) // 2).mean() > 0.75


def analysed(spark, n):
    rng = np.random.default_rng(5)
    names = [*assemble.DYNAMICS, *assemble.TIMBRE, "onset_rate"]
    rows = [(i, i % 3, i // 2, "1999-01-01" if i % 2 else None, 100.0 if i % 3 else None, "C", "major", None, rng.standard_normal(6).tolist(), *map(float, rng.standard_normal(len(names)))) for i in range(n)]
    return spark.createDataFrame(rows, "track_id long, artist_id long, album_id long, release_date string, bpm double, key string, scale string, key_strength double, clap array<double>, " + ", ".join(f"{c} double" for c in names))


def test_assemble(spark, tmp_path):
    out = assemble.assemble(analysed(spark, 9), 6, np.eye(6)[:2] - np.eye(6)[2:4], np.eye(6)[:5])
    assert [b[:3] for b in out.blocks] == [("tempo", 0, 2), ("key", 2, 5), ("dynamics", 5, 8), ("timbre", 8, 12), ("mood", 12, 14), ("style", 14, 19), ("era", 19, 20), ("semantic", 20, 26)]
    rows = {r["track_id"]: np.array(r["vec"]) for r in out.rows.collect()}
    for v in rows.values():
        for _, start, end, _ in out.blocks:
            length = np.linalg.norm(v[start:end])
            assert length == pytest.approx(1) or length < 1e-6
    clap = {r["track_id"]: np.array(r["clap"]) for r in analysed(spark, 9).collect()}
    axes = np.array([(clap[i] - out.mean) @ out.axes.T for i in range(9)])
    z = (axes - axes.mean(0)) / axes.std(0)
    assert np.allclose(z / np.linalg.norm(z, axis=1, keepdims=True), [rows[i][20:] for i in range(9)], atol=1e-6)
    folder = str(tmp_path / "space")
    tables.publish(out.rows, folder, out.blocks, out.mean, out.axes)
    mean, axes = tables.load_params(spark, folder)
    assert np.allclose(mean, out.mean) and np.allclose(axes, out.axes) and tables.load(spark, folder).count() == 9
    tables.publish(out.rows.where("track_id < 4"), folder, out.blocks)
    assert tables.load(spark, folder).count() == 4
    with pytest.raises(ValueError, match="no axes"):
        tables.load_params(spark, folder)
    u = assemble.reweighted(out.rows, out.blocks, {"era": 0.0}).head()["u"]
    assert u[19] == 0 and np.linalg.norm(u) == pytest.approx(1)


def test_assemble_of_nothing(spark):
    out = assemble.assemble(analysed(spark, 1).limit(0), 6, np.eye(6)[:2], np.eye(6)[:5])
    assert out.rows.count() == 0 and out.blocks[-1][2] == 15


def test_replace_and_digests(spark, tmp_path):
    folder = str(tmp_path / "layout")
    with pytest.raises(FileNotFoundError):
        tables.current(spark, folder)
    for n in (5, 3):
        tables.replace(spark.range(n), folder)
        assert tables.current(spark, folder).count() == n
    for name, text in (("a", b"1"), ("b", b"2"), ("c", b"3")):
        (tmp_path / name).write_bytes(text)
    local = tables.digests(spark, str(tmp_path / "[abc]"))
    remote = spark.createDataFrame([("a", "c4ca4238a0b923820dcc509a6f75849b"), ("b", "x")], "name string, md5 string")
    assert sorted(r["name"] for r in tables.to_send(local, remote).collect()) == ["b", "c"]


def test_matrix(spark):
    ids = spark.createDataFrame([(0, 7), (1, 8), (2, 9)], "row_idx int, track_id long")
    rows = spark.createDataFrame([(7, [1.0, 2.0]), (8, [1.0])], "track_id long, vec array<double>")
    assert [r["vec"] for r in tables.matrix(ids, rows, 2).orderBy("row_idx").collect()] == [[1, 2], [0, 0], [0, 0]]


def test_map_payload(spark):
    points = spark.createDataFrame([(5, 0.5, 1.0, "b", 0), (6, None, 1.0, "c", 1), (7, 2.0, 3.0, "a", 2)], "track_id long, x double, y double, genre string, place int")
    raw = map2d.payload(points, "genre", "place")
    assert len(raw) == 36 and np.frombuffer(raw[:16], "<f8").tolist() == [5, 7] and np.frombuffer(raw[16:32], "<f4").tolist() == [0.5, 1, 2, 3]
    assert np.frombuffer(raw[32:], "<u2").tolist() == [0, 2]
    assert map2d.meta(points, "genre", "place") == {"n": 2, "min_x": 0.5, "max_x": 2, "min_y": 1, "max_y": 3, "genres": ["b", "c", "a"], "has_layout": True}
    with pytest.raises(ValueError, match="three points"):
        rotation.layout(spark.createDataFrame([(5, 7, 1.0)], "a long, b long, w double"), points.where("x is not null"))


def brute_order(vectors):
    far, n = 1 - vectors @ vectors.T, len(vectors)
    order, rest = [0], list(range(1, n))
    while rest:
        order.append(rest.pop(min(range(len(rest)), key=lambda i: (far[order[-1], rest[i]], i))))
    for _ in range(32):
        better = False
        for i in range(1, n - 1):
            for j in range(i + 1, n):
                more = j + 1 < n
                removed = far[order[i - 1], order[i]] + (far[order[j], order[j + 1]] if more else 0)
                added = far[order[i - 1], order[j]] + (far[order[i], order[j + 1]] if more else 0)
                if added + 1e-6 < removed:
                    order[i : j + 1] = order[i : j + 1][::-1]
                    better = True
        if not better:
            break
    return order


def test_order_queue():
    for seed in range(8):
        v = np.random.default_rng(seed).standard_normal((25, 5))
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        assert walks.order_queue(v, False) == brute_order(v)


def test_sort_after(spark):
    at = lambda a: [math.cos(a), math.sin(a)]
    rows = [(0, 0, 1, at(2.0)), (0, 1, 2, at(0.0)), (0, 2, 3, at(0.9)), (0, 3, 4, None), (0, 4, 5, at(0.3)), (0, 5, 6, at(0.6)), (1, 0, 7, at(0.0)), (1, 1, 8, None), (1, 2, 9, at(1.0))]
    queues = spark.createDataFrame(rows, "queue_id long, place long, track_id long, u array<double>")
    got = walks.sort_after(queues, spark.createDataFrame([(0, 1)], "queue_id long, place long")).orderBy("queue_id", "place").collect()
    assert [r["track_id"] for r in got] == [1, 2, 5, 6, 3, 4, 7, 9, 8]
