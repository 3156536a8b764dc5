"""Walks through a space. Each step is one distributed scan with a top-1: what a
step excludes (the walk so far, at most `steps` rows) is a filter on the scan."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orbweave.operators.knn import scored

_WALK = "step int, track_id long, similarity double"


@dataclass
class Constraints:
    """What a next step must not be: `exclude` ids, an artist of the last
    `cooldown` steps, the previous step's album (unless `same_album`), or a tempo
    further than `max_bpm_step` where both are known."""

    exclude: list[int] = field(default_factory=list)
    cooldown: int = 3
    same_album: bool = False
    max_bpm_step: float | None = None

    def allowed(self, walk: list[Row]) -> Column:
        out = ~F.col("track_id").isin([r["track_id"] for r in walk] + list(self.exclude))
        recent = [r["artist_id"] for r in walk[-self.cooldown :] if r["artist_id"] not in (None, -1)] if self.cooldown else []
        if recent:
            out &= F.col("artist_id").isNull() | ~F.col("artist_id").isin(recent)
        last = walk[-1] if walk else None
        if last is not None and not self.same_album and last["album_id"] not in (None, ""):
            out &= F.col("album_id").isNull() | (F.col("album_id") != last["album_id"])
        if last is not None and self.max_bpm_step is not None and last["bpm"] is not None:
            out &= F.col("bpm").isNull() | (F.abs(F.col("bpm") - last["bpm"]) <= self.max_bpm_step)
        return out


def _row(space: DataFrame, track: int) -> Row | None:
    return space.where(F.col("track_id") == track).head()


def _best(space: DataFrame, score: Column, allowed: Column) -> Row | None:
    return space.where(allowed).withColumn("score", score).orderBy(F.desc("score"), "track_id").head()


def _walk(space: DataFrame, rows: list[tuple[int, float | None]]) -> DataFrame:
    return space.sparkSession.createDataFrame([(i, t, s) for i, (t, s) in enumerate(rows)], _WALK)


def radio(space: DataFrame, start: int, steps: int, penalty: float = 0.1, rules: Constraints | None = None) -> DataFrame:
    """Nearest to the last step, less `penalty` for each time its artist occurred; reported scores are after that."""
    rules, first = rules or Constraints(), _row(space, start)
    walk, rows = ([first], [(start, None)]) if first else ([], [])
    while first and len(walk) < steps:
        score = scored(space, walk[-1]["u"])
        counts: dict[int, int] = {}
        for r in walk:
            if r["artist_id"] not in (None, -1):
                counts[r["artist_id"]] = counts.get(r["artist_id"], 0) + 1
        less = F.lit(0.0)
        for artist, n in counts.items():
            less = F.when(F.col("artist_id") == artist, penalty * n).otherwise(less)
        found = _best(space, F.round(score - less, 9), rules.allowed(walk))
        if found is None:
            break
        walk.append(found)
        rows.append((found["track_id"], found["score"]))
    return _walk(space, rows)


def _through(space: DataFrame, walk: list[Row], targets: list[list[float]], rules: Constraints, also: list[int]) -> list[Row]:
    for target in targets:
        found = _best(space, scored(space, target), rules.allowed(walk) & ~F.col("track_id").isin(also or [-1]))
        if found is None:
            break
        walk.append(found)
    return walk


def interpolate(space: DataFrame, a: int, b: int, steps: int, rules: Constraints | None = None) -> DataFrame:
    """From a to b by the allowed rows nearest to points between; b always ends it. No scores."""
    rules, first, last = rules or Constraints(), _row(space, a), _row(space, b)
    if first is None or last is None:
        return _walk(space, [])
    x, y = np.array(first["u"]), np.array(last["u"])
    targets = [((1 - i / (steps - 1)) * x + i / (steps - 1) * y).tolist() for i in range(1, steps - 1)]
    walk = _through(space, [first], targets, rules, [b])
    return _walk(space, [(r["track_id"], None) for r in [*walk, last]])


def anchors(rows: DataFrame, query: list[float], k: int, vector: str) -> DataFrame:
    """The k rows of greatest plain dot product with a query (track_id, score)."""
    from orbweave.functions.vectors import dot

    score = dot(F.col(vector), F.lit([float(x) for x in query]))
    return rows.select("track_id", score.alias("score")).orderBy(F.round("score", 9).desc(), "track_id").limit(k)


def centroid(space: DataFrame, ids: DataFrame) -> list[float] | None:
    """The mean of the ids' unit rows, not made a unit again; null of none."""
    cells = space.join(ids.select("track_id"), "track_id", "left_semi").select(F.posexplode("u").alias("i", "x"))
    means = cells.groupBy("i").agg(F.avg("x").alias("x")).orderBy("i").collect()  # one row a dimension
    return [r["x"] for r in means] or None


def drift(space: DataFrame, start: int, target: list[float] | None, steps: int, rules: Constraints | None = None) -> DataFrame:
    """From a track towards a point, by the allowed rows nearest to points between."""
    first = _row(space, start)
    if first is None or target is None:
        return _walk(space, [])
    x, y = np.array(first["u"]), np.array(target)
    targets = [((1 - i / (steps - 1)) * x + i / (steps - 1) * y).tolist() for i in range(1, steps)]
    return _walk(space, [(r["track_id"], None) for r in _through(space, [first], targets, rules or Constraints(), [])])


def order_queue(vectors: np.ndarray, pinned: bool) -> list[int]:
    """A short open path through unit rows: greedy, then 2-opt, of which each sweep takes
    the first better end for each start, all ends at once. The first row stays first."""
    n = len(vectors)
    far = 1 - vectors @ vectors.T
    order, left = [0], np.ones(n, bool)
    left[0] = False
    while left.any():
        rest = np.flatnonzero(left)
        order.append(int(rest[far[order[-1], rest].argmin()]))
        left[order[-1]] = False
    path = np.array(order)
    for _ in range(32):
        better = False
        for i in range(1, n - 1):
            j = i + 1
            while j < n:
                ends, after = path[j:], path[j + 1 :]
                gain = far[path[i - 1], path[i]] - far[path[i - 1], ends]
                gain[:-1] += far[ends[:-1], after] - far[path[i], after]
                found = np.flatnonzero(gain > 1e-6)
                if not len(found):
                    break
                j += int(found[0])
                path[i : j + 1] = path[i : j + 1][::-1].copy()
                better, j = True, j + 1
        if not better:
            break
    return path[1:].tolist() if pinned else path.tolist()


def queue_order(queues: DataFrame, most: int = 1024) -> DataFrame:
    """(queue_id, place, track_id) of queues (queue_id, place, track_id, u, anchor):
    rows without a vector are dropped; under three or over `most` others stay as
    they are. An anchor row leads the way and isn't part of the result."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame[frame["u"].notna()].sort_values(["anchor", "place"], ascending=[False, True])
        pinned = bool(frame["anchor"].any())
        own = frame[~frame["anchor"].astype(bool)]
        if 3 <= len(own) <= most:
            order = order_queue(np.stack(list(frame["u"])), pinned)
            own = frame.iloc[order]
        return pd.DataFrame({"queue_id": own["queue_id"], "place": np.arange(len(own)), "track_id": own["track_id"]})

    return queues.groupBy("queue_id").applyInPandas(one, "queue_id long, place long, track_id long")


def sort_after(queues: DataFrame, current: DataFrame) -> DataFrame:
    """(queue_id, place, track_id) of queues (queue_id, place, track_id, u) where what comes
    after each queue's current place is put in a short order that starts there; rows
    without a vector follow, as they were. Up to the current place nothing moves."""
    rows = queues.join(current.select("queue_id", F.col("place").alias("now")), "queue_id", "left").withColumn("now", F.coalesce("now", F.lit(-1)))
    played = rows.where(F.col("place") <= F.col("now")).select("queue_id", F.lit(0).alias("turn"), "place", "track_id")
    ahead = rows.where(F.col("place") >= F.col("now")).withColumn("anchor", F.col("place") == F.col("now"))
    placed = queue_order(ahead.select("queue_id", "place", "track_id", "u", "anchor")).select("queue_id", F.lit(1).alias("turn"), "place", "track_id")
    rest = rows.where((F.col("place") > F.col("now")) & F.col("u").isNull()).select("queue_id", F.lit(2).alias("turn"), "place", "track_id")
    every = played.unionByName(placed).unionByName(rest)
    place = F.row_number().over(Window.partitionBy("queue_id").orderBy("turn", "place")) - 1
    return every.select("queue_id", place.cast("long").alias("place"), "track_id")
