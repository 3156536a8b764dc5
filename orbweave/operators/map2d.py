"""What a two-dimensional layout starts from, and map queries; `rotation` has the layout itself."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.operators.relational import numbered


def bounds(points: DataFrame) -> DataFrame:
    """Extent of x and y; zeros for no points."""
    parts = [F.coalesce(f(c), F.lit(0.0)).alias(f"{n}_{c}") for c in ("x", "y") for f, n in ((F.min, "min"), (F.max, "max"))]
    return points.agg(F.count("*").alias("n"), *parts)


def first_seen_codes(rows: DataFrame, column: str, place: str) -> DataFrame:
    """A number from 0 for each value, in order of first appearance."""
    firsts = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(place).alias("first"))
    return numbered(firsts, ["first", column], "code").withColumn("code", (F.col("code") - 1).cast("int"))


def legend(rows: DataFrame, column: str, place: str) -> DataFrame:
    """Each value's code, where it is first seen and how many rows have it."""
    return first_seen_codes(rows, column, place).join(rows.groupBy(column).agg(F.count("*").alias("n")), column)


def meta(points: DataFrame, genre: str, place: str) -> dict:
    """What a map shows beside its points: how many, their bounds, genres in order of code, and whether any has a place."""
    b = bounds(points.where(F.col("x").isNotNull() & F.col("y").isNotNull())).head().asDict()
    genres = [r[genre] for r in first_seen_codes(points, genre, place).orderBy("code").collect()]  # one row a genre
    return b | {"genres": genres, "has_layout": b["n"] > 0}


def fitted(points: DataFrame, width: float, height: float, pad: float = 30.0) -> DataFrame:
    """Points on a view of that size (sx, sy), at one scale both ways, `pad` from its edges at the least."""
    b = bounds(points).head()
    scale = min((width - 2 * pad) / max(b["max_x"] - b["min_x"], 1e-6), (height - 2 * pad) / max(b["max_y"] - b["min_y"], 1e-6))
    return points.withColumns({f"s{c}": F.col(c) * scale + (pad - b[f"min_{c}"] * scale) for c in ("x", "y")})


def route_places(route: DataFrame, points: DataFrame) -> DataFrame:
    """A route (step, track_id) with the places of its points; unknown ids are left out."""
    return route.join(points.select("track_id", "place"), "track_id").select("step", "track_id", "place")


def payload(points: DataFrame, genre: str, place: str) -> bytes:
    """A map for a browser: all ids as 64-bit floats, then x and y as 32-bit ones, then genre codes as
    16-bit numbers, little-endian. The whole map is in the result, 18 bytes a point, as its format asks."""
    codes = first_seen_codes(points, genre, place).select(genre, "code")
    rows = points.where(F.col("x").isNotNull() & F.col("y").isNotNull()).join(codes, genre, "left").orderBy(place)
    frame = rows.select(F.col("track_id").cast("double"), F.col("x").cast("float"), F.col("y").cast("float"), F.coalesce("code", F.lit(0)).alias("code")).toPandas()
    xy = frame[["x", "y"]].to_numpy("<f4")
    return frame["track_id"].to_numpy("<f8").tobytes() + xy.tobytes() + frame["code"].to_numpy("<u2").tobytes()


def grid(points: DataFrame) -> DataFrame:
    """Cells of a uniform grid with side = clamp(round(sqrt(n / 2)), 1, 512)."""
    b = bounds(points).head()
    side = min(512, max(1, int(np.sqrt(b["n"] / 2) + 0.5)))
    cell = lambda c: F.least(F.lit(side - 1), F.floor((F.col(c) - b[f"min_{c}"]) / max(b[f"max_{c}"] - b[f"min_{c}"], 1e-9) * side)).cast("int")
    return points.withColumns({"cell_x": cell("x"), "cell_y": cell("y")})


def memberships(dist: np.ndarray, k: int) -> np.ndarray:
    """exp(-(dist - rho) / sigma) by row, for rows of distances that are padded with
    NaN: rho is the row's first positive distance, sigma such that all but one of the
    weights sum to log2(k + 1) - 1 within 1e-5. All rows are bisected together."""
    d = np.maximum(dist, 0.0)
    there = ~np.isnan(d)
    rho = np.where((d > 0).any(axis=1), np.min(np.where(d > 0, d, np.inf), axis=1), 0.0)
    gaps = np.where(there, d - rho[:, None], np.inf)
    goal = float(np.log2(k + 1) - 1)
    low, high, sigma = np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d))
    weigh = lambda s: np.where(there, np.where(gaps > 0, np.exp(-np.maximum(gaps, 0) / s[:, None]), 1.0), 0.0)
    for _ in range(64):
        over = weigh(sigma).sum(axis=1) - 1 - goal
        go = np.abs(over) >= 1e-5
        if not go.any():
            break
        high, low = np.where(go & (over > 0), sigma, high), np.where(go & (over <= 0), sigma, low)
        sigma = np.where(go, np.where(np.isinf(high), sigma * 2, (low + np.minimum(high, 1e300)) / 2), sigma)
    return weigh(np.maximum(np.maximum(sigma, 1e-3 * np.nanmean(d, axis=1)), 1e-12))


def fuzzy_weights(edges: DataFrame, k: int) -> DataFrame:
    """(src, dst, w) of a kNN graph (src, dst, dist); a row has its k neighbours, many rows are weighed at once."""

    @F.pandas_udf("array<double>")
    def weights(dist: pd.Series) -> pd.Series:
        size = dist.map(len).to_numpy(int)
        padded = np.full((len(dist), size.max(initial=1)), np.nan)
        padded[np.arange(padded.shape[1])[None, :] < size[:, None]] = np.concatenate(list(dist)) if len(dist) else []
        return pd.Series([w[:n] for w, n in zip(memberships(padded, k), size, strict=True)])

    rows = edges.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("dist", "dst"))).alias("near"))
    rows = rows.select("src", F.col("near.dst").alias("dst"), weights(F.col("near.dist")).alias("w"))
    return rows.select("src", F.explode(F.arrays_zip("dst", "w")).alias("e")).select("src", "e.dst", "e.w")


def fuzzy_union(weights: DataFrame) -> DataFrame:
    """(a, b, w) with a < b: w + v - w v of both directions, a missing one as 0."""
    a, b = F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")
    both = weights.where("src <> dst").groupBy(a, b).agg(
        F.coalesce(F.max(F.when(F.col("src") < F.col("dst"), F.col("w"))), F.lit(0.0)).alias("w"),
        F.coalesce(F.max(F.when(F.col("src") > F.col("dst"), F.col("w"))), F.lit(0.0)).alias("v"),
    )
    return both.select("a", "b", (F.col("w") + F.col("v") - F.col("w") * F.col("v")).alias("w"))


def fit_curve(min_dist: float = 0.1, spread: float = 1.0) -> tuple[float, float]:
    """(a, b) so that 1 / (1 + a d^2b) fits 1 up to min_dist and an exponential beyond, by least squares on finer and finer grids."""
    d = np.linspace(0, 3 * spread, 300)
    goal = np.where(d < min_dist, 1.0, np.exp(-(d - min_dist) / spread))
    a, b, step = 1.5, 1.0, 0.5
    for _ in range(30):
        grid_a, grid_b = np.meshgrid(np.clip(a + step * np.linspace(-1, 1, 11), 1e-3, None), np.clip(b + step * np.linspace(-1, 1, 11), 1e-3, None), indexing="ij")
        error = ((1 / (1 + grid_a[..., None] * d ** (2 * grid_b[..., None])) - goal) ** 2).sum(-1)
        i, j = np.unravel_index(error.argmin(), error.shape)
        a, b, step = float(grid_a[i, j]), float(grid_b[i, j]), step * 0.7
    return a, b


def spread_start(points: DataFrame, seed: int = 42) -> DataFrame:
    """x and y scaled to [-10, 10], with a jitter of 1e-4 so that rows at one place can part."""
    b = bounds(points).head()
    unit = lambda c: F.pmod(F.xxhash64("track_id", F.lit(c), F.lit(seed)), F.lit(1 << 32)) / float(1 << 32)
    scaled = lambda c: 20 * (F.col(c) - b[f"min_{c}"]) / max(b[f"max_{c}"] - b[f"min_{c}"], 1e-12) - 10 + 1e-4 * (unit(c) - 0.5)
    return points.select("track_id", scaled("x").alias("x"), scaled("y").alias("y"))
