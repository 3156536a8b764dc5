"""Vector functions as Column builders over arrays of doubles, and PCA from a distributed scatter matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.functions.selection import finite, medians

TINY = 1e-9

# The blocks of a space in order, and their weights.
BLOCKS = ("tempo", "key", "dynamics", "timbre", "mood", "style", "era", "semantic")
WEIGHTS = (1.0, 0.4, 0.8, 0.6, 1.2, 1.5, 0.3, 2.0)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.greatest(F.sqrt(dot(v, v)), F.lit(TINY))


def unit(v: Column) -> Column:
    """Of length 1. Vector and norm are bound by lambdas, else both would be computed again for each component."""
    by_norm = lambda w: F.transform(F.array(norm(w)), lambda n: F.transform(w, lambda x: x / n))[0]
    return F.transform(F.array(v), by_norm)[0]


def weighted_unit(v: Column, scales: list[float]) -> Column:
    """Each dimension times its block's weight, then to length 1."""
    return unit(F.zip_with(v, F.lit(scales), lambda x, w: x * w))


def block_scales(width: int, weights: tuple[float, ...] = WEIGHTS) -> list[float]:
    """A scale for each dimension: blocks of equal width in order."""
    each = max(1, width // len(weights))
    return [weights[min(i // each, len(weights) - 1)] for i in range(width)]


def interpolate(a: Column, b: Column, t: float) -> Column:
    return F.zip_with(a, b, lambda x, y: (1 - t) * x + t * y)


def scatter(df: DataFrame, column: str, width: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, sum and X'X of a vector column. Each task sends one matrix of width x width."""

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total, gram = 0, np.zeros(width), np.zeros((width, width))
        for frame in frames:
            x = np.stack(list(frame[column])).astype(np.float64) if len(frame) else np.zeros((0, width))
            n, total, gram = n + len(x), total + x.sum(0), gram + x.T @ x
        yield pd.DataFrame({"i": np.arange(width + 1), "n": n, "row": [total.tolist(), *gram.tolist()]})

    rows = df.select(column).mapInPandas(part, "i int, n long, row array<double>")
    cells = rows.select("i", "n", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    out = cells.orderBy("i", "j").toPandas()  # (width + 1) * width cells
    full = out["x"].to_numpy().reshape(width + 1, width) if len(out) else np.zeros((width + 1, width))
    return (int(out["n"].iloc[0]) if len(out) else 0), full[0], full[1:]


def fit_pca(df: DataFrame, column: str, width: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and the first min(k, n, width) axes; each axis' first greatest coefficient is positive."""
    n, total, gram = scatter(df, column, width)
    mean = total / max(n, 1)
    values, vectors = np.linalg.eigh(gram - n * np.outer(mean, mean))
    axes = vectors[:, np.argsort(-values, kind="stable")[: min(k, n, width)]].T
    lead = np.abs(axes).round(12).argmax(1) if len(axes) else []
    return mean, axes * np.sign(axes[np.arange(len(axes)), lead])[:, None] if len(axes) else axes


def project(v: Column, mean: np.ndarray, axes: np.ndarray) -> Column:
    centred = F.zip_with(v, F.lit(mean.tolist()), lambda x, m: x - m)
    return F.array(*[dot(centred, F.lit(a.tolist())) for a in axes])


def impute(df: DataFrame, columns: list[str]) -> DataFrame:
    """Medians of the finite values for missing ones; 0 where there are none at all."""
    middle = medians(df, columns)
    return df.withColumns({c: F.coalesce(finite(F.col(c)), F.lit(middle[c]).cast("double"), F.lit(0.0)) for c in columns})


def normalise_block(df: DataFrame, columns: list[str], out: str) -> DataFrame:
    """Columns as population z-scores (what isn't finite counts as 0; a deviation
    under 1e-9 as 1), each row then to length 1."""
    clean = {c: F.coalesce(finite(F.col(c)), F.lit(0.0)) for c in columns}
    stats = df.agg(*[f(clean[c]).alias(f"{p}{i}") for i, c in enumerate(columns) for f, p in ((F.avg, "m"), (F.stddev_pop, "s"))]).head()
    scores = []
    for i, c in enumerate(columns):
        mean, std = stats[f"m{i}"] or 0.0, stats[f"s{i}"] or 0.0
        scores.append((clean[c] - mean) / (std if std >= TINY else 1.0))
    return df.withColumn(out, unit(F.array(*scores)))


def products(v: Column, matrix: np.ndarray) -> Column:
    """The dot products of a vector with each row of a matrix, a batch at a time."""

    @F.pandas_udf("array<double>")
    def score(column: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(list(column)).astype(np.float64) @ matrix.T) if len(column) else [])

    return score(v)


def standardised(df: DataFrame, widths: dict[str, int]) -> tuple[DataFrame, dict[str, tuple[list[float], list[float]]]]:
    """Array columns of those widths as normalise_block has them, and each one's means and
    deviations: all of them of one aggregate, an array of no width as it is."""
    clean = {(c, i): F.coalesce(finite(F.col(c)[i]), F.lit(0.0)) for c, n in widths.items() for i in range(n)}
    places = list(clean)
    stats = df.agg(F.array(*[F.avg(clean[p]) for p in places]).alias("mean"), F.array(*[F.stddev_pop(clean[p]) for p in places]).alias("std")).head() if places else None
    mean = {p: (stats["mean"][k] or 0.0) for k, p in enumerate(places)}
    std = {p: (x if (x := stats["std"][k] or 0.0) >= TINY else 1.0) for k, p in enumerate(places)}
    scores = {c: unit(F.array(*[(clean[c, i] - mean[c, i]) / std[c, i] for i in range(n)])) if n else F.array().cast("array<double>") for c, n in widths.items()}
    return df.withColumns(scores), {c: ([mean[c, i] for i in range(n)], [std[c, i] for i in range(n)]) for c, n in widths.items()}
