"""A space from analysed tracks: blocks of descriptors, of contrasts and styles of the
audio vector, and of its main axes, each standardised, then side by side."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.functions import expr, vectors
from orbweave.session import checkpointed

# Descriptors of the blocks that are made of them.
DYNAMICS = ("loudness_integrated", "dynamic_complexity", "loudness_range")
TIMBRE = ("spectral_centroid", "spectral_rolloff", "spectral_flatness", "zero_crossing_rate")
STYLE_AXES, SEMANTIC_AXES = 20, 40


@dataclass
class Assembled:
    """rows: track_id, artist_id, album_id, bpm and vec; blocks (name, start, end,
    weight) in order; the axes by which a vector comes to the semantic block."""

    rows: DataFrame
    blocks: list[tuple[str, int, int, float]]
    mean: np.ndarray
    axes: np.ndarray


def offsets(widths: dict[str, int]) -> list[tuple[str, int, int, float]]:
    """(name, start, end, weight) of blocks side by side, in the fixed order."""
    out, at = [], 0
    for name, weight in zip(vectors.BLOCKS, vectors.WEIGHTS, strict=True):
        out.append((name, at, at + widths[name], weight))
        at += widths[name]
    return out


def _main_axes(rows: DataFrame, column: str, width: int, k: int, out: str) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    mean, axes = vectors.fit_pca(rows, column, width, k)
    moved = F.zip_with(column, F.lit(mean.tolist()), lambda x, m: x - m)
    return rows.withColumn(out, vectors.products(moved, axes)), mean, axes


def assemble(tracks: DataFrame, width: int, moods: np.ndarray, styles: np.ndarray) -> Assembled:
    """tracks: track_id, artist_id, album_id, release_date, the descriptors and `clap`
    of that width (all of one row a track, none null). moods and styles: directions,
    one a row. Missing descriptors take the median, a missing key none; axes are as
    many as 20 and 40, the rows and the dimensions allow. No rows give blocks without axes."""
    named = [*DYNAMICS, *TIMBRE, "onset_rate"]
    rows = tracks.withColumns({"_bpm": expr.fold_bpm(F.col("bpm")), "_year": expr.release_year(F.col("release_date")).cast("double"), "_clap": vectors.doubles(F.col("clap"))})
    rows = vectors.impute(rows, ["_bpm", "_year", *named])
    key = expr.key_coordinates(F.col("key"), F.col("scale"), F.col("key_strength"))
    each = lambda names: F.array(*map(F.col, names))
    parts: dict[str, Column] = {
        "tempo": each(["_bpm", "onset_rate"]), "key": F.array(*(key[c] for c in ("fifths_cos", "fifths_sin", "mode"))), "dynamics": each(DYNAMICS), "timbre": each(TIMBRE),
        "mood": vectors.products(F.col("_clap"), moods), "_styles": vectors.products(F.col("_clap"), styles), "era": each(["_year"]),
    }
    rows = checkpointed(rows.select("track_id", "artist_id", "album_id", "bpm", "_clap", *[c.alias(name) for name, c in parts.items()]))
    rows, _, style_axes = _main_axes(rows, "_styles", len(styles), STYLE_AXES, "style")
    rows, mean, axes = _main_axes(rows, "_clap", width, SEMANTIC_AXES, "semantic")
    rows = checkpointed(rows)
    widths = {"tempo": 2, "key": 3, "dynamics": 3, "timbre": 4, "mood": len(moods), "style": len(style_axes), "era": 1, "semantic": len(axes)}
    rows, _ = vectors.standardised(rows, widths)
    vec = F.concat(*vectors.BLOCKS)
    return Assembled(rows.select("track_id", "artist_id", "album_id", "bpm", vec.alias("vec")), offsets(widths), mean, axes)


def reweighted(rows: DataFrame, blocks: list[tuple[str, int, int, float]], weights: dict[str, float] | None = None) -> DataFrame:
    """The rows with their unit rows `u` at new weights; a block without one keeps its own."""
    scales = [(weights or {}).get(name, weight) for name, start, end, weight in blocks for _ in range(start, end)]
    return rows.withColumn("u", vectors.weighted_unit(F.col("vec"), [float(s) for s in scales]))
