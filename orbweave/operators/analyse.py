"""Descriptors, windows and mel levels of excerpts (track_id, rate, samples), row by row in Arrow batches.

An excerpt is bounded (90 seconds), and so are batches in bytes (spark.sql.execution.arrow.maxBytesPerBatch).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from orbweave.functions import descriptors

_TEXTS = ("key", "scale")
NAMES = (
    "bpm", "onset_rate", "key", "scale", "key_strength", "loudness_integrated", "loudness_range", "dynamic_complexity",
    "spectral_centroid", "spectral_rolloff", "spectral_flatness", "zero_crossing_rate",
)


def _rows(excerpts: DataFrame, one, schema: str) -> DataFrame:
    """Rows (track_id, ...) that `one` makes of an excerpt's samples and rate."""
    out = _parse_datatype_string(schema)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                samples = batch.column("samples")[i]
                x = np.nan_to_num(np.asarray(samples.values, np.float64)) if samples.is_valid else np.zeros(0)
                found = [{"track_id": batch.column("track_id")[i].as_py(), **row} for row in one(x, batch.column("rate")[i].as_py())]
                yield pa.RecordBatch.from_pylist(found, schema=arrow)

    return excerpts.select("track_id", "rate", "samples").mapInArrow(run, out)


def describe(excerpts: DataFrame) -> DataFrame:
    """One row for each excerpt: its descriptors, or why it has none (reason). A null
    or short excerpt has a reason; null samples count as 0."""

    def one(x: np.ndarray, rate: int | None) -> list[dict]:
        try:
            if not rate:
                raise ValueError("no sample rate")
            return [descriptors.extract(x[: int(descriptors.EXCERPT_SECONDS * rate)], rate) | {"reason": None}]
        except ValueError as error:
            return [{"reason": str(error)}]

    columns = ", ".join(f"{n} {'string' if n in _TEXTS else 'double'}" for n in NAMES)
    return _rows(excerpts, one, f"track_id long, {columns}, reason string")


def resampled(excerpts: DataFrame, rate: int = 48_000) -> DataFrame:
    """The excerpts at one rate."""
    one = lambda x, own: [{"rate": rate, "samples": descriptors.resample(x, own, rate).astype(np.float32)}]
    return _rows(excerpts, one, "track_id long, rate int, samples array<float>")


def mel_windows(excerpts: DataFrame, seconds: int = 10) -> DataFrame:
    """(track_id, window, levels): mel levels of each window, frame by frame."""

    def one(x: np.ndarray, rate: int) -> list[dict]:
        return [{"window": i, "levels": descriptors.log_mel(w, rate).astype(np.float32).ravel()} for i, w in enumerate(descriptors.windows(x, seconds * rate))]

    return _rows(excerpts, one, "track_id long, window int, levels array<float>")


def pooled(windows: DataFrame, vector: str = "vec") -> DataFrame:
    """(track_id, vec): the unit of the sum of each track's unit vectors, in the JVM."""
    cells = windows.withColumn("_n", F.greatest(F.sqrt(F.aggregate(vector, F.lit(0.0).cast("double"), lambda s, x: s + x * x)), F.lit(1e-9)))
    sums = cells.select("track_id", F.posexplode(vector).alias("i", "x"), "_n").groupBy("track_id", "i").agg(F.sum(F.col("x") / F.col("_n")).alias("x"))
    rows = sums.groupBy("track_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda c: c["x"]).alias("v"), F.greatest(F.sqrt(F.sum(F.col("x") * F.col("x"))), F.lit(1e-9)).alias("n"))
    return rows.select("track_id", F.transform("v", lambda x: x / F.col("n")).alias("vec"))


def synthetic(spark: SparkSession, albums: int = 8, tracks: int = 4, rate: int = 48_000, seconds: float = 25.0) -> DataFrame:
    """Invented excerpts: track_id is tracks * album + number, alike within an album."""
    ids = spark.range(albums * tracks).select(F.col("id").alias("track_id"), F.lit(rate).alias("rate"), F.array().cast("array<float>").alias("samples"))

    arrow = to_arrow_schema(ids.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column("track_id").to_pylist():
                yield pa.RecordBatch.from_pylist([{"track_id": i, "rate": rate, "samples": descriptors.synthetic(i // tracks, i % tracks, rate, seconds)}], schema=arrow)

    return ids.mapInArrow(run, ids.schema)
