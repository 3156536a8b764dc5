"""The space that the embeddings table stands for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.functions.vectors import block_scales, doubles, weighted_unit
from orbweave.session import table

#: Its dimensions, and the artist that vector queries block.
WIDTH, BLOCKED = 64, 9


def space(spark: SparkSession, sf_dir: str, blocked: bool = True) -> DataFrame:
    """track_id, artist_id, album_id, bpm, vec and the weighted unit row u."""
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("track_id"), F.col("label").cast("long").alias("artist_id"), F.floor(F.col("vec_id") / 4).alias("album_id"),
        (70.0 + F.col("vec_id") % 70).alias("bpm"), doubles(F.col("embedding")).alias("vec"),
    )
    rows = rows.withColumn("u", weighted_unit(F.col("vec"), block_scales(WIDTH)))
    return rows.where(F.col("artist_id") != BLOCKED) if blocked else rows
