"""Queries over excerpts and spaces made from them, and their SQL.

A user's events stand in for an excerpt: each value is held for 150 samples.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.operators import analyse, walks
from orbweave.plans import assemble
from orbweave.plans.space import space
from orbweave.registry import query
from orbweave.session import table

RATE, HELD = 1500, 150


def _excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An excerpt is a bounded list: no user has more than some hundred events."""
    samples = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda e: (e["value"] - 50) / 100)
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(samples.alias("v"))
    held = F.flatten(F.transform("v", lambda x: F.array_repeat(x, HELD)))
    return rows.select(F.col("user_id").alias("track_id"), F.lit(RATE).alias("rate"), held.alias("samples"))


@query(f"""
WITH s AS (SELECT user_id, row_number() OVER w - 1 AS i, (value - 50) / 100 AS v, lag(value) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT user_id, count(*) * {HELD} AS n, count(*) FILTER ((v >= 0) <> (before >= 50)) AS crossed FROM s GROUP BY user_id),
b AS (SELECT user_id, 10 * log10(greatest(avg(v * v), 1e-12)) AS level FROM s GROUP BY user_id, i // 4 HAVING count(*) = 4),
m AS (SELECT user_id, avg(level) AS mean FROM b WHERE level > -70 GROUP BY user_id),
d AS (SELECT user_id, CASE WHEN count(*) >= 2 THEN avg(abs(level - mean)) END AS complexity FROM b JOIN m USING (user_id) WHERE level > -70 GROUP BY user_id)
SELECT user_id AS track_id, CASE WHEN n > 8192 THEN round(crossed / n, 9) END AS zero_crossing_rate, CASE WHEN n > 8192 THEN round(complexity, 6) END AS dynamic_complexity,
  CASE WHEN n <= 8192 THEN 'too few samples' END AS reason FROM n LEFT JOIN d USING (user_id)""")
def excerpt_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = analyse.describe(_excerpts(spark, sf_dir))
    return rows.select("track_id", F.round("zero_crossing_rate", 9).alias("zero_crossing_rate"), F.round("dynamic_complexity", 6).alias("dynamic_complexity"), "reason")


@query()
def descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All descriptors; tests hold them against tones, clicks and plain sums."""
    return analyse.describe(_excerpts(spark, sf_dir))


@query(f"SELECT user_id AS track_id, ({RATE} * 2)::bigint AS rate, count(*) * {HELD} * 2 AS n FROM events GROUP BY user_id")
def resampled_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyse.resampled(_excerpts(spark, sf_dir), 2 * RATE).select("track_id", F.col("rate").cast("long").alias("rate"), F.size("samples").cast("long").alias("n"))


@query("""
WITH w AS (SELECT vec_id // 4 AS track_id, i, embedding[i + 1]::double / greatest(sqrt(list_dot_product(embedding::double[], embedding::double[])), 1e-9) AS x FROM embeddings, range(64) t(i)),
s AS (SELECT track_id, i, sum(x) AS x FROM w GROUP BY ALL), n AS (SELECT track_id, greatest(sqrt(sum(x * x)), 1e-9) AS n FROM s GROUP BY track_id)
SELECT track_id, i::int AS dim, round(x / n, 6) AS x FROM s JOIN n USING (track_id)""")
def pooled_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("track_id"), F.col("embedding").cast("array<double>").alias("vec"))
    return analyse.pooled(windows).select("track_id", F.posexplode("vec").alias("dim", "x")).withColumn("x", F.round("x", 6))


#: Directions: a mood is the contrast of two dimensions, a style one dimension.
MOODS = np.eye(64)[:8] - np.eye(64)[8:16]
STYLES = np.eye(64)[:30]


def _analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("vec_id")
    rows = table(spark, sf_dir, "embeddings")
    named = {n: ((i * (k + 3)) % 17).cast("double") for k, n in enumerate(("onset_rate", "loudness_range", "dynamic_complexity", "spectral_centroid", "spectral_rolloff", "spectral_flatness", "zero_crossing_rate"))}
    return rows.select(
        i.alias("track_id"), F.col("label").cast("long").alias("artist_id"), F.floor(i / 4).alias("album_id"), F.when(i % 7 != 0, F.concat((1950 + i % 70).cast("string"), F.lit("-01-01"))).alias("release_date"),
        F.when(i % 5 != 0, (60 + i % 120).cast("double")).alias("bpm"), F.lit("C").alias("key"), F.lit("major").alias("scale"), (i % 10 / 10).alias("key_strength"),
        F.when(i % 11 != 0, (i % 13).cast("double")).alias("loudness_integrated"), *[c.alias(n) for n, c in named.items()], F.col("embedding").alias("clap"),
    )


@query("""
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 5 <> 0 THEN log2(60 + vec_id % 120) - floor(log2((60 + vec_id % 120) / 70.0)) END AS t, (vec_id * 3 % 17)::double AS o, embedding FROM embeddings),
f AS (SELECT vec_id, coalesce(t, (SELECT median(t) FROM r)) AS t, o, list_transform(range(1, 9), lambda i: embedding[i]::double - embedding[i + 8]::double) AS mood FROM r),
s AS (SELECT avg(t) AS mt, stddev_pop(t) AS st, avg(o) AS mo, stddev_pop(o) AS so FROM f), z AS (SELECT vec_id, (t - mt) / st AS a, (o - mo) / so AS b FROM f, s)
SELECT vec_id AS track_id, round(a / greatest(sqrt(a * a + b * b), 1e-9), 6) AS tempo, round(b / greatest(sqrt(a * a + b * b), 1e-9), 6) AS onsets FROM z""")
def assembled_tempo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first block of the assembled space."""
    rows = assemble.assemble(_analysed(spark, sf_dir), 64, MOODS, STYLES).rows
    return rows.select("track_id", F.round(F.col("vec")[0], 6).alias("tempo"), F.round(F.col("vec")[1], 6).alias("onsets"))


@query("""
WITH m AS (SELECT vec_id, i, embedding[i]::double - embedding[i + 8]::double AS x FROM embeddings, range(1, 9) t(i)), s AS (SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM m GROUP BY i),
z AS (SELECT vec_id, m.i, (x - m) / s AS z FROM m JOIN s USING (i)), n AS (SELECT vec_id, greatest(sqrt(sum(z * z)), 1e-9) AS n FROM z GROUP BY vec_id)
SELECT vec_id AS track_id, i::int AS axis, round(z / n, 6) AS x FROM z JOIN n USING (vec_id)""")
def assembled_moods(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assemble.assemble(_analysed(spark, sf_dir), 64, MOODS, STYLES)
    start, end = next((a, b) for name, a, b, _ in out.blocks if name == "mood")
    cells = out.rows.select("track_id", F.posexplode(F.slice("vec", start + 1, end - start)).alias("axis", "x"))
    return cells.select("track_id", (F.col("axis") + 1).alias("axis"), F.round("x", 6).alias("x"))


@query()
def assembled_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assemble.assemble(_analysed(spark, sf_dir), 64, MOODS, STYLES)
    return assemble.reweighted(out.rows, out.blocks, {"era": 0.0}).select("track_id", "artist_id", "album_id", "bpm", "vec", "u")


@query()
def queue_after_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queues of 40, of which each tenth row has no vector, sorted after their fourth item."""
    u = F.when(F.col("track_id") % 10 != 7, F.col("u"))
    queues = space(spark, sf_dir).select(F.floor(F.col("track_id") / 40).alias("queue_id"), (F.col("track_id") % 40).alias("place"), "track_id", u.alias("u"))
    return walks.sort_after(queues, queues.select("queue_id").distinct().withColumn("place", F.lit(4)))
