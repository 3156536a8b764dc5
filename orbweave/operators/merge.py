"""Upserts as folds: a batch of changes for a key in one aggregation, in order of arrival."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last(column: str, seq: str) -> Column:
    """The last value, null or not."""
    return F.max_by(column, seq)


def last_known(column: str, seq: str) -> Column:
    """The last value that isn't null."""
    return F.max_by(F.col(column), F.when(F.col(column).isNotNull(), F.col(seq)))


def fold(changes: DataFrame, key: list[str], seq: str, overwrite: Sequence[str] = (), coalesce: Sequence[str] = (), least: Sequence[str] = (), first: Sequence[str] = ()) -> DataFrame:
    """One row a key: the last value of `overwrite`, the last known one of
    `coalesce`, the least of `least`, the first known one of `first`."""
    parts = [last(c, seq).alias(c) for c in overwrite] + [last_known(c, seq).alias(c) for c in coalesce]
    parts += [F.min(c).alias(c) for c in least] + [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in first]
    return changes.groupBy(*key).agg(*parts)


def upsert(table: DataFrame, changes: DataFrame, key: list[str], seq: str, **how: list[str]) -> DataFrame:
    """The table with the changes folded in; its rows come before them all."""
    before = table.withColumn(seq, F.struct(F.lit(0).alias("turn"), F.lit(None).cast(changes.schema[seq].dataType).alias("seq")))
    after = changes.withColumn(seq, F.struct(F.lit(1).alias("turn"), F.col(seq).alias("seq")))
    return fold(before.unionByName(after, allowMissingColumns=True), key, seq, **how)


def purge(tables: dict[str, tuple[DataFrame, str]], keys: DataFrame, key: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Each table without the keys' rows, and how many rows that took from each."""
    left, counts = {}, None
    for name, (df, column) in tables.items():
        gone = keys.select(F.col(key).alias(column)).distinct()
        left[name] = df.join(gone, column, "left_anti")
        n = df.join(gone, column, "left_semi").agg(F.count("*").alias("removed")).select(F.lit(name).alias("what"), "removed")
        counts = n if counts is None else counts.unionByName(n)
    return left, counts


def record_features(features: DataFrame, failures: DataFrame, new: DataFrame, seq: str) -> tuple[DataFrame, DataFrame]:
    """New feature rows replace a track's, and clear its failure."""
    columns = [c for c in features.columns if c != "track_id"]
    return upsert(features, new, ["track_id"], seq, overwrite=columns), failures.join(new.select("track_id").distinct(), "track_id", "left_anti")


def record_failures(failures: DataFrame, new: DataFrame, seq: str, most: int = 500) -> DataFrame:
    """The last failure of each track, its reason cut to `most` characters."""
    cut = new.withColumn("reason", F.substring("reason", 1, most))
    return upsert(failures, cut, ["track_id"], seq, overwrite=[c for c in failures.columns if c != "track_id"])


def block(blocked: DataFrame, frontier: DataFrame, asked: DataFrame, seq: str) -> tuple[DataFrame, DataFrame]:
    """Blocked artists with those asked for: known names and reasons give way only to
    known ones, the first time stands; and the frontier without these artists."""
    out = upsert(blocked, asked, ["artist_id"], seq, coalesce=["name", "reason"], first=["blocked_at"])
    gone = asked.select(F.lit("artist").alias("kind"), F.col("artist_id").cast("string").alias("ref_id")).distinct()
    return out, frontier.join(gone, ["kind", "ref_id"], "left_anti")


def unblock(blocked: DataFrame, lifted: DataFrame) -> DataFrame:
    return blocked.join(lifted.select("artist_id").distinct(), "artist_id", "left_anti")


def purge_artists(tables: dict[str, DataFrame], artists: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """All that belongs to the artists goes: features, layout and failures of their
    tracks, their tracks and albums, their frontier entries; and how many rows of each."""
    owned = tables["tracks"].join(artists.select("artist_id").distinct(), "artist_id", "left_semi").select("track_id")
    left, counts = purge({name: (tables[name], "track_id") for name in ("features", "layout", "failures")}, owned, "track_id")
    rest, more = purge({name: (tables[name], "artist_id") for name in ("tracks", "albums")}, artists, "artist_id")
    entries = artists.select(F.lit("artist").alias("kind"), F.col("artist_id").cast("string").alias("ref_id")).distinct()
    frontier = tables["frontier"]
    gone = frontier.join(entries, ["kind", "ref_id"], "left_semi").agg(F.count("*").alias("removed")).select(F.lit("frontier").alias("what"), "removed")
    return left | rest | {"frontier": frontier.join(entries, ["kind", "ref_id"], "left_anti")}, counts.unionByName(more).unionByName(gone)
