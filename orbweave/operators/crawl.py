"""The crawl's frontier over edge tables; `streaming.crawl_log` has the crawl itself.

frontier: kind ('artist' or 'album'), ref_id (string), priority (the distance) and
state (pending, done, skipped or failed). An artist hands its distance on to its
albums and one more to similar artists, an album hands its own to its tracks;
entries go by distance, artists before albums.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENTRY = ["kind", "ref_id"]


@dataclass
class Sources:
    """artist_albums (artist_id, album_id), similar (artist_id, similar_id), albums
    (album_id, artist_id), album_tracks (album_id, track_id): what remote calls
    would return; dead (kind, ref_id): entries whose call fails."""

    artist_albums: DataFrame
    similar: DataFrame
    albums: DataFrame
    album_tracks: DataFrame
    dead: DataFrame | None = None


def enqueue(frontier: DataFrame, asked: DataFrame) -> DataFrame:
    """The frontier with entries (kind, ref_id, priority) asked for: the least priority
    counts, a known entry's state stays, a new one is pending."""
    rows = frontier.select(*ENTRY, "priority", "state").unionByName(asked.select(*ENTRY, "priority", F.lit(None).cast("string").alias("state")))
    return rows.groupBy(*ENTRY).agg(F.min("priority").alias("priority"), F.coalesce(F.max("state"), F.lit("pending")).alias("state"))


def mark(frontier: DataFrame, entries: DataFrame, state: str) -> DataFrame:
    """The frontier with the state of some entries changed."""
    hit = entries.select(*ENTRY).distinct().withColumn("_hit", F.lit(True))
    return frontier.join(hit, ENTRY, "left").withColumn("state", F.when(F.col("_hit"), state).otherwise(F.col("state"))).drop("_hit")


def blocked_entries(frontier: DataFrame, blocked: DataFrame, albums: DataFrame | None) -> DataFrame:
    """Entries of blocked artists (an artist by its id, an album by the one it's filed under). Without
    `albums` those are left out, for frontiers that have none. Of the albums only blocked artists' ones
    meet the frontier."""
    gone = blocked.select("artist_id").distinct()
    artists = frontier.where("kind = 'artist'").withColumn("artist_id", F.col("ref_id").try_cast("long"))
    out = artists.join(gone, "artist_id", "left_semi").select(*ENTRY)
    if albums is None:
        return out
    filed = albums.join(gone, "artist_id", "left_semi").select(F.col("album_id").cast("string").alias("ref_id"))
    return out.unionByName(frontier.where("kind = 'album'").join(filed, "ref_id", "left_semi").select(*ENTRY))


def stats(frontier: DataFrame) -> DataFrame:
    """(outcome, n): artists and albums expanded, entries skipped and failed."""
    outcome = (
        F.when((F.col("state") == "done") & (F.col("kind") == "artist"), "artists_expanded").when(F.col("state") == "done", "albums_expanded")
        .when(F.col("state") == "skipped", "blocked_skipped").when(F.col("state") == "failed", "errors")
    )
    return frontier.select(outcome.alias("outcome")).where(F.col("outcome").isNotNull()).groupBy("outcome").agg(F.count("*").alias("n"))


def pop(frontier: DataFrame) -> DataFrame:
    """The next pending entry: the nearest, an artist before an album."""
    return frontier.where("state = 'pending'").orderBy("priority", F.desc("kind"), "ref_id").limit(1)
