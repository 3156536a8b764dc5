"""A crawl that goes on where it stopped: rounds are committed to a log of deltas.

A round's folder has what changed of the frontier, by priority, and the tracks that it found;
it is written beside its place and renamed, so that a round is there whole or not at all,
and of two crawlers that write the same round the second fails. The state is the
fold of all rounds. A round reads the entries of one priority and touches those that
are due; after MANY rounds the fold is written as a base that later readers begin at.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.operators.crawl import ENTRY, Sources, blocked_entries
from orbweave.operators.relational import running_total
from orbweave.session import checkpointed
from orbweave.sources.tables import _files, removed

#: Rounds after which their fold is written.
MANY = 16
_FRONTIER = "kind string, ref_id string, state string, round long, priority long"
_TRACKS = "track_id long, album_id string, seed_distance long, round long"


class Conflict(RuntimeError):
    """Another crawler has committed the round."""


class CrawlLog:
    """The committed rounds of a crawl in a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def rounds(self) -> list[str]:
        """Names of committed rounds from the newest base on, in order."""
        files, path = _files(self.spark, f"{self.folder}/rounds")
        names = sorted(s.getPath().getName() for s in files.listStatus(path)) if files.exists(path) else []
        bases = [i for i, name in enumerate(names) if name.endswith("-base")]
        return names[bases[-1] :] if bases else names

    def deltas(self, priority: int | None = None) -> DataFrame:
        """Changes of entries, of one priority (its folders alone are read) or of all."""
        frames = [self.spark.read.schema(_FRONTIER).parquet(f"{self.folder}/rounds/{r}/frontier") for r in self.rounds()]
        out = frames[0] if frames else self.spark.createDataFrame([], _FRONTIER)
        for more in frames[1:]:
            out = out.unionByName(more)
        return out if priority is None else out.where(F.col("priority") == priority)

    def entries(self, priority: int | None = None) -> DataFrame:
        """The frontier (kind, ref_id, priority, state), of one priority or whole; an entry that got a lesser priority is there alone."""
        last = self.deltas(priority).groupBy(*ENTRY, "priority").agg(F.max_by("state", "round").alias("state"))
        return last.where("state <> 'moved'").select(*ENTRY, "priority", "state")

    def tracks(self) -> DataFrame:
        """(track_id, album_id, seed_distance): each track's least distance and the album where it was first so near."""
        frames = [self.spark.read.schema(_TRACKS).parquet(f"{self.folder}/rounds/{r}/tracks") for r in self.rounds()]
        out = frames[0] if frames else self.spark.createDataFrame([], _TRACKS)
        for more in frames[1:]:
            out = out.unionByName(more)
        return out.groupBy("track_id").agg(F.min_by("album_id", F.struct("seed_distance", "round", "album_id")).alias("album_id"), F.min("seed_distance").alias("seed_distance"))

    def commit(self, frontier: DataFrame | None, tracks: DataFrame | None, at: int, base: bool = False) -> None:
        """Write round `at`; fails if it is there."""
        beside = f"{self.folder}/.making-{uuid.uuid4().hex}"
        frontier = frontier if frontier is not None else self.spark.createDataFrame([], "kind string, ref_id string, priority long, state string")
        tracks = tracks if tracks is not None else self.spark.createDataFrame([], "track_id long, album_id string, seed_distance long")
        stamped = frontier.select(*ENTRY, "state", F.lit(at).cast("long").alias("round"), F.col("priority").cast("long").alias("priority"))
        # A round has few priorities, so rows aren't dealt by these: one task would write a round's entries.
        stamped.write.partitionBy("priority").parquet(f"{beside}/frontier")
        tracks.select("track_id", F.col("album_id").cast("string").alias("album_id"), F.col("seed_distance").cast("long").alias("seed_distance"), F.lit(at).cast("long").alias("round")).write.parquet(f"{beside}/tracks")
        files, made = _files(self.spark, beside)
        _, place = _files(self.spark, f"{self.folder}/rounds/{at:06d}{'-base' * base}")
        files.mkdirs(place.getParent())
        if files.exists(place) or not files.rename(made, place):
            removed(self.spark, beside)
            raise Conflict(f"round {at} is committed already")

    def next_round(self) -> int:
        names = self.rounds()
        return int(names[-1].split("-")[0]) + 1 if names else 0

    def compact(self) -> None:
        """Write the fold of all rounds as a base; rounds before it are no longer read."""
        self.commit(self.entries(), self.tracks(), self.next_round(), base=True)

    def clean(self) -> None:
        """Remove rounds before the newest base, when no reader is left there, and what stopped writers left."""
        kept = set(self.rounds())
        for folder, stays in ((f"{self.folder}/rounds", kept), (self.folder, {"rounds"})):
            files, path = _files(self.spark, folder)
            for s in files.listStatus(path) if files.exists(path) else []:
                if s.getPath().getName() not in stays:
                    removed(self.spark, f"{folder}/{s.getPath().getName()}")


def seed(log: CrawlLog, entries: DataFrame) -> None:
    """Entries (kind, ref_id, priority) to crawl from; those that the log has stay as they are."""
    log.commit(_new(log, entries.select(*ENTRY, "priority")), None, log.next_round())


def _new(log: CrawlLog, asked: DataFrame) -> DataFrame:
    """What asked entries change: unknown ones are pending, a lesser priority is taken on with the state."""
    asked = checkpointed(asked.groupBy(*ENTRY).agg(F.min("priority").cast("long").alias("priority")))
    known = log.deltas().join(asked.select(*ENTRY), ENTRY, "left_semi").groupBy(*ENTRY, "priority").agg(F.max_by("state", "round").alias("state")).where("state <> 'moved'")
    met = asked.join(known.withColumnRenamed("priority", "was"), ENTRY, "left").where("was IS NULL OR priority < was")
    change = lambda priority, state: F.struct(F.col(priority).alias("priority"), state.alias("state"))
    nearer = F.array(change("priority", F.col("state")), change("was", F.lit("moved")))
    changes = met.select(*ENTRY, F.explode(F.when(F.col("was").isNull(), F.array(change("priority", F.lit("pending")))).otherwise(nearer)).alias("c"))
    return changes.select(*ENTRY, "c.priority", "c.state")


def _judged(due: DataFrame, blocked: DataFrame, sources: Sources, albums: bool) -> DataFrame:
    """Entries that are due with their new state, and whether there may be albums among them."""
    skipped = blocked_entries(due, blocked, sources.albums if albums else None).withColumn("skipped", F.lit(True))
    dead = sources.dead.select(*ENTRY).distinct().withColumn("dead", F.lit(True)) if sources.dead is not None else None
    out = due.join(skipped.distinct(), ENTRY, "left")
    out = out.join(dead, ENTRY, "left") if dead is not None else out.withColumn("dead", F.lit(None).cast("boolean"))
    odd = (F.col("kind") == "artist") & F.col("ref_id").try_cast("long").isNull()
    return out.select(*ENTRY, "priority", F.when(F.col("skipped"), "skipped").when(odd | F.col("dead"), "failed").otherwise("done").alias("state"))


def _asked(kind: str, rows: DataFrame, column: str, priority: int) -> DataFrame:
    return rows.select(F.lit(kind).alias("kind"), F.col(column).cast("string").alias("ref_id"), F.lit(priority).cast("long").alias("priority")).distinct()


def step(log: CrawlLog, blocked: DataFrame, sources: Sources, max_distance: int, max_tracks: int | None = None) -> bool:
    """One round: the pending artists (and other kinds) of the least priority, or if there are none
    its albums. False when nothing is left to do or there are `max_tracks` tracks."""
    at = log.next_round()
    count = log.tracks().count() if max_tracks is not None else 0
    if max_tracks is not None and count >= max_tracks:
        return False
    least = log.entries().where("state = 'pending'").agg(F.min("priority")).head()[0]
    if least is None:
        return False
    if least > max_distance:
        beyond = log.entries().where("state = 'pending'").withColumn("state", F.lit("skipped"))
        log.commit(beyond, None, at)
        return False
    pending = log.entries(least).where("state = 'pending'")
    judged = checkpointed(_judged(pending.where("kind <> 'album'"), blocked, sources, albums=False))
    if not judged.isEmpty():
        own = judged.where("kind = 'artist' AND state = 'done'").select(F.col("ref_id").cast("long").alias("artist_id"))
        asked = _asked("album", sources.artist_albums.join(own, "artist_id", "left_semi"), "album_id", least)
        if least < max_distance:
            near = sources.similar.join(own, "artist_id", "left_semi").select(F.col("similar_id").alias("artist_id"))
            asked = asked.unionByName(_asked("artist", near.join(blocked.select("artist_id"), "artist_id", "left_anti"), "artist_id", least + 1))
        log.commit(judged.unionByName(_new(log, asked)), None, at)
        return True
    judged = checkpointed(_judged(pending, blocked, sources, albums=True))
    stopped = False
    if max_tracks is not None:
        wanted = judged.where("state = 'done'").select("ref_id")
        new = sources.album_tracks.select(F.col("album_id").cast("string").alias("ref_id"), "track_id").join(log.tracks(), "track_id", "left_anti")
        counts = wanted.join(new.groupBy("ref_id").agg(F.count("*").alias("n")), "ref_id", "left").fillna(0, ["n"])
        late = checkpointed(running_total(counts, ["ref_id"], "n", "upto").where(F.col("upto") - F.col("n") + count >= max_tracks).select("ref_id"))
        stopped = not late.isEmpty()
        judged = judged.join(late, "ref_id", "left_anti")
    albums = judged.where("state = 'done'").select(F.col("ref_id").alias("_album"))
    found = sources.album_tracks.join(albums, F.col("album_id").cast("string") == F.col("_album"), "left_semi")
    log.commit(judged, found.select("track_id", "album_id", F.lit(least).cast("long").alias("seed_distance")), at)
    return not stopped


def run(log: CrawlLog, blocked: DataFrame, sources: Sources, max_distance: int, max_tracks: int | None = None, rounds: int | None = None) -> None:
    """Rounds until nothing is left, or so many. A crawl that was stopped at any place is run again the same way."""
    done = 0
    while (rounds is None or done < rounds) and step(log, blocked, sources, max_distance, max_tracks):
        done += 1
        if len(log.rounds()) > MANY:
            log.compact()
