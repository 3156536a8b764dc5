"""Joins, filters and ranked lists of the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orbweave.session import checkpointed


def not_blocked(rows: DataFrame, blocked: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't blocked; a null key stays. AQE broadcasts a small list."""
    return rows.join(blocked.select(key).distinct(), key, "left_anti")


def pending(tracks: DataFrame, features: DataFrame, failures: DataFrame, key: str, version: str) -> DataFrame:
    """Tracks without a feature row of the current version and without a failure."""
    done = features.where(F.col("version") == version).select(key).distinct()
    return tracks.join(done, key, "left_anti").join(failures.select(key).distinct(), key, "left_anti")


def counted(parts: dict[str, DataFrame]) -> DataFrame:
    """One row for each named table, with its count."""
    out = None
    for name, df in parts.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def first_by(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def resolve(artists: DataFrame, tracks: DataFrame, text: str, limit: int = 25) -> DataFrame:
    """Artists by id if the text is one that exists, else by name (ignoring case),
    those with most tracks first. Only the found ones meet the tracks."""
    number = int(text) if text.isascii() and text.isdigit() else None
    found = artists.where(F.col("id") == number) if number is not None else None
    if found is None or not found.head(1):
        found = artists.where(F.col("name").ilike(f"%{text}%"))
    counts = found.join(tracks.select(F.col("artist_id").alias("id"), F.lit(1).alias("one")), "id", "left").groupBy("id", "name").agg(F.count("one").alias("tracks"))
    return counts.orderBy(F.desc("tracks"), "name", "id").limit(limit)


def _ranges(df: DataFrame, order: list[Column | str], weight: Column) -> DataFrame:
    """The rows in sorted ranges: their place from 0 in their range (_at), the range
    (_part) and the sum of weights in the ranges before, of which the driver gets one for each partition."""
    parts = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    parts = parts.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1))
    before, total = [], 0
    for part, n in sorted(map(tuple, parts.groupBy("_part").agg(F.sum(weight)).collect())):
        before.append((part, total))
        total += n
    offsets = df.sparkSession.createDataFrame(before, "_part long, _before long")
    return parts.join(F.broadcast(offsets), "_part")


def numbered(df: DataFrame, order: list[Column | str], place: str) -> DataFrame:
    """A number from 1 for each row in an order, by sorted ranges and their counts."""
    return _ranges(df, order, F.lit(1).cast("long")).withColumn(place, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def running_total(df: DataFrame, order: list[Column | str], value: str, total: str) -> DataFrame:
    """The sum of a whole number up to each row in an order, by sorted ranges and their sums."""
    by = Window.partitionBy("_part").orderBy("_at")
    return _ranges(df, order, F.col(value).cast("long")).withColumn(total, F.col("_before") + F.sum(value).over(by)).drop("_part", "_at", "_before")


def mixed_list(kinds: list[DataFrame]) -> DataFrame:
    """Rows (id, label) of several kinds in one list: kind by kind, by id."""
    every = None
    for kind, rows in enumerate(kinds):
        one = rows.select(F.lit(kind).alias("kind"), "id", "label")
        every = one if every is None else every.unionByName(one)
    return numbered(every, ["kind", "id"], "place")


def sorted_list(df: DataFrame, key: Column, descending: bool, place: str) -> DataFrame:
    """A place for each row by a key: nulls last either way, ties in the given order."""
    return numbered(df.withColumn("_key", key), [F.col("_key").desc_nulls_last() if descending else F.col("_key").asc_nulls_last(), place], "sorted").drop("_key")


def groups_of(rows: DataFrame, key: str, rank: str, place: str) -> DataFrame:
    """The groups of ranked rows: least rank and place, and the first row's label."""
    return rows.groupBy(key).agg(F.min(rank).alias("rank"), F.min(place).alias("place"), F.count("*").alias("n"), F.min_by("label", place).alias("label"))


def pending_first(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """Tracks in the order they are to be analysed: the nearest first, then by id."""
    ordered = rows.orderBy("seed_distance", "track_id")
    return ordered if limit is None else ordered.limit(limit)


def liked_only(rows: DataFrame, liked: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among the liked ones."""
    return rows.join(liked.select(key).distinct(), key, "left_semi")


def own_releases(rows: DataFrame, artist: int) -> DataFrame:
    """Releases filed under the artist, or under none."""
    return rows.where(F.col("artist_id").isNull() | (F.col("artist_id") == artist))


def by_year(releases: DataFrame, artist: int) -> DataFrame:
    """An artist's own releases, the latest year first, else in the order they came (place)."""
    return own_releases(releases, artist).orderBy(F.coalesce("year", F.lit("")).desc(), "place")


def places_left(rows: DataFrame, known: DataFrame, key: str, order: list[Column | str]) -> DataFrame:
    """Rows that aren't known, with their place from 0 in the whole list."""
    return numbered(rows, order, "place").withColumn("place", F.col("place") - 1).join(known.select(key).distinct(), key, "left_anti")


def laid_out(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("x").isNotNull() & F.col("y").isNotNull())


def queue_additions(added: DataFrame, queue: DataFrame, key: str, place: str) -> DataFrame:
    """What isn't in the queue yet, the first of each key."""
    return first_by(added.join(queue.select(key).distinct(), key, "left_anti"), [key], [F.col(place)])


def point_labels(ids: DataFrame, tracks: DataFrame) -> DataFrame:
    """(track_id, label, bpm): `Artist - Title`, or the id itself and a null tempo for one that isn't known."""
    known = tracks.select("track_id", F.concat_ws(" - ", F.coalesce("artist", F.lit("")), F.coalesce("title", F.lit(""))).alias("label"), "bpm")
    return ids.join(known, "track_id", "left").withColumn("label", F.coalesce("label", F.col("track_id").cast("string")))


def blocked_list(blocked: DataFrame) -> DataFrame:
    return blocked.orderBy(F.lower("name"), "artist_id")


def matching_blocks(blocked: DataFrame, needle: str) -> DataFrame:
    """Blocks of exactly that artist id, or whose name holds the text, ignoring case."""
    return blocked.where((F.col("artist_id").cast("string") == needle) | F.contains(F.lower("name"), F.lit(needle.lower())))


def analysed(tracks: DataFrame, features: DataFrame, albums: DataFrame, blocked: DataFrame, width: int) -> DataFrame:
    """Tracks that have a vector of that width and whose artist isn't blocked, with
    their features and, where there is one, their album's release date; by id."""
    met = tracks.join(features, "track_id").join(albums.select("album_id", "release_date"), "album_id", "left")
    return not_blocked(met, blocked, "artist_id").where(F.col("clap").isNotNull() & (F.size("clap") == width)).orderBy("track_id")
