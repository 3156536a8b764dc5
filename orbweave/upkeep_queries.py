"""Queries over payloads, lists, the crawl and changes to the catalogue, and their SQL.

Customers are artists (blocked with a negative balance), orders albums, line items
tracks, numbered l_orderkey * 10 + l_linenumber.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.catalogue_queries import indexed_points, part_index
from orbweave.functions import expr, vectors
from orbweave.operators import crawl, map2d, map_index, merge, relational
from orbweave.plans.derived import digest, files_version
from orbweave.plans.space import WIDTH, space
from orbweave.operators.relational import numbered
from orbweave.registry import query
from orbweave.session import checkpointed, shared_folder, table
from orbweave.sources import store, tables
from orbweave.streaming import crawl_log

# --- payloads ------------------------------------------------------------

_PAYLOAD = """WITH p AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '{"id":' || user_id || '}' WHEN 1 THEN '{"id":"' || user_id || '"}' WHEN 2 THEN '{"id":"x' || user_id || '"}'
  WHEN 3 THEN '{"id":true}' WHEN 4 THEN '{"id":""}' ELSE '{}' END AS payload FROM events)"""


@query(_PAYLOAD + """ SELECT event_id, CASE WHEN json_type(payload, '$.id') IN ('UBIGINT', 'VARCHAR') THEN try_cast(payload->>'$.id' AS BIGINT) END AS number_id,
  CASE WHEN json_type(payload, '$.id') IN ('UBIGINT', 'VARCHAR') THEN nullif(payload->>'$.id', '') END AS text_id FROM p""")
def payload_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, user = F.col("event_id") % 6, F.col("user_id").cast("string")
    wrap = lambda a, b: F.concat(F.lit(a), user, F.lit(b))
    payload = F.when(i == 0, wrap('{"id":', "}")).when(i == 1, wrap('{"id":"', '"}')).when(i == 2, wrap('{"id":"x', '"}')).when(i == 3, '{"id":true}').when(i == 4, '{"id":""}').otherwise("{}")
    rows = table(spark, sf_dir, "events").select("event_id", payload.alias("payload"))
    return rows.select("event_id", expr.number_id(F.col("payload"), "$.id").alias("number_id"), expr.text_id(F.col("payload"), "$.id").alias("text_id"))


@query(f"""
WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'P' || o_custkey WHEN o_orderkey % 3 = 0 THEN '' END AS performer, CASE WHEN o_orderkey % 5 = 0 THEN 'A' || o_custkey END AS artist,
  CASE o_orderkey % 4 WHEN 0 THEN '{{"image":"u' || o_custkey || '"}}' WHEN 1 THEN '{{"image":{{"mega":"m","large":"l","small":""}}}}' WHEN 2 THEN '{{"images":{{"portrait":{{"hash":"h' || o_custkey || '"}}}}}}' ELSE '{{"image":3}}' END AS payload, * FROM orders)
SELECT k AS o_orderkey, coalesce(nullif(performer, ''), nullif(artist, ''), 'Unknown Artist') AS artist,
  CASE WHEN performer <> '' THEN o_custkey WHEN artist <> '' THEN o_custkey + 1 END AS artist_id,
  CASE k % 4 WHEN 0 THEN 'u' || o_custkey WHEN 1 THEN 'l' WHEN 2 THEN '{expr.PORTRAITS}h' || o_custkey || '.jpg' END AS image,
  coalesce(nullif(CASE WHEN k % 7 = 0 THEN '' END, ''), CASE WHEN k % 3 = 0 THEN o_orderstatus END, o_orderpriority) AS released,
  strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+00:00') AS at, md5(o_orderpriority) AS md5, sha256(o_orderpriority) AS sha256, o_orderpriority || ' music' AS prompt,
  CASE WHEN o_custkey % 7 > 0 THEN least(floor(CASE WHEN (o_custkey % 7) * 60 > 90 THEN ((o_custkey % 7) * 60 - 90) / 2.0 ELSE 0 END * (k * 1000 / ((o_custkey % 7) * 60.0)::double)), k * 1000) ELSE 0 END::bigint AS first_byte,
  CASE WHEN o_custkey % 7 > 0 THEN least(floor(CASE WHEN (o_custkey % 7) * 60 > 90 THEN ((o_custkey % 7) * 60 - 90) / 2.0 ELSE 0 END * (k * 1000 / ((o_custkey % 7) * 60.0)::double)) + floor(93.0::double * (k * 1000 / ((o_custkey % 7) * 60.0)::double)), k * 1000) ELSE k * 1000 END::bigint AS last_byte
FROM o""")
def payload_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda a, b="": F.concat(F.lit(a), c.cast("string"), F.lit(b))
    performer, artist = F.when(k % 2 == 0, text("P")).when(k % 3 == 0, ""), F.when(k % 5 == 0, text("A"))
    payload = (
        F.when(k % 4 == 0, text('{"image":"u', '"}')).when(k % 4 == 1, '{"image":{"mega":"m","large":"l","small":""}}')
        .when(k % 4 == 2, text('{"images":{"portrait":{"hash":"h', '"}}}')).otherwise('{"image":3}')
    )
    rows = table(spark, sf_dir, "orders").withColumns({"found": expr.first_artist((performer, c), (artist, c + 1)), "payload": payload, "window": expr.byte_window(k * 1000, (c % 7) * 60)})
    return rows.select(
        k, "found.name", "found.id", expr.image(F.col("payload")).alias("image"), expr.first_known(F.when(k % 7 == 0, ""), F.when(k % 3 == 0, F.col("o_orderstatus")), F.col("o_orderpriority")).alias("released"),
        expr.utc_text(F.col("o_orderdate")).alias("at"), expr.digest(F.col("o_orderpriority")).alias("md5"), expr.token_hash(F.col("o_orderpriority")).alias("sha256"), expr.style_prompt(F.col("o_orderpriority")).alias("prompt"),
        F.col("window.start").alias("first_byte"), F.col("window.end").alias("last_byte"),
    ).withColumnsRenamed({"name": "artist", "id": "artist_id"})


@query("""
SELECT p_partkey FROM part WHERE contains(lower(p_name), '1') AND contains(lower(p_name), 'p')
  OR NOT ((contains(lower(p_brand), '1') OR contains(lower(p_name), '1') OR contains(lower(p_type), '1')) AND (contains(lower(p_brand), 'p') OR contains(lower(p_name), 'p') OR contains(lower(p_type), 'p')))""")
def remote_hits_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(expr.worth_keeping("1 P", F.col("p_brand"), F.col("p_name"), F.col("p_type"))).select("p_partkey")


# --- lists ---------------------------------------------------------------


def _blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("artist_id"), F.col("c_name").alias("name"))


def _albums(spark: SparkSession, sf_dir: str) -> DataFrame:
    artist = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("album_id"), artist.alias("artist_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("release_date"))


def _tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a track; the line items' key isn't unique."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("track_id"), F.col("l_orderkey").alias("album_id")).distinct()
    return rows.join(_albums(spark, sf_dir).select("album_id", "artist_id"), "album_id", "left")


_ALBUMS = "albums AS (SELECT o_orderkey AS album_id, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS artist_id, strftime(o_orderdate, '%Y-%m-%d') AS release_date FROM orders)"
_TRACKS = _ALBUMS + ", tracks AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS track_id, l_orderkey AS album_id, artist_id FROM lineitem LEFT JOIN albums ON album_id = l_orderkey)"


@query("SELECT o_orderkey AS album_id, (row_number() OVER (ORDER BY o_orderkey) - 1) AS place FROM orders QUALIFY o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def remote_only_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places are those of the whole list."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("album_id"), F.col("o_custkey").alias("artist_id"))
    return relational.places_left(rows, _blocked(spark, sf_dir), "artist_id", ["album_id"]).select("album_id", "place")


@query(f"WITH {_ALBUMS} SELECT album_id, left(release_date, 4) AS year FROM albums WHERE artist_id IS NULL OR artist_id = 7 ORDER BY year DESC, album_id")
def discography(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _albums(spark, sf_dir).withColumn("year", expr.year_label(F.col("release_date"))).withColumn("place", F.col("album_id"))
    return relational.by_year(rows, 7).select("album_id", "year")


@query(f"WITH {_TRACKS} SELECT track_id FROM tracks WHERE album_id IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 200000)")
def liked_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    liked = table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_orderkey").alias("album_id"))
    return relational.liked_only(_tracks(spark, sf_dir), liked, "album_id").select("track_id")


@query("SELECT user_id, min(event_id) AS event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_id % 10 = 0) GROUP BY user_id")
def queue_additions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id")
    return relational.queue_additions(events, events.where("event_id % 10 = 0"), "user_id", "event_id").select("user_id", "event_id")


@query("SELECT c_custkey AS artist_id, c_name AS name FROM customer WHERE c_acctbal < 0 AND (c_custkey::varchar = '11' OR contains(lower(c_name), '11')) ORDER BY lower(c_name), artist_id")
def unblock_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.blocked_list(relational.matching_blocks(_blocked(spark, sf_dir), "11"))


@query("""SELECT vec_id + 3 AS track_id, CASE WHEN v.vec_id + 3 IN (SELECT vec_id FROM embeddings) THEN (SELECT label::varchar || ' - ' || 'T' || e.vec_id FROM embeddings e WHERE e.vec_id = v.vec_id + 3) ELSE (vec_id + 3)::varchar END AS label,
  CASE WHEN v.vec_id + 3 IN (SELECT vec_id FROM embeddings) THEN 70.0 + (v.vec_id + 3) % 70 END::double AS bpm FROM embeddings v""")
def point_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = space(spark, sf_dir, blocked=False).select("track_id", F.col("artist_id").cast("string").alias("artist"), F.concat(F.lit("T"), F.col("track_id")).alias("title"), "bpm")
    return relational.point_labels(rows.select((F.col("track_id") + 3).alias("track_id")), rows)


@query(f"""
WITH {_TRACKS} SELECT track_id, album_id, release_date FROM tracks LEFT JOIN albums USING (album_id)
WHERE track_id % 3 <> 0 AND track_id % 5 <> 0 AND (tracks.artist_id IS NULL OR tracks.artist_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0))""")
def analysed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third track has no vector, every fifth one of another width."""
    tracks = _tracks(spark, sf_dir)
    clap = F.when(F.col("track_id") % 5 == 0, F.array(F.lit(1.0))).when(F.col("track_id") % 3 != 0, F.array(F.lit(1.0), F.lit(2.0)))
    return relational.analysed(tracks, tracks.select("track_id", clap.alias("clap")), _albums(spark, sf_dir), _blocked(spark, sf_dir), 2).select("track_id", "album_id", "release_date")


@query(f"""
WITH {_TRACKS} SELECT track_id, track_id % 11 AS seed_distance FROM tracks WHERE track_id % 3 = 0 ORDER BY seed_distance, track_id LIMIT 500""")
def pending_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 500 to be analysed."""
    rows = _tracks(spark, sf_dir).where("track_id % 3 = 0").select("track_id", (F.col("track_id") % 11).alias("seed_distance"))
    return relational.pending_first(rows, 500)


# --- crawl ---------------------------------------------------------------

#: Every artist has two similar ones, found by arithmetic on its id.
_SIMILAR = "near AS (SELECT c_custkey AS a, c_custkey * 3 % n + 1 AS b FROM customer, (SELECT count(*) AS n FROM customer) UNION ALL SELECT c_custkey, c_custkey * 5 % n + 1 FROM customer, (SELECT count(*) AS n FROM customer))"
_CRAWL = f"""
WITH RECURSIVE {_SIMILAR}, blocked AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal < 0),
reach AS (SELECT c_custkey AS id, 0 AS d FROM customer WHERE c_custkey % 37 = 0
  UNION SELECT b, d + 1 FROM reach JOIN near ON a = reach.id WHERE d < 2 AND reach.id NOT IN (FROM blocked) AND b NOT IN (FROM blocked)),
artists AS (SELECT id, min(d) AS d FROM reach GROUP BY id), open_ AS (SELECT * FROM artists WHERE id NOT IN (FROM blocked)),
found AS (SELECT o_orderkey AS id, d, o_custkey FROM orders JOIN open_ ON o_custkey = open_.id)"""


def _crawled(spark: SparkSession, sf_dir: str) -> crawl_log.CrawlLog:
    """The crawl's log in the shared folder; a crawl that is there goes on, or is at its end."""
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    n = customers.count()
    near = customers.select(F.col("c_custkey").alias("artist_id"), F.explode(F.array(*(F.col("c_custkey") * k % n + 1 for k in (3, 5)))).alias("similar_id"))
    albums = orders.select(F.col("o_custkey").alias("artist_id"), F.col("o_orderkey").alias("album_id"))
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("album_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("track_id"))
    seeds = customers.where("c_custkey % 37 = 0").select(F.lit("artist").alias("kind"), F.col("c_custkey").cast("string").alias("ref_id"), F.lit(0).cast("long").alias("priority"))
    version = digest("crawl", *(files_version(spark, f"{sf_dir}/{name}.parquet") for name in ("customer", "orders", "lineitem")))
    log = crawl_log.CrawlLog(spark, f"{shared_folder(spark)}/derived/crawl-{version}")
    if not log.rounds():
        crawl_log.seed(log, seeds)
    crawl_log.run(log, _blocked(spark, sf_dir), crawl.Sources(albums, near, albums, items), 2)
    return log


@query(_CRAWL + """ SELECT 'artist' AS kind, id::varchar AS ref_id, d::bigint AS priority, CASE WHEN id IN (FROM blocked) THEN 'skipped' ELSE 'done' END AS state FROM artists
  UNION ALL SELECT 'album', id::varchar, d, 'done' FROM found""")
def crawl_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _crawled(spark, sf_dir).entries()


@query(_CRAWL + " SELECT DISTINCT l_orderkey * 10 + l_linenumber AS track_id, l_orderkey AS album_id, d::bigint AS seed_distance FROM lineitem JOIN found ON id = l_orderkey")
def crawl_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _crawled(spark, sf_dir).tracks().withColumn("album_id", F.col("album_id").cast("long"))


@query(_CRAWL + """ SELECT outcome, n FROM (SELECT 'artists_expanded' AS outcome, count(*) AS n FROM open_ UNION ALL SELECT 'albums_expanded', count(*) FROM found
  UNION ALL SELECT 'blocked_skipped', count(*) FROM artists WHERE id IN (FROM blocked)) WHERE n > 0""")
def crawl_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.stats(_crawled(spark, sf_dir).entries())


# --- changes -------------------------------------------------------------


def _catalogue(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    tracks = checkpointed(_tracks(spark, sf_dir))
    return {
        "tracks": tracks, "albums": _albums(spark, sf_dir), "features": tracks.where("track_id % 2 = 0").select("track_id"), "layout": tracks.where("track_id % 3 = 0").select("track_id"),
        "failures": tracks.where("track_id % 5 = 0").select("track_id"),
        "frontier": table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 2 == 0, "artist").otherwise("album").alias("kind"), F.col("c_custkey").cast("string").alias("ref_id")),
    }


@query(f"""
WITH {_TRACKS}, b AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal < 0), owned AS (SELECT track_id FROM tracks WHERE artist_id IN (FROM b))
SELECT 'features' AS what, count(*) AS removed FROM owned WHERE track_id % 2 = 0 UNION ALL SELECT 'layout', count(*) FROM owned WHERE track_id % 3 = 0
UNION ALL SELECT 'failures', count(*) FROM owned WHERE track_id % 5 = 0 UNION ALL SELECT 'tracks', count(*) FROM owned
UNION ALL SELECT 'albums', count(*) FROM albums WHERE artist_id IN (FROM b) UNION ALL SELECT 'frontier', count(*) FROM b WHERE id % 2 = 0""")
def purge_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.purge_artists(_catalogue(spark, sf_dir), _blocked(spark, sf_dir))[1]


@query(f"""
WITH {_TRACKS}, b AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal < 0)
SELECT track_id FROM tracks WHERE track_id % 2 = 0 AND (artist_id IS NULL OR artist_id NOT IN (FROM b))""")
def purged_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.purge_artists(_catalogue(spark, sf_dir), _blocked(spark, sf_dir))[0]["features"]


@query("""
WITH asked AS (SELECT user_id AS id, arg_max('n' || event_id, event_id) FILTER (event_id % 3 <> 0) AS name, arg_max('r' || event_id, event_id) FILTER (event_id % 4 = 0) AS reason, min(event_id)::varchar AS first FROM events GROUP BY user_id),
known AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS reason, '0' AS at FROM customer WHERE c_acctbal < 0)
SELECT coalesce(asked.id, known.id) AS artist_id, coalesce(asked.name, known.name) AS name, coalesce(asked.reason, known.reason) AS reason, coalesce(known.at, asked.first) AS blocked_at
FROM asked FULL JOIN known ON asked.id = known.id""")
def block_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("artist_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("reason"), F.lit("0").alias("blocked_at"))
    e = F.col("event_id")
    asked = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("artist_id"), F.when(e % 3 != 0, F.concat(F.lit("n"), e)).alias("name"), F.when(e % 4 == 0, F.concat(F.lit("r"), e)).alias("reason"), e.cast("string").alias("blocked_at"), e.alias("seq"))
    none = spark.createDataFrame([], "kind string, ref_id string")
    return merge.block(known, none, asked, "seq")[0]


@query("""
WITH last AS (SELECT user_id, arg_max(event_type, event_id) AS stage, left(arg_max(repeat(event_type, 60), event_id), 500) AS reason FROM events GROUP BY user_id),
known AS (SELECT c_custkey, 'old' AS stage, c_name AS reason FROM customer)
SELECT coalesce(user_id, c_custkey) AS track_id, coalesce(last.stage, known.stage) AS stage, coalesce(last.reason, known.reason) AS reason FROM last FULL JOIN known ON user_id = c_custkey""")
def failure_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("track_id"), F.lit("old").alias("stage"), F.col("c_name").alias("reason"))
    new = table(spark, sf_dir, "events").select(F.col("user_id").alias("track_id"), F.col("event_type").alias("stage"), F.repeat("event_type", F.lit(60)).alias("reason"), F.col("event_id").alias("seq"))
    return merge.record_failures(known, new, "seq")


# --- map -----------------------------------------------------------------


@query("""
WITH p AS (SELECT vec_id AS track_id, embedding[1]::double AS x, embedding[2]::double AS y FROM embeddings WHERE vec_id % 9 <> 0),
b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p), s AS (SELECT *, least(1140 / greatest(x1 - x0, 1e-6), 740 / greatest(y1 - y0, 1e-6)) AS scale FROM b)
SELECT track_id, round(x * scale + 30 - x0 * scale, 6) AS sx, round(y * scale + 30 - y0 * scale, 6) AS sy FROM p, s""")
def map_on_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points fitted to a view of 1200 by 800; those without a place are left out."""
    place = lambda i: F.when(F.col("vec_id") % 9 != 0, F.col("embedding")[i].cast("double"))
    points = relational.laid_out(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("track_id"), place(0).alias("x"), place(1).alias("y")))
    return map2d.fitted(points, 1200, 800).select("track_id", F.round("sx", 6).alias("sx"), F.round("sy", 6).alias("sy"))


@query("""
SELECT label AS genre, min(vec_id) AS first, (row_number() OVER (ORDER BY min(vec_id)) - 1)::int AS code, count(*) AS n FROM embeddings GROUP BY label""")
def map_legend(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("genre"), F.col("vec_id").alias("place"))
    return map2d.legend(rows, "genre", "place")


@query("""
SELECT i AS step, vec_id * 1 AS track_id, (SELECT count(*) FROM embeddings f WHERE f.vec_id < e.vec_id) AS place
FROM (SELECT unnest(range(8)) AS i, unnest([3, 999999999, 12, 40, 7, -1, 3, 100]) AS asked) r JOIN embeddings e ON vec_id = asked""")
def route_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of a route as places in the list of points; ids that aren't known are left out."""
    asked = [3, 999999999, 12, 40, 7, -1, 3, 100]
    route = spark.createDataFrame(list(enumerate(asked)), "step long, track_id long")
    points = relational.numbered(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("track_id")), ["track_id"], "place")
    return map2d.route_places(route, points.withColumn("place", F.col("place") - 1))


@query("""
WITH found AS (SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey = 7)
SELECT id, name, count(o_orderkey) AS tracks FROM found LEFT JOIN orders ON o_custkey = id GROUP BY ALL""")
def resolve_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text that is an existing id names that artist alone."""
    artists = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return relational.resolve(artists, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("artist_id")), "7")


@query("SELECT p_partkey, left(p_brand, 4) AS year FROM part WHERE contains(lower(p_name), 'e') AND contains(lower(p_name), 't')")
def title_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = part_index(spark, sf_dir, "p_name").search(" E T ").select("p_partkey")
    return table(spark, sf_dir, "part").join(found, "p_partkey").select("p_partkey", expr.year_label(F.col("p_brand")).alias("year"))


@query("SELECT vec_id AS track_id FROM embeddings WHERE embedding[1]::double BETWEEN -0.1 AND 0.1 AND embedding[2]::double BETWEEN -0.1 AND 0.1")
def map_rectangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_index.rectangle(*indexed_points(spark, sf_dir), -0.1, -0.1, 0.1, 0.1).select("track_id")


@query("""
SELECT o_orderkey AS row_idx, o_orderkey * 2 AS track_id, coalesce(p_name, '<missing ' || o_orderkey * 2 || '>') AS title, CASE WHEN p_partkey IS NULL THEN 0 ELSE p_size END AS artist_id
FROM orders LEFT JOIN part ON p_partkey = o_orderkey * 2""")
def catalogue_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_idx"), (F.col("o_orderkey") * 2).alias("track_id"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("track_id"), F.col("p_name").alias("title"), F.col("p_size").alias("artist_id"))
    return tables.in_order(ids, rows, {"artist_id": 0})


@query("""
WITH new AS (SELECT user_id AS track_id, arg_max(event_type, (ts, event_id)) AS version FROM events GROUP BY user_id)
SELECT coalesce(new.track_id, c_custkey) AS track_id, coalesce(version, c_mktsegment) AS version FROM new FULL JOIN customer ON c_custkey = new.track_id""")
def features_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("track_id"), F.col("c_mktsegment").alias("version"))
    new = table(spark, sf_dir, "events").select(F.col("user_id").alias("track_id"), F.col("event_type").alias("version"), F.struct("ts", "event_id").alias("seq"))
    return merge.record_features(known, known.select("track_id"), new, "seq")[0]


@query("""
WITH new AS (SELECT DISTINCT user_id FROM events) SELECT c_custkey AS track_id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM new)""")
def failures_cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures that are left when new features come in."""
    failures = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("track_id"))
    new = table(spark, sf_dir, "events").select(F.col("user_id").alias("track_id"), F.col("event_type").alias("version"), F.col("event_id").alias("seq"))
    return merge.record_features(new.drop("seq").limit(0), failures, new, "seq")[1]


@query("SELECT vec_id AS track_id, i::int AS dim, round(0.75 * embedding[i + 1]::double + 0.25 * embedding[64 - i]::double, 6) AS x FROM embeddings, range(64) t(i)")
def between_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the way from each row to its reverse."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("track_id"), vectors.doubles(F.col("embedding")).alias("v"))
    cells = rows.select("track_id", F.posexplode(vectors.interpolate(F.col("v"), F.reverse("v"), 0.25)).alias("dim", "x"))
    return cells.withColumn("x", F.round("x", 6))


@query("""
SELECT vec_id * 3 AS track_id, i::int AS dim, CASE WHEN vec_id * 3 IN (SELECT vec_id FROM embeddings) AND vec_id * 3 % 5 <> 0 THEN (SELECT e.embedding[i + 1]::double FROM embeddings e WHERE e.vec_id = o.vec_id * 3) ELSE 0 END AS x
FROM embeddings o, range(64) t(i)""")
def matrix_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of ids, as zeros where there is no vector or one of another width."""
    rows = table(spark, sf_dir, "embeddings")
    ids = rows.select(F.col("vec_id").alias("row_idx"), (F.col("vec_id") * 3).alias("track_id"))
    vec = F.when(F.col("vec_id") % 5 == 0, F.slice("embedding", 1, 3)).otherwise(F.col("embedding"))
    out = tables.matrix(ids, rows.select(F.col("vec_id").alias("track_id"), vec.alias("vec")), 64)
    return out.select("track_id", F.posexplode("vec").alias("dim", "x"))


# --- shelves, counts and stores -------------------------------------------


@query("SELECT c_custkey AS artist_id, c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def shelf_artists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shelf of artists without blocked ones."""
    artists = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("artist_id"), F.col("c_name").alias("name"))
    return relational.not_blocked(artists, _blocked(spark, sf_dir), "artist_id")


@query(f"""
WITH {_TRACKS}, blocked AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal < 0), shown AS (SELECT * FROM tracks WHERE artist_id IS NULL OR artist_id NOT IN (FROM blocked))
SELECT 'tracks' AS what, count(*) AS n FROM tracks UNION ALL SELECT 'analysed', count(*) FROM tracks WHERE track_id % 2 = 0
UNION ALL SELECT 'to_analyse', count(*) FROM shown WHERE track_id % 2 <> 0 AND track_id % 5 <> 0 UNION ALL SELECT 'failed', count(*) FROM tracks WHERE track_id % 5 = 0
UNION ALL SELECT 'pending', count(*) FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT 'buildable', count(*) FROM shown WHERE track_id % 4 = 0""")
def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six counts, each as its stage asks: what is analysed counts whoever it is of, what is to be analysed or built leaves blocked artists out."""
    tracks, blocked = checkpointed(_tracks(spark, sf_dir)), _blocked(spark, sf_dir)
    shown = relational.not_blocked(tracks, blocked, "artist_id")
    features = tracks.where("track_id % 2 = 0").select("track_id", F.lit("v1").alias("extractor_version"), F.when(F.col("track_id") % 4 == 0, F.lit(1)).alias("clap"))
    failures = tracks.where("track_id % 5 = 0").select("track_id")
    frontier = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 3 == 0, "pending").otherwise("done").alias("state"))
    pending = shown.join(features.select("track_id"), "track_id", "left_anti").join(failures, "track_id", "left_anti")
    return relational.counted({
        "tracks": tracks, "analysed": features, "to_analyse": pending, "failed": failures, "pending": frontier.where("state = 'pending'"),
        "buildable": shown.join(features.where("clap IS NOT NULL").select("track_id"), "track_id", "left_semi"),
    })


@query("SELECT c_custkey, row_number() OVER (ORDER BY CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END ASC NULLS LAST, c_custkey) AS sorted FROM customer")
def sort_nulls_last_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment"))
    return relational.sorted_list(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), key, False, "c_custkey").select("c_custkey", "sorted")


#: Rows of a search that are shown.
SEARCH_LIMIT = 50


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'e') ORDER BY p_partkey LIMIT 50")
def search_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_index(spark, sf_dir, "p_name").search("e").select("p_partkey").orderBy("p_partkey").limit(SEARCH_LIMIT)


@query("""SELECT event_id, list_filter(list_transform(string_split(event_type || ' ; ' || user_id || ';;' || CASE WHEN event_id % 3 = 0 THEN ' ' ELSE 'x' END, ';'), lambda c: trim(c)), lambda c: c <> '')::varchar AS credits FROM events""")
def credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("event_type", F.lit(" ; "), F.col("user_id").cast("string"), F.lit(";;"), F.when(F.col("event_id") % 3 == 0, " ").otherwise("x"))
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("["), F.array_join(expr.split_credits(text), ", "), F.lit("]")).alias("credits"))


@query("SELECT c_custkey AS artist_id, c_name AS name FROM customer WHERE c_acctbal < 0 AND c_custkey % 2 = 1")
def unblocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocked artists that are left when every other one is let back."""
    blocked = _blocked(spark, sf_dir)
    return merge.unblock(blocked, blocked.where("artist_id % 2 = 0"))


@query("""
SELECT user_id AS id, arg_max(event_type, (ts, event_id)) AS title, arg_max(event_type, (ts, event_id)) FILTER (event_id % 3 <> 0) AS genre, min(event_id % 11) AS seed_distance FROM events GROUP BY user_id""")
def track_upsert_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks as a store has them after three commits and a compaction."""
    e = table(spark, sf_dir, "events")
    changes = e.select(
        F.col("user_id").alias("id"), F.col("event_type").alias("title"), F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("genre"), (F.col("event_id") % 11).alias("seed_distance"),
        F.col("event_id"), "ts",
    )
    rows = checkpointed(numbered(changes, ["ts", "event_id"], "n"))
    last = rows.agg(F.max("n")).head()[0] or 0
    kept = store.Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", "id long, title string, genre string, seed_distance long", ["id"], {"overwrite": ["title"], "coalesce": ["genre"], "least": ["seed_distance"]})
    for part in range(3):
        own = rows.where((F.col("n") > part * last // 3) & (F.col("n") <= (part + 1) * last // 3)).drop("event_id", "ts")
        kept.commit(own, "n", kept.version())
        if part == 1:
            kept.compact()
    return kept.read()


@query("SELECT vec_id AS track_id, round(list_sum(embedding::double[]), 6) AS total, len(embedding) AS width FROM embeddings")
def published_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A space that is published twice and read again as its newest manifest describes it."""
    rows, folder = space(spark, sf_dir, blocked=False).select("track_id", "vec"), f"{shared_folder(spark)}/space-{uuid.uuid4().hex}"
    width = WIDTH // len(vectors.BLOCKS)
    blocks = [(name, i * width, (i + 1) * width, weight) for i, (name, weight) in enumerate(zip(vectors.BLOCKS, vectors.WEIGHTS, strict=True))]
    tables.publish(rows.limit(1), folder, blocks)
    tables.publish(rows, folder, blocks)
    return tables.load(spark, folder).select("track_id", F.round(F.aggregate("vec", F.lit(0.0), lambda t, x: t + x), 6).alias("total"), F.size("vec").cast("long").alias("width"))
