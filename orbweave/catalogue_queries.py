"""Queries over the catalogue's operators, and their SQL.

Test tables stand in for the catalogue: customers are artists (blocked with a
negative balance), orders tracks, line items features, embeddings the space.
"""

from __future__ import annotations

import hashlib
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orbweave.functions import expr, signal, vectors
from orbweave.operators import cells, knn, many_walks, map2d, map_index, merge, relational, rotation, search, walks
from orbweave.plans.derived import Navigator, files_version, map_of, search_index
from orbweave.plans.space import BLOCKED, WIDTH, space
from orbweave.registry import ORACLE_SQL, QUERIES, query  # noqa: F401
from orbweave.session import checkpointed, shared_folder, table
from orbweave.sources import tables
from orbweave.streaming import incremental

_SCALES = "[" + ", ".join(map(str, vectors.block_scales(WIDTH))) + "]::double[]"
_SPACE = f"""
scaled AS (SELECT vec_id AS track_id, label::bigint AS artist_id, floor(vec_id / 4)::bigint AS album_id, embedding::double[] AS vec,
    list_transform(range(1, {WIDTH + 1}), lambda i: embedding[i]::double * ({_SCALES})[i]) AS s FROM embeddings),
space AS (SELECT track_id, artist_id, album_id, vec, list_transform(s, lambda x: x / greatest(sqrt(list_dot_product(s, s)), 1e-9)) AS u FROM scaled)"""


# --- vectors -------------------------------------------------------------

_NEIGHBOURS = f"""
WITH {_SPACE}, q AS (SELECT u AS q, artist_id AS a FROM space WHERE track_id = 0),
scored AS (SELECT track_id, list_dot_product(u, q) / greatest(sqrt(list_dot_product(q, q)), 1e-9) AS similarity
    FROM space, q WHERE track_id <> 0 AND artist_id <> {BLOCKED} AND %s)
SELECT track_id, round(similarity, 6) AS similarity, row_number() OVER (ORDER BY round(similarity, 9) DESC, track_id)::int AS rank
FROM scored QUALIFY rank <= 10"""


def _nearest_to_first(spark: SparkSession, sf_dir: str, exclude_same_artist: bool = False) -> DataFrame:
    """The neighbours of row 0, which may itself be of the blocked artist."""
    found = knn.neighbours(space(spark, sf_dir, blocked=False), 0, 10, exclude_same_artist, space(spark, sf_dir))
    return found.withColumn("similarity", F.round("similarity", 6))


@query(_NEIGHBOURS % "true")
def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest_to_first(spark, sf_dir)


@query(_NEIGHBOURS % "artist_id <> a")
def neighbours_excl_artist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest_to_first(spark, sf_dir, exclude_same_artist=True)


@query(f"WITH {_SPACE} SELECT track_id, i::int AS dim, round(u[i + 1], 6) AS x FROM space, range({WIDTH}) t(i)")
def weighted_unit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return space(spark, sf_dir, blocked=False).select("track_id", F.posexplode("u").alias("dim", "x")).withColumn("x", F.round("x", 6))


@query(f"""
WITH {_SPACE}, pairs AS (SELECT a.track_id AS src, b.track_id AS dst, list_dot_product(a.u, b.u) AS similarity
    FROM space a, space b WHERE a.track_id <> b.track_id AND b.artist_id <> {BLOCKED})
SELECT src, dst, round(1 - similarity, 6) AS dist, row_number() OVER (PARTITION BY src ORDER BY round(similarity, 9) DESC, dst)::int AS rank
FROM pairs QUALIFY rank <= 8""")
def knn_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = space(spark, sf_dir, blocked=False)
    return knn.knn_graph(every, 8, every.where(F.col("artist_id") != BLOCKED)).withColumn("dist", F.round("dist", 6))


_RANKS = f"""
WITH {_SPACE}, pairs AS (SELECT a.track_id AS track_id, a.album_id = b.album_id AS same,
      row_number() OVER (PARTITION BY a.track_id ORDER BY round(list_dot_product(a.u, b.u), 9) DESC, b.track_id) AS n
    FROM space a, space b WHERE a.track_id <> b.track_id),
ranks AS (SELECT track_id, min(n)::bigint AS rank FROM pairs WHERE same GROUP BY track_id)"""


@query(_RANKS + " SELECT track_id, rank FROM ranks")
def evaluate_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.evaluate(space(spark, sf_dir, blocked=False))


@query(_RANKS + ", placed AS (SELECT rank, row_number() OVER (ORDER BY rank) - 1 AS i, count(*) OVER () AS n FROM ranks) SELECT count(*) AS n, round(avg((rank = 1)::int), 9) AS top_1, max(CASE WHEN i = n // 2 THEN rank END) AS median, round(avg(rank), 6) AS mean FROM placed")
def evaluate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median is the upper one."""
    return knn.rank_summary(knn.evaluate(space(spark, sf_dir, blocked=False)))


def _phrase(rows: DataFrame) -> list[float]:
    found = rows.where("track_id = 7").select("vec").head()
    return found["vec"] if found else [0.0] * WIDTH


_ANCHORS = f"""
WITH {_SPACE}, phrase AS (SELECT vec AS q FROM space WHERE track_id = 7),
anchors AS (SELECT track_id, u, list_dot_product(vec, q) AS score FROM space, phrase WHERE artist_id <> {BLOCKED} ORDER BY round(list_dot_product(vec, q), 9) DESC, track_id LIMIT 5)"""


@query(_ANCHORS + " SELECT track_id, round(score, 6) AS score FROM anchors")
def text_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrase = _phrase(space(spark, sf_dir, blocked=False))
    return walks.anchors(space(spark, sf_dir), phrase, 5, "vec").withColumn("score", F.round("score", 6))


@query(_ANCHORS + f" SELECT i::int AS dim, round(avg(u[i + 1]), 6) AS x FROM anchors, range({WIDTH}) t(i) GROUP BY i")
def text_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = space(spark, sf_dir)
    ids = walks.anchors(rows, _phrase(space(spark, sf_dir, blocked=False)), 5, "vec")
    cells = rows.join(ids.select("track_id"), "track_id", "left_semi").select(F.posexplode("u").alias("dim", "x"))
    return cells.groupBy("dim").agg(F.round(F.avg("x"), 6).alias("x"))


@query("""
WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS a, coalesce(CASE WHEN l_linenumber = 3 THEN NULL ELSE l_extendedprice END, 0) AS b FROM lineitem),
s AS (SELECT avg(a) ma, stddev_pop(a) sa, avg(b) mb, stddev_pop(b) sb FROM c),
z AS (SELECT c.*, (a - ma) / sa AS za, (b - mb) / sb AS zb FROM c, s)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(za / greatest(sqrt(za * za + zb * zb), 1e-9), 6) AS x, round(zb / greatest(sqrt(za * za + zb * zb), 1e-9), 6) AS y FROM z""")
def block_zscore_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("price", F.when(F.col("l_linenumber") != 3, F.col("l_extendedprice")))
    out = vectors.normalise_block(rows, ["l_quantity", "price"], "v")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("v")[0], 6).alias("x"), F.round(F.col("v")[1], 6).alias("y"))


@query("SELECT p_partkey, coalesce(CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice END, (SELECT median(p_retailprice) FROM part WHERE p_partkey % 7 <> 0), 0) AS price FROM part")
def impute_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 7 != 0, F.col("p_retailprice")).alias("price"))
    return vectors.impute(part, ["price"])


@query()
def pca_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = space(spark, sf_dir, blocked=False)
    mean, axes = vectors.fit_pca(rows, "vec", WIDTH, 8)
    return rows.select("track_id", F.posexplode(vectors.project(F.col("vec"), mean, axes)).alias("axis", "x")).withColumn("x", F.round("x", 6))


# --- scalars -------------------------------------------------------------


@query("SELECT p_partkey, CASE WHEN p_size * 7 > 0 THEN round(log2(p_size * 7.0) - floor(log2(p_size * 7.0 / 70)), 9) END AS folded FROM part")
def fold_bpm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(expr.fold_bpm(F.col("p_size") * 7.0), 9).alias("folded"))


@query("""
WITH k AS (SELECT p_partkey, ['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'][(p_partkey % 13 + 1)::int] AS key, p_size % 2 = 0 AS major, CASE WHEN p_size % 5 = 0 THEN 0.5 ELSE p_size / 50.0 END AS s, p_partkey % 13 AS i FROM part)
SELECT p_partkey, round(CASE WHEN i < 12 THEN cos(i * 7 % 12 * 2 * pi() / 12) * s ELSE 0 END, 6) + 0 AS fifths_cos, round(CASE WHEN i < 12 THEN sin(i * 7 % 12 * 2 * pi() / 12) * s ELSE 0 END, 6) + 0 AS fifths_sin, round(CASE WHEN i < 12 THEN CASE WHEN major THEN s ELSE -s END ELSE 0 END, 6) AS mode FROM k""")
def key_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.get(F.array(*map(F.lit, expr.PITCHES)), (F.col("p_partkey") % 13).cast("int"))
    scale, strength = F.when(F.col("p_size") % 2 == 0, "major").otherwise("minor"), F.when(F.col("p_size") % 5 != 0, F.col("p_size") / 50.0)
    at = table(spark, sf_dir, "part").select("p_partkey", expr.key_coordinates(key, scale, strength).alias("k"))
    return at.select("p_partkey", *[(F.round(f"k.{c}", 6) + 0.0).alias(c) for c in ("fifths_cos", "fifths_sin", "mode")])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN year(o_orderdate)::int END AS year FROM orders")
def release_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    date = F.when(F.col("o_orderkey") % 5 == 0, "n.d.").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, sf_dir, "orders").select("o_orderkey", expr.release_year(date).alias("year"))


@query("""
SELECT p_partkey, CASE WHEN p_size > 0 THEN (p_size * 11 // 60)::varchar || ':' || lpad((p_size * 11 % 60)::varchar, 2, '0') ELSE '' END AS duration,
  CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_name || ' (' || p_type || ')' END AS title,
  CASE WHEN p_partkey % 4 = 0 THEN p_name ELSE p_brand || ' - ' || p_name END AS label,
  CASE WHEN length(c) >= 4 THEN right(c, 2) || '/' || left(right(c, 4), 2) || '/' || c END AS cover,
  CASE WHEN p_partkey % 5 = 0 THEN 'id:' || p_partkey ELSE upper(trim(p_brand)) END AS recording,
  CASE WHEN p_size * 11.0 > 90 THEN (p_size * 11.0 - 90) / 2 ELSE 0 END AS start
FROM (SELECT *, regexp_replace(p_brand, '[^0-9A-Za-z]', '', 'g') AS c FROM part)""")
def text_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    return part.select(
        key, expr.duration_label(F.col("p_size") * 11).alias("duration"), expr.full_title(F.col("p_name"), F.when(key % 3 != 0, F.col("p_type"))).alias("title"),
        expr.artist_title(F.when(key % 4 != 0, F.col("p_brand")), F.col("p_name")).alias("label"), expr.cover_path(F.col("p_brand")).alias("cover"),
        expr.recording(F.when(key % 5 != 0, F.concat(F.lit(" "), F.lower("p_brand"))).otherwise(" "), key).alias("recording"), expr.excerpt_start(F.col("p_size") * 11.0).alias("start"),
    )


@query("""SELECT event_id, json_extract(props, '$.k')::double AS k, '{"k":' || json_extract(props, '$.k')::double || '}' AS slim FROM events""")
def slim_catalog_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", expr.json_number(F.col("props"), "$.k").alias("k"), expr.slim_json(F.col("props"), "k").alias("slim"))


@query("""SELECT event_id, event_id % 7 AS start, user_id % 7 AS target, event_id // 7 % 7 AS place,
  CASE WHEN event_id // 7 % 7 = event_id % 7 THEN user_id % 7 WHEN event_id % 7 < event_id // 7 % 7 AND event_id // 7 % 7 <= user_id % 7 THEN event_id // 7 % 7 - 1
    WHEN user_id % 7 <= event_id // 7 % 7 AND event_id // 7 % 7 < event_id % 7 THEN event_id // 7 % 7 + 1 ELSE event_id // 7 % 7 END AS moved FROM events""")
def queue_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event moves the item at `start` of a list of seven to `target`; where is the one at `place` then?"""
    e = table(spark, sf_dir, "events")
    cells = e.select("event_id", (F.col("event_id") % 7).alias("start"), (F.col("user_id") % 7).alias("target"), (F.floor(F.col("event_id") / 7) % 7).alias("place"))
    return cells.withColumn("moved", expr.moved_index(F.col("place"), F.col("start"), F.col("target")))


# --- relations -----------------------------------------------------------


@query("""
SELECT o_orderkey, coalesce(o_custkey, -1) AS artist_id, coalesce(c_name, '') AS artist, coalesce(n_name, '') AS nation, coalesce(r_name, '') AS region
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS o_custkey FROM orders) o
LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def catalog_left_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey")).alias("c_custkey"))
    nation = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey").withColumnRenamed("n_regionkey", "r_regionkey")
    every = orders.join(table(spark, sf_dir, "customer"), "c_custkey", "left").join(nation, "c_nationkey", "left").join(table(spark, sf_dir, "region"), "r_regionkey", "left")
    text = lambda c, name: F.coalesce(c, F.lit("")).alias(name)
    return every.select("o_orderkey", F.coalesce("c_custkey", F.lit(-1)).alias("artist_id"), text("c_name", "artist"), text("n_name", "nation"), text("r_name", "region"))


def _blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("artist_id"))


def _tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("track_id"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey")).alias("artist_id"))


@query("""
SELECT o_orderkey AS track_id, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS artist_id FROM orders
WHERE o_orderkey % 7 = 0 OR o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def not_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.not_blocked(_tracks(spark, sf_dir), _blocked(spark, sf_dir), "artist_id")


_PENDING = """
WITH pending AS (SELECT o_orderkey AS track_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag <> 'R') AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50))"""


def _pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    features = items.select(F.col("l_orderkey").alias("track_id"), F.when(F.col("l_returnflag") == "R", "v1").otherwise("v2").alias("version"))
    return relational.pending(_tracks(spark, sf_dir).select("track_id"), features, items.where("l_quantity >= 50").select(F.col("l_orderkey").alias("track_id")), "track_id", "v2")


@query(_PENDING + " SELECT track_id FROM pending")
def pending_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pending(spark, sf_dir)


@query(_PENDING + " SELECT count(*) AS n FROM pending")
def pending_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pending(spark, sf_dir).agg(F.count("*").alias("n"))


@query("""
SELECT 'artists' AS what, count(*) AS n FROM customer UNION ALL SELECT 'tracks', count(*) FROM orders UNION ALL SELECT 'blocked', count(*) FROM customer WHERE c_acctbal < 0
UNION ALL SELECT 'analysed', count(DISTINCT l_orderkey) FROM lineitem UNION ALL SELECT 'buildable', count(*) FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def corpus_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    analysed = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("track_id")).distinct()
    tracks = _tracks(spark, sf_dir)
    return relational.counted({
        "artists": table(spark, sf_dir, "customer"), "tracks": tracks, "blocked": _blocked(spark, sf_dir), "analysed": analysed, "buildable": tracks.join(analysed, "track_id", "left_semi"),
    })


@query("""
SELECT c_custkey AS id, c_name AS name, count(o_orderkey) AS tracks FROM customer LEFT JOIN orders ON c_custkey = o_custkey
WHERE c_name ILIKE '%r#00000001%' GROUP BY ALL ORDER BY tracks DESC, name, id LIMIT 25""")
def resolve_artist(spark: SparkSession, sf_dir: str) -> DataFrame:
    artists = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return relational.resolve(artists, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("artist_id")), "R#00000001")


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("id"), F.struct("ts", "event_id").alias("seq"), F.col("event_type").alias("title"), F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("genre"),
        (F.col("event_id") % 11).alias("seed_distance"), F.when(F.col("event_id") % 4 != 0, F.round("value", 6)).alias("blocked_at"),
    )


@query("""
SELECT user_id AS id, arg_max(event_type, (ts, event_id)) AS title, arg_max(event_type, (ts, event_id)) FILTER (event_id % 3 <> 0) AS genre, min(event_id % 11) AS seed_distance FROM events GROUP BY user_id""")
def track_upsert_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.fold(_changes(spark, sf_dir), ["id"], "seq", overwrite=["title"], coalesce=["genre"], least=["seed_distance"])


@query("""SELECT user_id AS id, arg_max(event_type, (ts, event_id)) FILTER (event_id % 3 <> 0) AS genre, arg_min(round(value, 6), (ts, event_id)) FILTER (event_id % 4 <> 0) AS blocked_at FROM events GROUP BY user_id""")
def block_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.fold(_changes(spark, sf_dir), ["id"], "seq", coalesce=["genre"], first=["blocked_at"])


_FRONTIER = """
WITH frontier AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'artist' ELSE 'album' END AS kind, user_id AS ref_id, min(event_id % 9 + user_id % 5) AS priority FROM events GROUP BY ALL)"""


def _frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    asked = e.select(F.when(F.col("event_id") % 2 == 0, "artist").otherwise("album").alias("kind"), F.col("user_id").alias("ref_id"), (F.col("event_id") % 9 + F.col("user_id") % 5).alias("priority"), F.col("event_id").alias("seq"))
    return merge.fold(asked, ["kind", "ref_id"], "seq", least=["priority"])


@query(_FRONTIER + " SELECT kind, ref_id, priority FROM frontier")
def frontier_enqueue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frontier(spark, sf_dir)


@query(_FRONTIER + " SELECT kind, ref_id, priority FROM frontier ORDER BY priority, kind DESC, ref_id LIMIT 1")
def frontier_pop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frontier(spark, sf_dir).orderBy("priority", F.desc("kind"), "ref_id").limit(1)


@query("""
SELECT 'features' AS what, count(*) AS removed FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0))
UNION ALL SELECT 'tracks', count(*) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
UNION ALL SELECT 'artists', count(*) FROM customer WHERE c_acctbal < 0""")
def purge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocked, orders = _blocked(spark, sf_dir), table(spark, sf_dir, "orders")
    owned = orders.join(blocked.withColumnRenamed("artist_id", "o_custkey"), "o_custkey", "left_semi").select("o_orderkey")
    _, features = merge.purge({"features": (table(spark, sf_dir, "lineitem"), "l_orderkey")}, owned, "o_orderkey")
    _, rest = merge.purge({"tracks": (orders, "o_custkey"), "artists": (table(spark, sf_dir, "customer"), "c_custkey")}, blocked, "artist_id")
    return features.unionByName(rest)


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) = 1""")
def dedup_recording(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return relational.first_by(rows, ["l_orderkey", "l_linenumber"], [F.col("l_partkey"), F.col("l_suppkey"), F.col("l_extendedprice")])


_FOUND = """
WITH found AS (SELECT p_partkey, p_brand, p_name, CASE WHEN starts_with(lower(p_name), '1') OR starts_with(lower(p_brand), '1') THEN 0 ELSE 1 END AS rank FROM part
    WHERE (contains(lower(p_name), '1') OR contains(lower(p_brand), '1')) AND (contains(lower(p_name), 'b') OR contains(lower(p_brand), 'b')))"""


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_index(spark, sf_dir, "p_name", "p_brand").search("1 B")


def part_index(spark: SparkSession, sf_dir: str, *fields: str) -> search.Index:
    """The grams of parts' texts, kept in the shared folder."""
    return search_index(table(spark, sf_dir, "part"), "p_partkey", list(fields), f"{shared_folder(spark)}/derived", files_version(spark, f"{sf_dir}/part.parquet"))


@query(_FOUND + " SELECT p_partkey, rank, (SELECT count(*) FROM found) AS total FROM found ORDER BY rank, p_partkey LIMIT 720")
def search_terms_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = checkpointed(_found(spark, sf_dir).select("p_partkey", "rank"))
    return found.orderBy("rank", "p_partkey").limit(720).withColumn("total", F.lit(found.count()).cast("long"))


@query(_FOUND + " SELECT p_brand, min(rank) AS rank, min(p_partkey) AS place, count(*) AS n, arg_min(p_name, p_partkey) AS label FROM found GROUP BY p_brand")
def space_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.groups_of(_found(spark, sf_dir).withColumnRenamed("p_name", "label"), "p_brand", "rank", "p_partkey").withColumnRenamed("p_partkey", "place")


@query("SELECT c_custkey, row_number() OVER (ORDER BY CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END DESC NULLS LAST, c_custkey) AS sorted FROM customer")
def sort_nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment"))
    return relational.sorted_list(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), key, True, "c_custkey").select("c_custkey", "sorted")


@query("""
SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)""")
def liked_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks whose artist or album is liked itself are left out."""
    artists = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    albums = table(spark, sf_dir, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return relational.not_blocked(relational.not_blocked(rows, artists, "o_custkey"), albums, "o_orderkey").select("o_orderkey")


def _kinds(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    names = (("customer", "c_custkey", "c_name"), ("part", "p_partkey", "p_name"), ("supplier", "s_suppkey", "s_name"))
    return [table(spark, sf_dir, name).select(F.col(key).alias("id"), F.col(label).alias("label")) for name, key, label in names]


@query("""
SELECT kind, id, label, row_number() OVER (ORDER BY kind, id)::int AS place FROM (
  SELECT 0 AS kind, c_custkey AS id, c_name AS label FROM customer UNION ALL SELECT 1, p_partkey, p_name FROM part UNION ALL SELECT 2, s_suppkey, s_name FROM supplier)""")
def mixed_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artists, albums, tracks in one list."""
    return relational.mixed_list(_kinds(spark, sf_dir)).withColumn("place", F.col("place").cast("int"))


# --- map -----------------------------------------------------------------


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("track_id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


def indexed_points(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, map_index.Grid]:
    """The points in the order of the map's curve, kept in the shared folder."""
    return map_of(_points(spark, sf_dir), f"{shared_folder(spark)}/derived", files_version(spark, f"{sf_dir}/embeddings.parquet"))


_POINTS = "WITH points AS (SELECT vec_id AS track_id, embedding[1]::double AS x, embedding[2]::double AS y FROM embeddings)"


@query(_POINTS + " SELECT count(*) AS n, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM points")
def map_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map2d.bounds(_points(spark, sf_dir))


@query("SELECT genre, first, (row_number() OVER (ORDER BY first) - 1)::int AS code FROM (SELECT o_orderpriority AS genre, min(o_orderkey) AS first FROM orders GROUP BY ALL)")
def genre_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map2d.first_seen_codes(table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "genre"), "genre", "o_orderkey")


@query(_POINTS + """, b AS (SELECT min(x) x0, max(x) x1, min(y) y0, max(y) y1, least(512, greatest(1, floor(sqrt(count(*) / 2) + 0.5))) AS side FROM points)
SELECT track_id, least(side - 1, floor((x - x0) / greatest(x1 - x0, 1e-9) * side))::int AS cell_x, least(side - 1, floor((y - y0) / greatest(y1 - y0, 1e-9) * side))::int AS cell_y FROM points, b""")
def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map2d.grid(_points(spark, sf_dir)).select("track_id", "cell_x", "cell_y")


@query(_POINTS + " SELECT track_id, round(sqrt(x * x + y * y), 9) AS distance FROM points WHERE sqrt(x * x + y * y) < 0.2 ORDER BY x * x + y * y, track_id LIMIT 1")
def nearest_in_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_index.nearest(*indexed_points(spark, sf_dir), 0.0, 0.0, 0.2)


@query(f"""
WITH {_SPACE}, pairs AS (SELECT a.track_id AS src, b.track_id AS dst, round(list_dot_product(a.u, b.u), 9) AS similarity FROM space a, space b WHERE a.track_id <> b.track_id),
w AS (SELECT src, dst, 1.0 / row_number() OVER (PARTITION BY src ORDER BY similarity DESC, dst) AS w FROM pairs QUALIFY row_number() OVER (PARTITION BY src ORDER BY similarity DESC, dst) <= 6),
both_ways AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, coalesce(max(w) FILTER (src < dst), 0) AS w, coalesce(max(w) FILTER (src > dst), 0) AS v FROM w GROUP BY ALL)
SELECT a, b, round(w + v - w * v, 6) AS w FROM both_ways""")
def fuzzy_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = knn.knn_graph(space(spark, sf_dir, blocked=False), 6)
    return map2d.fuzzy_union(graph.select("src", "dst", (1.0 / F.col("rank")).alias("w"))).withColumn("w", F.round("w", 6))


@query(f"""
WITH RECURSIVE {_SPACE}, pairs AS (SELECT a.track_id AS src, b.track_id AS dst, list_dot_product(a.u, b.u) AS similarity FROM space a, space b WHERE a.track_id <> b.track_id),
near AS (SELECT src, dst, greatest(1 - similarity, 0) AS d FROM pairs QUALIFY row_number() OVER (PARTITION BY src ORDER BY round(similarity, 9) DESC, dst) <= 15),
rows AS (SELECT src, coalesce(min(d) FILTER (d > 0), 0) AS rho, avg(d) AS mean, list(d) AS ds FROM near GROUP BY src),
gaps AS (SELECT src, rho, mean, list_transform(ds, lambda d: d - rho) AS gs FROM rows),
halved AS (SELECT src, 0 AS i, 0::double AS low, 'inf'::double AS high, 1::double AS sigma, list_sum(list_transform(gs, lambda g: CASE WHEN g > 0 THEN exp(-g) ELSE 1 END)) - log2(16) AS over FROM gaps
  UNION ALL SELECT src, i, low, high, next, list_sum(list_transform(gs, lambda g: CASE WHEN g > 0 THEN exp(-g / next) ELSE 1 END)) - log2(16)
  FROM (SELECT src, i + 1 AS i, CASE WHEN over > 0 THEN low ELSE sigma END AS low, CASE WHEN over > 0 THEN sigma ELSE high END AS high,
      CASE WHEN over > 0 THEN (low + sigma) / 2 WHEN isinf(high) THEN sigma * 2 ELSE (sigma + high) / 2 END AS next FROM halved WHERE abs(over) >= 1e-5 AND i < 64) JOIN gaps USING (src)),
found AS (SELECT src, greatest(arg_max(sigma, i), 1e-3 * any_value(mean), 1e-12) AS sigma, any_value(rho) AS rho FROM halved JOIN gaps USING (src) GROUP BY src),
w AS (SELECT src, dst, CASE WHEN d - rho > 0 THEN exp(-(d - rho) / sigma) ELSE 1 END AS w FROM near JOIN found USING (src)),
both_ways AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, coalesce(max(w) FILTER (src < dst), 0) AS w, coalesce(max(w) FILTER (src > dst), 0) AS v FROM w GROUP BY ALL)
SELECT a, b, round(w + v - w * v, 6) AS w FROM both_ways""")
def layout_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = knn.knn_graph(space(spark, sf_dir, blocked=False), 15)
    return map2d.fuzzy_union(map2d.fuzzy_weights(graph, 15)).withColumn("w", F.round("w", 6))


def _laid_out(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The neighbour graph of all rows, and their places."""
    rows = space(spark, sf_dir, blocked=False)
    mean, axes = vectors.fit_pca(rows, "vec", WIDTH, 2)
    start = rows.select("track_id", vectors.project(F.col("vec"), mean, axes).alias("p")).select("track_id", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))
    graph = checkpointed(knn.knn_graph(rows, 15))
    edges = checkpointed(map2d.fuzzy_union(map2d.fuzzy_weights(graph, 15)))
    return graph, rotation.layout(edges, map2d.spread_start(start))


@query()
def layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _laid_out(spark, sf_dir)[1]


@query("SELECT count(*) AS n, count(*) AS placed, true AS near FROM embeddings")
def layout_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows the layout has and how many at finite places, and whether of the 15 neighbours of
    a row three times as many as by chance are among the 30 rows that are nearest on the map."""
    graph, points = _laid_out(spark, sf_dir)
    points = checkpointed(points)
    nearest = cells.nearest(points.select("track_id", F.array("x", "y").alias("v")), points.select("track_id", F.array("x", "y").alias("v")), 30, "v", cosine=False)
    kept = rotation.neighbours_kept(graph, points, nearest).agg(F.avg("kept").alias("kept"))
    finite = vectors.finite(F.col("x")).isNotNull() & vectors.finite(F.col("y")).isNotNull()
    return points.agg(F.count("*").alias("n"), F.count(F.when(finite, 1)).alias("placed")).crossJoin(kept).select("n", "placed", (F.col("kept") > 3 * 30 / F.col("n")).alias("near"))


# --- walks ---------------------------------------------------------------


#: Rows that a walk may go on to: not blocked, not in it, of no artist of its last three rows and not of the last one's album.
_ALLOWED = f"s.artist_id <> {BLOCKED} AND NOT list_contains(walk, s.track_id) AND NOT list_contains(list_slice(artists, -3, -1), s.artist_id) AND s.album_id <> albums[-1]"
_START = "[track_id] AS walk, [artist_id] AS artists, [album_id] AS albums"
_ON = "list_append(walk, s.track_id), list_append(artists, s.artist_id), list_append(albums, s.album_id)"


def _cosine(v: str) -> str:
    return f"round(list_dot_product(s.u, {v}) / greatest(sqrt(list_dot_product({v}, {v})), 1e-9), 9)"


def _towards(steps: int, but: str = "true") -> str:
    """A walk from row 0 through points between the `ends` a and b, of which seven steps lead to b."""
    return f"""walk AS (SELECT 0 AS step, track_id, {_START} FROM space WHERE track_id = 0 AND artist_id <> {BLOCKED}
  UNION ALL SELECT * FROM (SELECT step + 1, s.track_id, {_ON}
    FROM walk, space s, ends, LATERAL (SELECT list_transform(range(1, {WIDTH + 1}), lambda i: (1 - (step + 1) / 7.0) * a[i] + (step + 1) / 7.0 * b[i]) AS t)
    WHERE {_ALLOWED} AND {but} AND step < {steps} ORDER BY {_cosine("t")} DESC, s.track_id LIMIT 1))"""


@query(f"""
WITH RECURSIVE {_SPACE}, walk AS (SELECT 0 AS step, track_id, NULL::double AS similarity, {_START}, u AS last FROM space WHERE track_id = 0 AND artist_id <> {BLOCKED}
  UNION ALL SELECT * FROM (SELECT step + 1, s.track_id, round({_cosine("last")} - 0.1 * len(list_filter(artists, lambda a: a = s.artist_id)), 9) AS score, {_ON}, s.u
    FROM walk, space s WHERE {_ALLOWED} AND step < 11 ORDER BY score DESC, s.track_id LIMIT 1))
SELECT step::int AS step, track_id, similarity FROM walk""")
def radio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walks.radio(checkpointed(space(spark, sf_dir)), 0, 12)


@query(f"""
WITH RECURSIVE {_SPACE}, walk AS (SELECT 0 AS step, track_id AS start, track_id, NULL::double AS similarity, {_START}, u AS last FROM space WHERE artist_id <> {BLOCKED}
  UNION ALL SELECT * FROM (SELECT step + 1, start, s.track_id, round({_cosine("last")} - 0.1 * len(list_filter(artists, lambda a: a = s.artist_id)), 9) AS score, {_ON}, s.u
    FROM walk, space s WHERE {_ALLOWED} AND step < 5 QUALIFY row_number() OVER (PARTITION BY start ORDER BY score DESC, s.track_id) = 1))
SELECT start, step::int AS step, track_id, similarity FROM walk""")
def radios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A radio from each row that isn't blocked, all at once."""
    nav = navigator(spark, sf_dir, 64)
    rows = nav.visible()
    return many_walks.radios(rows, many_walks.candidates(nav.graph(), rows, 64), rows, 6)


@query(f"""
WITH RECURSIVE {_SPACE}, ends AS (SELECT x.u AS a, y.u AS b FROM space x, space y WHERE x.track_id = 0 AND y.track_id = 101 AND x.artist_id <> {BLOCKED} AND y.artist_id <> {BLOCKED}),
{_towards(6, "s.track_id <> 101")}
SELECT step::int AS step, track_id, NULL::double AS similarity FROM (SELECT step, track_id FROM walk UNION ALL SELECT max(step) + 1, 101 FROM walk HAVING count(*) > 0), ends""")
def interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walks.interpolate(checkpointed(space(spark, sf_dir)), 0, 101, 8)


@query(_ANCHORS.replace("WITH", "WITH RECURSIVE", 1) + f""",
ends AS (SELECT (SELECT u FROM space WHERE track_id = 0) AS a, (SELECT list(x ORDER BY i) FROM (SELECT i, avg(u[i]) AS x FROM anchors, range(1, {WIDTH + 1}) t(i) GROUP BY i)) AS b),
{_towards(7)}
SELECT step::int AS step, track_id, NULL::double AS similarity FROM walk""")
def drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = checkpointed(space(spark, sf_dir))
    target = walks.centroid(rows, walks.anchors(rows, _phrase(space(spark, sf_dir, blocked=False)), 5, "vec"))
    return walks.drift(rows, 0, target, 8)


def navigator(spark: SparkSession, sf_dir: str, k: int = 16) -> Navigator:
    """The space with what is kept of it in the shared folder."""
    rows = space(spark, sf_dir, blocked=False).drop("u")
    width = WIDTH // len(vectors.BLOCKS)
    blocks = [(name, i * width, (i + 1) * width, weight) for i, (name, weight) in enumerate(zip(vectors.BLOCKS, vectors.WEIGHTS, strict=True))]
    out = Navigator(rows, blocks, files_version(spark, f"{sf_dir}/embeddings.parquet"), f"{shared_folder(spark)}/derived", k)
    out.set_blocked(spark.createDataFrame([(BLOCKED,)], "artist_id long"))
    return out


@query(f"""
WITH RECURSIVE {_SPACE}, pairs AS (SELECT a.track_id AS src, b.track_id AS dst, list_dot_product(a.u, b.u) AS similarity, a.artist_id = b.artist_id AS same
    FROM space a, space b WHERE a.track_id <> b.track_id AND b.artist_id <> {BLOCKED}),
edges AS (SELECT src, dst, greatest(1 - similarity, 0) + CASE WHEN same THEN 0.05 ELSE 0 END AS w FROM pairs QUALIFY row_number() OVER (PARTITION BY src ORDER BY round(similarity, 9) DESC, dst) <= 16),
best(node, cost, parent) USING KEY (node) AS (SELECT 0::bigint, 0.0::double, NULL::bigint
  UNION SELECT dst, min(b.cost + w), arg_min(b.node, b.cost + w) FROM best b JOIN edges ON src = b.node LEFT JOIN recurring.best r ON r.node = dst WHERE r.cost IS NULL OR b.cost + w < r.cost GROUP BY dst),
back AS (SELECT node, cost, parent, 0 AS i FROM best WHERE node = 101 UNION ALL SELECT b.node, b.cost, b.parent, i + 1 FROM back JOIN best b ON b.node = back.parent)
SELECT (max(i) OVER () - i)::int AS step, node AS track_id, round(cost, 9) AS cost FROM back""")
def graph_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigator(spark, sf_dir).path(0, 101)


@query()
def queue_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    queues = space(spark, sf_dir).select(F.floor(F.col("track_id") / 40).alias("queue_id"), F.col("track_id").alias("place"), "track_id", "u", (F.col("track_id") % 40 == 0).alias("anchor"))
    return walks.queue_order(queues)


# --- streams and signals -------------------------------------------------


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def incremental_analyse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events by a stream that takes each file once, then totals of what it wrote."""
    root = f"{shared_folder(spark)}/analysed-{spark.sparkContext.applicationId}-{hashlib.md5(sf_dir.encode()).hexdigest()}"
    source = f"{sf_dir}/events.parquet"
    incremental.process_new(spark, source + "*", spark.read.parquet(source).schema, f"{root}/rows", f"{root}/state", lambda s: s.select("event_id", "event_type", "value"))
    done = spark.read.parquet(f"{root}/rows")
    return done.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = incremental.windowed_counts(table(spark, sf_dir, "events"))
    return rows.select(F.col("window.start").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT event_id, event_type FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 500) WHERE event_id > (SELECT max(event_id) - 100 FROM events)")
def log_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    last = events.agg(F.max("event_id")).head()[0] or 0
    return incremental.since(events, last - 100, 500).select("event_id", "event_type")


@query("""
WITH f AS (SELECT event_id, user_id, ts, coalesce(greatest(value - lag(value) OVER w, 0), 0) AS flux FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, round(greatest(flux - avg(flux) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 25 PRECEDING AND 25 FOLLOWING), 0), 9) AS onset FROM f""")
def onset_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.onset_envelope(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value").select("event_id", F.round("onset", 9).alias("onset"))


@query("""
WITH s AS (SELECT user_id, (value >= 50)::int AS up, lag((value >= 50)::int) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events)
SELECT user_id, round(coalesce(avg((up <> was)::int), 0), 9) AS zero_crossing_rate, count(*) AS n FROM s GROUP BY user_id""")
def zero_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = signal.zero_crossing_rate(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("value") - 50)
    return out.withColumn("zero_crossing_rate", F.round("zero_crossing_rate", 9))


@query("""
WITH o AS (SELECT user_id, value FROM events WHERE value > 5), m AS (SELECT user_id, avg(value) AS mean FROM o GROUP BY user_id)
SELECT user_id, CASE WHEN count(*) >= 2 THEN round(avg(abs(value - mean)), 6) END AS dynamic_complexity FROM o JOIN m USING (user_id) GROUP BY user_id""")
def dynamic_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.dynamic_complexity(table(spark, sf_dir, "events"), "user_id", "value", 5.0).withColumn("dynamic_complexity", F.round("dynamic_complexity", 6))


@query("""
WITH RECURSIVE f AS (SELECT user_id, ts, event_id, coalesce(greatest(value - lag(value) OVER w, 0), 0) AS flux FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t,
  round(greatest(flux - avg(flux) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 25 PRECEDING AND 25 FOLLOWING), 0), 9) AS v FROM f),
s AS (SELECT user_id, avg(v) + stddev_pop(v) AS level, count(*) AS n FROM e GROUP BY user_id),
m AS (SELECT user_id, t, v, max(v) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS top FROM e),
p AS (SELECT user_id, t FROM m JOIN s USING (user_id) WHERE v > level AND v >= top),
walk AS (SELECT user_id, min(t) AS t FROM p GROUP BY user_id
  UNION ALL SELECT w.user_id, min(p.t) FROM walk w JOIN p ON p.user_id = w.user_id AND p.t >= w.t + 5 GROUP BY w.user_id, w.t)
SELECT s.user_id, s.n, CASE WHEN s.n >= 3 THEN round(count(walk.t) * 100.0 / s.n, 6) ELSE 0 END AS onset_rate
FROM s LEFT JOIN walk ON walk.user_id = s.user_id GROUP BY s.user_id, s.n""")
def onset_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    envelope = signal.onset_envelope(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value").withColumn("onset", F.round("onset", 9))
    rates = signal.onset_rate(envelope, "user_id", ["ts", "event_id"], "onset")
    return rates.withColumn("onset_rate", F.round("onset_rate", 6))


@query("""SELECT event_id, '{"k":' || coalesce(try_cast(json_extract_string(props, '$.k') AS DOUBLE)::varchar, 'null') || '}' AS props FROM events""")
def slim_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", tables.only_field(F.col("props"), "k").alias("props"))
