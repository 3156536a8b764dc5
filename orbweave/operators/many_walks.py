"""Many walks at once: a table of walks that all take a step by one join with a kept neighbour graph."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.operators.cells import matrix, side_rows
from orbweave.operators.walks import Constraints
from orbweave.session import checkpointed

#: Rows that walks are compared with at once where the graph doesn't tell, and walks at once.
PART_ROWS, PART_WALKS = 4096, 256
_FLOOR = -2.0


def candidates(graph: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """Edges (src, dst, sim, artist_id, album_id, bpm, floor) of a graph of the k nearest: what no row
    outside of it exceeds is the floor, least of all where the graph has all rows."""
    sim = F.round(1 - F.col("dist"), 9)
    floors = graph.groupBy("src").agg(F.when(F.count("*") == k, F.min(sim)).otherwise(F.lit(_FLOOR)).alias("floor"))
    attributes = rows.select(F.col("track_id").alias("dst"), "artist_id", "album_id", "bpm")
    return graph.select("src", "dst", sim.alias("sim")).join(floors, "src").join(attributes, "dst")


def _allowed(rules: Constraints) -> Column:
    """Whether a walk (ids, artists, albums, bpm) may go on to a row (dst, artist_id, album_id, bpm)."""
    known = lambda c: F.col(c).isNotNull() & (F.col(c) != -1)
    out = ~F.array_contains("ids", F.col("dst")) & ~F.col("dst").isin(list(rules.exclude) or [-1])
    if rules.cooldown:
        recent = F.slice("artists", F.greatest(F.lit(1), F.size("artists") - (rules.cooldown - 1)), F.lit(rules.cooldown))
        out &= ~(known("artist_id") & F.coalesce(F.exists(recent, lambda a: a == F.col("artist_id")), F.lit(False)))
    if not rules.same_album:
        last = F.element_at("albums", -1).cast("string")
        out &= ~(last.isNotNull() & (last != "") & last.eqNullSafe(F.col("album_id").cast("string")))
    if rules.max_bpm_step is not None:
        out &= F.col("last_bpm").isNull() | F.col("bpm").isNull() | (F.abs(F.col("bpm") - F.col("last_bpm")) <= rules.max_bpm_step)
    return out


def _score(penalty: float) -> Column:
    """Nearness less `penalty` for each time that the row's artist is in the walk."""
    times = F.size(F.filter("artists", lambda a: a == F.col("artist_id")))
    return F.round(F.col("sim") - F.when(F.col("artist_id").isNotNull() & (F.col("artist_id") != -1), times * penalty).otherwise(0.0), 9)


def _best(met: DataFrame) -> DataFrame:
    """Each walk's best row (start, score, dst): a partial maximum where rows are, then one for each walk."""
    best = met.groupBy("start").agg(F.max(F.struct("score", (-F.col("dst")).alias("o"))).alias("b"))
    return best.select("start", F.col("b.score").alias("score"), (-F.col("b.o")).alias("dst"))


def dealt(n: int, m: int) -> tuple[int, int]:
    """Parts of n rows and blocks of m walks: about as many however many rows there are, since each row is sent to each block."""
    return max(1, -(-n // side_rows(n, PART_ROWS))), max(1, -(-m // side_rows(m, PART_WALKS)))


def _scanned(walks: DataFrame, rows: DataFrame, penalty: float, rules: Constraints) -> DataFrame:
    """The best row of each walk among all rows, part by part."""
    parts, blocks = dealt(rows.count(), walks.count())
    upto = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    u = rows.select(F.col("track_id").alias("last"), F.col("u").alias("v"))
    left = walks.join(u, "last").withColumn("block", F.pmod(F.xxhash64("start"), F.lit(blocks)).cast("int")).withColumn("part", upto(parts))
    right = rows.select("track_id", "artist_id", "album_id", "bpm", "u").withColumn("part", F.pmod(F.xxhash64("track_id"), F.lit(parts)).cast("int")).withColumn("block", upto(blocks))
    left, right = (x.select(*[F.col(c).alias(c) for c in x.columns]) for x in (left, right))

    def best(a: pd.DataFrame, b: pd.DataFrame, out: dict[str, list]) -> None:
        ids, v = b["track_id"].to_numpy(), matrix(a["v"])
        sims = np.round(v @ matrix(b["u"]).T / np.maximum(np.sqrt((v * v).sum(1)), 1e-9)[:, None], 9)
        artist, album, bpm = b["artist_id"].to_numpy(float), b["album_id"].astype("string"), b["bpm"].to_numpy(float)
        known = ~np.isnan(artist) & (artist != -1)
        for sim, walk in zip(sims, a.to_dict("records"), strict=True):
            may = ~np.isin(ids, [*walk["ids"], *rules.exclude])
            artists = np.array([np.nan if x is None else x for x in walk["artists"]], float)
            if rules.cooldown:
                may &= ~(known & np.isin(artist, artists[-rules.cooldown :]))
            last = walk["albums"][-1]
            if not rules.same_album and last not in (None, "") and last == last:
                may &= ~(album == str(last)).fillna(False).to_numpy(bool)
            if rules.max_bpm_step is not None and walk["last_bpm"] is not None and walk["last_bpm"] == walk["last_bpm"]:
                may &= np.isnan(bpm) | (np.abs(bpm - walk["last_bpm"]) <= rules.max_bpm_step)
            times = (artist[:, None] == artists[None, :]).sum(1)
            total = np.where(may, np.round(sim - np.where(known, times * penalty, 0.0), 9), -np.inf)
            at = int(total.argmax())  # of equals the least id
            if total[at] > -np.inf:
                for c, x in zip(out, (walk["start"], total[at], ids[at]), strict=True):
                    out[c].append(x)

    def score(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"start": [], "score": [], "dst": []}
        b = b.sort_values("track_id")
        for i in range(0, len(a), PART_WALKS):
            for j in range(0, len(b), PART_ROWS):
                best(a.iloc[i : i + PART_WALKS], b.iloc[j : j + PART_ROWS], out)
        return pd.DataFrame(out).sort_values(["score", "dst"], ascending=[False, True]).drop_duplicates("start")

    keys = ["part", "block"]
    return _best(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(score, "start long, score double, dst long"))


def radios(starts: DataFrame, near: DataFrame, rows: DataFrame, steps: int, penalty: float = 0.1, rules: Constraints | None = None, report: dict | None = None) -> DataFrame:
    """A radio (start, step, track_id, similarity) from each start (track_id) among the rows.

    near: candidates of a graph. A walk's best candidate is the best row of all if it is above
    the floor, since no row outside is nearer and penalties only lower scores; walks of
    which that isn't so, few with a graph of enough neighbours, are compared with all rows.
    Jobs grow with steps, not with walks. `report` gets how many steps were compared with all.
    """
    rules, attributes = rules or Constraints(), rows.select("track_id", "artist_id", "album_id", "bpm")
    near = checkpointed(near.repartition("src"))
    floors = checkpointed(near.groupBy(F.col("src").alias("last")).agg(F.first("floor").alias("floor")))
    first = starts.select("track_id").distinct().join(attributes, "track_id")
    walks = first.select(
        F.col("track_id").alias("start"), F.col("track_id").alias("last"), F.col("bpm").alias("last_bpm"), F.array("track_id").alias("ids"), F.array("artist_id").alias("artists"),
        F.array("album_id").alias("albums"), F.array(F.lit(None).cast("double")).alias("scores"),
    )
    walks, ended, scanned = checkpointed(walks), [], 0
    for _ in range(steps - 1):
        met = walks.join(near.withColumnRenamed("src", "last"), "last")
        best = _best(met.where(_allowed(rules)).withColumn("score", _score(penalty)).select("start", "score", "dst"))
        told = walks.select("start", "last").join(floors, "last", "left").join(best, "start", "left")
        sure = (F.coalesce("floor", F.lit(2.0)) == _FLOOR) | (F.col("dst").isNotNull() & F.coalesce(F.col("score") > F.col("floor"), F.lit(False)))
        told = checkpointed(told.select("start", "dst", "score", sure.alias("sure")))
        found = told.where(F.col("sure") & F.col("dst").isNotNull()).select("start", "score", "dst")
        unsure = told.where("not sure").select("start")
        n = unsure.count()
        if n:
            scanned += n
            found = found.unionByName(_scanned(walks.join(unsure, "start"), rows, penalty, rules))
        onto = found.join(attributes.withColumnRenamed("track_id", "dst"), "dst")
        grown = lambda c, x: F.concat(c, F.array(x)).alias(c)
        went = walks.drop("last", "last_bpm").join(onto, "start").select(
            "start", F.col("dst").alias("last"), F.col("bpm").alias("last_bpm"), grown("ids", F.col("dst")), grown("artists", F.col("artist_id")), grown("albums", F.col("album_id")), grown("scores", F.col("score"))
        )
        went = checkpointed(went)
        ended.append(walks.join(went.select("start"), "start", "left_anti"))
        walks = went
    if report is not None:
        report.update(scanned=scanned)
    for stopped in ended:
        walks = walks.unionByName(stopped)
    return walks.select("start", F.posexplode(F.arrays_zip("ids", "scores")).alias("step", "at")).select("start", F.col("step").cast("int").alias("step"), F.col("at.ids").alias("track_id"), F.col("at.scores").alias("similarity"))
