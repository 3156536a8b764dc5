"""Exact nearest neighbours: for one query by a scan, for all rows by cells."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orbweave.functions.vectors import dot, norm
from orbweave.operators import cells
from orbweave.operators.relational import running_total
from orbweave.session import checkpointed

#: Rows of small albums that share a task.
ALBUM_ROWS = 512


def scored(space: DataFrame, query: list[float]) -> Column:
    """Cosine of unit rows `u` to a query of any length, rounded so that near-ties break by id."""
    return F.round(cosine(query), 9)


def cosine(query: list[float]) -> Column:
    q = F.lit([float(x) for x in query])
    return dot(F.col("u"), q) / norm(q)


#: The order of similarities: near-ties, alike in nine places, break by id. What is handed on isn't rounded.
def nearest_first(id_col: str) -> list[Column]:
    return [F.round("similarity", 9).desc(), F.col(id_col)]


def neighbours(space: DataFrame, track: int, k: int, exclude_same_artist: bool = False, targets: DataFrame | None = None) -> DataFrame:
    """The k nearest targets (rows of the space, unless given) to a track's row, which need not be a target:
    (track_id, similarity, rank). One scan and a top-k; an unknown track has none."""
    own = space.where(F.col("track_id") == track).select("u", "artist_id").head()
    if own is None:
        return space.select("track_id", F.lit(0.0).alias("similarity"), F.lit(0).alias("rank")).limit(0)
    rest = (space if targets is None else targets).where(F.col("track_id") != track)
    if exclude_same_artist:
        rest = rest.where(~F.col("artist_id").eqNullSafe(own["artist_id"]))
    top = rest.select("track_id", cosine(own["u"]).alias("similarity")).orderBy(*nearest_first("track_id")).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*nearest_first("track_id"))))


def knn_graph(space: DataFrame, k: int, targets: DataFrame | None = None, cell_rows: int = cells.CELL_ROWS, report: dict | None = None) -> DataFrame:
    """(src, dst, dist, rank): each row's k nearest targets, itself excluded; dist is 1 - cosine."""
    found = cells.nearest(space, space if targets is None else targets, k, "u", True, cell_rows, report)
    return found.select("src", "dst", (1 - F.col("similarity")).alias("dist"), "rank")


def album_best(space: DataFrame) -> DataFrame:
    """(track_id, u, s, o): each row's greatest cosine, in nine places, to another row of its album, and
    that row. Small albums share a task, a large one is met block against block."""
    placed = space.where(F.col("album_id").isNotNull()).select("track_id", "u", "album_id")
    sizes = placed.groupBy("album_id").agg(F.count("*").alias("n")).where("n > 1")
    small, large = F.col("n") <= ALBUM_ROWS, F.ceil(F.col("n") / cells.QUERY_ROWS)
    shared = max(1, -(-(sizes.where(small).agg(F.sum("n")).head()[0] or 0) // ALBUM_ROWS))
    rows = placed.join(sizes, "album_id").withColumn("task", F.when(small, F.pmod(F.xxhash64("album_id"), F.lit(shared))).otherwise(F.lit(-1)))
    rows = rows.withColumn("album", F.when(small, F.lit(None).cast("long")).otherwise(F.xxhash64("album_id")))
    block = F.when(small, F.lit(0)).otherwise(F.pmod(F.xxhash64("track_id"), large)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.when(small, F.lit(0)).otherwise(large - 1).cast("int")))
    left, right = rows.withColumn("l", block).withColumn("r", every), rows.withColumn("r", block).withColumn("l", every)
    left, right = (x.select(*[F.col(c).alias(c) for c in x.columns]) for x in (left, right))

    def score(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"track_id": pd.Series(dtype="int64"), "s": pd.Series(dtype="float64"), "o": pd.Series(dtype="int64")})
        b = b.sort_values("track_id")
        ids, own = b["track_id"].to_numpy(), a["track_id"].to_numpy()
        same = (a["album_id"].to_numpy()[:, None] == b["album_id"].to_numpy()[None, :]) & (own[:, None] != ids[None, :])
        s = np.where(same, np.round(cells.matrix(a["u"]) @ cells.matrix(b["u"]).T, 9), -np.inf)
        best = s.argmax(axis=1)  # of equals the least id
        out = pd.DataFrame({"track_id": own, "s": s[np.arange(len(own)), best], "o": ids[best]})
        return out[np.isfinite(out["s"])]

    keys = ["task", "album", "l", "r"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(score, "track_id long, s double, o long")
    best = met.groupBy("track_id").agg(F.max(F.struct("s", (-F.col("o")).alias("o"))).alias("best"))
    return space.select("track_id", "u").join(best, "track_id").select("track_id", "u", F.col("best.s").alias("s"), (-F.col("best.o")).alias("o"))


def evaluate(space: DataFrame, cell_rows: int = cells.CELL_ROWS) -> DataFrame:
    """(track_id, rank): where the first other row of the same album stands among all others. The
    best of each row's album is found first; then only rows that are better are counted, whole
    cells at a time where bounds tell."""
    counted = cells.ranks(album_best(space), space, "u", cell_rows)
    return counted.select("track_id", (F.col("n") + 1).alias("rank"))


def rank_summary(ranked: DataFrame) -> DataFrame:
    """n, the share of rank 1, the upper median and the mean of ranks. Ranks are counted by value and
    the values' counts summed up in sorted ranges, so that no task gets them all."""
    counts = ranked.groupBy("rank").agg(F.count("*").alias("c"))
    upto = checkpointed(running_total(counts, ["rank"], "c", "upto"))
    total = upto.agg(F.sum("c").alias("n")).head()["n"] or 0
    return upto.agg(
        F.lit(total).cast("long").alias("n"), F.round(F.sum(F.when(F.col("rank") == 1, F.col("c")).otherwise(0)) / F.lit(total), 9).alias("top_1"),
        F.min(F.when(F.col("upto") > total // 2, F.col("rank"))).alias("median"), F.round(F.sum(F.col("rank") * F.col("c")) / F.lit(total), 6).alias("mean"),
    )
