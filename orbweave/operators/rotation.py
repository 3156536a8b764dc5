"""The two-dimensional layout: stochastic gradient descent by rotating pairs of blocks.

Points are dealt to blocks by a hash, and edges belong to the pair of blocks that they join.
In each round every block is paired with another, so that the pairs share no point and all
are worked on at once, each by many epochs over its own edges; after as many rounds as a
tournament of the blocks has, every edge has had its epochs. Between rounds only
positions move. Points that repel are drawn from a pair's two blocks, which are samples
of all points.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.operators.map2d import fit_curve
from orbweave.session import checkpointed, shared_folder
from orbweave.sources.tables import removed

#: Points of a block, about, and the fewest blocks.
BLOCK_POINTS, LEAST_BLOCKS = 50_000, 4
#: Tournaments that a layout's epochs are dealt to, and rounds between checkpoints.
SWEEPS, ROUNDS_AT_ONCE = 20, 4


def epochs_for(n: int) -> int:
    return 200 if n > 10_000 else 500


def partner(block: Column, round_: Column | int, blocks: int) -> Column:
    """The other block of a pair in a round of a tournament of an even number of blocks."""
    last, r = blocks - 1, F.lit(round_) if isinstance(round_, int) else round_
    against = F.pmod(r - block, F.lit(last))
    half = F.pmod(r * (blocks // 2), F.lit(last))  # the block that would meet itself meets the last one
    return F.when(block == last, half).when(against == block, F.lit(last)).otherwise(against).cast("int")


def meeting(a: Column, b: Column, blocks: int) -> Column:
    """The round in which two different blocks are a pair."""
    last = blocks - 1
    other = F.least(a, b)
    return F.when(F.greatest(a, b) == last, F.pmod(2 * other, F.lit(last))).otherwise(F.pmod(a + b, F.lit(last)))


def descend(
    at: np.ndarray, i: np.ndarray, j: np.ndarray, ratio: np.ndarray, first: int, last: int, epochs: int, curve: tuple[float, float], negatives: int, rate: float, rng: np.random.Generator
) -> None:
    """Move points `at` along edges i, j by the epochs from `first` to `last` of all. An edge takes part
    in an epoch as often as its weight is of the greatest. An epoch's edges come in batches, in which a
    point has about one edge; where it has more, it makes the mean of their moves."""
    a, b = curve
    n, ends = len(at), len(np.unique(np.concatenate([i, j])))
    for epoch in range(first, last):
        due = np.flatnonzero(np.floor(epoch * ratio) > np.floor((epoch - 1) * ratio)) if epoch else np.zeros(0, int)
        if not len(due):
            continue
        rng.shuffle(due)
        alpha = rate * (1 - epoch / epochs)
        for part in np.array_split(due, max(1, math.ceil(2 * len(due) / ends))):
            turned = rng.random(len(part)) < 0.5
            p, q = np.where(turned, j[part], i[part]), np.where(turned, i[part], j[part])
            d = at[p] - at[q]
            d2 = (d * d).sum(1)
            pull = np.where(d2 > 0, -2 * a * b * np.maximum(d2, 1e-12) ** (b - 1) / (a * d2**b + 1), 0.0)
            pulled = np.clip(pull[:, None] * d, -4, 4)
            other = rng.integers(0, n, (len(part), negatives))
            away = at[p][:, None] - at[other]
            e2 = (away * away).sum(2)
            push = 2 * b / ((0.001 + e2) * (a * e2**b + 1))
            pushed = np.where((e2 > 0)[..., None], np.clip(push[..., None] * away, -4, 4), 4.0)
            pushed[other == p[:, None]] = 0
            ids, place = np.unique(np.concatenate([p, q]), return_inverse=True)
            moves = np.concatenate([pulled + pushed.sum(1), -pulled])
            count = np.bincount(place)
            for c in (0, 1):
                at[ids, c] += alpha * np.bincount(place, moves[:, c]) / count


def _dealt(edges: DataFrame, places: DataFrame, blocks: int) -> DataFrame:
    """Edges by round and pair, with the block and the place in it of both ends. An edge within a
    block has a round by a hash of its own, so that each comes once in a tournament."""
    here = edges.join(places.select(F.col("track_id").alias("a"), F.col("block").alias("block_a"), F.col("place").alias("place_a")), "a")
    here = here.join(places.select(F.col("track_id").alias("b"), F.col("block").alias("block_b"), F.col("place").alias("place_b")), "b")
    met = F.when(F.col("block_a") != F.col("block_b"), meeting(F.col("block_a"), F.col("block_b"), blocks)).otherwise(F.pmod(F.xxhash64("a", "b"), F.lit(blocks - 1)))
    here = here.withColumn("round", met.cast("int"))
    pair = F.least(F.col("block_a"), partner(F.col("block_a"), F.col("round"), blocks))
    return here.select("round", pair.cast("int").alias("pair"), "block_a", "place_a", "block_b", "place_b", "ratio")


def layout(
    edges: DataFrame, start: DataFrame, epochs: int | None = None, rate: float = 1.0, negatives: int = 5, min_dist: float = 0.1, blocks: int | None = None, sweeps: int = SWEEPS, seed: int = 42
) -> DataFrame:
    """Positions (track_id, x, y) after attraction along weighted edges (a, b, w) and, at each move,
    repulsion from `negatives` random points. Edges of less than the greatest weight by the number of
    epochs take no part; a point without edges stays where it starts. Without `epochs` there are
    500, or 200 above 10,000 points. Fewer than three points are an error.

    A task holds two blocks of points (BLOCK_POINTS each, about) and the edges of their pair in one
    round. Jobs grow with the number of blocks, not with epochs.
    """
    spark, curve = start.sparkSession, fit_curve(min_dist)
    n = start.count()
    if n < 3:
        raise ValueError(f"a layout needs three points at least, not {n}")
    epochs = epochs_for(n) if epochs is None else epochs
    blocks = blocks or max(LEAST_BLOCKS, 2 * math.ceil(n / (2 * BLOCK_POINTS)))
    if blocks % 2 or blocks < 2:
        raise ValueError(f"blocks meet in pairs, so their number is even, not {blocks}")
    home = f"{shared_folder(spark)}/layout-{uuid.uuid4().hex}"
    dealt = start.select(F.pmod(F.xxhash64("track_id"), F.lit(blocks)).cast("int").alias("block"), "track_id", F.col("x").cast("double"), F.col("y").cast("double"))
    rows = dealt.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("track_id", "x", "y"))).alias("points"))
    rows = checkpointed(rows.select("block", *[F.col(f"points.{c}").alias(c) for c in ("track_id", "x", "y")]))
    ids, state = rows.select("block", "track_id"), rows.select("block", "x", "y")
    places = ids.select("block", F.posexplode("track_id").alias("place", "track_id"))
    most = edges.agg(F.max("w")).head()[0] or 1.0
    strong = edges.where((F.col("w") * epochs >= most) & (F.col("a") != F.col("b"))).select("a", "b", (F.col("w") / most).alias("ratio"))

    def work(round_: int, first: int, last: int):
        def pair(points: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            points = points.sort_values("block")
            if not len(own) or not len(points):
                return points[["block", "x", "y"]]
            sizes = [len(x) for x in points["x"]]
            begins = dict(zip(points["block"], np.concatenate([[0], np.cumsum(sizes)[:-1]]), strict=True))
            at = np.stack([np.concatenate(list(points[c])) for c in ("x", "y")], axis=1)
            i, j = (own[f"block_{e}"].map(begins).to_numpy(np.int64) + own[f"place_{e}"].to_numpy(np.int64) for e in ("a", "b"))
            order = np.lexsort((j, i))  # rows come in any order
            rng = np.random.default_rng([seed, first, round_, int(own["pair"].iloc[0])])
            descend(at, i[order], j[order], own["ratio"].to_numpy()[order], first, last, epochs, curve, negatives, rate, rng)
            split = np.split(at, np.cumsum(sizes)[:-1])
            return pd.DataFrame({"block": points["block"].to_numpy(), "x": [s[:, 0] for s in split], "y": [s[:, 1] for s in split]})

        return pair

    try:
        _dealt(strong, places, blocks).repartition("round").write.partitionBy("round").parquet(f"{home}/edges")
        every = spark.read.schema("pair int, block_a int, place_a int, block_b int, place_b int, ratio double, round int").parquet(f"{home}/edges")
        bounds = np.linspace(0, epochs, min(sweeps, max(epochs, 1)) + 1).round().astype(int).tolist()
        done = 0
        for first, last in zip(bounds[:-1], bounds[1:], strict=True):
            for round_ in range(blocks - 1):
                pairs = blocks // 2
                left = state.withColumn("pair", F.least(F.col("block"), partner(F.col("block"), round_, blocks))).repartition(pairs, "pair")
                right = every.where(F.col("round") == round_).drop("round").repartition(pairs, "pair")
                state = left.groupBy("pair").cogroup(right.groupBy("pair")).applyInPandas(work(round_, first, last), "block int, x array<double>, y array<double>")
                done += 1
                if done % ROUNDS_AT_ONCE == 0:
                    state = checkpointed(state)
        state = checkpointed(state)
    finally:
        removed(spark, home)
    moved = ids.join(state, "block").select(F.explode(F.arrays_zip("track_id", "x", "y")).alias("p"))
    return moved.select("p.track_id", "p.x", "p.y")


def neighbours_kept(edges: DataFrame, points: DataFrame, nearest: DataFrame) -> DataFrame:
    """(src, kept): the share of a row's graph neighbours (src, dst) that are among its nearest points (src, dst) of the layout."""
    both = edges.select("src", "dst").join(nearest.select("src", "dst", F.lit(1).alias("near")), ["src", "dst"], "left")
    return both.groupBy("src").agg(F.avg(F.coalesce("near", F.lit(0))).alias("kept"))
