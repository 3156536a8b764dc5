"""Cheapest paths over a neighbour graph that is kept: both ends search at once, and landmarks
tell which rows can't be on a cheaper path than the one that is known."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.session import checkpointed

#: Ids that are looked up by their values; more meet the table by a join.
LOOKED_UP = 500
_SLACK = 1e-12


def steps(edges: DataFrame, artists: DataFrame, artist_cost: float = 0.05) -> DataFrame:
    """(ahead, node, other, cost) of edges (src, dst, dist): each with its end ahead and, for the search
    from the goal, backwards. Between rows of one artist it is `artist_cost` more."""
    a = artists.select("track_id", "artist_id")
    cost = F.greatest(F.col("dist"), F.lit(0.0)) + F.when(F.col("x.artist_id").eqNullSafe(F.col("y.artist_id")), artist_cost).otherwise(0.0)
    met = edges.join(a.alias("x"), F.col("src") == F.col("x.track_id")).join(a.alias("y"), F.col("dst") == F.col("y.track_id")).select("src", "dst", cost.alias("cost"))
    ends = F.explode(F.array(F.struct(F.lit(True).alias("ahead"), F.col("src").alias("node"), F.col("dst").alias("other")), F.struct(F.lit(False).alias("ahead"), F.col("dst").alias("node"), F.col("src").alias("other"))))
    return met.select("cost", ends.alias("e")).select("e.ahead", "e.node", "e.other", "cost")


def by_node(table: DataFrame) -> DataFrame:
    """The table in ranges of nodes, so that files and their parts have few nodes each."""
    return table.repartitionByRange("node").sortWithinPartitions("node")


def looked_up(table: DataFrame, ids: DataFrame) -> DataFrame:
    """The table's rows of some nodes (a column `node`, distinct). A few are pushed to the scan as values."""
    few = [r["node"] for r in ids.select("node").limit(LOOKED_UP + 1).collect()]
    return table.where(F.col("node").isin(few)) if len(few) <= LOOKED_UP else table.join(ids.select("node"), "node", "left_semi")


def landmarks(every: DataFrame, count: int) -> DataFrame:
    """(node, away, home): the costs from and to some rows, infinite where there is no way. All landmarks
    are worked on at once, and only rows that got nearer to one hand their costs on."""
    nodes = every.select("node").distinct()
    chosen = [r["node"] for r in nodes.orderBy(F.xxhash64("node", F.lit(11)), "node").limit(count).collect()]
    spark, far = every.sparkSession, float("inf")
    costs = [(ahead, n, [0.0 if i == j else far for j in range(len(chosen))], True) for i, n in enumerate(chosen) for ahead in (True, False)]
    known = spark.createDataFrame(costs, "ahead boolean, node long, costs array<double>, fresh boolean")
    least = lambda c: F.array(*[F.min(F.get(c, F.lit(i))) for i in range(len(chosen))])
    while chosen:
        front = known.where("fresh").select("ahead", "node", "costs")
        offers = front.join(every, ["ahead", "node"]).groupBy("ahead", F.col("other").alias("node")).agg(least(F.transform("costs", lambda c: c + F.col("cost"))).alias("offer"))
        met = known.drop("fresh").join(offers, ["ahead", "node"], "full_outer")
        worst = F.array_repeat(F.lit(far), len(chosen))
        had, got = F.coalesce("costs", worst), F.coalesce("offer", worst)
        nearer = F.exists(F.zip_with(had, got, lambda x, y: y < x), lambda b: b)
        known = checkpointed(met.select("ahead", "node", F.zip_with(had, got, lambda x, y: F.least(x, y)).alias("costs"), nearer.alias("fresh")))
        if not known.where("fresh").head(1):
            break
    none = F.array_repeat(F.lit(far), len(chosen))
    sides = [known.where(F.col("ahead") == ahead).select("node", F.col("costs").alias(name)) for ahead, name in ((True, "away"), (False, "home"))]
    met = nodes.join(sides[0], "node", "left").join(sides[1], "node", "left")
    return met.select("node", F.coalesce("away", none).alias("away"), F.coalesce("home", none).alias("home"))


def _bound(ahead: Column, ends: dict[bool, tuple[list[float], list[float]]]) -> Column:
    """What it costs at least from a row (away, home) to the goal, or to it from the start."""
    finite = lambda v: [None if np.isinf(x) else float(x) for x in v]

    def one(side: bool) -> Column:
        away, home = (F.lit(finite(v)).cast("array<double>") for v in ends[side])
        # Where both are known their difference bounds the way; unknown ones say nothing.
        known = lambda v: F.when(v < float("inf"), v)
        first = F.zip_with("away", away, lambda x, g: g - known(x) if side else known(x) - g)
        second = F.zip_with("home", home, lambda x, g: known(x) - g if side else g - known(x))
        return F.greatest(F.lit(0.0), F.coalesce(F.array_max(first), F.lit(0.0)), F.coalesce(F.array_max(second), F.lit(0.0)))

    return F.when(ahead, one(True)).otherwise(one(False))


def shortest(every: DataFrame, start: int, goal: int, bounds: DataFrame | None = None, report: dict | None = None) -> DataFrame:
    """The cheapest path (step, track_id, cost) from start to goal; no rows if there is none.

    Each round takes the rows of both searches that got cheaper one step on. A row is left if with
    what the way on costs at least (by landmarks) it can't beat the best path through a
    row that both have reached; the search ends when no two open rows can. Costs come
    with their path, so nothing is looked up afterwards. `report` gets the rounds and
    how many steps they offered.
    """
    spark, path_type = every.sparkSession, "array<struct<node: long, cost: double>>"
    out = "step int, track_id long, cost double"
    there = {r["node"] for r in every.where(F.col("node").isin([start, goal])).select("node").distinct().collect()}
    if start == goal and start in there:
        return spark.createDataFrame([(0, start, 0.0)], out)
    if not {start, goal} <= there:
        return spark.createDataFrame([], out)
    ends = None
    if bounds is not None:
        at = {r["node"]: (r["away"], r["home"]) for r in bounds.where(F.col("node").isin([start, goal])).collect()}
        ends = {True: at[goal], False: at[start]}
    schema = f"ahead boolean, node long, cost double, path {path_type}, fresh boolean"
    known = spark.createDataFrame([(True, start, 0.0, [(start, 0.0)], True), (False, goal, 0.0, [(goal, 0.0)], True)], schema)
    best, rounds, offered = None, 0, 0
    while True:
        front = known.where("fresh").drop("fresh")
        own = looked_up(every, front.select("node").distinct())
        gone = front.withColumnRenamed("cost", "so_far").join(own, ["ahead", "node"])
        total = F.col("so_far") + F.col("cost")
        offers = gone.select("ahead", F.col("other").alias("node"), total.alias("offer"), F.concat("path", F.array(F.struct(F.col("other").alias("node"), total.alias("cost")))).alias("way"))
        offers = checkpointed(offers.groupBy("ahead", "node").agg(F.min(F.struct("offer", "way")).alias("o"), F.count("*").alias("n")))
        offered += offers.agg(F.sum("n")).head()[0] or 0
        rounds += 1
        met = known.drop("fresh").join(offers, ["ahead", "node"], "full_outer")
        better = F.col("o").isNotNull() & (F.col("cost").isNull() | (F.col("o.offer") < F.col("cost")))
        known = met.select("ahead", "node", F.when(better, F.col("o.offer")).otherwise(F.col("cost")).alias("cost"), F.when(better, F.col("o.way")).otherwise(F.col("path")).alias("path"), better.alias("fresh"))
        known = checkpointed(known)
        both = known.where("ahead").alias("f").join(known.where("not ahead").alias("b"), "node")
        found = both.select((F.col("f.cost") + F.col("b.cost")).alias("cost"), "node", F.col("f.path").alias("there"), F.col("b.path").alias("back")).orderBy("cost", "node").head()
        if found is not None and (best is None or found["cost"] < best["cost"]):
            best = found
        if best is not None:
            open_ = known.where("fresh")
            on = open_
            if ends is not None:
                on = open_.join(looked_up(bounds, open_.select("node").distinct()), "node", "left").withColumns({c: F.coalesce(c, F.array().cast("array<double>")) for c in ("away", "home")})
                on = on.withColumn("on", F.col("cost") + _bound(F.col("ahead"), ends))
            else:
                on = on.withColumn("on", F.col("cost"))
            stays = on.where(F.col("on") < best["cost"] - _SLACK).select("ahead", "node", F.lit(True).alias("stays"))
            known = checkpointed(known.join(stays, ["ahead", "node"], "left").withColumn("fresh", F.coalesce("stays", F.lit(False))).drop("stays"))
        low = {r["ahead"]: r["c"] for r in known.where("fresh").groupBy("ahead").agg(F.min("cost").alias("c")).collect()}
        if not low or best is not None and low.get(True, np.inf) + low.get(False, np.inf) >= best["cost"] - _SLACK:
            break
        if best is None and len(low) < 2:
            break  # one end has been searched whole and the other isn't in it
    if report is not None:
        report.update(rounds=rounds, offered=offered)
    if best is None:
        return spark.createDataFrame([], out)
    way = [(p["node"], p["cost"]) for p in best["there"]] + [(p["node"], best["cost"] - p["cost"]) for p in reversed(best["back"][:-1])]
    return spark.createDataFrame([(i, n, round(c, 9)) for i, (n, c) in enumerate(way)], out)


def graph_path(edges: DataFrame, artists: DataFrame, start: int, goal: int, artist_cost: float = 0.05, report: dict | None = None) -> DataFrame:
    """The cheapest path over edges (src, dst, dist) that aren't kept."""
    return shortest(checkpointed(steps(edges, artists, artist_cost)), start, goal, None, report)
