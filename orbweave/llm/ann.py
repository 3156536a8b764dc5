"""Approximate nearest neighbours: a forest of random-projection trees.

Each tree splits by hyperplanes between two random rows, at the median. A query
searches all trees through one priority queue: the leaf whose worst margin on
the way is best comes first, of whichever tree. The rows of the leaves it visits
are reranked by exact cosine, leaf by leaf, where both sides meet.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string
from pyspark.sql.window import Window

from orbweave.llm.common import checkpointed

#: Distinct vectors that the hyperplanes are drawn from, about. All rows are indexed.
SAMPLE_ROWS = 50_000
TREES = 16
LEAF_ROWS = 64
#: A query visits as few leaves, over all trees, as give TRIED sampled queries this recall.
TRIED, RECALL = 100, 0.95
#: The hyperplanes go to every task, so they have no more bytes than this: where
#: vectors are long, leaves hold more rows instead.
FOREST_BYTES = 64 << 20


@dataclass
class Forest:
    """Inner nodes of all trees: hyperplanes, offsets and both children; a child
    below zero is the leaf -1 - child. roots: the trees' first nodes or leaves."""

    planes: np.ndarray
    offsets: np.ndarray
    children: np.ndarray
    roots: list[int]

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        out = np.empty((len(x), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            node = np.full(len(x), root, np.int64)
            while True:
                rows = np.flatnonzero(node >= 0)
                if not len(rows):
                    break
                at = node[rows]
                side = np.einsum("ij,ij->i", x[rows], self.planes[at]) > self.offsets[at]
                node[rows] = self.children[at, side.astype(np.int64)]
            out[:, t] = -1 - node
        return out

    def leaves(self) -> int:
        """How many leaves all trees have."""
        return -int(min([*self.roots, self.children.min(initial=0)]))

    def visit(self, q: np.ndarray, most: int) -> list[int]:
        """Up to `most` leaves, best first, by one queue for all trees."""
        margin = (self.planes @ q - self.offsets).tolist() if len(self.planes) else []
        children = self.children
        queue = [(-np.inf, root) for root in self.roots]
        heapq.heapify(queue)
        found: list[int] = []
        while queue and len(found) < most:
            worst, node = heapq.heappop(queue)
            if node < 0:
                found.append(-1 - node)
                continue
            m = margin[node]
            left, right = int(children[node, 0]), int(children[node, 1])
            heapq.heappush(queue, (max(worst, m), left))
            heapq.heappush(queue, (max(worst, -m), right))
        return found


def grow(x: np.ndarray, trees: int, leaf: int, seed: int = 7) -> Forest:
    """A forest over sampled unit rows; leaves hold up to `leaf` of them, or more where
    the planes would outgrow FOREST_BYTES."""
    most = FOREST_BYTES // (4 * x.shape[1] * trees)  # planes of one tree
    leaf = max(leaf, -(-2 * len(x) // max(most, 1)))  # halves of a leaf that was split have half of that
    rng = np.random.default_rng(seed)
    planes: list[np.ndarray] = []
    offsets: list[float] = []
    children: list[list[int]] = []
    leaves = 0

    def split(rows: np.ndarray) -> int:
        nonlocal leaves
        if len(rows) > leaf and len(planes) < room:
            for _ in range(4):
                a, b = x[rng.choice(rows, 2, replace=False)]
                plane = a - b
                side = x[rows] @ plane
                cut = float(np.median(side))
                right = side > cut
                if 0 < right.sum() < len(rows):
                    node = len(planes)
                    planes.append(plane)
                    offsets.append(cut)
                    children.append([0, 0])
                    children[node] = [split(rows[~right]), split(rows[right])]
                    return node
        leaves += 1
        return -leaves

    roots = []
    for t in range(1, trees + 1):
        room = most * t
        roots.append(split(np.arange(len(x))))
    width = x.shape[1]
    return Forest(np.array(planes, np.float32).reshape(-1, width), np.array(offsets, np.float32), np.array(children, np.int64).reshape(-1, 2), roots)


def calibrated(forest: Forest, x: np.ndarray, k: int, recall: float, seed: int = 11) -> int:
    """The least number of leaves that gives sampled queries this recall of their k
    nearest others, by brute force over the sampled rows: for data without structure
    a share of all leaves, for clustered data a few."""
    asked = np.random.default_rng(seed).choice(len(x), min(TRIED, len(x)), replace=False)
    leaves = forest.leaves_of(x)
    total = forest.leaves()
    met = [np.zeros(1, np.int64)]  # the visit at which each true neighbour is first met
    for q in asked:
        score = x @ x[q]
        score[q] = -np.inf
        near = np.argsort(-score, kind="stable")[: min(k, len(x) - 1)]
        place = np.empty(total, np.int64)
        place[forest.visit(x[q], total)] = np.arange(total)
        met.append(place[leaves[near]].min(1, initial=total))
    met = np.sort(np.concatenate(met))
    return int(met[math.ceil(recall * len(met)) - 1]) + 1


def usable(v: Column) -> Column:
    """Not null, not zero, and without null or non-finite components."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    return (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32)


def nearest(
    rows: DataFrame, asked: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
    trees: int = TREES, leaf_rows: int = LEAF_ROWS, visited: int | None = None, recall: float = RECALL, sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """The k nearest found of each row where `asked` holds, among all other rows.

    Returns query_id, rank (from 1), vec_id and score, the cosine in double
    precision; ties go to the smaller vec_id. Ids are unique and not null (null
    ones take no part). Vectors that aren't usable take no part, nor do those
    whose length isn't the most frequent one's (the longest of these). Rows of
    the same vector are searched as one and counted by the smallest of their
    ids. Other columns are ignored; an empty table gives no rows. A query whose
    leaves hold fewer than k others visits more, all of them in the end, so that it
    gets k rows wherever there are as many.
    """
    v = F.col("v")
    given = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), asked.alias("asked")).where(F.col("id").isNotNull() & usable(v))
    sizes = given.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).head()
    width = sizes["d"] if sizes else 0
    given = given.where(F.size(v) == width)
    # The least ids of each vector, asked or not: Spark drops the rest before the shuffle.
    least = Window.partitionBy("v", "asked").orderBy("id")
    kept = given.withColumn("n", F.row_number().over(least)).where(F.col("n") <= k + 1)
    own = kept.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.max("asked").alias("asked"))
    own = checkpointed(own.select(F.col("ids")[0].alias("rep"), F.slice("ids", 1, k + 1).alias("ids"), "v", "asked"))
    n = own.count()
    share = min(1.0, sample_rows / max(n, 1))
    # At most about sample_rows vectors come to the driver.
    drawn = own.where(F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(1 << 20)) < share * (1 << 20)).orderBy("rep").select("v").toPandas()["v"]
    sample = unit(drawn) if len(drawn) else np.zeros((0, max(width, 1)), np.float32)
    forest = grow(sample, trees, max(2, int(leaf_rows * share)))
    most = visited or calibrated(forest, sample, k, recall)
    buckets = max(1, n * trees // 20_000)  # a leaf's bucket is its number's remainder
    kind = dict(own.dtypes)["rep"]
    schema = f"bucket long, rep {kind}, v {dict(own.dtypes)['v']}, leaves array<long>"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def dealt(batches, leaves_of):
        for batch in batches:
            for start in range(0, batch.num_rows, 2_000):
                part = batch.slice(start, 2_000)
                vectors = part.column("v").to_pylist()
                out: dict[str, list] = {c: [] for c in ("bucket", "rep", "v", "leaves")}
                for rep, v, leaves in zip(part.column("rep").to_pylist(), vectors, leaves_of(unit(vectors)), strict=True):
                    by: dict[int, list[int]] = {}
                    for leaf in np.asarray(leaves).tolist():
                        by.setdefault(leaf % buckets, []).append(leaf)
                    for bucket, own_leaves in by.items():
                        for c, x in zip(out, (bucket, rep, v, own_leaves), strict=True):
                            out[c].append(x)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    def rerank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Each query's best rows in the leaves of one bucket, by cosine of the given vectors."""
        found: dict[str, list] = {"q": [], "rep": [], "score": []}
        if len(left) and len(right):
            c = np.stack(list(left["v"])).astype(np.float64)
            norm, of = np.sqrt(np.einsum("ij,ij->i", c, c)), left["rep"].to_numpy()
            rows: dict[int, list[int]] = {}
            for i, leaves in enumerate(left["leaves"]):
                for leaf in leaves:
                    rows.setdefault(leaf, []).append(i)
            for name, v, leaves in zip(right["rep"], right["v"], right["leaves"], strict=True):
                at = np.unique(np.concatenate([np.array(rows.get(leaf, []), np.int64) for leaf in leaves]))
                q = np.asarray(v, np.float64)
                score = np.einsum("ij,j->i", c[at], q) / (norm[at] * np.sqrt(np.einsum("i,i->", q, q)))
                best = np.lexsort((of[at], -score))[: k + 1]
                found["q"] += [name] * len(best)
                found["rep"] += of[at][best].tolist()
                found["score"] += score[best].tolist()
        return pd.DataFrame(found)

    index = own.select("rep", "v").mapInArrow(lambda b: dealt(b, forest.leaves_of), schema)

    def searched(queries: DataFrame, visits: int) -> DataFrame:
        """(q, rep, score): the best k + 1 rows of each of the queries (rep, v)."""
        search = queries.select("rep", "v").mapInArrow(lambda b: dealt(b, lambda x: [forest.visit(q, visits) for q in x]), schema)
        met = index.groupBy("bucket").cogroup(search.groupBy("bucket")).applyInPandas(rerank, f"q {kind}, rep {kind}, score double")
        once = met.groupBy("q", "rep").agg(F.max("score").alias("score"))
        place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "rep"))
        return checkpointed(once.withColumn("n", place).where(F.col("n") <= k + 1).drop("n"))

    best, total = searched(own.where("asked"), most), forest.leaves()
    while most < total:
        enough = best.groupBy("q").count().where(F.col("count") >= min(k + 1, n)).select(F.col("q").alias("rep"))
        few = checkpointed(own.where("asked").join(enough, "rep", "left_anti"))
        if few.isEmpty():
            break
        most *= 8
        again = searched(few, most)
        best = best.join(few.select(F.col("rep").alias("q")), "q", "left_anti").unionByName(again)
    listed = best.join(own.select("rep", "ids"), "rep").groupBy("q").agg(F.collect_list(F.struct("score", "ids")).alias("found"))
    queries = given.where("asked").select("id", "v").join(own.where("asked").select("v", F.col("rep").alias("q")), "v").select("id", "q")
    every = queries.join(listed, "q").select("id", F.explode("found").alias("f")).select("id", "f.score", F.explode("f.ids").alias("vec_id")).where(F.col("vec_id") != F.col("id"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "vec_id"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("id").alias("query_id"), "rank", "vec_id", "score")

