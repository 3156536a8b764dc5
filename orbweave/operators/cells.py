"""Exact nearest rows by cells around pivots.

Targets are dealt to the cell of their nearest pivot. A query first meets the nearest cells that
hold enough rows; its k-th result there bounds the rest: by the triangle inequality no row of a
cell is nearer than the distance to its pivot less the cell's radius (or the cell's
inner radius less that distance), and cells that can't beat the bound aren't met. Where vectors
have no clusters all cells are, and the work is that of comparing all rows with all.

Cells near each other share a tile, and a query goes to a tile once, however many of its cells it
meets there. There are about SIDE tiles and SIDE blocks of queries, however many rows there are, so
that what is sent grows as the rows do; above SIDE * MOST_ROWS rows there are more of both, since a
task holds one of each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orbweave.session import checkpointed

#: Targets of a cell, about, and the most pivots; rows of a block that meet each other in one task.
CELL_ROWS, MOST_PIVOTS, QUERY_ROWS = 2048, 4096, 4096
#: Tiles and blocks of queries, about, and the most rows of each.
SIDE, MOST_ROWS = 8, 131_072
#: Similarities are compared in nine places, distances have rounding errors.
_NEAR, _SLACK = 2e-9, 1e-7
#: Rows whose distances to all pivots are in memory at once.
_AT_ONCE = 1024


def side_rows(n: int, least: int) -> int:
    """Rows of each of about SIDE parts of n."""
    return min(MOST_ROWS, max(-(-n // SIDE), least, 1))


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(list(column)).astype(np.float64)


@dataclass
class Cells:
    """Pivots, and of each cell its inner and outer radius, rows, first tile and how many tiles it takes.
    With cosines a last cell has what isn't of length 1, and its outer radius is the greatest length there."""

    pivots: np.ndarray
    low: np.ndarray
    high: np.ndarray
    count: np.ndarray
    tile: np.ndarray
    parts: np.ndarray
    cosine: bool

    def distances(self, v: np.ndarray, pivots: np.ndarray | None = None) -> np.ndarray:
        pivots = self.pivots if pivots is None else pivots
        square = (v * v).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * v @ pivots.T
        return np.sqrt(np.maximum(square, 0))

    def odd(self, v: np.ndarray) -> np.ndarray:
        return np.abs((v * v).sum(1) - 1) > 1e-6 if self.cosine else np.zeros(len(v), bool)

    def similarities(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Cosines of unit rows, or squared distances below zero."""
        return a @ b.T if self.cosine else -np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)

    def reach(self, similarity: np.ndarray) -> np.ndarray:
        """The distance at which rows are as similar."""
        return np.sqrt(np.maximum(2 - 2 * similarity if self.cosine else -similarity, 0))

    def bounds(self, v: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest distance that a row of each of some cells can have; of the last cell nothing is known."""
        low, high = np.zeros((len(v), len(own))), np.full((len(v), len(own)), np.inf)
        near = own < len(self.pivots)
        at = own[near]
        far = self.distances(v, self.pivots[at])
        slack = _SLACK * (1 + far)
        low[:, near] = np.maximum(np.maximum(far - self.high[at], self.low[at] - far) - slack, 0)
        high[:, near] = far + self.high[at] + slack
        return low, high

    def nearer(self, v: np.ndarray, level: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Which of some cells may have a row as similar as a level (NaN: none is ruled out)."""
        low, _ = self.bounds(v, own)
        may = ~(low > (self.reach(level - _NEAR) * (1 + 1e-9))[:, None])
        if self.cosine:
            may[:, own == len(self.pivots)] = ~(self.high[-1] < level - _NEAR)[:, None]
            may[self.odd(v)] = True
        return may & (self.count[own] > 0)

    def better(self, v: np.ndarray, level: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of some cells those that are nearer than a level as a whole, and those that may have such rows among others."""
        low, high = self.bounds(v, own)
        # A cell that may have the row itself is met, so that it isn't counted.
        inside = (high < self.reach(level + _NEAR)[:, None] - _SLACK) & (low > 0)
        may = ~inside & ~(low > self.reach(level - _NEAR)[:, None] * (1 + 1e-9))
        odd, loose = self.odd(v), own == len(self.pivots)
        inside[:, loose], may[:, loose] = False, True
        inside[odd], may[odd] = False, True
        return inside, may & (self.count[own] > 0)

    def tiles(self, met: np.ndarray) -> np.ndarray:
        """The tiles of some cells."""
        return np.unique(np.concatenate([np.arange(self.tile[c], self.tile[c] + self.parts[c]) for c in met] or [np.zeros(0)])).astype(np.int32)

    def tiles_of(self, met: np.ndarray) -> list[np.ndarray]:
        """The tiles of each row's cells, of a table of rows and cells."""
        hit = np.zeros((len(met), int((self.tile + self.parts).max())), bool)
        for layer in range(int(self.parts.max())):
            for c in np.flatnonzero(self.parts > layer):
                hit[:, self.tile[c] + layer] |= met[:, c]
        return [np.flatnonzero(row).astype(np.int32) for row in hit]


def tiled(pivots: np.ndarray, count: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The first tile and the number of tiles of each cell. A cell of more than so many rows has tiles of
    its own; the others are halved along the direction in which their pivots differ most."""
    parts, tile, made = np.maximum(1, -(-count // rows)), np.zeros(len(count), np.int64), 0
    alone = parts > 1
    alone[len(pivots) :] = True
    for c in np.flatnonzero(alone):
        tile[c] = made
        made += parts[c]
    shared = np.flatnonzero(~alone)
    open_ = [(shared, int(max(1, -(-count[shared].sum() // rows))))] if len(shared) else []
    while open_:
        group, want = open_.pop()
        if want == 1 or len(group) == 1:
            tile[group] = made
            made += 1
            continue
        turn = group[np.argsort(pivots[group][:, pivots[group].var(0).argmax()], kind="stable")]
        upto = np.cumsum(count[turn])
        at = int(np.clip(np.searchsorted(upto, upto[-1] * (want // 2) / want) + 1, 1, len(turn) - 1))
        open_ += [(turn[:at], want // 2), (turn[at:], want - want // 2)]
    return tile, parts


def deal(others: DataFrame, vector: str, cosine: bool = True, cell_rows: int = CELL_ROWS) -> tuple[DataFrame, Cells]:
    """Targets (track_id, v, cell, tile) and their cells. Pivots are the rows of least hash, at most MOST_PIVOTS."""
    own = others.select("track_id", F.col(vector).alias("v"))
    n = own.count()
    most = int(min(MOST_PIVOTS, max(1, -(-n // cell_rows))))
    found = own.orderBy(F.xxhash64("track_id", F.lit(7)), "track_id").select("v").limit(most).toPandas()  # bounded by MOST_PIVOTS
    pivots = matrix(found["v"]) if len(found) else np.zeros((1, 1))
    size = len(pivots) + cosine
    out = Cells(pivots, np.zeros(size), np.zeros(size), np.zeros(size, np.int64), np.zeros(size, np.int64), np.ones(size, np.int64), cosine)
    if not n:
        return own.select("track_id", "v", F.lit(0).alias("cell"), F.lit(0).alias("tile")), out

    @F.pandas_udf("cell int, d double")
    def assign(v: pd.Series) -> pd.DataFrame:
        cell, d = np.zeros(len(v), np.int64), np.zeros(len(v))
        for at in range(0, len(v), _AT_ONCE):
            x = matrix(v.iloc[at : at + _AT_ONCE])
            far, odd, here = out.distances(x), out.odd(x), slice(at, at + len(x))
            cell[here], d[here] = np.where(odd, len(pivots), far.argmin(1)), np.where(odd, np.sqrt((x * x).sum(1)), far.min(1))
        return pd.DataFrame({"cell": cell, "d": d})

    dealt = checkpointed(own.withColumn("a", assign("v")).select("track_id", "v", "a.cell", "a.d"))
    for r in dealt.groupBy("cell").agg(F.min("d").alias("low"), F.max("d").alias("high"), F.count("*").alias("n")).collect():  # one row a pivot
        out.low[r["cell"]], out.high[r["cell"]], out.count[r["cell"]] = r["low"], r["high"], r["n"]
    out.tile, out.parts = tiled(pivots, out.count, side_rows(n, cell_rows))
    of = lambda numbers: F.get(F.lit(numbers.tolist()), F.col("cell"))
    return dealt.select("track_id", "v", "cell", (of(out.tile) + F.pmod(F.xxhash64("track_id"), of(out.parts))).cast("int").alias("tile")), out


def meet(asked: DataFrame, targets: DataFrame, cells: Cells, score: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """What `score` makes of queries (track_id, v, tiles, ...) and the targets of each tile that they ask for."""
    visits = asked.withColumn("tile", F.explode("tiles")).drop("tiles")
    counts = {r["tile"]: r["n"] for r in visits.groupBy("tile").agg(F.count("*").alias("n")).collect()}  # one row a tile
    rows = side_rows(max(counts.values(), default=0), CELL_ROWS)
    blocks = np.zeros(int((cells.tile + cells.parts).max()), np.int64)
    for tile, n in counts.items():
        blocks[tile] = -(-n // rows)
    of = F.get(F.lit(blocks.tolist()), F.col("tile"))
    left = visits.withColumn("block", F.pmod(F.xxhash64("track_id"), of).cast("int"))
    right = targets.where(of > 0).withColumn("block", F.explode(F.sequence(F.lit(0), (of - 1).cast("int"))))
    left, right = (x.select(*[F.col(c).alias(c) for c in x.columns]) for x in (left, right))  # both may come of one table
    return left.groupBy("tile", "block").cogroup(right.groupBy("tile", "block")).applyInPandas(lambda a, b: score(a, b), schema)


class Tile:
    """Targets of a tile by cell and id."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows.sort_values(["cell", "track_id"])
        self.v, self.ids = matrix(rows["v"]), rows["track_id"].to_numpy()
        self.cells, starts = np.unique(rows["cell"].to_numpy(), return_index=True)
        self.ends = [*zip(starts, [*starts[1:], len(rows)], strict=True)]

    def own(self, cell: int, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of those ids in a cell: places of the ids, and the rows' places in the cell."""
        here = self.ids[slice(*self.ends[cell])]
        first, last = np.searchsorted(here, ids), np.searchsorted(here, ids, side="right")
        while (more := np.flatnonzero(first < last)).size:
            yield more, first[more]
            first = first + 1


_FOUND = "src long, dst long, similarity double"
_NONE = pd.DataFrame({"src": pd.Series(dtype="int64"), "dst": pd.Series(dtype="int64"), "similarity": pd.Series(dtype="float64")})


class Best:
    """The k most similar of some rows, those alike in so many places by id; none that is less than its level."""

    def __init__(self, src: np.ndarray, level: np.ndarray, k: int, places: int | None):
        self.src, self.k, self.places = src, k, places
        self.level = np.where(np.isnan(level), -np.inf, level)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, at: np.ndarray, s: np.ndarray, ids: np.ndarray) -> None:
        """Similarities of rows `at` to targets; -inf takes no part."""
        slack = _NEAR if self.places else 0.0
        least = np.maximum(self.level[at] - slack, np.finfo(float).min)
        hit = s >= least[:, None]
        n, k = s.shape[1], self.k
        many = np.flatnonzero(hit.sum(1) > 2 * k)
        if len(many):
            kth = np.partition(np.where(np.isnan(s[many]), -np.inf, s[many]), n - k, axis=1)[:, n - k]
            self.level[at[many]] = np.maximum(self.level[at[many]], kth)
            hit[many] = s[many] >= np.maximum(kth - slack, least[many])[:, None]
        i, j = np.nonzero(hit)
        self.found.append((at[i], ids[j], s[i, j]))
        self.waiting += len(i)
        if self.waiting > 3 * k * len(self.src) + 10_000:
            self.settle()

    def settle(self) -> None:
        i, ids, s = (np.concatenate(x) for x in zip(*self.found, strict=True)) if self.found else (np.zeros(0, np.int64),) * 3
        rounded = s if self.places is None else np.round(s, self.places)
        turn = np.lexsort((ids, -rounded, i))
        i, ids, s, rounded = i[turn], ids[turn], s[turn], rounded[turn]
        first = np.searchsorted(i, np.arange(len(self.src)))
        place = np.arange(len(i)) - first[i]
        full = place == self.k - 1
        self.level[i[full]] = np.maximum(self.level[i[full]], rounded[full])
        kept = place < self.k
        self.found, self.waiting = [(i[kept], ids[kept], s[kept])], 0

    def frame(self) -> pd.DataFrame:
        self.settle()
        i, ids, s = self.found[0]
        return pd.DataFrame({"src": self.src[i], "dst": ids, "similarity": s}) if len(i) else _NONE


def order(places: int | None) -> list[Column]:
    s = F.col("similarity") if places is None else F.round("similarity", places)
    return [s.desc(), F.col("dst")]


def nearest(rows: DataFrame, others: DataFrame, k: int, vector: str = "u", cosine: bool = True, cell_rows: int = CELL_ROWS, report: dict | None = None) -> DataFrame:
    """(src, dst, similarity, rank): each row's k nearest others, itself excluded. With cosines vectors
    are of length 1 (what isn't is compared with all), and those alike in nine places are
    ordered by id; else similarity is the squared distance below zero. `report` gets how many
    pairs of a query and a cell there are and how many met."""
    (targets, cells), places = deal(others, vector, cosine, cell_rows), 9 if cosine else None
    n, loose = len(cells.pivots), len(cells.count) - 1

    def score(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        """Of the first meeting the cells in `met`, of the second those that `least` doesn't rule out."""
        if not len(a) or not len(b):
            return _NONE
        tile, again, out = Tile(b), "least" in a, []
        for at in range(0, len(a), _AT_ONCE):
            part = a.iloc[at : at + _AT_ONCE]
            x, src = matrix(part["v"]), part["track_id"].to_numpy()
            level = part["least"].to_numpy(np.float64) if again else np.full(len(x), np.nan)
            seen = np.zeros((len(x), len(cells.count)), bool)
            for row, met in zip(seen, part["met"], strict=True):
                row[np.asarray(met, int)] = True
            seen = seen[:, tile.cells]
            need = cells.nearer(x, level, tile.cells) & ~seen if again else seen
            found = Best(src, level, k, places)
            for c, (start, end) in enumerate(tile.ends):
                rows = np.flatnonzero(need[:, c])
                if len(rows):
                    s = cells.similarities(x[rows], tile.v[start:end])
                    for i, j in tile.own(c, src[rows]):
                        s[i, j] = -np.inf
                    found.add(rows, s, tile.ids[start:end])
            out.append(found.frame())
        return pd.concat(out)

    @F.pandas_udf("met array<int>, tiles array<int>")
    def enough(v: pd.Series) -> pd.DataFrame:
        """The nearest cells with more than k rows in all, and their tiles."""
        out: list[np.ndarray] = []
        for at in range(0, len(v), _AT_ONCE):
            x = matrix(v.iloc[at : at + _AT_ONCE])
            turn = np.argsort(cells.distances(x), axis=1)
            upto = (np.cumsum(cells.count[turn], axis=1) <= k).sum(1) + 1
            out += [t[:m].astype(np.int32) for t, m in zip(turn, upto, strict=True)]
        return pd.DataFrame({"met": out, "tiles": [cells.tiles(met) for met in out]})

    @F.pandas_udf("n long, tiles array<int>")
    def rest(v: pd.Series, least: pd.Series, met: pd.Series) -> pd.DataFrame:
        """How many more cells there are that a row of may be nearer than the k-th found, and their tiles."""
        n: list[int] = []
        out: list[np.ndarray] = []
        for at in range(0, len(v), _AT_ONCE):
            here = slice(at, at + _AT_ONCE)
            may = cells.nearer(matrix(v.iloc[here]), least.iloc[here].to_numpy(np.float64), np.arange(len(cells.count)))
            for row, seen in zip(may, met.iloc[here], strict=True):
                row[np.asarray(seen, int)] = False
            n += may.sum(1).tolist()
            out += cells.tiles_of(may)
        return pd.DataFrame({"n": n, "tiles": out})

    asked = rows.select("track_id", F.col(vector).alias("v"))
    rank = F.row_number().over(Window.partitionBy("src").orderBy(*order(places)))
    top = lambda found: found.withColumn("rank", rank).where(F.col("rank") <= k)
    only = n == 1 and not (cosine and cells.count[loose])
    if only:
        alone = F.lit(cells.tiles(np.zeros(1, int)).tolist()).cast("array<int>")
        found = top(meet(asked.withColumns({"met": F.array(F.lit(0)), "tiles": alone}), targets, cells, score, _FOUND))
        if report is not None:
            report.update(pairs=1.0, met=1.0)
        return found
    asked = checkpointed(asked.withColumn("e", enough("v")).select("track_id", "v", "e.met", "e.tiles"))
    first = checkpointed(top(meet(asked, targets, cells, score, _FOUND)).drop("rank"))
    levels = first.groupBy(F.col("src").alias("track_id")).agg(F.count("*").alias("n"), F.min("similarity").alias("least"))
    more = asked.join(levels, "track_id", "left").withColumn("least", F.when(F.col("n") == k, F.round("least", places) if places else F.col("least")))
    more = more.select("track_id", "v", "met", "least", rest("v", F.coalesce("least", F.lit(float("nan"))), "met").alias("r"))
    more = checkpointed(more.select("track_id", "v", "met", "least", "r.n", "r.tiles"))
    if report is not None:
        total = more.agg(F.count("*").alias("n"), F.sum(F.col("n") + F.size("met")).alias("met")).head()
        report.update(pairs=float(total["n"] * (cells.count > 0).sum()), met=float(total["met"] or 0))
    again = meet(more.drop("n"), targets, cells, score, _FOUND)
    return top(first.unionByName(again))


def ranks(asked: DataFrame, others: DataFrame, vector: str = "u", cell_rows: int = CELL_ROWS) -> DataFrame:
    """(track_id, n): how many others are better than a level, for rows (track_id, vector, s, o): of a greater
    cosine than s, in nine places, or of the same and a smaller id than o. Cells that are
    nearer as a whole are counted without meeting, those that are farther aren't met."""
    targets, cells = deal(others, vector, True, cell_rows)

    @F.pandas_udf("whole long, tiles array<int>")
    def split(v: pd.Series, s: pd.Series) -> pd.DataFrame:
        """The tiles with a cell that must be met, and the rows of nearer cells in the other tiles."""
        whole, out = [], []
        for at in range(0, len(v), _AT_ONCE):
            here = slice(at, at + _AT_ONCE)
            inside, may = cells.better(matrix(v.iloc[here]), s.iloc[here].to_numpy(np.float64), np.arange(len(cells.count)))
            met = cells.tiles_of(may)
            for row, tiles in zip(inside, met, strict=True):
                row[np.isin(cells.tile, tiles)] = False  # those are counted there
            whole += (inside * cells.count).sum(1).tolist()
            out += met
        return pd.DataFrame({"whole": whole, "tiles": out})

    def score(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"track_id": pd.Series(dtype="int64"), "n": pd.Series(dtype="int64")})
        tile, counts = Tile(b), np.zeros(len(a), np.int64)
        for at in range(0, len(a), _AT_ONCE):
            part = a.iloc[at : at + _AT_ONCE]
            x, own, level, first = matrix(part["v"]), part["track_id"].to_numpy(), part["s"].to_numpy(np.float64), part["o"].to_numpy()
            inside, may = cells.better(x, level, tile.cells)
            n = counts[at : at + _AT_ONCE]
            for c, (start, end) in enumerate(tile.ends):
                n += inside[:, c] * (end - start)
                rows = np.flatnonzero(may[:, c])
                if len(rows):
                    s, ids = x[rows] @ tile.v[start:end].T, tile.ids[start:end]
                    for i, j in tile.own(c, own[rows]):
                        s[i, j] = -np.inf
                    # What isn't near the level needs no rounding.
                    sure = s > (level[rows] + _NEAR)[:, None]
                    i, j = np.nonzero((s >= (level[rows] - _NEAR)[:, None]) & ~sure)
                    alike, at_level = np.round(s[i, j], 9), level[rows[i]]
                    more = (alike > at_level) | ((alike == at_level) & (ids[j] < first[rows[i]]))
                    n[rows] += sure.sum(1) + np.bincount(i[more], minlength=len(rows))
        return pd.DataFrame({"track_id": a["track_id"].to_numpy(), "n": counts})

    rows = asked.select("track_id", F.col(vector).alias("v"), "s", "o").withColumn("c", split("v", "s"))
    rows = checkpointed(rows.select("track_id", "v", "s", "o", "c.whole", "c.tiles"))
    met = meet(rows.drop("whole"), targets, cells, score, "track_id long, n long")
    every = met.unionByName(rows.select("track_id", F.col("whole").alias("n")))
    return every.groupBy("track_id").agg(F.sum("n").alias("n"))
