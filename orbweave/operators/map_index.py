"""Map points that are kept in the order of a Z-curve, so that a part of the map is a few ranges of its cells."""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.operators.map2d import bounds

#: Points of a cell, about, the finest grid (2 to its power cells a side), and that of the folders.
CELL_POINTS, FINEST, TILES = 64, 15, 3
#: Ranges that a rectangle is made of at most; where more would be needed, some hold more than it.
RANGES = 32


def _spread(v: Column) -> Column:
    """The bits of a number under 2**16, with a zero before each."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return v


def z_of(cell_x: Column, cell_y: Column) -> Column:
    return _spread(cell_x.cast("long")).bitwiseOR(F.shiftleft(_spread(cell_y.cast("long")), 1))


@dataclass
class Grid:
    """Cells of a map, 2**level a side."""

    min_x: float
    min_y: float
    max_x: float
    max_y: float
    level: int

    @property
    def width(self) -> float:
        return max(self.max_x - self.min_x, 1e-9)

    @property
    def height(self) -> float:
        return max(self.max_y - self.min_y, 1e-9)

    @property
    def tile_shift(self) -> int:
        return 2 * max(0, self.level - TILES)

    def columns(self, points: DataFrame) -> DataFrame:
        """The points with z, their cell's place on the curve, and tile, their folder."""
        side = 1 << self.level
        at = lambda c, low, size: F.greatest(F.lit(0), F.least(F.lit(side - 1), F.floor((F.col(c) - low) / size * side)))
        z = z_of(at("x", self.min_x, self.width), at("y", self.min_y, self.height))
        return points.withColumn("z", z).withColumn("tile", F.shiftright("z", self.tile_shift).cast("int"))

    def cells(self, x0: float, y0: float, x1: float, y1: float) -> tuple[int, int, int, int] | None:
        """First and last cells of a rectangle, both ways; a cell more at each side, for rounding."""
        if x1 < self.min_x or y1 < self.min_y or x0 > self.max_x or y0 > self.max_y or x1 < x0 or y1 < y0:
            return None
        side = 1 << self.level
        at = lambda v, low, size, more: min(side - 1, max(0, math.floor((min(max(v, low), low + size) - low) / size * side) + more))
        return at(x0, self.min_x, self.width, -1), at(y0, self.min_y, self.height, -1), at(x1, self.min_x, self.width, 1), at(y1, self.min_y, self.height, 1)

    def ranges(self, x0: float, y0: float, x1: float, y1: float, most: int = RANGES) -> list[tuple[int, int]]:
        """Ranges of z (both ends in) that hold all cells of a rectangle: quadrants, of which the
        largest that reach beyond it are split while there are not too many."""
        box = self.cells(x0, y0, x1, y1)
        if box is None:
            return []
        a, b, c, d = box
        done, open_ = [], [(-self.level, 0, 0, 0)]  # size as a negative power, z, cell x, cell y
        while open_:
            size, z, x, y = heapq.heappop(open_)
            side = 1 << -size
            inside = a <= x and x + side - 1 <= c and b <= y and y + side - 1 <= d
            if inside or not size or len(done) + len(open_) + 4 > most:
                done.append((z, z + side * side - 1))
                continue
            half = side // 2
            for q, (i, j) in enumerate(((0, 0), (1, 0), (0, 1), (1, 1))):
                u, v = x + i * half, y + j * half
                if u <= c and u + half > a and v <= d and v + half > b:
                    heapq.heappush(open_, (size + 1, z + q * half * half, u, v))
        merged: list[tuple[int, int]] = []
        for low, high in sorted(done):
            if merged and low <= merged[-1][1] + 1:
                merged[-1] = (merged[-1][0], max(high, merged[-1][1]))
            else:
                merged.append((low, high))
        return merged


def grid_for(points: DataFrame) -> Grid:
    b = bounds(points).head()
    level = max(0, min(FINEST, math.ceil(math.log2(max(b["n"] / CELL_POINTS, 1)) / 2)))
    return Grid(b["min_x"], b["min_y"], b["max_x"], b["max_y"], level)


def indexed(points: DataFrame, grid: Grid) -> DataFrame:
    """Points that have a place, in ranges of the curve; one cell's many points are split by id."""
    placed = grid.columns(points.where(F.col("x").isNotNull() & F.col("y").isNotNull()))
    return placed.repartitionByRange("z", "track_id").sortWithinPartitions("tile", "z", "track_id")


def rectangle(index: DataFrame, grid: Grid, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """The points in a rectangle: folders by their tiles, parts of files by ranges of the curve, and what is left by place."""
    ranges = grid.ranges(x0, y0, x1, y1)
    if not ranges:
        return index.limit(0)
    tiles = sorted({t for low, high in ranges for t in range(low >> grid.tile_shift, (high >> grid.tile_shift) + 1)})
    on = F.lit(False)
    for low, high in ranges:
        on = on | F.col("z").between(low, high)
    return index.where(F.col("tile").isin(tiles)).where(on).where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))


def nearest(index: DataFrame, grid: Grid, x: float, y: float, radius: float) -> DataFrame:
    """The nearest point (track_id, distance) closer than the radius, if there is one: by squares around
    the place that grow twofold from a cell's size, until what is found is nearer than their sides."""
    reach = min(radius, max(grid.width, grid.height) / (1 << grid.level))
    d2 = (F.col("x") - x) ** 2 + (F.col("y") - y) ** 2
    while True:
        near = rectangle(index, grid, x - reach, y - reach, x + reach, y + reach).withColumn("d2", d2).where(F.col("d2") < radius * radius)
        found = near.orderBy("d2", "track_id").select("track_id", "d2").head()
        if reach >= radius or found is not None and found["d2"] <= reach * reach:
            break
        reach = min(2 * reach, radius)
    rows = [(found["track_id"], round(math.sqrt(found["d2"]), 9))] if found is not None else []
    return index.sparkSession.createDataFrame(rows, "track_id long, distance double")
