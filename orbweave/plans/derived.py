"""Tables that are derived from a space and kept: unit rows at weights, and neighbour graphs.

Each is written once under a digest of what it is made of. New weights change the digest of
rows and graph, other blocked artists that of the graph alone; what was made before is found
again if they come back. A table is written beside its place and then renamed, so that
readers never meet half of one, and of two writers the first is kept.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.operators import knn, map_index, paths, search
from orbweave.plans.assemble import reweighted
from orbweave.sources.tables import _files, removed


def digest(*parts) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()[:32]


def set_digest(ids: DataFrame, column: str) -> str:
    """A digest of the distinct values of a column, from sums that are made where they are."""
    each = ids.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("v")).distinct()
    half = lambda i: F.conv(F.substring(F.sha2("v", 256), 15 * i + 1, 15), 16, 10).cast("decimal(38, 0)")
    got = each.agg(F.count("*").alias("n"), F.sum(half(0)).alias("a"), F.sum(half(1)).alias("b"), F.bit_xor(F.xxhash64("v")).alias("c")).head()
    return digest(got["n"], str(got["a"]), str(got["b"]), got["c"])


def files_version(spark: SparkSession, folder: str) -> str:
    """A digest of a table's files: their names, lengths and times."""
    files, path = _files(spark, folder)
    return digest(folder, *sorted([s.getPath().getName(), s.getLen(), s.getModificationTime()] for s in files.listStatus(path)))


def kept(spark: SparkSession, folder: str, key: str, make: Callable[[], DataFrame], by: tuple[str, ...] = ()) -> tuple[DataFrame, bool]:
    """The table of a key, in folders by some columns, and whether it was made now."""
    files, path = _files(spark, f"{folder}/{key}")
    if files.exists(path):
        return spark.read.parquet(f"{folder}/{key}"), False
    beside = f"{folder}/.making-{uuid.uuid4().hex}"
    make().write.partitionBy(*by).parquet(beside)
    _, made = _files(spark, beside)
    files.mkdirs(path.getParent())
    if files.exists(path) or not files.rename(made, path):
        removed(spark, beside)  # another writer was first
    return spark.read.parquet(f"{folder}/{key}"), True


def map_of(points: DataFrame, folder: str, version: str) -> tuple[DataFrame, map_index.Grid]:
    """The map index of a version's points (track_id, x, y), and its grid."""
    spark, key = points.sparkSession, digest("map", version, map_index.CELL_POINTS, map_index.TILES)
    meta, _ = kept(spark, folder, f"grid-{key}", lambda: spark.createDataFrame([tuple(vars(map_index.grid_for(points)).values())], "min_x double, min_y double, max_x double, max_y double, level int").coalesce(1))
    grid = map_index.Grid(**meta.head().asDict())
    index, _ = kept(spark, folder, f"map-{key}", lambda: map_index.indexed(points, grid), ("tile",))
    return index, grid


def search_index(rows: DataFrame, key: str, fields: list[str], folder: str, version: str) -> search.Index:
    """What a version's rows are searched by: a row for each key, with text fields."""
    spark, of = rows.sparkSession, digest("search", version, key, fields, search.GRAM)
    own, _ = kept(spark, folder, f"texts-{of}", lambda: rows.select(key, *fields).repartitionByRange(key).sortWithinPartitions(key))
    index, _ = kept(spark, folder, f"grams-{of}", lambda: search.postings(own, key, fields))
    counts, _ = kept(spark, folder, f"counts-{of}", lambda: search.counted(index))
    return search.Index(own, index, counts, key, fields)


class Navigator:
    """A space to ask for neighbours and paths. rows: track_id, artist_id, album_id, bpm and vec of a
    version, with blocks (name, start, end, weight). `made` counts what was built, by name."""

    def __init__(self, rows: DataFrame, blocks: list[tuple[str, int, int, float]], version: str, folder: str, k: int = 16):
        self.spark, self.source, self.blocks, self.version, self.folder, self.k = rows.sparkSession, rows, blocks, version, folder, k
        self.made: Counter[str] = Counter()
        self.set_weights(None)
        self.set_blocked(None)

    def set_weights(self, weights: dict[str, float] | None) -> None:
        """Weights by block; a block without one keeps its own. Rows and graph are others then."""
        self.weights = {name: float((weights or {}).get(name, weight)) for name, _, _, weight in self.blocks}
        self.rows_key = digest("rows", self.version, self.weights)

    def set_blocked(self, artists: DataFrame | None) -> None:
        """Artists (artist_id) that neither neighbours nor paths lead to. The graph is another then."""
        self.blocked = artists
        self.blocked_key = set_digest(artists, "artist_id") if artists is not None else digest(0)

    def _kept(self, name: str, key: str, make: Callable[[], DataFrame]) -> DataFrame:
        table, made = kept(self.spark, self.folder, f"{name}-{key}", make)
        self.made[name] += made
        return table

    def rows(self) -> DataFrame:
        return self._kept("rows", self.rows_key, lambda: reweighted(self.source, self.blocks, self.weights))

    def visible(self) -> DataFrame:
        rows = self.rows()
        return rows if self.blocked is None else rows.join(self.blocked.select("artist_id").distinct(), "artist_id", "left_anti")

    def _graph_key(self) -> str:
        return digest("graph", self.rows_key, self.blocked_key, self.k)

    def graph(self) -> DataFrame:
        """(src, dst, dist, rank): each row's k nearest rows that aren't blocked."""
        return self._kept("graph", self._graph_key(), lambda: knn.knn_graph(self.rows(), self.k, self.visible()))

    def steps(self) -> DataFrame:
        """The graph as paths take it, both ways, sorted so that a few rows' steps are in few files."""
        return self._kept("steps", self._graph_key(), lambda: paths.by_node(paths.steps(self.graph(), self.rows())))

    def landmarks(self, count: int = 4) -> DataFrame:
        return self._kept("landmarks", digest(self._graph_key(), count), lambda: paths.by_node(paths.landmarks(self.steps(), count)))

    def path(self, start: int, goal: int, landmarks: int = 0, report: dict | None = None) -> DataFrame:
        bounds = self.landmarks(landmarks) if landmarks else None
        return paths.shortest(self.steps(), start, goal, bounds, report)

    def forget(self) -> None:
        """Remove all tables but those of the present weights and blocked artists."""
        now = {self.rows_key, self._graph_key()}
        files, path = _files(self.spark, self.folder)
        for s in files.listStatus(path) if files.exists(path) else []:
            name = s.getPath().getName()
            if name.split("-", 1)[-1] not in now:
                removed(self.spark, f"{self.folder}/{name}")
