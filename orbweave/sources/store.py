"""A keyed table that is changed by many: a base, deltas that readers merge, and versions that are
committed by one writer each.

Version n is a folder that is written beside its place and renamed to it: it is there whole or
not at all, and the second of two writers of one version fails and may try again on
what the first has made. Rows are in folders by a hash of their key, so that a few keys are
read from few of them. Compaction writes what is merged as a base; versions before it
stay until no reader that has pinned one is left.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.operators.merge import upsert
from orbweave.sources.tables import _files, removed

#: Folders that rows are dealt to by default.
BUCKETS = 8


class Conflict(RuntimeError):
    """Another writer has committed the version."""


class Store:
    """columns: those of the table as DDL; key: of a row; how: what becomes of the other columns, as
    merge.fold has it (overwrite, coalesce, least, first)."""

    def __init__(self, spark: SparkSession, folder: str, columns: str, key: list[str], how: dict[str, list[str]], buckets: int = BUCKETS):
        self.spark, self.folder, self.key, self.how, self.buckets = spark, folder, key, how, buckets
        self.empty = spark.createDataFrame([], columns)
        self.schema = self.empty.withColumn("_gone", F.lit(False)).withColumn("_seq", F.lit(0).cast("long")).withColumn("_bucket", F.lit(0)).schema

    def _names(self) -> list[str]:
        files, path = _files(self.spark, f"{self.folder}/versions")
        return sorted(s.getPath().getName() for s in files.listStatus(path)) if files.exists(path) else []

    def version(self) -> int:
        """The newest version; 0 of a table that has none."""
        names = self._names()
        return int(names[-1].split("-")[0]) if names else 0

    def _since_base(self, version: int) -> list[str]:
        names = [n for n in self._names() if int(n.split("-")[0]) <= version]
        bases = [i for i, n in enumerate(names) if n.endswith("-base")]
        return names[bases[-1] :] if bases else names

    def _bucket(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_bucket", F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int"))

    def _commit(self, rows: DataFrame, version: int, base: bool) -> int:
        beside = f"{self.folder}/.making-{uuid.uuid4().hex}"
        dealt = self._bucket(rows).repartition("_bucket").select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields])
        dealt.sortWithinPartitions("_bucket", *self.key).write.partitionBy("_bucket").parquet(beside)
        files, made = _files(self.spark, beside)
        _, place = _files(self.spark, f"{self.folder}/versions/{version:08d}")
        _, as_base = _files(self.spark, f"{self.folder}/versions/{version:08d}-base")
        files.mkdirs(place.getParent())
        if files.exists(place) or files.exists(as_base) or not files.rename(made, as_base if base else place):
            removed(self.spark, beside)
            raise Conflict(f"version {version} is committed already")
        return version

    def commit(self, changes: DataFrame, seq: str, after: int, gone: DataFrame | None = None) -> int:
        """The changes (in the order of a whole number `seq`), and keys that go before them, as the
        version after `after`; fails if there is one. What a column of `how` has no value for stays as it is."""
        rows = changes.withColumn("_gone", F.lit(False)).withColumn("_seq", F.col(seq).cast("long")).drop(*({seq} - set(self.empty.columns)))
        rows = self.empty.withColumn("_gone", F.lit(False)).withColumn("_seq", F.lit(0).cast("long")).unionByName(rows, allowMissingColumns=True)
        if gone is not None:
            rows = rows.unionByName(gone.select(*self.key).distinct().withColumn("_gone", F.lit(True)).withColumn("_seq", F.lit(0).cast("long")), allowMissingColumns=True)
        return self._commit(rows, after + 1, False)

    def change(self, changes: Callable[[DataFrame], DataFrame], seq: str, tries: int = 5) -> int:
        """Commit what `changes` makes of the newest version, again of the then newest after a conflict."""
        for left in range(tries - 1, -1, -1):
            version = self.version()
            try:
                return self.commit(changes(self.read(version)), seq, version)
            except Conflict:
                if not left:
                    raise
        raise AssertionError

    def read(self, version: int | None = None, keys: DataFrame | None = None) -> DataFrame:
        """The table as of a version; of some keys (few, distinct) their folders alone are read."""
        frames = []
        for turn, name in enumerate(self._since_base(self.version() if version is None else version)):
            rows = self.spark.read.schema(self.schema).parquet(f"{self.folder}/versions/{name}").withColumn("_turn", F.lit(turn))
            frames.append(rows)
        if not frames:
            return self.empty
        every = frames[0]
        for more in frames[1:]:
            every = every.unionByName(more)
        if keys is not None:
            found = [r["_bucket"] for r in self._bucket(keys.select(*self.key)).select("_bucket").distinct().collect()]  # a number for each folder
            every = every.where(F.col("_bucket").isin(found)).join(F.broadcast(keys.select(*self.key)), self.key, "left_semi")
        order = F.struct("_turn", F.when(F.col("_gone"), 0).otherwise(1).alias("kind"), "_seq")
        every = every.drop("_bucket").withColumn("_at", order)
        left = every.groupBy(*self.key).agg(F.max(F.when(F.col("_gone"), F.col("_at"))).alias("_last_gone"))
        live = every.where("NOT _gone").join(left.where("_last_gone IS NOT NULL"), self.key, "left").where("_last_gone IS NULL OR _at > _last_gone")
        none = self.empty.limit(0)
        merged = upsert(none, live.drop("_gone", "_seq", "_turn", "_last_gone"), self.key, "_at", **self.how)
        return merged.select(*self.empty.columns)

    def compact(self) -> int:
        """The newest version's rows as a base of their own version."""
        version = self.version()
        rows = self.read(version).withColumn("_gone", F.lit(False)).withColumn("_seq", F.lit(0).cast("long"))
        return self._commit(rows, version + 1, True)

    @contextmanager
    def pinned(self, seconds: float = 3600.0) -> Iterator[tuple[int, DataFrame]]:
        """A version and its rows, which stay at least until the end, or so many seconds."""
        version = self.version()
        files, place = _files(self.spark, f"{self.folder}/readers/{version:08d}-{int((time.time() + seconds) * 1000)}-{uuid.uuid4().hex}")
        files.mkdirs(place)
        try:
            yield version, self.read(version)
        finally:
            files.delete(place, True)

    def expire(self) -> list[str]:
        """Remove versions that neither the newest base nor a pinned version is read from; their names."""
        files, path = _files(self.spark, f"{self.folder}/readers")
        pins = [s.getPath().getName().split("-") for s in files.listStatus(path)] if files.exists(path) else []
        live = [int(v) for v, until, _ in pins if int(until) > time.time() * 1000]
        needed = {n for v in [self.version(), *live] for n in self._since_base(v)}
        gone = [n for n in self._names() if n not in needed and int(n.split("-")[0]) < self.version()]
        for name in gone:
            removed(self.spark, f"{self.folder}/versions/{name}")
        return gone
