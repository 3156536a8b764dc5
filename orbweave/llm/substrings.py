"""Substring deduplication with a log-structured fingerprint index.

A window is WINDOW consecutive words. Of the runs of ANCHOR words in a window,
the one of least hash is its anchor; equal windows have equal anchors, and an
anchor serves about seven windows. The index keeps anchors in sorted immutable
runs (tables bucketed and sorted by hash, one for each batch), which a new batch
meets in merge joins without a shuffle; when there are too many runs they are
compacted into one. Windows of anchors that occur twice are then verified by
128 bits over their words, and all but the first of equal ones are removed.
"""

from __future__ import annotations

import hashlib
import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orbweave.llm.common import checkpointed, map_columns, matching, texts
from orbweave.llm.words import run_hashes, word_hashes

WINDOW, ANCHOR = 20, 8
#: Runs that an index may have before they are compacted.
MOST_RUNS = 2
#: Words of one bucket of a run, about, and the least number of buckets.
WORDS_PER_BUCKET, BUCKETS = 1_500_000, 48
#: deduplicate() cuts its table into 3 batches, and one more each time that it has four times as many rows as this.
BATCH_ROWS = 50_000
#: Sampled ids for each bound between batches.
SAMPLED_PER_BATCH = 100
#: A row's part in a run: an anchor's first place in its slice of texts, alone or
#: with others; and those others, whose key is their own, so that a frequent
#: anchor's rows don't meet in one bucket.
_ALONE, _FIRST, _OTHER = 0, 1, 2
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = hashlib.sha256(b"").hexdigest()


class _Windows:
    """All windows of a batch: each one's text, first word and anchor (both in that
    text), and the hashes of all anchors and words."""

    def __init__(self, batch: pa.RecordBatch, text_col: str):
        bounds, (self.words, self.again) = word_hashes([t.encode() for t in texts(batch, text_col)])
        self.anchors = run_hashes(self.words, ANCHOR)
        n = max(0, len(self.words) - WINDOW + 1)
        best, at = self.anchors[:n].copy(), np.arange(n)
        for step in range(1, WINDOW - ANCHOR + 1):
            other = self.anchors[step : step + n]
            less = np.flatnonzero(other < best)
            best[less] = other[less]
            at[less] = less + step
        row = np.repeat(np.arange(batch.num_rows), np.diff(bounds))[:n]
        whole = np.arange(n) + WINDOW <= bounds[1:][row]
        self.row, self.at, self.start = row[whole], at[whole], np.flatnonzero(whole)
        self.offset = bounds[:-1]


def _runs(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of rows in the keys' order: whether a row is the first of its keys, and how many have them."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    group = np.cumsum(new) - 1
    return new, np.bincount(group, minlength=1)[group]


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, h, id, pos, part): the anchors of each text, and their first words."""
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        def step(batch: pa.RecordBatch) -> dict[str, list]:
            w = _Windows(batch, text_col)
            at, first = np.unique(w.at, return_index=True)
            row = w.row[first]
            h = w.anchors[at]
            order = np.argsort(h, kind="stable")
            h, at, row = h[order], at[order], row[order]
            new, n = _runs([h])
            part = np.where(new, np.where(n > 1, _FIRST, _ALONE), _OTHER)
            key = np.where(new, h, h + np.arange(1, len(h) + 1, dtype=np.uint64) * _GOLDEN)
            ids = batch.column(id_col).take(pa.array(row))
            return {"key": key.view(np.int64), "h": h.view(np.int64), "id": ids, "pos": (at - w.offset[row]).astype(np.int32), "part": part.astype(np.int8)}

        return step

    return map_columns(docs.select(id_col, text_col), make, f"key long, h long, id {kind}, pos int, part tinyint", text_col)


def _verified(matched: DataFrame) -> DataFrame:
    """(id, start) of the windows of age 1 in (age, id, text, places) that also start earlier.
    Within a slice only the first of equal windows goes on to the shuffle; the others
    are known to have an earlier one, and go on as one list for each text."""
    kind = matched.schema["id"].dataType.simpleString()

    def make():
        def step(batch: pa.RecordBatch) -> dict[str, list]:
            w = _Windows(batch, "text")
            places = batch.column("places")
            sizes = np.asarray(pc.list_value_length(places), np.int64)
            found = np.asarray(places.flatten(), np.int64) + np.repeat(w.offset, sizes)
            asked = np.zeros(len(w.words) + 1, bool)
            asked[found] = True
            on = np.flatnonzero(asked[w.at])
            row, start = w.row[on], w.start[on]
            one, two = run_hashes(w.words, WINDOW, 1)[start], run_hashes(w.again, WINDOW, 2)[start]
            ids, age = batch.column("id"), np.asarray(batch.column("age"))
            rank = np.empty(batch.num_rows, np.int64)  # of the rows by age and id; equal ids are as early
            order = np.asarray(pc.sort_indices(pa.table({"age": age, "id": ids}), [("age", "ascending"), ("id", "ascending")]))
            rank[order] = np.arange(batch.num_rows)
            order = np.lexsort((start, rank[row], two, one))
            row, start, one, two = row[order], start[order], one[order], two[order]
            new, _ = _runs([one, two])
            lead = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            pos = start - w.offset[row]
            key = np.asarray(ids)[row]
            same = ~new & (key == key[lead]) & (pos == pos[lead]) & (age[row] == age[row[lead]])
            later = np.flatnonzero(~new & ~same & (age[row] == 1))
            later = later[np.argsort(row[later], kind="stable")]
            of, edges = np.unique(row[later], return_index=True)
            lists = pa.ListArray.from_arrays(np.append(edges, len(later)).astype(np.int32), pa.array(pos[later], pa.int32()))
            none = np.zeros(len(of), np.int64)
            return {
                "one": np.concatenate([one[new].view(np.int64), none]), "two": np.concatenate([two[new].view(np.int64), none]),
                "age": np.concatenate([age[row[new]], age[of]]), "id": np.concatenate([key[new], np.asarray(ids)[of]]),
                "start": np.concatenate([pos[new], none]), "later": pa.concat_arrays([pa.nulls(int(new.sum()), lists.type), lists]),
            }

        return step

    rows = map_columns(matched, make, f"one long, two long, age int, id {kind}, start int, later array<int>", "text")
    rows = rows.withColumn("salt", F.when(F.col("later").isNotNull(), F.xxhash64("id")).otherwise(0))
    first = Window.partitionBy("one", "two", "salt").orderBy("age", "id", "start")
    # Equal places of repeated rows are as early as each other: rank, not row_number.
    found = rows.withColumn("n", F.rank().over(first)).where((F.col("age") == 1) & (F.col("later").isNotNull() | (F.col("n") > 1)))
    return found.select("id", F.explode(F.coalesce("later", F.array("start"))).alias("start"))


class FingerprintIndex:
    """Anchors of all texts so far, in sorted runs. Tables of the session's
    warehouse; drop() removes them."""

    def __init__(self, spark: SparkSession, name: str | None = None, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS):
        self.spark, self.id_col, self.text_col, self.buckets = spark, id_col, text_col, buckets
        self.name = name or f"fingerprints_{uuid.uuid4().hex}"
        self.runs: list[str] = []
        self.made = 0

    def _write(self, rows: DataFrame) -> str:
        run = f"{self.name}_{self.made}"
        self.made += 1
        rows.repartition(self.buckets, "key").sortWithinPartitions("key").write.bucketBy(self.buckets, "key").sortBy("key").saveAsTable(run)
        return run

    def add(self, docs: DataFrame, archive: DataFrame | None = None) -> DataFrame:
        """The words of `docs` to remove, (id, start) of each window that also
        starts earlier, in `docs` or in an earlier batch; then docs are indexed.
        `archive` has the earlier batches' texts."""
        if len(self.runs) >= MOST_RUNS:  # before a batch that meets them, so that none is compacted in vain
            self.compact()
        run = self._write(fingerprints(docs, self.id_col, self.text_col))
        new = self.spark.table(run)
        leads = new.where(F.col("part") < _OTHER)
        again = leads.groupBy("key").agg(F.count("*").alias("n"), F.max("part").alias("part")).where((F.col("n") > 1) | (F.col("part") == _FIRST))
        hits = [leads.join(again, "key", "left_semi"), new.where(F.col("part") == _OTHER)]
        old = []
        for other in map(self.spark.table, self.runs):
            met = other.where(F.col("part") < _OTHER).join(leads, "key", "left_semi")
            # The others of a met anchor's rows: few anchors have any, so those are found first.
            several = checkpointed(other.where(F.col("part") == _FIRST).join(leads, "key", "left_semi").select(F.col("key").alias("h")).distinct())
            old += [met, matching(other.where(F.col("part") == _OTHER), several, "h")]
            hits.append(leads.join(other.where(F.col("part") < _OTHER), "key", "left_semi"))
        matched = self._matched(docs, hits, 1)
        if old and archive is not None:
            matched = matched.unionByName(self._matched(archive, old, 0))
        found = _verified(matched).groupBy("id").agg(F.collect_set("start").alias("starts"))
        found = checkpointed(found)
        self.runs.append(run)
        return found

    def _matched(self, docs: DataFrame, hits: list[DataFrame], age: int) -> DataFrame:
        every = hits[0].select("id", "pos")
        for more in hits[1:]:
            every = every.unionByName(more.select("id", "pos"))
        places = checkpointed(every.groupBy("id").agg(F.collect_set("pos").alias("places")))
        own = docs.select(F.col(self.id_col).alias("id"), F.col(self.text_col).alias("text"))
        few = matching(own, places.select("id"), "id")
        return few.join(places, "id").select(F.lit(age).alias("age"), "id", "text", "places")

    def compact(self) -> None:
        """Merge all runs into one, and drop them."""
        every = self.spark.table(self.runs[0])
        for run in self.runs[1:]:
            every = every.unionByName(self.spark.table(run))
        merged = self._write(every)
        for run in self.runs:
            self.spark.sql(f"DROP TABLE {run}")
        self.runs = [merged]

    def drop(self) -> None:
        for run in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {run}")
        self.runs = []


def _profile(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n_words, digest): the SHA-256 of the words joined by a space."""
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        def step(batch: pa.RecordBatch) -> dict[str, list]:
            words = [t.encode().split() for t in texts(batch, text_col)]
            return {"id": batch.column(id_col), "n_words": [len(w) for w in words], "digest": [hashlib.sha256(b" ".join(w)).hexdigest() for w in words]}

        return step

    return map_columns(docs.select(id_col, text_col), make, f"id {kind}, n_words long, digest string", text_col)


def _kept(docs: DataFrame) -> DataFrame:
    """(id, n_removed, kept_sha256, kept) of (id, text, starts)."""
    kind = docs.schema["id"].dataType.simpleString()

    def make():
        def step(batch: pa.RecordBatch) -> dict[str, list]:
            out: dict[str, list] = {"id": batch.column("id"), "n_removed": [], "kept_sha256": [], "kept": []}
            for text, starts in zip(texts(batch), batch.column("starts").to_pylist(), strict=True):
                words = text.encode().split()
                edge = np.zeros(len(words) + 1, np.int64)
                edge[starts] += 1
                edge[np.array(starts, np.int64) + WINDOW] -= 1
                stay = np.cumsum(edge)[:-1] == 0
                kept = b" ".join([w for w, s in zip(words, stay.tolist(), strict=True) if s])
                out["n_removed"].append(int((~stay).sum()))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["kept"].append(kept.decode())
            return out

        return step

    return map_columns(docs, make, f"id {kind}, n_removed long, kept_sha256 string, kept string")


def _bounds(profile: DataFrame, rows: int, batches: int) -> list:
    """Ids between batches of about the same number of rows, from a sample of about
    SAMPLED_PER_BATCH ids for each; they only bound the batches."""
    share = min(1.0, batches * SAMPLED_PER_BATCH / max(rows, 1))
    hashed = F.pmod(F.xxhash64("id"), F.lit(1 << 20))
    drawn = sorted(r["id"] for r in profile.where(F.col("id").isNotNull() & (hashed < share * (1 << 20))).select("id").collect())
    return sorted({drawn[i * len(drawn) // batches] for i in range(1, batches)}) if drawn else []


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int | None = None) -> DataFrame:
    """What stays of each text when repeated windows go.

    Words are runs of anything but space, tab and line ends. A word goes if a
    window that covers it has the same words as one that starts earlier: in a
    document of smaller id, or earlier in the same. Returns one row for each
    input row: the id column, n_words, n_removed, kept_sha256 (of the kept words,
    joined by a space) and kept (that text where words went, else null). The
    table goes through the index in `batches` by ascending id (by default a few,
    more with its size). Ids are of any type that has an order. A null text has
    no words; rows of a null id lose nothing and are no one's source; rows of
    one id should have one text, and don't count as earlier than each other.
    """
    spark = docs.sparkSession
    profile = checkpointed(_profile(docs, id_col, text_col))
    # Later copies of the same words lose all of them, if there is a window; only first ones are indexed.
    first = profile.where(F.col("id").isNotNull()).groupBy("digest").agg(F.min("id").alias("first"))
    judged = checkpointed(profile.join(first, "digest", "left").withColumn("copy", (F.col("id") > F.col("first")) & (F.col("n_words") >= WINDOW)))
    copies = judged.where("copy").select(F.col("id").alias(id_col)).distinct()
    source = docs.select(id_col, text_col).where(F.col(id_col).isNotNull())
    source = matching(source, checkpointed(copies), id_col, "left_anti")
    rows, words = profile.agg(F.count("*"), F.sum("n_words")).head()
    batches = batches or 3 + max(0, math.floor(math.log(max(rows, 1) / BATCH_ROWS, 4)))
    bounds = _bounds(profile, rows, batches)
    # No fewer buckets than a shuffle has partitions: each of those then writes files of one bucket or two.
    buckets = max(BUCKETS, (words or 0) // WORDS_PER_BUCKET, int(spark.conf.get("spark.sql.shuffle.partitions")))
    index = FingerprintIndex(spark, None, id_col, text_col, buckets)
    changed = None
    try:
        for low, high in zip([None, *bounds], [*bounds, None], strict=True):
            part = source if low is None else source.where(F.col(id_col) > low)
            part = part if high is None else part.where(F.col(id_col) <= high)
            found = index.add(part, None if low is None else source.where(F.col(id_col) <= low))
            own = part.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            ids = found.select("id")
            kept = _kept(matching(own, ids, "id").join(found, "id").select("id", "text", "starts"))
            changed = kept if changed is None else changed.unionByName(kept)
    finally:
        index.drop()
    changed = changed.dropDuplicates(["id"])
    removed = F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
    sha = F.when(F.col("copy"), F.lit(_EMPTY)).otherwise(F.coalesce("kept_sha256", "digest"))
    return judged.join(changed, "id", "left").select(
        F.col("id").alias(id_col), "n_words", removed.alias("n_removed"), sha.alias("kept_sha256"), F.when(F.col("copy"), F.lit("")).otherwise(F.col("kept")).alias("kept")
    )
