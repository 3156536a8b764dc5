"""Importance resampling towards a target's distribution, over hashed runs of words."""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from orbweave.llm.common import map_columns, map_stream, removed, shared_folder, stored
from orbweave.operators.relational import numbered

#: Words: runs of digits, lower-case letters and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BETWEEN = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
#: Texts are split in parts of about so many characters, cut between words.
PART_CHARS = 1 << 16
#: Features and their buckets that a task remembers, and the longest of them.
REMEMBERED, REMEMBERED_CHARS = 200_000, 64
#: Buckets of features that are counted at once.
_AT_ONCE = 1 << 20


def parts(text: str) -> Iterator[str]:
    """A text in parts of about PART_CHARS; none ends within a word."""
    start = 0
    while len(text) - start > PART_CHARS:
        cut = _BETWEEN.search(text, start + PART_CHARS)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


class Buckets(dict):
    """The bucket of each feature, remembered in part."""

    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __missing__(self, feature: str) -> int:
        bucket = zlib.crc32(feature.encode()) % self.n
        if len(feature) <= REMEMBERED_CHARS and len(self) < REMEMBERED:
            self[feature] = bucket
        return bucket


def windows(found: list[tuple[str, tuple[int, int]]], longest: int, seen: int) -> Iterator[str]:
    """Runs of 1 to `longest` words, which are joined by one space: each is what stands between the
    offsets of its first and its last word there. Those that end within the first `seen`
    words were given before."""
    joined = " ".join(w for w, _ in found)
    ends = np.cumsum([b - a + 1 for _, (a, b) in found]) - 1
    pairs = list(zip((ends - [b - a for _, (a, b) in found]).tolist(), ends.tolist(), strict=True)) if found else []
    for length in range(1, longest + 1):
        for i in range(max(0, seen - length + 1), len(pairs) - length + 1):
            yield joined[pairs[i][0] : pairs[i + length - 1][1]]


def histograms(texts: list[str], splitter: pre_tokenizers.PreTokenizer, buckets: Buckets, longest: int) -> dict[str, list]:
    """Of each lower-cased text: n_words, n_features, and the buckets it has with their counts."""
    n_words, n_features = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    keys, counts, pending, size = [], [], [], 0

    def count() -> None:
        nonlocal size
        key, n = np.unique(np.concatenate(pending), return_counts=True)
        keys.append(key)
        counts.append(n)
        pending.clear()
        size = 0

    for i, text in enumerate(texts):
        carried: list[tuple[str, tuple[int, int]]] = []
        for part in parts(text):
            found = splitter.pre_tokenize_str(part)
            n_words[i] += len(found)
            if longest == 1:
                own = [buckets[w] for w, _ in found]
            else:
                found = carried + found
                own = [buckets[w] for w in windows(found, longest, len(carried))]
                carried = found[max(0, len(found) - longest + 1) :]
            n_features[i] += len(own)
            if own:
                pending.append(np.array(own, np.int64) + i * buckets.n)
                size += len(own)
            if size > _AT_ONCE:
                count()
    if pending:
        count()
    if len(keys) > 1:
        key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(inverse, np.concatenate(counts)).astype(np.int64)
    else:
        key, n = (keys[0], counts[0]) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    ends = np.searchsorted(key, np.arange(len(texts) + 1) * buckets.n).astype(np.int32)
    lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (key % buckets.n, n)]
    return {"n_words": n_words, "n_features": n_features, "buckets": lists[0], "counts": lists[1]}


def features(rows: DataFrame, columns: list[str], text_col: str, longest: int, buckets: int) -> DataFrame:
    """The columns and, of each row's whole text (null: no words), A-Z lower-cased: n_words,
    n_features, and the buckets it has with their counts, at most `buckets` of them."""
    own = rows.select(*columns, F.col(text_col).cast("string").alias("_text"))

    def make():
        splitter, known = pre_tokenizers.Split(Regex(WORD), behavior="removed", invert=True), Buckets(buckets)

        def step(batch: pa.RecordBatch) -> dict[str, list]:
            lowered = pc.ascii_lower(batch.column("_text")).to_pylist()
            return {c: batch.column(c) for c in columns} | histograms(["" if t is None else t for t in lowered], splitter, known, longest)

        return step

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in own.schema.fields[:-1])
    return map_columns(own, make, f"{kept}n_words long, n_features long, buckets array<int>, counts array<int>", "_text")


def totals(featured: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket over all rows. A task gives a row for each bucket at most."""

    def make():
        held = np.zeros(buckets, np.int64)

        def step(batch: pa.RecordBatch | None) -> dict[str, list]:
            if batch is None:
                some = np.flatnonzero(held)
                return {"bucket": some, "n": held[some]}
            at, n = (batch.column(c).flatten().to_numpy() for c in ("buckets", "counts"))
            np.add(held, np.bincount(at, n, buckets).astype(np.int64), out=held)
            return {"bucket": [], "n": []}

        return step

    summed = map_stream(featured.select("buckets", "counts"), make, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[summed["bucket"].to_numpy(np.int64)] = summed["n"].to_numpy(np.int64)
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of how much likelier each bucket is in the target, with one feature more in each."""
    n, s, t = len(source), source.astype(float), target.astype(float)
    ratio = (t + 1) * (float(source.sum()) + n) / ((s + 1) * (float(target.sum()) + n))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weighed(featured: DataFrame, gain: np.ndarray, columns: list[str]) -> DataFrame:
    """The columns and weight: the sum of gains over a row's features, 0 if it has none."""

    def make():
        def step(batch: pa.RecordBatch) -> dict[str, list]:
            at, n = (batch.column(c).flatten().to_numpy() for c in ("buckets", "counts"))
            sums = np.concatenate([[0], np.cumsum(gain[at] * n.astype(np.int64))])
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(batch.column("buckets")).to_numpy(zero_copy_only=False))])
            return {c: batch.column(c) for c in columns} | {"weight": sums[ends[1:]] - sums[ends[:-1]]}

        return step

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in featured.schema.fields if f.name in columns)
    return map_columns(featured.select(*columns, "buckets", "counts"), make, f"{kept}weight long", None)


def resample(
    rows: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, buckets: int = 10_000, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """A draw of `percent` of the rows with at least `least_words` words, without replacement and
    likelier the more a text resembles the target's: (id, n_words, n_features, weight, score, rank).

    score is the weight and a thousandfold Gumbel number drawn from the id's hash; the highest
    are drawn and ranked from 1, ties to the smaller id (then fewer features, then less weight);
    others have no rank. One row for each row, repeated ones too; a null text has no words, a null
    id is hashed as the empty one and comes last among ties. No rows give no rows; without a
    target all buckets are as likely in it. Other columns are left out.

    Each text is split once; its buckets and counts are written to the shared folder until the draw is made.
    """
    spark, kept = rows.sparkSession, ["_id", "n_words", "n_features"]
    home = f"{shared_folder(spark)}/resample-{uuid.uuid4().hex}"
    try:
        own = stored(features(rows.select(F.col(id_col).alias("_id"), text_col), ["_id"], text_col, longest, buckets), f"{home}/features")
        gain = gains(totals(own, buckets), totals(features(target, [], text_col, longest, buckets), buckets))
        digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))), 256)
        h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
        score = (F.col("weight") + F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))).cast("long")
        scored = stored(weighed(own, gain, kept).withColumn("score", score).withColumn("_may", F.col("n_words") >= least_words), f"{home}/scored")
        drawn = percent * scored.where("_may").count() // 100
        placed = numbered(scored, [F.desc("_may"), F.desc("score"), F.col("_id").asc_nulls_last(), "n_features", "weight"], "_place")
    finally:
        removed(spark, home)
    rank = F.when(F.col("_may") & (F.col("_place") <= drawn), F.col("_place"))
    return placed.select(F.col("_id").alias(id_col), "n_words", "n_features", "weight", "score", rank.alias("rank"))
