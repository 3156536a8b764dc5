"""Exact Jaccard join of shingle sets by universe partition.

The hash universe is cut into segments, by bands of set sizes. Two sets of
Jaccard similarity 0.8 or more differ in at most H elements, so with H + 1 + X
segments at least 1 + X of them hold the same elements of both: the hash of a
segment's elements is a signature, and such sets share one. Empty segments and
signatures whose buckets hold too many pairs of unlinked sets ("common") are
passed over; X is the slack for that. Sets that pass over more than X segments
match each other in their cheapest other segments with at most one element
deleted.

In each signature's bucket all sets are first verified against one of them, which
joins groups of copies in linear time; only pairs that are still in different
components are then verified one by one, if there are few of them for the bucket's size.
Before sets meet, their parities do: bits that each element flips, which differ in no
more places than the sets in elements. Only pairs that these don't rule out need sets.

A set that has enough other segments finds all its partners by them. Those that
don't ("short") have partners left among each other alone. Common buckets join them
to groups; each is taken relative to its group's pivot, the set that is in most of
these buckets: what all share with the pivot vanishes, and sets alike must be alike
in their differences d from it. Sets far from their pivot form groups anew. |x - y| counted both
ways is |dx - dy| so counted, so x and y of sizes nx and ny are linked if
18 * |dx & dy| >= wx + wy with w = 9 * |d| - n. Sets with no common difference are
then linked only if both are linked with the pivot; the others meet in one of
their cheapest differences, each a segment of its own, as many as must hold a shared one.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.llm.common import ascii_lower, checkpointed, map_columns, matching, splitmix, texts
from orbweave.llm.graph import components
from orbweave.llm.words import shingle_sets

SHINGLE = 5
#: A link: PERCENT * union <= 100 * intersection. The pivots' bounds hold for this figure.
PERCENT = 80
#: Sets of up to so many elements, and their partners, have each element as a segment.
SMALL = 16
#: A bucket with more pairs of unlinked sets for each of its sets than this is common.
COMMON = 8
#: Hashes are counted in 2**SKETCH_BITS buckets to tell which are frequent.
SKETCH_BITS = 20
#: Pairs with the same first set that one task verifies, about.
SHARE = 1_000
_GROWTH = 1.25
#: Classes of weights relative to a pivot grow by this factor.
_CLASS = 1.125
#: Times that sets far from their pivot get another; in the last round all that are left take theirs.
ROUNDS = 3


@functools.lru_cache(maxsize=1)
def bands(most: int = 1 << 33) -> list[tuple[int, int, int, int]]:
    """(least size, greatest size, segments, slack) by ascending size; a pair lies
    in the band whose step its smaller set is in. The first has one element each segment."""
    out = [(1, SMALL * 100 // PERCENT, 0, 0)]
    low = SMALL + 1
    while low < most:
        after = max(low + 1, int(low * _GROWTH))
        high = (after - 1) * 100 // PERCENT
        differ = (after - 1 + high) * (100 - PERCENT) // (100 + PERCENT)
        slack = 3 + differ // 12
        out.append((low, high, differ + 1 + slack, slack))
        low = after
    return out


@functools.lru_cache(maxsize=1 << 14)
def bands_of(size: int) -> list[tuple[int, int, int]]:
    """(number, segments, slack) of the bands that a set of that size is in."""
    return [(i, m, x) for i, (low, high, m, x) in enumerate(bands()) if low <= size <= high] if size else []


def _numbers(s: np.ndarray, m: int) -> np.ndarray:
    """Of each element, the number of its segment among m."""
    return ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)


def _mixed(s: np.ndarray) -> np.ndarray:
    return splitmix(s + np.uint64(0x51ED270B0F1A2C35))


def _segments(s: np.ndarray, mixed: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a sorted set and its mixed elements in one band: where its non-empty
    segments start, their numbers, and sums of mixed elements."""
    if m == 0:
        return np.arange(len(s)), s, mixed
    number = _numbers(s, m)
    starts = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
    return starts, number[starts], np.add.reduceat(mixed, starts)


def _signature(sums: np.ndarray, number: np.ndarray, band: int) -> np.ndarray:
    return splitmix(sums + splitmix(number * np.uint64(0x9E3779B97F4A7C15) + np.uint64(band)))


def is_bare(s: np.ndarray) -> bool:
    """Whether a sorted set has more empty segments than slack in one of its bands."""
    for _, m, slack in bands_of(len(s)):
        if m and (number := _numbers(s, m)).size and m - 1 - np.count_nonzero(number[1:] != number[:-1]) > slack:
            return True
    return False


def signatures(s: np.ndarray) -> np.ndarray:
    """A set's signatures in all its bands."""
    found, mixed = [], _mixed(s)
    for band, m, _ in bands_of(len(s)):
        _, number, sums = _segments(s, mixed, m)
        found.append(_signature(sums, number, band))
    return np.concatenate(found) if found else s[:0]


def _sets(batch: pa.RecordBatch, column: str) -> list[np.ndarray]:
    return shingle_sets([ascii_lower(t) for t in texts(batch, column)], SHINGLE)


def _stored(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The sets of a batch's `elements`."""
    return (np.frombuffer(e, np.uint64) for e in batch.column("elements").to_pylist())


def _parity(s: np.ndarray) -> bytes:
    """Bits, one or two for each element, of which each element flips one."""
    bits = max(64, 1 << (len(s) - 1).bit_length()) if len(s) else 64
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def _apart(a: bytes, b: bytes) -> int:
    """In how many elements two sets differ at the least, by their parities; the longer one is folded."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _profile(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        def step(batch: pa.RecordBatch) -> dict[str, list]:
            sets = _sets(batch, text_col)
            return {"id": batch.column(id_col), "n": [len(s) for s in sets], "digest": [hashlib.md5(s.tobytes()).hexdigest() for s in sets], "bare": [is_bare(s) for s in sets], "parity": [_parity(s) for s in sets]}

        return step

    return map_columns(docs.select(id_col, text_col), make, f"id {kind}, n long, digest string, bare boolean, parity binary", text_col)


def _signature_rows(docs: DataFrame) -> DataFrame:
    """(sig, id) of distinct sets."""
    kind = docs.schema["id"].dataType.simpleString()

    def make():
        def step(batch: pa.RecordBatch) -> dict[str, list]:
            found = [signatures(s) for s in _sets(batch, "text")]
            row = np.repeat(np.arange(len(found)), [len(f) for f in found])
            return {"sig": np.concatenate(found).view(np.int64), "id": batch.column("id").take(pa.array(row))}

        return step

    return map_columns(docs, make, f"sig long, id {kind}")


def _set_rows(docs: DataFrame) -> DataFrame:
    """(id, elements): each set's sorted hashes, 64 bits each."""
    kind = docs.schema["id"].dataType.simpleString()

    def make():
        return lambda batch: {"id": batch.column("id"), "elements": [s.tobytes() for s in _sets(batch, "text")]}

    return map_columns(docs, make, f"id {kind}, elements binary")


def _buckets(rows: DataFrame) -> DataFrame:
    """(sig, lead, id) of signatures that several ids have; lead is the least id.
    Rows come sorted, so a bucket of any size passes through in batches."""
    kind = dict(rows.dtypes)["id"]
    sorted_rows = rows.repartition("sig").sortWithinPartitions("sig", "id")

    def make():
        last: list = [None, None, None, True]  # signature, lead and id of the last row, and whether its lead was handed on

        def step(batch: pa.RecordBatch) -> dict[str, list]:
            sig, ids = np.asarray(batch.column("sig")), np.asarray(batch.column("id"))
            fresh = np.ones(len(sig), bool)
            fresh[1:] = (sig[1:] != sig[:-1]) | (ids[1:] != ids[:-1])
            fresh[0] = last[0] is None or sig[0] != last[0] or ids[0] != last[2]
            sig, ids = sig[fresh], ids[fresh]
            if not len(sig):
                return {"sig": [], "lead": [], "id": []}
            carried = last[0] is not None and sig[0] == last[0]
            if carried and not last[3]:
                sig, ids = np.concatenate([[last[0]], sig]), np.concatenate([[last[1]], ids])
            new = np.ones(len(sig), bool)
            new[1:] = sig[1:] != sig[:-1]
            run = np.cumsum(new) - 1
            first = np.flatnonzero(new)[run]
            lead, several = ids[first], np.bincount(run)[run] > 1
            if carried:
                head = run == 0
                lead, several = np.where(head, last[1], lead), several | head
            last[:] = [sig[-1], lead[-1], ids[-1], bool(several[-1])]
            return {"sig": sig[several], "lead": lead[several], "id": ids[several]}

        return step

    return map_columns(sorted_rows, make, f"sig long, lead {kind}, id {kind}", None)


def _likely(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and parities don't rule out; sketches: id, n, parity."""
    kind = dict(pairs.dtypes)["a"]
    rows = pairs
    for end in ("a", "b"):
        rows = rows.join(sketches.select(F.col("id").alias(end), F.col("n").alias(f"n{end}"), F.col("parity").alias(f"p{end}")), end)
    rows = rows.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * PERCENT)

    def make():
        def step(batch: pa.RecordBatch) -> dict[str, list]:
            na, nb, a, b = (batch.column(c).to_pylist() for c in ("na", "nb", "pa", "pb"))
            on = [(100 + PERCENT) * _apart(x, y) <= (100 - PERCENT) * (n + m) for n, m, x, y in zip(na, nb, a, b, strict=True)]
            return {c: batch.column(c).filter(pa.array(on, pa.bool_())) for c in ("a", "b")}

        return step

    return map_columns(rows, make, f"a {kind}, b {kind}", "pb")


def _facing(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, salt, b, elements): b's set in rows of pairs (a, b), sorted so that a's own set comes first, with b null. Pairs of an a that very many have are dealt over salts."""
    kind = dict(pairs.dtypes)["b"]
    many = checkpointed(pairs.groupBy("a").agg(F.count("*").alias("many")).where(F.col("many") > 2 * SHARE))
    if many.isEmpty():
        dealt = pairs.withColumn("salt", F.lit(0))
    else:
        salt = F.when(F.col("many").isNull(), 0).otherwise(F.pmod(F.xxhash64("b"), F.ceil(F.col("many") / SHARE)))
        dealt = pairs.join(many, "a", "left").withColumn("salt", salt.cast("int"))
    rows = dealt.join(sets.select(F.col("id").alias("b"), "elements"), "b").select("a", "salt", "b", "elements")
    heads = dealt.select("a", "salt").distinct().join(sets.select(F.col("id").alias("a"), "elements"), "a")
    heads = heads.select("a", "salt", F.lit(None).cast(kind).alias("b"), "elements")
    return rows.unionByName(heads).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())


def _faced(batch: pa.RecordBatch, head: list) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, a's set, b's set) of a batch of _facing(); head keeps a's set from batch to batch."""
    for i, (b, s) in enumerate(zip(batch.column("b").to_pylist(), _stored(batch), strict=True)):
        if b is None:
            head[:] = [s]
        else:
            yield i, head[0], s


def _inside(s: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which of a sorted set's elements another has."""
    if not len(other):
        return np.zeros(len(s), bool)
    return other[np.minimum(np.searchsorted(other, s), len(other) - 1)] == s


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are alike enough."""
    kind = dict(pairs.dtypes)["a"]

    def make():
        head: list = []

        def step(batch: pa.RecordBatch) -> dict[str, list]:
            on = []
            for i, a, b in _faced(batch, head):
                small, large = sorted((a, b), key=len)
                if len(small) * 100 >= len(large) * PERCENT:
                    same = int(_inside(small, large).sum())
                    if 100 * same >= PERCENT * (len(a) + len(b) - same):
                        on.append(i)
            at = pa.array(on, pa.int64())
            return {"a": batch.column("a").take(at), "b": batch.column("b").take(at)}

        return step

    return map_columns(_facing(pairs, sets), make, f"a {kind}, b {kind}", "elements")


def _bucket_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


@dataclass
class Counts:
    """Counts of hashes by bucket, 0 for buckets that aren't listed."""

    bucket: np.ndarray
    n: np.ndarray

    def of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.bucket):
            return np.zeros(len(hashes), np.int64)
        asked = _bucket_of(hashes)
        at = np.minimum(np.searchsorted(self.bucket, asked), len(self.bucket) - 1)
        return np.where(self.bucket[at] == asked, self.n[at], 0)


def _frequent(hard: DataFrame, hashes_of: Callable[[pa.RecordBatch], np.ndarray], common: int) -> Counts:
    """Counts of hashes by bucket, of the buckets that have clearly more than most (at
    most 2**SKETCH_BITS, mostly few, come to the driver and go to the tasks). They
    only tell what is cheap: results don't depend on them."""

    def make():
        def step(batch: pa.RecordBatch) -> dict[str, list]:
            bucket, n = np.unique(_bucket_of(hashes_of(batch)), return_counts=True)
            return {"bucket": bucket, "n": n}

        return step

    counts = checkpointed(map_columns(hard, make, "bucket long, n long", "elements").groupBy("bucket").agg(F.sum("n").alias("n")))
    mean = (counts.agg(F.sum("n")).head()[0] or 0) / (1 << SKETCH_BITS)
    many = counts.where(F.col("n") > common + 2 * mean).orderBy("bucket").toPandas()
    return Counts(many["bucket"].to_numpy(np.int64), many["n"].to_numpy(np.int64))


def _neighbourhoods(s: np.ndarray, common: list[int] | None) -> list[tuple]:
    """(how many segments must match with one element deleted, segments, which of them are
    passed over, and of each signature its segment, z and hash) of a set's bands in which
    it passes over more segments than slack. z = 0: the whole segment, z = 1: without one
    element, of those that have several: also of those passed over, since a partner may
    have the rest as a rare segment. The first band has no signatures."""
    out = []
    passed, mixed = np.array(common or [], np.int64).view(np.uint64), _mixed(s)
    for band, m, slack in bands_of(len(s)):
        starts, number, sums = _segments(s, mixed, m)
        sig = _signature(sums, number, band)
        over = np.isin(sig, passed)
        least = -(-len(s) * PERCENT // 100) - 1  # of a partner's shared elements, less one
        need = int(m - len(number) + over.sum() - slack) if m else int(over.sum()) - least
        if need < 1:
            continue
        sizes = np.diff(np.append(starts, len(s)))
        owner = np.repeat(np.arange(len(number)), sizes)
        part = np.flatnonzero((sizes > 1)[owner]) if m else owner[:0]
        less = _signature(sums[owner[part]] - mixed[part], number[owner[part]], band)
        whole = np.arange(len(number)) if m else owner[:0]
        out.append((need, len(number), over, np.concatenate([whole, owner[part]]), np.repeat([0, 1], [len(whole), len(part)]), np.concatenate([sig[whole], less])))
    return out


def _deletions(hard: DataFrame, common: int) -> DataFrame:
    """Rows (id, sig, z, chosen) of sets (id, elements, common): their signatures with at
    most one element deleted. Of each band a set chooses as many segments as must
    match, those of least cost: of few signatures, none of them frequent. A set
    without enough such segments ("short") has one more row, with sig null. Segments
    with a frequent signature are no one's choice, so such signatures are left out."""
    kind = hard.schema["id"].dataType.simpleString()

    def each(batch: pa.RecordBatch) -> Iterator[list[tuple]]:
        return (_neighbourhoods(s, c) for s, c in zip(_stored(batch), batch.column("common").to_pylist(), strict=True))

    def hashes_of(batch: pa.RecordBatch) -> np.ndarray:
        found = [x[-1] for bands in each(batch) for x in bands]
        return np.concatenate(found) if found else np.zeros(0, np.uint64)

    counts = _frequent(hard, hashes_of, common)

    def make():
        def step(batch: pa.RecordBatch) -> dict[str, list]:
            rows, sigs, zs, choices, short = [], [], [], [], []
            for i, bands in enumerate(each(batch)):
                enough = True
                for need, segments, over, segment, z, sig in bands:
                    often = counts.of(sig)
                    cost = np.bincount(segment, minlength=segments)
                    open_ = ~over & (np.bincount(segment[z == 1], minlength=segments) > 0) & (np.bincount(segment[often > 0], minlength=segments) == 0)
                    best = np.flatnonzero(open_)
                    best = best[np.argsort(cost[best], kind="stable")][:need]
                    enough &= len(best) == need
                    keep = often == 0
                    sigs.append(sig[keep])
                    zs.append(z[keep])
                    choices.append(np.isin(segment[keep], best))
                    rows.append(np.full(int(keep.sum()), i))
                if not enough:
                    short.append(i)
            none = np.zeros(len(short), np.int64)
            row = np.concatenate([*rows, np.array(short, np.int64)]).astype(np.int64)
            missing = np.arange(len(row)) >= len(row) - len(short)
            return {
                "id": batch.column("id").take(pa.array(row)), "sig": pa.array(np.concatenate([*(s.view(np.int64) for s in sigs), none]), mask=missing),
                "z": np.concatenate([*zs, none]).astype(np.int32), "chosen": np.concatenate([*choices, none]).astype(bool),
            }

        return step

    return map_columns(hard, make, f"id {kind}, sig long, z int, chosen boolean", "elements")


class _Differences:
    """What sets show of their differences from a pivot: rows (probe, class, element,
    w, what is left from that element on)."""

    def __init__(self, counts: Counts):
        self.counts = counts

    def rows(self, pivot: np.ndarray, s: np.ndarray) -> tuple[bool, list[np.ndarray]]:
        """Whether the pivot is linked with the set, and the columns of its rows.

        Of two sets the one of greater w probes, those of its class of w or a lower
        one are indexed under that class. Elements go from rare to frequent, those
        that the pivot lacks first, so the first that two sets share is among the
        first |d| - t + 1 of each, where t is the least number that they must share.
        """
        own, lost = s[~_inside(s, pivot)], pivot[~_inside(pivot, s)]
        mixed = [splitmix(x) for x in (own, lost)]
        often = [self.counts.of(x) for x in mixed]
        d = np.concatenate([mixed[0][np.lexsort((mixed[0], often[0]))], mixed[1][np.lexsort((mixed[1], -often[1]))]])
        n, w = len(d), 9 * len(d) - len(s)
        linked = w <= len(pivot)
        shown = []
        if not linked:
            shown.append((True, self._class(w + len(pivot)), n - max(1, n - len(s) // 4) + 1))
        low = max(w + len(pivot), 2 * len(pivot) + 1)  # a probe isn't linked with the pivot
        at = self._class(low)
        while n and (bound := max(low, _CLASS**at * (1 - 1e-9)) - len(pivot)) <= w + 2 * len(s):  # |wx - wy| <= nx + ny + |nx - ny|
            need = max(1, math.ceil((bound + w) / 18 - 1e-9))
            if need > n:
                break
            shown.append((False, at, n - need + 1))
            at += 1
        sizes = np.array([k for *_, k in shown], np.int64)
        place = np.concatenate([np.arange(0), *map(np.arange, sizes)])
        columns = [np.repeat(np.array([x[i] for x in shown], np.int64), sizes) for i in (0, 1)]
        return linked, [*columns, d[place], np.full(len(place), w), n - place]

    @staticmethod
    def _class(v: int) -> int:
        return int(math.log(max(v, 1)) / math.log(_CLASS) + 1e-9)


#: What a row of _pivoted() says: a difference to be found, one that looks for others, a set linked with its pivot, one far from it.
_INDEX, _PROBE, _LINKED, _FAR = range(4)


def _pivots(members: DataFrame) -> DataFrame:
    """(a, b): each set b of (sig, id) with the pivot a of its group, but for the pivot itself."""
    leads = members.groupBy("sig").agg(F.min("id").alias("a"))
    groups = components(members.join(leads, "sig").select("a", F.col("id").alias("b")))
    placed = groups.withColumnRenamed("node", "id").join(members.groupBy("id").agg(F.count("*").alias("n")), "id")
    pivots = placed.groupBy("component").agg(F.min_by("id", F.struct(-F.col("n"), F.col("id"))).alias("a"))
    return placed.join(pivots, "component").where(F.col("a") != F.col("id")).select("a", F.col("id").alias("b"))


def _pivoted(short: DataFrame, members: DataFrame, common: int) -> DataFrame:
    """Candidate pairs (a, b) of short sets (id, elements, bare) that are in one group,
    by their differences from its pivot, or that both are bare, by their elements; and
    pivots with the sets linked with them. members: (sig, id) of common signatures.

    Of linked sets neither is nearer to a pivot by more than a quarter of the other's size.
    So those within the pivot's size have all partners among those that are within it less a
    quarter of their own; all others go on to the next round, where they form groups anew."""
    kind = short.schema["id"].dataType.simpleString()
    counts = _frequent(short.select("elements"), lambda batch: np.concatenate([splitmix(s) for s in _stored(batch)]), common)
    schema = f"key long, says tinyint, id {kind}, w int, rest int, lead {kind}"

    def rows(facing: DataFrame, last: bool) -> DataFrame:
        def make():
            head, shown = [np.zeros(0, np.uint64)], _Differences(counts)

            def step(batch: pa.RecordBatch) -> dict[str, list]:
                paired = "b" in batch.schema.names
                faced = _faced(batch, head) if paired else ((i, head[0], s) for i, s in enumerate(_stored(batch)))
                group = np.asarray(batch.column("salted"))
                linked, far, at, out = [], [], [np.zeros(0, np.int64)], [[np.zeros(0, np.int64)] for _ in range(4)]
                for i, pivot, s in faced:
                    apart = len(s) + len(pivot) - 2 * int(_inside(s, pivot).sum())
                    if apart > len(pivot) and not last:
                        far.append(i)
                        if 4 * (apart - len(pivot)) > len(s):
                            continue
                    on, (probe, number, element, w, left) = shown.rows(pivot, s)
                    if on:
                        linked.append(i)
                    at.append(np.full(len(left), i))
                    key = splitmix(element + splitmix(number.astype(np.uint64) + group[i : i + 1].view(np.uint64)))
                    for column, v in zip(out, (key.view(np.int64), probe, w, left), strict=True):
                        column.append(v)
                key, probe, w, left = (np.concatenate(c) for c in out)
                more = np.repeat([_LINKED, _FAR], [len(linked), len(far)])
                where, fill = pa.array(np.concatenate([np.concatenate(at), linked, far]).astype(np.int64)), np.zeros(len(more), np.int64)
                return {
                    "key": pa.array(np.concatenate([key, fill]), mask=np.arange(len(where)) >= len(key)), "says": np.concatenate([np.where(probe, _PROBE, _INDEX), more]).astype(np.int8),
                    "id": batch.column("b" if paired else "id").take(where), "w": np.concatenate([w, fill]), "rest": np.concatenate([left, fill]),
                    "lead": batch.column("a").take(where) if paired else pa.nulls(len(where), batch.schema.field("id").type),
                }

            return step

        return map_columns(facing, make, schema, "elements")

    shown = rows(short.where("bare").select("id", "elements", F.lit(0).cast("long").alias("salted")), True)
    left = checkpointed(matching(members, checkpointed(short.select("id")), "id"))
    for n in range(1, ROUNDS + 1):
        pairs = checkpointed(_pivots(left))
        found = checkpointed(rows(_facing(pairs, short).withColumn("salted", F.xxhash64("a")), n == ROUNDS))
        shown = shown.unionByName(found)
        far = checkpointed(found.where(F.col("says") == _FAR).select("id"))
        if far.isEmpty():
            break
        left = checkpointed(matching(left, far, "id"))
    shown = checkpointed(shown)
    probes = shown.where(F.col("says") == _PROBE).select("key", F.col("id").alias("x"), F.col("w").alias("wx"), F.col("rest").alias("rx"))
    index = shown.where(F.col("says") == _INDEX).select("key", "id", "w", "rest")
    enough = F.least("rx", "rest") * 18 >= F.col("wx") + F.col("w")
    met = probes.join(index, "key").where((F.col("x") != F.col("id")) & enough).select(F.least("x", "id").alias("a"), F.greatest("x", "id").alias("b"))
    linked = shown.where(F.col("says") == _LINKED).select(F.least("lead", "id").alias("a"), F.greatest("lead", "id").alias("b"))
    return met.unionByName(linked).distinct()


def _compensated(hard: DataFrame, members: DataFrame, common: int) -> DataFrame:
    """Candidate pairs (a, b) of sets (id, elements, common, bare) that pass over more
    segments than slack: those that match in a chosen segment with one element
    deleted; and for short ones those that are alike in their differences from a pivot."""
    rows = checkpointed(_deletions(hard, common))
    each = rows.where(F.col("sig").isNotNull())
    probes = each.where("chosen").select("sig", F.col("id").alias("a"), F.col("z").alias("za"))
    met = probes.join(each.select("sig", F.col("id").alias("b"), F.col("z").alias("zb")), "sig").where((F.col("a") != F.col("b")) & (F.col("za") + F.col("zb") == 1))
    found = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    short = checkpointed(rows.where(F.col("sig").isNull()).select("id").distinct())
    if not short.isEmpty():
        found = found.unionByName(_pivoted(checkpointed(matching(hard.drop("common"), short, "id")), members, common))
    return found.distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", common: int = COMMON) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of 0.8 or more.

    Texts are lower-cased (A-Z), words are runs of anything but space, tab and
    line ends, shingles are SHINGLE words; a shorter text is one shingle, and one
    without words (or null) has none and no links. Returns one row for each input
    row: the id column, n_shingles and component_id, the least id that links
    reach. A row of a null id has no links and a null component; rows of one id
    should have one text. Other columns are ignored.
    """
    profile = checkpointed(_profile(docs, id_col, text_col))
    known = profile.where(F.col("id").isNotNull())
    # Documents of the same set are one; the least id stands for them.
    same = checkpointed(known.where("n > 0").groupBy("digest").agg(F.min("id").alias("lead"), F.max("bare").alias("bare"), F.max("n").alias("n"), F.max("parity").alias("parity")))
    sketches = same.select(F.col("lead").alias("id"), "n", "parity")
    repeated = known.count() > known.select("id").distinct().count()
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull())
    copies = known.join(same, "digest").where(F.col("id") != F.col("lead")).select("id").distinct()
    source = matching(own, checkpointed(copies), "id", "left_anti")
    buckets = checkpointed(_buckets(_signature_rows(source)))

    def sets_of(ids: DataFrame) -> DataFrame:
        sets = _set_rows(matching(own, checkpointed(ids.distinct()), "id"))
        return checkpointed(sets.dropDuplicates(["id"]) if repeated else sets)

    def linked(pairs: DataFrame) -> DataFrame:
        likely = checkpointed(_likely(pairs, sketches))
        return checkpointed(_verified(likely, sets_of(likely.select(F.col("a").alias("id")).union(likely.select("b")))))

    stars = checkpointed(buckets.where(F.col("lead") != F.col("id")).select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct())
    links = linked(stars)
    # Sets of one component, as far as two steps of links to smaller ids show; that is enough to spare most pairs.
    one = links.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("to")).groupBy("node").agg(F.min("to").alias("component"))
    two = one.join(one.select(F.col("node").alias("component"), F.col("component").alias("next")), "component", "left").select("node", F.coalesce("next", "component").alias("component"))
    reached = checkpointed(two)

    joined = checkpointed(buckets.select("sig", "id").join(reached.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id")))
    size = joined.groupBy("sig", "component").agg(F.count("*").alias("c"))
    spread = size.groupBy("sig").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("within"), F.max_by("component", "c").alias("largest"), F.count("*").alias("several")).where("several > 1")
    spread = spread.select("sig", "largest", ((F.col("n") * F.col("n") - F.col("within")) > 2 * common * F.col("n")).alias("often"))
    left = checkpointed(joined.join(spread, "sig"))  # buckets that still hold several components

    few = left.where(~F.col("often"))
    met = few.where(F.col("component") != F.col("largest")).select("sig", F.col("id").alias("x"), F.col("component").alias("cx"))
    met = met.join(few.select("sig", F.col("id").alias("y"), F.col("component").alias("cy")), "sig").where(F.col("cx") != F.col("cy"))
    pairs = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    # Common signatures are passed over; what that may lose is made good.
    members = left.where("often").select("sig", "id")
    passed = members.groupBy("id").agg(F.collect_set("sig").alias("common"))
    bare = same.where("bare").select(F.col("lead").alias("id"), F.lit(True).alias("bare"))
    asked = checkpointed(passed.join(bare, "id", "full_outer").select("id", "common", F.coalesce("bare", F.lit(False)).alias("bare")))
    made_good = _compensated(checkpointed(sets_of(asked.select("id")).join(asked, "id")), members, common)
    for end in ("a", "b"):
        made_good = made_good.join(reached.select(F.col("node").alias(end), F.col("component").alias(f"c{end}")), end, "left")
    made_good = made_good.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    pairs = checkpointed(pairs.unionByName(made_good).distinct().join(stars, ["a", "b"], "left_anti"))
    final = components(links.unionByName(linked(pairs))).withColumnRenamed("node", "lead")

    groups = same.select("digest", "lead").join(final, "lead", "left").select("digest", F.coalesce("component", "lead").alias("component"))
    out = profile.join(groups, "digest", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
