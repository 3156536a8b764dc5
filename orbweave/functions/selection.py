"""Exact order statistics of many columns at once, without any task holding a column."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins of a pass, and values that are few enough to be looked at themselves.
BINS, FEW = 4096, 2048
#: The first pass bins logarithms, which lie within this for any finite number.
_WIDEST = 710.0


def finite(x: Column) -> Column:
    """The value, null unless finite."""
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x)


@dataclass
class Wanted:
    """The value of a rank (from 0) among a column's finite values from low to high."""

    column: str
    rank: int
    low: float
    high: float
    count: int

    @property
    def found(self) -> bool:
        return self.low == self.high


def _first(x: Column) -> Column:
    """A bin by sign and logarithm: it rises with the number, and is 0 to BINS - 1 for all of them."""
    scaled = F.signum(x) * F.log1p(F.abs(x))
    return F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((scaled + _WIDEST) / (2 * _WIDEST) * BINS))).cast("int")


def _counted(df: DataFrame, cells: list[tuple[int, Column, Column, Column]]) -> dict[int, list]:
    """For each number: (bin, count, least, greatest) of its bins in order. A task and then each bin sums up what it has; at most BINS rows a number come here."""
    parts = F.array(*[F.when(on, F.struct(F.lit(i).alias("i"), bin_.alias("bin"), x.alias("x"))) for i, on, bin_, x in cells])
    rows = df.select(F.explode(parts).alias("c")).where(F.col("c").isNotNull()).groupBy("c.i", "c.bin").agg(F.count("*").alias("n"), F.min("c.x").alias("low"), F.max("c.x").alias("high"))
    out: dict[int, list] = {i: [] for i, *_ in cells}
    for r in rows.collect():
        out[r["i"]].append((r["bin"], r["n"], r["low"], r["high"]))
    return {i: sorted(bins) for i, bins in out.items()}


def _within(wanted: Wanted, bins: list) -> Wanted:
    """The bin that has the rank."""
    rank = wanted.rank
    for _, n, low, high in bins:
        if rank < n:
            return Wanted(wanted.column, rank, low, high, n)
        rank -= n
    raise ValueError("the rows changed between two passes")


def medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """The exact median of each column's finite values, of an even number the mean of the middle two; None of none.

    A pass counts bins of all columns and keeps the one with the middle rank, whose
    least and greatest value bound the next pass; each has BINS times fewer values, as
    long as they differ. Passes read the rows again; nothing is sorted.
    """
    x = {c: finite(F.col(c).cast("double")) + F.lit(0.0) for c in columns}
    first = _counted(df, [(i, x[c].isNotNull(), _first(x[c]), x[c]) for i, c in enumerate(columns)]) if columns else {}
    wanted: list[Wanted] = []
    for i, c in enumerate(columns):
        n = sum(b[1] for b in first[i])
        for rank in sorted({(n - 1) // 2, n // 2}) if n else []:
            wanted.append(_within(Wanted(c, rank, 0.0, 0.0, n), first[i]))
    while some := [w for w in wanted if not w.found and w.count > FEW]:
        tiny = [w for w in some if w.high / 2 - w.low / 2 == 0]  # least numbers that no bin tells apart
        wide = [w for w in some if w not in tiny]
        # By halves: the difference of two numbers may be too large for one.
        bins = [F.floor((x[w.column] / 2 - w.low / 2) / (w.high / 2 - w.low / 2) * BINS) for w in wide]
        cells = [(i, x[w.column].between(w.low, w.high), F.least(F.lit(BINS - 1), b).cast("int"), x[w.column]) for i, (w, b) in enumerate(zip(wide, bins, strict=True))]
        got = _counted(df, cells) if cells else {}
        for i, w in enumerate(wide):
            wanted[wanted.index(w)] = _within(w, got[i])
        for w in tiny:
            wanted[wanted.index(w)] = _told_apart(df, x[w.column], w)
    few = [w for w in wanted if not w.found]
    if few:
        parts = F.array(*[F.when(x[w.column].between(w.low, w.high), F.struct(F.lit(i).alias("i"), x[w.column].alias("x"))) for i, w in enumerate(few)])
        values: dict[int, list[float]] = {}
        for r in df.select(F.explode(parts).alias("c")).where(F.col("c").isNotNull()).select("c.*").collect():  # FEW of each
            values.setdefault(r["i"], []).append(r["x"])
        for i, w in enumerate(few):
            value = sorted(values[i])[w.rank]
            wanted[wanted.index(w)] = Wanted(w.column, w.rank, value, value, 1)
    out: dict[str, float | None] = dict.fromkeys(columns)
    for c in columns:
        own = [w.low for w in wanted if w.column == c]
        if own:
            out[c] = own[0] if len(own) == 1 else own[0] / 2 + own[1] / 2 if abs(own[0]) > 1e300 else (own[0] + own[1]) / 2
    return out


def _told_apart(df: DataFrame, x: Column, wanted: Wanted) -> Wanted:
    """Those of the least value, or all above it."""
    n = df.where(x == wanted.low).count()
    if wanted.rank < n:
        return Wanted(wanted.column, wanted.rank, wanted.low, wanted.low, n)
    above = df.where((x > wanted.low) & (x <= wanted.high)).agg(F.min(x).alias("low")).head()["low"]
    return Wanted(wanted.column, wanted.rank - n, above, wanted.high, wanted.count - n)
