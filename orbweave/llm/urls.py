"""URL filters by a sort-merge range join.

A url's key is its host's labels from right to left, then its path: keys that
begin alike lie together, so a rule for a host and its subdomains is an interval
of keys. Keys and intervals are cut into ranges at sampled bounds; in each range
a sweep over both in key order keeps the open rules on a stack, innermost last.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Urls of one range, about; the least and the greatest number of ranges; and sampled
#: keys for each bound between them. A range streams through its task, however many urls it has.
URLS_PER_RANGE, RANGES = 20_000, (64, 4096)
SAMPLED_PER_RANGE = 50
#: An upper end of all keys with a prefix: no host or path has this character.
_END = "\U0010ffff"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; then up to `?`, `#` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def host_key(host: Column) -> Column:
    """Labels from right to left, each with a dot after it, so that a host begins its subdomains' keys."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def judge(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow",
    ranges: int | None = None,
) -> DataFrame:
    """The verdict on each url: that of the longest fitting rule, else `default`.

    rules: host, path (beginning with `/`) and verdict. A rule fits its host and
    all subdomains, if the url's path begins with the rule's. Of rules with the
    same host and path the least verdict counts; rules with a null are left out.
    Returns one row for each input row, repeated ones too: the id column, host,
    path, rule (host and path, else null) and verdict. A null url, or one
    without `://`, has empty host and path and fits no rule. Null ids stay null;
    other columns are ignored.
    """
    host, path = host_and_path(F.col(url_col))
    asked = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    # What follows the path spreads equal urls over ranges.
    asked = asked.withColumn("key", F.concat(host_key(F.col("host")), "path", F.lit("\0"), F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")))))
    named = rules.select("host", "path", "verdict").dropna().groupBy("host", "path").agg(F.min("verdict").alias("verdict")).withColumn("key", host_key(F.col("host")))
    size = asked.count()
    ranges = ranges or min(max(size // URLS_PER_RANGE, RANGES[0]), RANGES[1])
    share = min(1.0, ranges * SAMPLED_PER_RANGE / max(size, 1))
    # About ranges * SAMPLED_PER_RANGE keys come to the driver; they only bound the ranges.
    drawn = sorted(r["key"] for r in asked.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < share * (1 << 20)).select("key").collect())
    bounds = sorted({drawn[i * len(drawn) // ranges] for i in range(1, ranges)}) if drawn else []
    cuts = F.lit(bounds) if bounds else F.array().cast("array<string>")
    place = lambda key: F.size(F.filter(cuts, lambda b: b <= key))

    kind = asked.schema["id"].dataType
    none = F.lit(None)
    stops = named.withColumn("range", F.explode(F.sequence(place(F.col("key")), place(F.concat("key", F.lit(_END))))))
    # Rules sort before the urls that their key begins.
    events = stops.select("range", "key", F.lit(0).alias("is_url"), none.cast(kind).alias("id"), "host", "path", "verdict").unionByName(
        asked.select(place(F.col("key")).alias("range"), "key", F.lit(1).alias("is_url"), "id", "host", "path", none.cast("string").alias("verdict"))
    )
    dealt = events.repartitionById(len(bounds) + 1, F.col("range")).sortWithinPartitions("range", "key", "is_url")
    schema = T.StructType([T.StructField(id_col, kind), *(T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict"))])

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stack = None, []  # of (key, host, verdicts by path, lengths of paths from long to short)
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in schema.fields}
            rows = (batch.column(c).to_pylist() for c in ("range", "key", "is_url", "id", "host", "path", "verdict"))
            for at, key, is_url, doc, host, path, verdict in zip(*rows, strict=True):
                if at != now:
                    now, stack = at, []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if not is_url:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, host, {}, []))
                    paths, lengths = stack[-1][2:]
                    paths[path] = verdict
                    if len(path) not in lengths:
                        lengths.append(len(path))
                        lengths.sort(reverse=True)
                    continue
                best = None
                for _, own, paths, lengths in stack:
                    n = next((n for n in lengths if path[:n] in paths and len(path) >= n), None)
                    if n is not None and (best is None or len(own) + n >= len(best[0])):
                        best = (own + path[:n], paths[path[:n]])
                for c, v in zip(out, (doc, host, path, *(best or (None, default))), strict=True):
                    out[c].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), arrow.types, strict=True)], schema=arrow)

    arrow = to_arrow_schema(schema)
    return dealt.mapInArrow(sweep, schema)
