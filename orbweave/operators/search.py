"""Search by postings of grams: which rows may have the terms is read from an index, then verified."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.functions.expr import all_terms, starts_rank

#: The longest grams. Shorter terms are grams themselves.
GRAM = 3
#: Rows that are looked up by their ids as values; more meet the table by a join.
LOOKED_UP = 1000


def grams(text: Column) -> Column:
    """The distinct runs of 1 to GRAM characters of a lower-cased text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    of = lambda n: F.when(F.length(low) >= n, F.transform(F.sequence(F.lit(1), F.length(low) - (n - 1)), lambda i: F.substring(low, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[of(n) for n in range(1, GRAM + 1)]))


def needed(query: str) -> list[list[str]]:
    """For each term the grams that a field with it has."""
    return [[t] if len(t) <= GRAM else sorted({t[i : i + GRAM] for i in range(len(t) - GRAM + 1)}) for t in dict.fromkeys(query.lower().split())]


def postings(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(gram, key): the rows that have a gram in some field, in ranges of grams; a frequent one's are split by key."""
    every = F.array_distinct(F.flatten(F.array(*[grams(F.col(f)) for f in fields])))
    return rows.select(F.explode(every).alias("gram"), key).repartitionByRange("gram", key).sortWithinPartitions("gram", key)


def counted(index: DataFrame) -> DataFrame:
    """(gram, n), in ranges of grams."""
    return index.groupBy("gram").agg(F.count("*").alias("n")).repartitionByRange("gram").sortWithinPartitions("gram")


@dataclass
class Index:
    """rows (sorted by key), postings and their counts."""

    rows: DataFrame
    postings: DataFrame
    counts: DataFrame
    key: str
    fields: list[str]

    def candidates(self, query: str) -> DataFrame | None:
        """Keys of rows that have the rarest gram of each term; None where a query has no terms."""
        terms = needed(query)
        if not terms:
            return None
        asked = sorted({g for t in terms for g in t})
        n = {r["gram"]: r["n"] for r in self.counts.where(F.col("gram").isin(asked)).collect()}  # the query's grams
        chosen = sorted({min(t, key=lambda g: (n.get(g, 0), g)) for t in terms})
        if any(g not in n for g in chosen):
            return self.postings.select(self.key).limit(0)
        found = self.postings.where(F.col("gram").isin(chosen)).groupBy(self.key).agg(F.count("*").alias("n"))
        return found.where(F.col("n") == len(chosen)).select(self.key)

    def search(self, query: str) -> DataFrame:
        """Rows with every term in some field, ignoring case, and `rank`: 0 where a field starts with the first term."""
        may, columns = self.candidates(query), [F.col(f) for f in self.fields]
        rows = self.rows
        if may is not None:
            few = [r[self.key] for r in may.limit(LOOKED_UP + 1).collect()]
            rows = rows.where(F.col(self.key).isin(few)) if len(few) <= LOOKED_UP else rows.join(may, self.key, "left_semi")
        return rows.where(all_terms(query, *columns)).withColumn("rank", starts_rank(query, *columns))
