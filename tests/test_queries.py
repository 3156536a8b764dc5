"""Every catalogue query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from orbweave import catalogue_queries, signal_queries, upkeep_queries  # noqa: F401
from orbweave import registry as catalogue


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{name}'")
    return con


def plain(rows):
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    return sorted(repr([None if v is None or v != v else round(float(v), 6) if number(v) else str(v) for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_matches_sql(spark, sf, con, name):
    got = catalogue.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    want = con.execute(catalogue.ORACLE_SQL[name])
    order = [d[0] for d in want.description]
    assert sorted(order) == columns
    rows = [[r[order.index(c)] for c in columns] for r in want.fetchall()]
    assert plain([[r[c] for c in columns] for r in got.collect()]) == plain(rows)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_has_rows(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


@pytest.mark.parametrize("name", ["neighbours", "neighbours_excl_artist"])
def test_first_row_of_the_blocked_artist(spark, sf, tmp_path, name):
    """Row 0 is asked for even where its artist is blocked."""
    blocked = duckdb.connect()
    blocked.execute(f"COPY (SELECT vec_id, embedding, CASE WHEN vec_id = 0 THEN 9 ELSE label END::int AS label FROM '{sf}/embeddings.parquet') TO '{tmp_path}/embeddings.parquet'")
    blocked.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    want = blocked.execute(catalogue.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    rows = want.fetchall()
    assert len(rows) == 10 and plain(catalogue.QUERIES[name](spark, str(tmp_path)).select(*columns).collect()) == plain(rows)
