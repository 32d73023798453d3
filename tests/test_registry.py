"""The registry: every oracle has a query, and some queries agree with DuckDB end to end."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["speed_events", "best_split", "life_time", "rule_match_ids", "region_maxima", "label_contingency", "percentile_level", "track_overlap"])
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    rows = cur.fetchall()
    cols = [d[0] for d in cur.description]
    got = sorted(str(tuple(r[c] for c in cols)) for r in df.collect())
    assert sorted(df.columns) == sorted(cols)
    assert got == sorted(str(tuple(r)) for r in rows)
