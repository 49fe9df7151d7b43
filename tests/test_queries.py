"""Every registered query of the reference's operators against its SQL on the small tables."""

import duckdb
import pytest

from vetloom.plans.bindings import DOCS
from vetloom.plans.oracle import ORACLE
from vetloom.plans.queries import QUERIES, TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = df.select(*columns).collect()
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE[name]})").fetchall()
    assert plain(map(tuple, got)) == plain(want)


def test_fallback_is_at_most_66(spark):
    rows = QUERIES["fallback_scoreboard"](spark, SF).collect()
    assert rows and all(r.total_score <= 66 and r.flag == "Model unavailable" and r.outcome != "APPROVED" for r in rows)


def test_every_outcome_occurs(spark):
    rows = {r.outcome: r.documents for r in QUERIES["outcome_counts"](spark, SF).collect()}
    assert set(rows) == {"REJECTED", "MANUAL_REVIEW", "APPROVED"}
    assert QUERIES["pending_extraction"](spark, SF).count() > 1


def test_endings_are_used():
    assert DOCS.count("WHEN") == 12
