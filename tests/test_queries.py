"""Every registered query with SQL gives the rows that DuckDB gives."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_point
from wickerwork.plans.registry import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "~"
    if isinstance(x, float):
        return f"{x:.8g}"
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(plain, x)) + "]"
    return str(x)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    cursor = duck.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    place = {c: i for i, c in enumerate(columns)}
    got = sorted("|".join(plain(r[c]) for c in sorted(columns)) for r in df.collect())
    want = sorted("|".join(plain(r[place[c]]) for c in sorted(columns)) for r in cursor.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"i2_i3_i4_baseline_scores", "i5_pu_bagging", "j1_ensemble", "i14_fit_heads"}))
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert len(set(df.columns)) == len(df.columns)
    rows = df.collect()
    assert rows or name == "o6_infer_pseudo_gpr"


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_only_the_entry_looks_for_optional_parts():
    root = Path(entry_point.__file__).parent
    for p in (root / "wickerwork").rglob("*.py"):
        if "llm" not in p.parts:
            assert "wickerwork.llm" not in p.read_text()
