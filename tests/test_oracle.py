"""Registered queries against their oracle SQL on the smallest tables (a cross-section)."""

import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"
sys.path.insert(0, str(ROOT))
import __spark_entry__ as entry  # noqa: E402

CHOSEN = ["p05_explode_instructions", "k01_error_counts", "k04_duration_dtw", "a07_summarize", "j14_plan_requests", "a17_cases_per_asset", "c06_alignment", "w03_terminal_status", "s01_manifest_scan"]


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for file in Path(SF).glob("*.parquet"):
        con.execute(f"create view {file.stem} as select * from '{file}'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(f"{r[i]:.6g}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", CHOSEN)
def test_query(spark, tables, name):
    df = entry.queries()[name](spark, SF)
    cursor = tables.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert plain(df.collect(), df.columns) == plain(cursor.fetchall(), columns)


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
