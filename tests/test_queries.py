"""All queries of the engine against DuckDB, and plans that must prune."""

import math

import duckdb
import pytest

from tidelog.errors import LsnRangeError
from tidelog.queries import QUERIES, SQL
from tidelog.sources.view import event_log

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", QUERIES)
def test_equals_duckdb(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    want = duck.sql(SQL[name])
    columns = sorted(want.columns)
    assert sorted(df.columns) == columns
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    at = [want.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_bounds_reach_the_files(spark, sf):
    plan = event_log(spark, sf).events(3, 5)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(event_id,2)" in plan
    assert "LessThanOrEqual(event_id,4)" in plan
    with pytest.raises(LsnRangeError):
        event_log(spark, sf).events(5, 3)


def test_imports_cover_the_whole_log(spark):
    sf = "/root/testdata/sf0.01"
    n = event_log(spark, sf).events().count()
    copies = QUERIES["import_overlap"](spark, sf).groupBy("copies").count().collect()
    assert sum(x["count"] for x in copies) == n and {x["copies"] for x in copies} == {1, 2}
    assert QUERIES["import_distinct"](spark, sf).select("lsn").distinct().count() == n
    assert n * 0.6 < QUERIES["snapshot_read"](spark, sf).count() < n * 0.7


@pytest.mark.parametrize("name", ["delete_before", "delete_older_than", "compact_checkpoint", "retention_count", "replica_missing_segments", "live_index"])
def test_rules_on_segments_take_some(spark, name):
    sf = "/root/testdata/sf0.01"
    assert 0 < QUERIES[name](spark, sf).count() < QUERIES["segments"](spark, sf).count()


def test_rules_on_frames_and_events_take_some(spark):
    sf = "/root/testdata/sf0.01"
    frames = QUERIES["frames"](spark, sf).count()
    assert 0 < QUERIES["batch_too_large"](spark, sf).count() < frames
    active = QUERIES["sparse_index"](spark, sf).groupBy("segment_lsn").count().orderBy("segment_lsn").collect()[-1]["count"]
    assert 0 < QUERIES["recover_prefix"](spark, sf).count() < active
    n = event_log(spark, sf).events().count()
    for name in ("store_delete_before", "store_snapshot", "follow_tidelog"):
        assert 0 < QUERIES[name](spark, sf).count() < n


def test_engine_stands_without_llm():
    import ast
    from pathlib import Path

    root = Path(__file__).resolve().parents[1] / "tidelog"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert not any("llm" in (getattr(n, "module", None) or "") for n in ast.walk(ast.parse(f.read_text())) if isinstance(n, ast.ImportFrom)), f
