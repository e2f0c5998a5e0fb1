"""Every registered query over virtual repositories against its SQL in DuckDB."""

from __future__ import annotations

import duckdb
import pytest

from palimpsest.plans.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(x):
    return round(x, 6) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    want = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = sorted((tuple(_plain(r[c]) for c in columns) for r in got.collect()), key=str)
    assert rows == sorted((tuple(_plain(x) for x in r) for r in want.fetchall()), key=str)


def test_queries_without_sql_run(spark, sf_dir):
    assert QUERIES.keys() - ORACLE_SQL.keys() == {"gc9_gc13_budgeted_plan"}
    rows = QUERIES["gc9_gc13_budgeted_plan"](spark, sf_dir).collect()
    assert {r.action for r in rows} == {"repack", "remove"} and all((r.step == 2) == (r.action == "repack") for r in rows)


def test_index_json_reads_bounded_files(spark, monkeypatch):
    from pyspark.sql import functions as F

    from palimpsest.sources import readers

    seen, rows = [], readers.index_rows
    monkeypatch.setattr(readers, "index_rows", lambda raw: (seen.append(raw), rows(raw))[1])
    assert QUERIES["s7_index_json"](spark, "/root/testdata/sf0.01").count() == 53_262
    blobs = seen[0].select(F.aggregate("packs", F.lit(0), lambda n, p: n + F.size(p.blobs)).alias("n")).agg(F.max("n"), F.sum("n")).first()
    assert blobs[0] <= 5_000 and blobs[1] == 2 * 53_262


def test_formats_of_large_numbers_match_sql(spark, sf_dir, tmp_path):
    con = duckdb.connect()
    ids = "[1023, 1024, 32767, 32768, 99999, 5999999, 19299647, 190315000]"
    con.execute(f"COPY (SELECT * REPLACE (CAST({ids}[event_id + 1] AS BIGINT) AS event_id) FROM '{sf_dir}/events.parquet' WHERE event_id < len({ids})) TO '{tmp_path}/events.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = con.execute(ORACLE_SQL["z_formats"]).fetchall()
    assert len(want) == 8 and sorted(map(tuple, QUERIES["z_formats"](spark, str(tmp_path)).collect())) == sorted(want)


def test_entry(spark):
    import __spark_entry__ as e

    out = e.entry(spark)
    assert out.count() == 1000 and out.columns == ["hostname", "event_id", "action", "reasons"]
    assert e.oracle_sql().keys() <= e.queries().keys()
