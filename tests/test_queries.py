"""Every oracle names a query, and every query with SQL gives its rows on the smallest tables."""

import threading
from concurrent.futures import ThreadPoolExecutor

import duckdb

import __spark_entry__ as entry
from tools.check_queries import TABLES, table

SF = "/root/testdata/sf0.001"
ALONE = {"stream_ingest", "stream_last_calls", "stream_calibration", "sql_functions"}
"""Queries that set something in the session while they run."""


def test_catalog():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 180


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_against_sql(spark):
    """All SQL checks, some at a time."""
    queries, oracles = entry.queries(), entry.oracle_sql()
    local = threading.local()

    def connection():
        if not hasattr(local, "con"):
            local.con = duckdb.connect()
            for t in TABLES:
                local.con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        return local.con

    def check(name):
        try:
            df = queries[name](spark, SF)
            got = table(df.columns, [tuple(r) for r in df.collect()])
            cur = connection().execute(oracles[name])
            want = table([d[0] for d in cur.description], cur.fetchall())
        except Exception as err:  # noqa: BLE001
            return f"{name}: {str(err)[:500]}"
        return None if got == want else f"{name}: {[(a, b) for a, b in zip(got[1], want[1], strict=False) if a != b][:2]} {len(got[1])}/{len(want[1])} {got[0]} {want[0]}"

    with ThreadPoolExecutor(6) as pool:
        bad = list(pool.map(check, [n for n in oracles if n not in ALONE]))
    bad += [check(n) for n in oracles if n in ALONE]
    assert not [b for b in bad if b], "\n".join(b for b in bad if b)
