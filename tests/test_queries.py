"""Registered queries against their SQL on the smallest tables (all of them with TEST_ALL=1)."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_queries import rows_of

QUICK = ("sync_gate", "asof_two_clock", "contiguous_runs", "bridge_gaps", "usable_rows", "norm_stats_multi", "pad_norm_fit", "loss_check", "hand_verdict",
         "integrity_check", "renumber", "rotation_delta", "rasterize_lookup", "contrastive_error", "stream_moments", "stream_baseline_delta", "stream_sync_gate")
NAMES = list(entry.queries()) if os.environ.get("TEST_ALL") else QUICK


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "passed" in df.columns


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, name):
    df = entry.queries()[name](spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in entry.oracle_sql():
        assert got[1]
        return
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    cur = con.execute(entry.oracle_sql()[name])
    assert got == rows_of([d[0] for d in cur.description], cur.fetchall())
