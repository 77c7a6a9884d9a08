"""The driver's contract, and a sample of queries against DuckDB."""

import glob
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

SAMPLE = ("g041_merge_edges", "g044_type_owner", "g054_ancestors", "g066_report_scope", "g090_coupling_metrics", "g095_file_summary", "g138_reachable", "g147_strong_components", "g150_layer_violations", "g154_impact", "g160_multi_root", "g185_notifications", "g189_contracts", "g202_sql_relations")


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 25


@pytest.mark.parametrize("name", SAMPLE)
def test_against_duckdb(spark, sf, name):
    con = duckdb.connect()
    for t in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(t)[:-8]} as select * from '{t}'")
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    want = con.execute(entry.oracle_sql()[name])
    at = [[d[0] for d in want.description].index(c) for c in cols]
    short = lambda v: round(v, 9) if isinstance(v, float) else v
    assert Counter(tuple(short(r[c]) for c in cols) for r in df.collect()) == Counter(tuple(short(r[i]) for i in at) for r in want.fetchall())
