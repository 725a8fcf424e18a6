"""Registered queries and their SQL agree."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from gapwright.plans import registry
from gapwright.plans.sql import POOL, PREDICTED

D = "/root/testdata/sf0.001"
SAMPLE = ["gt1_eligible_runs", "gt3_real_gap_inventory", "jn9_asof_edges", "bl1_climatology", "ag8_benchmark_score", "wn1_pre_edge_features", "ps2_paired_bootstrap", "td3_tail_runs", "rs1_run_state", "ag15_gap_level_candidates"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{D}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.fixture(scope="module")
def gap_first(tmp_path_factory):
    """lineitem from the first day of a gap of the pool on, which then has no known day before it."""
    d = tmp_path_factory.mktemp("gap_first")
    c = duckdb.connect()
    c.execute("create view lineitem as select * from '/root/testdata/sf0.01/lineitem.parquet'")
    day = c.sql(f"WITH {POOL} SELECT min(start) FROM pool WHERE gap_length = 7").fetchall()[0][0]
    c.execute(f"copy (select * from lineitem where l_shipdate >= '{day}') to '{d}/lineitem.parquet' (format parquet)")
    c.execute(f"create or replace view lineitem as select * from '{d}/lineitem.parquet'")
    assert c.sql(f"WITH {PREDICTED} SELECT count(*) FROM scored WHERE prediction IS NULL").fetchall()[0][0]
    return d


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(registry.oracle_sql()) >= 90


def test_flagship(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, duck, name, tmp_path):
    registry.queries()[name](spark, D).write.parquet(str(tmp_path / "o"))
    a, b = duck.sql(registry.oracle_sql()[name]), duck.sql(f"select * from '{tmp_path}/o/*.parquet'")
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    p = ", ".join(f'"{c}"' for c in cols)
    assert sorted(map(repr, a.project(p).fetchall())) == sorted(map(repr, b.project(p).fetchall()))


@pytest.mark.parametrize("name", ["st4_dropped_duplicates", "wn7_method_ranks", "vf2_scoring_chain"])
def test_query_equals_sql_where_a_gap_has_no_prediction(spark, gap_first, name):
    c = duckdb.connect()
    c.execute(f"create view lineitem as select * from '{gap_first}/lineitem.parquet'")
    want = c.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, str(gap_first)).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
