"""The registry: every query against its SQL on the smallest tables, and the import guard."""

import collections
import os
import subprocess
import sys

import pytest

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
FAST = ["weekly_mean", "smoothed_climatology", "anomaly", "lead_targets", "baseline_scores", "crps_fair", "crps_woy_climatology", "rank_histogram", "reliability_curve", "evaluation_scores", "daily_init_windows", "idw_interp", "time_gap_check", "forecast_scores", "event_reliability", "packed_samples", "loss_by_resolution"]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, db, name):
    import __spark_entry__ as e

    df = e.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rel = db.sql(e.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    assert collections.Counter(map(tuple, df.select(*cols).collect())) == collections.Counter(rel.select(*cols).fetchall())


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 12


def test_sql_names_are_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_registry_without_llm(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run(["cp", "-r", f"{root}/skillcube", f"{root}/__spark_entry__.py", str(tmp_path)], check=True)
    subprocess.run(["mv", str(tmp_path / "skillcube/llm"), str(tmp_path / "gone")], check=False)
    code = "import __spark_entry__ as e; assert 'baseline_scores' in e.queries() and not [n for n in e.queries() if n.startswith('op')]"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
