import os

import duckdb
import pytest

import __spark_entry__
from tideglass import queries as core

SF = "/root/testdata/sf0.001"


def test_names_and_sql_belong_together():
    """Listing needs no session: it runs in a process of its own."""
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], check=True)
    assert set(core.oracle_sql()) <= set(core.queries()) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["build_panel", "apply_pit_rules", "index_series", "compute_indices", "dedup_cross_venue", "corr_and_leadlag", "store_finalize", "stream_upsert_prices", "stream_late_ticks", "src_landed_files_a", "compare_benchmarks", "check_many_windows", "cross_param_rows"])
def test_rows_equal_the_sql(spark, name):
    db = duckdb.connect()
    for t in ("events", "lineitem", "orders", "documents"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = core.queries()[name](spark, SF)
    want = db.sql(core.oracle_sql()[name])
    order = sorted(found.columns)
    assert order == sorted(want.columns)
    got = sorted(repr(tuple(r[c] for c in order)) for r in found.collect())
    assert got == sorted(repr(tuple(dict(zip(want.columns, r, strict=True))[c] for c in order)) for r in want.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_flagship(spark):
    assert __spark_entry__.entry(spark).count() > 0
