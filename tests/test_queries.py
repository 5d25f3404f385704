import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from check import rows_of

SF = "/root/testdata/sf0.001"
EVERY = os.environ.get("MILLRACE_SOME_QUERIES") != "1"
SOME = ["l_all_low_stats", "c22_all_turns", "p06_core_metadata", "j01_stats_join", "a01_column_profile", "m18_map_and_validate",
        "i04_skill_task_coherence", "g02_traversal", "r09_training_table", "s12_filtered_globs", "w03_exact_duplicates", "q04_cube"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


def test_registry_needs_no_session():
    code = "import __spark_entry__ as e; assert len(e.queries()) >= len(e.oracle_sql()) > 200"
    root = os.path.dirname(os.path.abspath(entry.__file__))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)


def test_every_oracle_belongs_to_a_query():
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_flagship_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()) if EVERY else SOME)
def test_query_matches_its_oracle(spark, oracle, name):
    df = entry.queries()[name](spark, SF)
    cursor = oracle.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, cursor.fetchall())
