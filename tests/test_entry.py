import os
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"


def test_every_sql_has_its_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 90


def test_the_rest_stands_without_the_subpackage():
    code = "import sys; sys.modules['tagloom.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p3_found' in q and 'p2_found' not in q and 'p7_ids' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["map_budget_prefix", "p3_found", "p6_found", "snapshot_diff", "detect_fuzzy"])
def test_against_sql(spark, name):
    import duckdb

    import __spark_entry__ as e

    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    df = e.queries()[name](spark, DATA)
    r = c.execute(e.oracle_sql()[name])
    cols = [x[0] for x in r.description]
    assert sorted(map(repr, (tuple(x[k] for k in cols) for x in df.collect()))) == sorted(map(repr, r.fetchall()))
