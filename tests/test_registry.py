"""Every catalogue query and the flagship against DuckDB on the smallest data set."""

import os

import pytest

import __spark_entry__ as entry
from tests.conftest import SF
from tools.check_oracle import norm

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
# The detection chain is compared in full by tools/check_oracle.py; here one query of each layer.
CHAIN = {"Q01_detect_extrema", "Q02_cluster_extrema", "Q03_detect_blocking", "Q04_heat_clusters", "A20_isoline_cells", "T04_progress_stream"}
FAST = [n for n in entry.oracle_sql() if n in CHAIN or n[0] in "FUOW" and not n.startswith(("W0", "F00", "O01"))
        or n[:3] in ("P11", "P12", "P13", "P14", "P15", "P16", "J08", "J09", "J10", "J11", "J12", "J14", "A16", "A17", "A18", "G01", "G02", "G10", "S12")]


def test_every_query_is_callable_and_named():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 120
    assert all(callable(f) for f in q.values())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["time", "max_id", "min1_id", "min2_id", "type"] and df.count() >= 1


@pytest.mark.parametrize("name", FAST)
def test_against_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    cur = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = sorted(tuple(norm(dict(zip(names, r))[c]) for c in cols) for r in cur.fetchall())
    assert sorted(names) == cols
    assert got == want
