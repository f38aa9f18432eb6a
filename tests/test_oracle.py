"""Every registered query against its DuckDB oracle on the sf0.001 tables
(the driver runs the same comparison at sf0.01)."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="driver test data not present")
def test_all_queries_match_oracle(spark):
    import __spark_entry__ as E
    from check_oracle import TABLES, digest

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    qs, orc = E.queries(), E.oracle_sql()
    assert set(orc) <= set(qs)
    bad = []
    for name, fn in qs.items():
        df = fn(spark, SF)
        srows, scols = [tuple(r) for r in df.collect()], df.columns
        if name not in orc:
            continue
        cur = con.execute(orc[name])
        ocols = [d[0] for d in cur.description]
        orows = cur.fetchall()
        ok = len(srows) == len(orows) and sorted(scols) == sorted(ocols) and digest(scols, srows) == digest(ocols, orows)
        if not ok:
            bad.append((name, len(srows), len(orows)))
    assert bad == []
