"""All registered queries that have a DuckDB twin, row by row."""

import decimal
import math

import duckdb
import pytest

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def plain(v):
    return float(v) if isinstance(v, (decimal.Decimal, float)) else v if v is None or isinstance(v, (bool, int)) else str(v)


def same(a, b) -> bool:
    return len(a) == len(b) and all(math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) if isinstance(x, float) and isinstance(y, (float, int)) else x == y for x, y in zip(a, b))


def cores():
    from landcube.plans import registry

    return sorted(registry.oracles())


FAMILIES = ["agg", "dom", "flt", "geo", "idx", "jon", "msk", "prj", "ras", "scl", "set", "sma", "snk", "sql", "src", "srt", "win"]


@pytest.mark.parametrize("family,sf", [*((f, SMALL) for f in FAMILIES), ("flt", LARGER), ("snk", LARGER), ("srt", LARGER)])
def test_twins(spark, family, sf):
    from landcube.plans import registry
    from landcube.plans.roles import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    names = [n for n in cores() if n.startswith(family + "_")]
    faults = []
    for name in names:
        cur = con.execute(registry.oracles()[name])
        head = [d[0] for d in cur.description]
        cols = sorted(head)
        at = [head.index(c) for c in cols]
        want = sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=str)
        df = registry.queries()[name](spark, sf)
        got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
        if sorted(df.columns) != cols or len(got) != len(want) or not all(map(same, got, want)):
            faults.append(name)
    assert names and not faults
