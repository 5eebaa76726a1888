"""Every registered query of the engine against its SQL, and the optional part's guard."""

import math
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from sextant.plans import registry, registry_more, registry_search, registry_staging  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return [plain(x) for x in v] if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, sf, con, name):
    df = registry.QUERIES[name](spark, sf)
    theirs = con.sql(registry.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(theirs.columns)
    order = sorted(df.columns)
    ours = sorted(repr([plain(r[c]) for c in order]) for r in df.collect())
    want = [dict(zip(theirs.columns, r, strict=True)) for r in theirs.fetchall()]
    assert ours == sorted(repr([plain(r[c]) for c in order]) for r in want)


def test_bridges_take_every_node_and_source(spark, tmp_path):
    """Over 3,000 suppliers in chains of three: no chain is left out, and each one's middle counts."""
    c, chains = duckdb.connect(), 1050
    c.sql(f"create table link as select o, 3 * (o // 4) + (o // 2) % 2 as a, 3 * (o // 4) + (o // 2) % 2 + 1 as b from range({4 * chains}) r(o)")
    c.sql(f"create table supplier as select s::bigint as s_suppkey, 'Supplier#' || s as s_name from range({3 * chains}) r(s)")
    c.sql("create table orders as select o as o_orderkey, timestamp '1995-01-01' as o_orderdate, 'O' as o_orderstatus, '5-LOW' as o_orderpriority from link")
    c.sql("create table lineitem as select o as l_orderkey, a as l_suppkey, 1::int as l_linenumber from link union all select o, b, 2 from link")
    for name in ("supplier", "orders", "lineitem"):
        c.sql(f"copy {name} to '{tmp_path}/{name}.parquet'")
    got = {r["id"]: (r["betweenness"], r["bridge"]) for r in registry.QUERIES["bridges"](spark, str(tmp_path)).collect()}
    want = {k: v for k, *v in c.sql(registry.ORACLE_SQL["bridges"]).fetchall()}
    assert got.keys() == want.keys() and len(got) == 3 * chains
    assert all(abs(x - y) < 1e-12 for k in want for x, y in zip(got[k], want[k], strict=True))
    assert sum(x > 0 for x, _ in got.values()) == chains


def test_engine_without_the_optional_part(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/sextant", tmp_path / "sextant", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'lead_pairs' in e.queries() and not [q for q in e.queries() if q.startswith('op')]"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
