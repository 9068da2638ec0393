"""Queries against their SQL where copies lie at one place and numbers end in halves, as in larger tables."""

import os

import duckdb
import pytest

from wayfield import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def copies(tmp_path_factory):
    """Six copies of the customers with halves among their balances, and 600 of the parts; the other tables as they are."""
    d, c = str(tmp_path_factory.mktemp("copies")), duckdb.connect()
    c.execute(f"""copy (select c_custkey + i * 150 as c_custkey, c_name, c_nationkey, case when i % 3 = 0 then 201.0 + 200 * (c_custkey % 20) when i % 3 = 1 then 6.25 + 200 * (c_custkey % 20) else 7.5 + 200 * (c_custkey % 20) end::double as c_acctbal, c_mktsegment
        from '{DATA}/customer.parquet', range(6) r(i)) to '{d}/customer.parquet'""")
    c.execute(f"copy (select p_partkey + i * 200 as p_partkey, p_name, p_brand, p_type, p_size, p_retailprice from '{DATA}/part.parquet', range(600) r(i)) to '{d}/part.parquet'")
    for t in os.listdir(DATA):
        if not os.path.exists(f"{d}/{t}"):
            os.symlink(f"{DATA}/{t}", f"{d}/{t}")
    return d


NAMES = ["shared_routes", "rings_on_ground", "near_nodes", "node_positions", "matched_rays", "walked_edges"]


@pytest.mark.parametrize("name", NAMES)
def test_copies_and_halves(spark, copies, name, tmp_path):
    c = duckdb.connect()
    for t in os.listdir(copies):
        c.execute(f"create view {t.split('.')[0]} as select * from '{copies}/{t}'")
    registry.queries()[name](spark, copies).write.parquet(f"{tmp_path}/got")
    c.execute(f"create table want as {registry.oracle_sql()[name]}")
    cols = ", ".join(f'"{r[0]}"' for r in c.execute("describe want").fetchall())
    got = f"'{tmp_path}/got/*.parquet'"
    assert c.execute("select count(*) from want").fetchone()[0]
    assert not c.execute(f"(select {cols} from {got} except all select {cols} from want) union all (select {cols} from want except all select {cols} from {got})").fetchall()
