"""Queries over all rows, where the registered SQL covers a part of them."""

import math

import duckdb

from mezze import registry


def test_nearest_pairs_take_all_venues(spark, sf_dir, tmp_path):
    from mezze.plans.views import venues

    for name, rows in (("region", f"SELECT * FROM '{sf_dir}/region.parquet'"), ("nation", f"SELECT * FROM '{sf_dir}/nation.parquet'"), ("customer", "SELECT k AS c_custkey, 'c' || k AS c_name, (k % 25)::INTEGER AS c_nationkey, 0e0 AS c_acctbal, 'BUILDING' AS c_mktsegment FROM range(1, 1201) r(k)")):
        duckdb.sql(f"COPY ({rows}) TO '{tmp_path}/{name}.parquet'")
    sf_dir = str(tmp_path)
    points = [(r["id"], r["location"]["coordinates"]) for r in venues(spark, sf_dir).select("id", "location").collect() if r["location"]]

    def metres(a, b):
        (x1, y1), (x2, y2) = (map(math.radians, p) for p in (a, b))
        return 2 * 6371000 * math.asin(math.sqrt(math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2))

    want = {(i, j): m for i, a in points for j, b in points if i != j and (m := metres(a, b)) <= 15_000}
    got = {(r["id"], r["other_id"]): r["metres"] for r in registry.queries()["nearest_pairs"](spark, sf_dir).collect()}
    assert got.keys() == want.keys() and any(int(i) % 5 for i, _ in got)
    assert all(abs(got[k] - m) < 0.01 for k, m in want.items())


def test_job_fanout_takes_all_orders(spark, sf_dir):
    want = duckdb.sql(f"SELECT DISTINCT 'gm_aps_' || l_partkey % 50, l_orderkey, 'gm:aps/' || l_partkey % 50 FROM '{sf_dir}/lineitem.parquet' SEMI JOIN '{sf_dir}/orders.parquet' ON l_orderkey = o_orderkey").fetchall()
    got = registry.queries()["job_fanout"](spark, sf_dir).select("job_id", "request_id", "google_place_id").collect()
    assert sorted(map(tuple, got)) == sorted(want)
