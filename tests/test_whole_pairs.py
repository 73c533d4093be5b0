"""Pair queries on a table of more pairs than a request of the reference may ask for."""

import duckdb
import pytest
from pyspark.sql import functions as F

from docketry.operators import links as L
from docketry.plans import registry

N = 700


@pytest.fixture(scope="module")
def suppliers(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("suppliers"))
    spark.range(N).selectExpr("id AS s_suppkey", "cast((id * 7) % 25 AS int) AS s_nationkey").coalesce(1).write.parquet(f"{d}/supplier.parquet")
    return d


@pytest.mark.parametrize("name", ["disjoint_pairs", "pair_identity", "relation_corpus"])
def test_all_pairs_are_found(spark, suppliers, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW supplier AS SELECT * FROM '{suppliers}/supplier.parquet/*.parquet'")
    df = registry.queries()[name](spark, suppliers)
    want = c.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert len(want) > 5000
    assert sorted(map(tuple, df.collect())) == sorted(want)


def test_blocks_of_a_group_give_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(L, "PAIR_BLOCK", 3)
    rows = spark.createDataFrame([(i, i % 2, [f"o{i % 3}"]) for i in range(40)] + [(None, 1, ["x"])], "id int, scope int, orgs array<string>")
    want = sorted((s, a, b) for s in (0, 1) for b in range(s, 40, 2) for a in range(s, b, 2) if a % 3 != b % 3)
    assert sorted(map(tuple, L.disjoint_pairs(rows, "scope").collect())) == want


@pytest.mark.parametrize("name", ["disjoint_pairs", "pair_identity"])
def test_pairs_of_few_rows_are_the_work_of_many_tasks(spark, suppliers, name):
    rows = registry.queries()[name](spark, suppliers).groupBy(F.spark_partition_id()).count().collect()
    assert len(rows) > 1 and max(r["count"] for r in rows) < 0.8 * sum(r["count"] for r in rows)
