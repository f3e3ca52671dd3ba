"""What one task of the panel of two types holds does not grow with the tables."""

from tessella import session as S
from tessella.plans import panels


def test_tasks_grow_with_the_rows(spark):
    rows = S.split_by(spark.range(100), 100, "id", task_rows=10)
    assert rows.rdd.getNumPartitions() == 10
    assert S.split_by(spark.range(3), 3, "id").rdd.getNumPartitions() == S.shuffle_partitions(rows)


def test_both_sides_are_dealt_by_order_in_tasks_of_bounded_rows(spark, sf, monkeypatch):
    dealt = []

    def small_tasks(df, n, *keys):
        dealt.append((n, *keys))
        return S.split_by(df, n, *keys, task_rows=500)

    want = sorted(map(str, panels.panel_two_statement_types(spark, sf).collect()))
    monkeypatch.setattr(panels, "split_by", small_tasks)
    got = sorted(map(str, panels.panel_two_statement_types(spark, sf).collect()))
    n = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert dealt == [(n, "l_orderkey"), (n, "o_orderkey")] and got == want
