"""Cycles of plans of any length."""

from sievemill.operators import joins


def test_cycles_longer_than_64_steps(spark):
    rows = [(1, i, [i % 100 + 1]) for i in range(1, 101)] + [(2, 1, [2]), (2, 2, [3])]
    found = joins.cycles(spark.createDataFrame(rows, "plan_id long, step int, needs array<int>")).collect()
    assert {tuple(r) for r in found} == {(1, i) for i in range(1, 101)}
