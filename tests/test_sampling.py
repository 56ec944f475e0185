"""Pools, weighted draws and keyed permutations."""
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tandem.operators import batches as B


def test_pools_have_probabilities_of_their_own(spark):
    df = spark.createDataFrame([("mono", "a")] * 8 + [("mono", "b")] * 2 + [("para", "a")] * 3 + [("para", "c")], "pool string, item string")
    got = {(r.pool, r.item): (r.n, r.p) for r in B.pool_probs(df, "pool", "item", 0.5).collect()}
    assert got[("mono", "a")][0] == 8 and abs(got[("mono", "a")][1] - 2 / 3) < 1e-9
    assert abs(got[("para", "a")][1] - 3 ** 0.5 / (1 + 3 ** 0.5)) < 1e-9
    off = {(r.pool, r.item): r.p for r in B.pool_probs(df, "pool", "item", -1).collect()}
    assert set(off.values()) == {0.5}
    with pytest.raises(ValueError):
        B.pool_probs(df, "pool", "item", 0)


def test_draws_follow_the_weights(spark):
    probs = spark.createDataFrame([("a", 0.5), ("b", 0.3), ("c", 0.2), ("d", 0.0), ("e", 0.9)], "item string, p double")
    rows, items = spark.range(20000), ["a", "b", "c", "d"]
    got = B.race_draws(rows, "id", probs, "item", items, 3, 5).collect()
    assert len(got) == 60000 and {r.draw for r in got} == {0, 1, 2}
    share = {k: v / 60000 for k, v in Counter(r.item for r in got).items()}
    assert set(share) == {"a", "b", "c"} and abs(share["a"] - 0.5) < 0.01 and abs(share["c"] - 0.2) < 0.01
    alone = B.race_draws(rows, "id", probs, "item", items, 9, 5, replace=False).collect()
    per = Counter((r.id, r.item) for r in alone)
    assert set(per.values()) == {1} and len(alone) == 60000  # d never arrives
    first = Counter(r.item for r in alone if r.draw == 0)
    second = Counter(r.item for r in alone if r.draw == 1)
    assert abs(first["a"] / 20000 - 0.5) < 0.015
    assert abs(second["b"] / 20000 - (0.5 * 0.3 / 0.5 + 0.2 * 0.3 / 0.8)) < 0.015
    assert sorted(map(tuple, got)) == sorted(map(tuple, B.race_draws(rows.repartition(7), "id", probs, "item", items, 3, 5).collect()))


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000])
def test_permutation_is_a_bijection(spark, n):
    got = spark.range(n).select("id", B.permuted(F.col("id"), F.lit(n).cast("long"), 3).alias("a"),
                                B.permuted(F.col("id"), F.lit(n).cast("long"), 4).alias("b")).collect()
    assert sorted(r.a for r in got) == list(range(n)) == sorted(r.b for r in got)
    if n == 1000:
        assert [r.a for r in got] != [r.b for r in got]
        near = sum(abs(x.a - y.a) == 1 for x, y in zip(got, got[1:]))
        cells = Counter((r.id // 250, r.a // 250) for r in got)
        assert near < 12 and min(cells.values()) > 35 and max(cells.values()) < 95
