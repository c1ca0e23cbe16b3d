import random

import pytest

from tarmacade.llm.topn import top_n


def brute(rows, n):
    groups = {}
    for g, score, item in rows:
        if g is not None and score is not None:
            groups.setdefault(g, []).append((score, item))
    return sorted((g, k, i) for g, v in groups.items() for k, (_, i) in enumerate(sorted(v)[:n], 1))


@pytest.mark.parametrize("hot", [3, 40, 10**9])
def test_equals_brute_force_whatever_is_hot(spark, hot):
    rng = random.Random(1)
    rows = [("big", rng.choice([1, 1, 1, 2, 50, 90]), i) for i in range(500)]
    rows += [("tied", 4, 1000 + i) for i in range(300)]
    rows += [(f"g{i % 60}", rng.randint(1, 30), 2000 + i) for i in range(400)]
    rows += [(None, 1, 9000), ("null score", None, 9001), ("single", 7, 9002)]
    frame = spark.createDataFrame(rows, "g string, score int, item long").repartition(4)
    found = top_n(frame, "g", "score", "item", 5, hot=hot, ranges=4)
    assert sorted((r["g"], r["rnk"], r["item"]) for r in found.collect()) == brute(rows, 5)


def test_repeated_rows_and_other_columns_stay(spark):
    frame = spark.createDataFrame([("a", 1, 1, "x"), ("a", 1, 1, "x"), ("a", 2, 2, None)], "g string, score int, item long, extra string")
    for hot in (1, 100):
        found = top_n(frame, "g", "score", "item", 2, hot=hot)
        assert [(r["item"], r["rnk"], r["extra"]) for r in found.orderBy("rnk").collect()] == [(1, 1, "x"), (1, 2, "x")]


def test_no_rows(spark):
    frame = spark.createDataFrame([], "g string, score int, item long")
    assert top_n(frame, "g", "score", "item", 3).collect() == []
