import math
import random

import pytest
from pyspark.sql import functions as F

from tarmacade.llm.percentiles import counted, daily_sketch, multi_select, sketch_values

PERMILLES = [1, 500, 900, 990, 1000]


def brute(values, permille):
    return sorted(values)[max(1, math.ceil(len(values) * permille / 1000)) - 1]


def selected(spark, data, small):
    rows = [(g, float(v)) for g, vs in data.items() for v in vs]
    frame = spark.createDataFrame(rows, "g string, value double").repartition(5)
    found = multi_select(counted(frame, ["g"]), ["g"], PERMILLES, small=small)
    return {(r["g"], r["permille"]): (r["n"], r["value"]) for r in found.collect()}


@pytest.mark.parametrize("small", [1, 7, 100_000])
def test_equals_brute_force_whatever_the_range_size(spark, small):
    rng = random.Random(3)
    data = {
        "spread": [rng.uniform(0, 1e6) for _ in range(300)],
        "skewed": [rng.paretovariate(0.5) for _ in range(200)],
        "ties": [rng.choice([1, 1, 1, 2, 9]) for _ in range(90)],
        "one": [5.0],
        "same": [3.0] * 40,
        "negative": [-float(i) for i in range(50)],
    }
    found = selected(spark, data, small)
    assert found == {(g, p): (len(v), float(brute(v, p))) for g, v in data.items() for p in PERMILLES}


def test_null_and_nan_are_no_values_and_no_rows_give_no_rows(spark):
    frame = spark.createDataFrame([("a", None), ("a", float("nan")), ("b", 2.0)], "g string, value double")
    found = multi_select(counted(frame, ["g"]), ["g"], [500]).collect()
    assert [(r["g"], r["n"], r["value"]) for r in found] == [("b", 1, 2.0)]
    assert multi_select(counted(frame.limit(0), ["g"]), ["g"], [500]).collect() == []


def test_counts_of_parts_add_up(spark):
    frame = spark.range(1, 1001).select(F.lit("a").alias("g"), (F.col("id") % 97).cast("double").alias("value"), "id")
    parts = counted(frame.where("id % 3 = 0"), ["g"]).unionByName(counted(frame.where("id % 3 <> 0"), ["g"]))
    whole = parts.groupBy("g", "value").agg(F.sum("w").alias("w"))
    found = multi_select(whole, ["g"], PERMILLES, small=10).collect()
    values = [i % 97 for i in range(1, 1001)]
    assert {r["permille"]: r["value"] for r in found} == {p: float(brute(values, p)) for p in PERMILLES}


def test_sketches_of_days_keep_the_error_bound(spark):
    rng = random.Random(5)
    rows = [(f"d{i % 7}", rng.lognormvariate(7, 2) if i % 50 else 0.0) for i in range(3000)]
    frame = spark.createDataFrame(rows, "day string, value double")
    sketch = daily_sketch(counted(frame, ["day"]), ["day"], 0.01).withColumn("g", F.lit("all"))
    found = multi_select(sketch_values(sketch, ["g"], 0.01), ["g"], PERMILLES).collect()
    for r in found:
        exact = brute([v for _, v in rows], r["permille"])
        assert abs(r["value"] - exact) <= 0.0101 * exact


def test_clashing_columns_pass_unharmed(spark):
    frame = spark.createDataFrame([("a", 1.0, 7, 8, 9)], "g string, value double, n int, w int, permille int")
    assert multi_select(counted(frame, ["g"]), ["g"], [500]).collect()[0]["value"] == 1.0
