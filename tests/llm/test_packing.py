import random
from collections import Counter, defaultdict

import pytest

from tarmacade.llm.packing import Plan, fill_report, pack, ranked, size_counts

KINDS = "container string, capacity_tokens int"


def best_fit_decreasing(sizes, capacity):
    gaps = []
    for s in sorted(sizes, reverse=True):
        fit = min((g for g in gaps if g >= s), default=None)
        if fit is None:
            gaps.append(capacity - s)
        else:
            gaps.remove(fit)
            gaps.append(fit - s)
    return sorted(gaps)


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 100, 512])
    sizes = [rng.randint(1, capacity) for _ in range(rng.randint(0, 300))]
    plan, used = Plan(capacity, Counter(sizes)), Counter()
    for size, n in Counter(sizes).items():
        moves = plan.moves[size]
        for r in range(n):
            start, first, per = max(m for m in moves if m[0] <= r)
            used[first + (r - start) // per] += size
    assert sorted(capacity - u for u in used.values()) == best_fit_decreasing(sizes, capacity)
    assert len(used) == plan.containers


def test_every_text_once_and_no_container_too_full(spark):
    rng = random.Random(2)
    sizes = [rng.choice([7, 7, 7, rng.randint(1, 60), 230]) for _ in range(400)]
    items = spark.createDataFrame([(i, s, "x") for i, s in enumerate(sizes)], "doc_id long, tokens long, size string").repartition(5)
    rows = pack(items, spark.createDataFrame([("a", 100), ("b", 60), ("none", 0), (None, 5)], KINDS)).collect()
    for kind, capacity in (("a", 100), ("b", 60)):
        mine = [r for r in rows if r["container"] == kind]
        total, fill = defaultdict(int), defaultdict(int)
        for r in mine:
            total[r["doc_id"]] += r["tokens"]
            fill[r["container_id"]] += r["tokens"]
            assert r["tokens"] == capacity or r["piece"] == sizes[r["doc_id"]] // capacity
        assert total == dict(enumerate(sizes)) and max(fill.values()) <= capacity
        assert all(r["used_tokens"] == fill[r["container_id"]] and r["fill"] == r["used_tokens"] / capacity for r in mine)
        pieces = [min(capacity, s - k) for s in sizes for k in range(0, s, capacity)]
        assert sorted(capacity - f for f in fill.values()) == best_fit_decreasing(pieces, capacity)
        assert len({(r["doc_id"], r["piece"]) for r in mine}) == len(mine)
    assert {r["container"] for r in rows} == {"a", "b"}


def test_ranks_over_several_buckets_are_complete(spark):
    parts = spark.createDataFrame([("a", 9, i, 0, 5 if i % 3 else 8) for i in range(200)], "container string, capacity long, doc_id long, piece long, size long")
    for bucket_rows in (1000, 20, 1):
        found = defaultdict(list)
        for r in ranked(parts, size_counts(parts), bucket_rows).collect():
            found[r["size"]].append(r["rank"])
        assert all(sorted(v) == list(range(len(v))) for v in found.values())


def test_nothing_to_pack(spark):
    items = spark.createDataFrame([(1, 0), (2, None)], "doc_id long, tokens long")
    kinds = spark.createDataFrame([("a", 10)], KINDS)
    assert pack(items, kinds).collect() == [] and pack(items, kinds.limit(0)).collect() == []
    assert fill_report(pack(items, kinds)).collect() == []
