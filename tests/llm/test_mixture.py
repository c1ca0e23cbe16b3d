from collections import Counter, defaultdict

import numpy as np

from tarmacade.llm.mixture import hypergeometric, leaf, mix, share_report

ITEMS, TARGETS = "doc_id long, source string, tokens long", "source string, target_share double, max_repeats int"


def made(spark, n=600):
    rows = [(i, "big" if i % 3 else "small", 10 + i % 7) for i in range(n)] + [(9001, None, 10), (9002, "other", 10), (9003, "big", 0), (9004, "big", None)]
    return rows, spark.createDataFrame(rows, ITEMS).repartition(4)


def test_shares_repeats_and_shards(spark):
    rows, items = made(spark)
    targets = spark.createDataFrame([("big", 0.4, 1), ("small", 0.5, 3), ("absent", 0.1, 4), (None, 0.0, 1)], TARGETS)
    mixed = mix(items, targets, block_tokens=64, shard_tokens=900)
    used = mixed.collect()
    tokens, uses = Counter(), defaultdict(list)
    for r in used:
        tokens[r["source"]] += r["tokens"]
        uses[r["doc_id"]].append(r["copy"])
    total = sum(tokens.values())
    assert abs(tokens["big"] / total - 0.4 / 0.9) < 0.005 and abs(tokens["small"] / total - 0.5 / 0.9) < 0.005
    limits = {i: 1 if s == "big" else 3 for i, s, _ in rows}
    assert all(sorted(c) == list(range(len(c))) and len(c) <= limits[i] for i, c in uses.items())
    assert all(r["repeats"] == len(uses[r["doc_id"]]) for r in used)
    positions = defaultdict(list)
    for r in used:
        positions[r["shard"]].append(r["position"])
    assert len(positions) > 3 and all(sorted(p) == list(range(len(p))) for p in positions.values())
    sizes = Counter()
    for r in used:
        sizes[r["shard"]] += r["tokens"]
    assert max(sizes.values()) < 3 * min(sizes.values())
    report = {r["source"]: r for r in share_report(mixed, targets).collect()}
    assert report["absent"]["tokens"] == 0 and report["big"]["tokens"] == tokens["big"] and "other" not in report
    assert report["small"]["most_repeats"] == max(len(uses[i]) for i in uses if limits[i] == 3)
    assert sorted(used) == sorted(mix(items, targets, block_tokens=64, shard_tokens=900).collect())


def test_a_total_below_the_possible_is_met(spark):
    _, items = made(spark)
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 1)], TARGETS)
    used = mix(items, targets, total_tokens=1000, block_tokens=50, shard_tokens=300).collect()
    assert abs(sum(r["tokens"] for r in used) - 1000) <= 20


def test_nothing_to_mix(spark):
    _, items = made(spark)
    assert mix(items, spark.createDataFrame([], TARGETS)).collect() == []
    assert mix(items.limit(0), spark.createDataFrame([("big", 1.0, 1)], TARGETS)).collect() == []
    assert mix(items, spark.createDataFrame([("absent", 1.0, 1), ("big", 0.0, 1)], TARGETS)).collect() == []


def test_leaves_of_the_tree_add_up():
    blocks = np.array([100, 7, 0, 53])
    leaves = [leaf(k, 9, blocks, 3) for k in range(9)]
    assert np.array_equal(sum(h for _, h in leaves), blocks)
    for (b0, h0), (b1, _) in zip(leaves, leaves[1:]):
        assert np.array_equal(b0 + h0, b1)
    assert max(h.sum() for _, h in leaves) - min(h.sum() for _, h in leaves) <= 1


def test_more_blocks_than_the_library_draws():
    blocks = np.array([10**10, 3 * 10**9, 7, 0])
    leaves = [leaf(k, 5, blocks, 3) for k in range(5)]
    assert np.array_equal(sum(h for _, h in leaves), blocks)
    share = np.array([h[0] / h.sum() for _, h in leaves])
    assert abs(share - 10 / 13).max() < 1e-4 and len({int(h[0]) for _, h in leaves}) > 1


def test_large_draws_have_the_right_mean_and_spread():
    rng, good, bad, drawn = np.random.default_rng(1), 6 * 10**8, 9 * 10**8, 4 * 10**5
    found = np.array([hypergeometric(rng, good, bad, drawn) for _ in range(4000)])
    p = good / (good + bad)
    mean, spread = drawn * p, (drawn * p * (1 - p) * (good + bad - drawn) / (good + bad - 1)) ** 0.5
    assert abs(found.mean() - mean) < 4 * spread / 4000**0.5 and abs(found.std() / spread - 1) < 0.05


def test_small_large_draws_follow_the_exact_distribution():
    rng, n = np.random.default_rng(2), 20_000
    found = Counter(hypergeometric(rng, 5, 10**9, 4 * 10**8) for _ in range(n))
    for k in range(6):  # as good as binomial
        expected = [0.07776, 0.2592, 0.3456, 0.2304, 0.0768, 0.01024][k]
        assert abs(found[k] / n - expected) < 5 * (expected / n) ** 0.5


def test_the_blocks_are_not_broadcast(spark):
    _, items = made(spark)
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 1)], TARGETS)
    plan = mix(items, targets, block_tokens=50, shard_tokens=300)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
