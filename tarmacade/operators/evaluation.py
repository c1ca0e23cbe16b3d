"""Evaluation analytics: latencies, field scores, failure classes, parity of ordered results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmacade.session import cut_lineage


#: Percentiles of the latency summary, and buckets per factor e of the values: a bucket holds a
#: thousandth of relative width, so that no task sees the values of a whole group.
PERCENTS, BUCKETS = (50, 75, 90, 95, 99), 1000


def latency_summary(frame: DataFrame, groups: list[str], value: Column) -> DataFrame:
    """(groups, n, mean, p50, p75, p90, p95, p99, max): nearest-rank percentiles of valid values.

    Null, NaN and negative values are no measurements; groups have no nulls. Exact: values are
    counted, counts of narrow buckets tell in which bucket each rank lies, and only the values of
    those buckets are put in order. A group that holds a third of all rows is spread by value.
    """
    rows = frame.select(*groups, value.cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v") & (F.col("v") >= 0))
    bucket = F.when(F.col("v") > 0, F.floor(F.log("v") * BUCKETS).cast("int")).otherwise(-(2**31))
    counted = cut_lineage(rows.groupBy(*groups, "v").agg(F.count(F.lit(1)).alias("w")).withColumn("bucket", bucket.cast("int")))
    sums = counted.groupBy(*groups, "bucket").agg(F.sum("w").alias("w"))
    order = Window.partitionBy(*groups).orderBy("bucket")
    placed = sums.withColumns({"upto": F.sum("w").over(order), "n": F.sum("w").over(Window.partitionBy(*groups))})
    percent = F.explode(F.array(*map(F.lit, PERCENTS)))
    ranks = placed.select(*groups, "bucket", "w", "upto", "n", percent.alias("p")).withColumn("rank", F.expr("(n * p + 99) div 100"))
    wanted = ranks.where("rank <= upto and rank > upto - w")
    wanted = wanted.groupBy(*groups, "bucket").agg(F.max(F.col("upto") - F.col("w")).alias("before"), F.collect_list(F.struct("p", "rank")).alias("ranks"))
    inside = counted.join(wanted, [*groups, "bucket"])
    upto = F.col("before") + F.sum("w").over(Window.partitionBy(*groups, "bucket").orderBy("v"))
    hits = inside.withColumn("upto", upto).withColumn("r", F.explode("ranks")).where("r.rank <= upto and r.rank > upto - w")
    picked = hits.groupBy(*groups).agg(*[F.max(F.when(F.col("r.p") == p, F.col("v"))).alias(f"p{p}") for p in PERCENTS])
    whole = counted.groupBy(*groups).agg(F.sum("w").alias("n"), F.round(F.sum(F.col("v") * F.col("w")) / F.sum("w"), 6).alias("mean"), F.max("v").alias("max"))
    return whole.join(picked, groups).select(*groups, "n", "mean", *[f"p{p}" for p in PERCENTS], "max")


def phase_totals(frame: DataFrame, key: str, phases: dict[str, str]) -> DataFrame:
    """(key, one column per phase): the milliseconds of each phase summed per key, negatives left out."""
    total = lambda c: F.sum(F.when(F.col(c) >= 0, F.col(c).cast("long")).otherwise(0))
    return frame.groupBy(key).agg(*[total(c).alias(name) for name, c in phases.items()])


def failure_classes(frame: DataFrame, group: str, classes: list[tuple[str, Column]]) -> DataFrame:
    """(group, cases, one count per class, other): the first class whose condition holds counts."""
    kind = F.lit(None).cast("string")
    for name, condition in reversed(classes):
        kind = F.when(condition, F.lit(name)).otherwise(kind)
    counted = frame.select(group, F.coalesce(kind, F.lit("other")).alias("kind"))
    names = [*dict.fromkeys(name for name, _ in classes), "other"]
    return counted.groupBy(group).agg(F.count(F.lit(1)).alias("cases"), *[F.count_if(F.col("kind") == n).alias(n) for n in names])


def field_scores(pairs: DataFrame, fields: list[str], groups: list[str]) -> DataFrame:
    """(groups, tp, fp, fn, precision, recall, f1): arrays `expected_<f>` and `actual_<f>` compared as sets.

    Absent arrays are empty. Precision and recall are 1 where there was nothing to get wrong.
    """
    item = lambda c: F.array_distinct(F.coalesce(c, F.array().cast("array<string>")))
    e, a = ({f: item(F.col(f"{side}_{f}")) for f in fields} for side in ("expected", "actual"))
    sums = {
        "tp": sum((F.size(F.array_intersect(e[f], a[f])) for f in fields), F.lit(0)),
        "fp": sum((F.size(F.array_except(a[f], e[f])) for f in fields), F.lit(0)),
        "fn": sum((F.size(F.array_except(e[f], a[f])) for f in fields), F.lit(0)),
    }
    counted = pairs.groupBy(*groups).agg(*[F.sum(c.cast("long")).alias(n) for n, c in sums.items()])
    ratio = lambda x: F.when(F.col("tp") + F.col(x) == 0, 1.0).otherwise(F.col("tp") / (F.col("tp") + F.col(x)))
    scored = counted.withColumns({"precision": ratio("fp"), "recall": ratio("fn")})
    p, r = F.col("precision"), F.col("recall")
    return scored.withColumn("f1", F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)))


def parity(left: DataFrame, right: DataFrame) -> DataFrame:
    """(case_id, verdict): two results per case as arrays `ids`, compared in order.

    EXACT, UNDEFINED_ORDERING (the same items in another order), MISMATCH, or the side MISSING.
    """
    both = left.select("case_id", F.col("ids").alias("l")).join(right.select("case_id", F.col("ids").alias("r")), "case_id", "full_outer")
    same_items = F.array_sort("l") == F.array_sort("r")
    verdict = (
        F.when(F.col("l").isNull(), "MISSING_LEFT").when(F.col("r").isNull(), "MISSING_RIGHT")
        .when(F.col("l") == F.col("r"), "EXACT").when(same_items, "UNDEFINED_ORDERING").otherwise("MISMATCH")
    )
    return both.select("case_id", verdict.alias("verdict"))


def page_overlaps(pages: DataFrame) -> DataFrame:
    """(group, id, times): ids that come more than once over the pages (group, page, ids) of a group."""
    items = pages.select("group", F.explode("ids").alias("id"))
    return items.groupBy("group", "id").agg(F.count(F.lit(1)).alias("times")).where("times > 1")


def query_scores(pairs: DataFrame, fields: list[str], text: Column) -> DataFrame:
    """The pairs with how well `actual_<f>` meets `expected_<f>` (arrays) over all fields, and `text` grounds the rest.

    Adds tp, fp, fn; `extra` (values not expected, but said in the text), `hallucinated` (not even
    said), `misplaced` (expected in another field), `complete` (no field with several expected
    values lacks one) and `exact`. Values are compared stripped and in lower case; absent arrays
    are empty.
    """
    item = lambda c: F.array_distinct(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))))
    e, a = ({f: item(F.col(f"{side}_{f}")) for f in fields} for side in ("expected", "actual"))
    said = F.lower(F.coalesce(text, F.lit("")))
    grounded = lambda v: F.contains(said, v) | F.exists(F.split(v, " +"), lambda w: (w != "") & F.contains(said, w))
    none = F.array().cast("array<string>")
    beyond = F.flatten(F.array(*[F.array_except(a[f], e[f]) for f in fields]))
    elsewhere = {f: F.array_distinct(F.flatten(F.array(none, *[e[g] for g in fields if g != f]))) for f in fields}
    count = lambda parts: sum((F.size(p) for p in parts), F.lit(0))
    scored = pairs.withColumns({
        "tp": count(F.array_intersect(e[f], a[f]) for f in fields), "fp": count(F.array_except(a[f], e[f]) for f in fields), "fn": count(F.array_except(e[f], a[f]) for f in fields),
        "extra": F.size(F.filter(beyond, grounded)), "hallucinated": F.size(F.filter(beyond, lambda v: ~grounded(v))),
        "misplaced": count(F.array_intersect(F.array_except(a[f], e[f]), elsewhere[f]) for f in fields),
        "complete": sum((F.when((F.size(e[f]) > 1) & (F.size(F.array_except(e[f], a[f])) > 0), 1).otherwise(0) for f in fields), F.lit(0)) == 0,
    })
    return scored.withColumn("exact", (F.col("fp") == 0) & (F.col("fn") == 0))


def system_outcomes(turns: DataFrame) -> DataFrame:
    """The turns (expected, clarified, total, resolved_all, ran) with `correct`, `success` and `false_confident`.

    `expected` is RESOLVED, CLARIFY or NO_MATCH. Answering with rows where a question or nothing
    was due, without the entities that were meant, is false confidence.
    """
    asks, none = F.col("expected") == "CLARIFY", F.col("expected") == "NO_MATCH"
    empty = ~F.col("clarified") & (F.col("total") == 0)
    confident = (asks | none) & ~F.col("clarified") & (F.col("total") > 0) & ~F.col("resolved_all")
    return turns.withColumns({
        "correct": F.when(asks, F.col("clarified")).when(none, empty).otherwise(~F.col("clarified") & F.col("resolved_all")),
        "success": F.when(asks, F.col("clarified")).when(none, empty).otherwise(F.col("ran") & ~confident),
        "false_confident": confident,
    })


def conditional_rates(rows: DataFrame, groups: list[str], success: Column, conditions: dict[str, Column]) -> DataFrame:
    """(groups, cases, n_<c>, p_<c>): how often rows succeed given each condition; 0 where it never holds."""
    held = {n: F.coalesce(c, F.lit(False)) for n, c in conditions.items()}
    counts = [x for n, c in held.items() for x in (F.count_if(c).alias(f"n_{n}"), F.coalesce(F.avg(F.when(c, success.cast("double"))), F.lit(0.0)).alias(f"p_{n}"))]
    return rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("cases"), *counts)


def case_counts(cases: DataFrame, dimensions: list[str]) -> DataFrame:
    """(dimension, value, cases): how many cases have each value of each dimension, in one pass."""
    pair = lambda d: F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("none")).alias("value"))
    return cases.select(F.explode(F.array(*map(pair, dimensions))).alias("x")).groupBy("x.dimension", "x.value").agg(F.count(F.lit(1)).alias("cases"))


def duplicates(cases: DataFrame, key: Column) -> DataFrame:
    """(key, times): keys that come more than once."""
    return cases.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("times")).where("key is not null and times > 1")


def entity_preservation(transcript: Column, entities: Column) -> Column:
    """The share of entity names (normalised) that a normalised transcript still has; 1 without any, 0 without a transcript."""
    kept = F.size(F.filter(entities, lambda e: F.contains(transcript, e)))
    return F.when(transcript.isNull(), 0.0).when(F.size(entities) <= 0, 1.0).otherwise(kept / F.size(entities))


# Milliseconds that an answer from afar is waited for, and after which it is given up.
ONLINE_BUDGET_MS, ONLINE_CEILING_MS = 4_000, 35_000


def answer_stage(online_ms: Column, online_ok: Column, local: Column) -> Column:
    """Which of two answers is shown: `online` within its budget, else `local` if there is one (`local_offered`
    if the late one is then offered, never applied), else `online_late`, else `unavailable`."""
    ok = F.coalesce(online_ok, F.lit(False))
    late = ok & (online_ms <= ONLINE_CEILING_MS)
    return (
        F.when(ok & (online_ms <= ONLINE_BUDGET_MS), "online").when(local & late, "local_offered").when(local, "local").when(late, "online_late").otherwise("unavailable")
    )
