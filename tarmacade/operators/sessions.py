"""Turns of sessions: values carried forward, changes, and answers that came too late."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def carried(turns: DataFrame, session: str, order: list[str], columns: list[str]) -> DataFrame:
    """The turns with `active_<c>`: the last known value of each column up to the turn."""
    so_far = Window.partitionBy(session).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumns({f"active_{c}": F.last(c, ignorenulls=True).over(so_far) for c in columns})


def inherited(turns: DataFrame, session: str, order: list[str], columns: list[str]) -> DataFrame:
    """The turns with `inherited` and `refined`: the columns whose value is that of the turn before, or another."""
    before = Window.partitionBy(session).orderBy(*order)
    pick = lambda test: F.filter(F.array(*[F.when(test(F.col(c), F.lag(c).over(before)), F.lit(c)) for c in columns]), lambda x: x.isNotNull())
    first = F.row_number().over(before) == 1
    same = pick(lambda now, was: now.isNotNull() & now.eqNullSafe(was))
    other = pick(lambda now, was: now.isNotNull() & ~now.eqNullSafe(was))
    none = F.array().cast("array<string>")
    return turns.withColumns({"inherited": F.when(first, none).otherwise(same), "refined": F.when(first, none).otherwise(other)})


def stale(answers: DataFrame, session: str, order: list[str], generation: str) -> DataFrame:
    """The answers with `stale`: whether a later generation had been answered before them."""
    earlier = Window.partitionBy(session).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return answers.withColumn("stale", F.coalesce(F.max(generation).over(earlier) > F.col(generation), F.lit(False)))
