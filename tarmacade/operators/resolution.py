"""Resolving mentions in batch: composite scores, editions of rallies, cities, recoveries.

Every step takes and returns frames of all mentions at once; nothing is looked up per mention.
Ranked candidates are (mention_id, entity_id, name, score, base_score), decisions
(mention_id, strategy, entity_id, confidence, options).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarmacade.functions import text as T
from tarmacade.functions.composite import IN_CONTEXT, composited, formed
from tarmacade.operators.entities import ACCEPT, GAP
from tarmacade.session import merged, spread

# Confidence of a question asked before any score, plausible rallies for a city, options shown.
ASKED, PLAUSIBLE_RALLY, SHOWN = 0.5, 0.60, 5
# How many of the best found entities a lookup of each type returns.
LOOKED_UP = {"rally": 35, "stage": 35, "person": 50}


def looked_up(mentions: DataFrame, scored: DataFrame) -> DataFrame:
    """(mention_id, entity_id): what a lookup returns, the best scored of the whole pool; ties by name and id."""
    limit = F.lit(25)
    for kind, n in LOOKED_UP.items():
        limit = F.when(F.col("entity_type") == kind, F.lit(n)).otherwise(limit)
    order = Window.partitionBy("mention_id").orderBy(F.desc("score"), "name", "entity_id")
    ranked = scored.select("mention_id", "entity_id", F.row_number().over(order).alias("k"))
    return ranked.join(mentions.select("mention_id", limit.alias("most")), "mention_id").where("k <= most").select("mention_id", "entity_id")


def rescored(mentions: DataFrame, entities: DataFrame, pool: DataFrame, in_context: DataFrame | None = None) -> DataFrame:
    """(mention_id, entity_id, name, score, base_score): the pool by the composite score, best name first.

    `in_context` (mention_id, entity_id) are pairs whose score is raised by IN_CONTEXT. Forms are
    computed once per distinct mention and name, and a name is scored once, however many entities have it.
    """
    asked = formed(mentions.select("mention_id", (F.col("entity_type") == "person").alias("person"), "mention"), "mention", "q").drop("mention")
    named = entities.where(F.trim("name") != "").select("entity_id", "name").distinct()
    met = pool.select("mention_id", "entity_id").join(named, "entity_id")
    pairs = spread(met.select("mention_id", "name").distinct()).join(asked, "mention_id").join(formed(named.select("name").distinct(), "name", "c"), "name")
    base = composited(pairs, F.col("person"), "base_score").select("mention_id", "name", "base_score")
    best = merged(met, base, ["mention_id", "name"]).groupBy("mention_id", "entity_id").agg(F.min(F.struct((-F.col("base_score")).alias("order"), "name")).alias("r"))
    best = best.select("mention_id", "entity_id", "r.name", (-F.col("r.order")).alias("base_score"))
    if in_context is None:
        return best.withColumn("score", F.col("base_score"))
    near = in_context.select("mention_id", "entity_id").distinct().withColumn("near", F.lit(True))
    raised = F.when(F.col("near"), F.round(F.least(F.lit(1.0), F.col("base_score") + IN_CONTEXT), 3)).otherwise(F.col("base_score"))
    return best.join(near, ["mention_id", "entity_id"], "left").withColumn("score", raised).drop("near")


def of_edition(mentions: DataFrame, ranked: DataFrame, years: DataFrame) -> DataFrame:
    """The candidates of the edition that a mention names, all of them where it names none that exists.

    The year is the mention's `year` or, without one, the year in its text; `years` is
    (entity_id, year). A year that no candidate has is ignored rather than emptying the pool.
    """
    wanted = mentions.select("mention_id", F.coalesce("year", T.extract_year(F.col("mention"))).alias("wanted"))
    dated = ranked.join(wanted, "mention_id").join(years.select("entity_id", F.col("year").alias("held")).distinct(), "entity_id", "left")
    fits = F.coalesce(F.col("held") == F.col("wanted"), F.lit(False))
    found = F.max(fits).over(Window.partitionBy("mention_id"))
    return dated.withColumns({"fits": fits, "found": found}).where("fits or not found").drop("wanted", "held", "fits", "found")


def editions_asked(mentions: DataFrame, ranked: DataFrame, decided: DataFrame) -> DataFrame:
    """The decisions, where a rally without a year whose two best are editions of one name asks for the year.

    Searches for videos (`video` of the mention) take all editions and ask nothing.
    """
    order = Window.partitionBy("mention_id").orderBy(F.desc("score"), F.col("name"), F.col("entity_id"))
    top = ranked.withColumn("k", F.row_number().over(order)).where(F.col("k") <= SHOWN)
    shown = top.groupBy("mention_id").agg(
        F.max(F.when(F.col("k") == 1, T.strip_year(F.col("name")))).alias("first"), F.max(F.when(F.col("k") == 2, T.strip_year(F.col("name")))).alias("second"),
        F.transform(F.array_sort(F.collect_list(F.struct("k", "entity_id"))), lambda o: o["entity_id"]).alias("editions"),
    )
    undated = mentions.where(F.coalesce("year", T.extract_year(F.col("mention"))).isNull() & ~F.coalesce("video", F.lit(False)) & (F.col("entity_type") == "rally"))
    asks = shown.where("first = second").join(undated.select("mention_id"), "mention_id", "left_semi").select("mention_id", "editions")
    joined = decided.join(asks, "mention_id", "left")
    open_ = F.col("editions").isNotNull()
    return joined.select(
        "mention_id", F.when(open_, "multi_year_ambiguity").otherwise(F.col("strategy")).alias("strategy"), F.when(~open_, F.col("entity_id")).alias("entity_id"),
        F.when(open_, F.lit(ASKED)).otherwise(F.col("confidence")).alias("confidence"), F.coalesce("editions", "options").alias("options"),
    )


def cities(mentions: DataFrame, rallies: DataFrame, ranked: DataFrame) -> DataFrame:
    """(mention_id, strategy, city, rally_id, confidence): what mentions of cities mean.

    `rallies` is (entity_id, city), `ranked` the rallies that the index found for the same
    mentions. A text that is a city and also finds a rally asks which is meant; a city alone
    resolves; a rally alone resolves if it is clear, is offered from PLAUSIBLE_RALLY on, and
    otherwise there is nothing.
    """
    key = lambda c: T.normalize(F.col(c))
    known = rallies.where(F.trim("city") != "").groupBy(key("city").alias("key")).agg(F.min("city").alias("city"))
    asked = mentions.select("mention_id", key("mention").alias("key")).join(known, "key", "left").drop("key")
    order = Window.partitionBy("mention_id").orderBy(F.desc("score"), F.col("name"), F.col("entity_id"))
    best = ranked.withColumns({"k": F.row_number().over(order), "second": F.lead("score").over(order)}).where("k = 1").select("mention_id", F.col("entity_id").alias("rally_id"), "score", "second")
    joined = asked.join(best, "mention_id", "left")
    clear = (F.col("score") >= ACCEPT) & (F.col("second").isNull() | (F.col("score") - F.col("second") >= GAP))
    plausible = F.coalesce(F.col("score") >= PLAUSIBLE_RALLY, F.lit(False))
    strategy = (
        F.when(F.col("city").isNotNull() & plausible, "location_vs_event_ambiguity").when(F.col("city").isNotNull(), "unique_match")
        .when(clear, "clear_winner").when(plausible, "plausible_candidates").otherwise("none")
    )
    decided = joined.withColumn("strategy", strategy)
    confidence = F.when(F.col("strategy") == "location_vs_event_ambiguity", F.lit(ASKED)).when(F.col("strategy") == "unique_match", 1.0).when(F.col("strategy") == "none", 0.0).otherwise(F.col("score"))
    return decided.select("mention_id", "strategy", "city", F.when(F.col("strategy").isin("clear_winner", "plausible_candidates", "location_vs_event_ambiguity"), F.col("rally_id")).alias("rally_id"), F.round(confidence, 6).alias("confidence"))


def recovered(phrases: DataFrame, as_rally: DataFrame, as_person: DataFrame) -> DataFrame:
    """(mention_id, intent, entity_type, entity_id): rally phrases that are really a person.

    `phrases` is (mention_id, intent, may_recover, has_driver); the others are decisions. A phrase
    becomes a person only if its intent allows it, no driver is named, it resolved to no rally
    nor offers one of at least ACCEPT, and the person resolves at ACCEPT or more. A search for
    rallies then looks for the person's rallies.
    """
    rally = as_rally.select("mention_id", F.col("entity_id").alias("rally_id"), F.col("confidence").alias("rally_score"), (F.size("options") > 0).alias("asks"))
    person = as_person.select("mention_id", F.col("entity_id").alias("person_id"), F.col("confidence").alias("person_score"))
    joined = phrases.join(rally, "mention_id", "left").join(person, "mention_id", "left")
    strong = F.coalesce(F.col("asks") & (F.col("rally_score") >= ACCEPT), F.lit(False))
    turns = F.col("may_recover") & ~F.col("has_driver") & F.col("rally_id").isNull() & ~strong & F.coalesce(F.col("person_id").isNotNull() & (F.col("person_score") >= ACCEPT), F.lit(False))
    return joined.select(
        "mention_id", F.when(turns & (F.col("intent") == "SEARCH_RALLIES"), "SEARCH_DRIVER_RALLIES").otherwise(F.col("intent")).alias("intent"),
        F.when(turns, "person").when(F.col("rally_id").isNotNull(), "rally").alias("entity_type"), F.when(turns, F.col("person_id")).otherwise(F.col("rally_id")).alias("entity_id"),
    )


def useful(decided: DataFrame) -> DataFrame:
    """The decisions with `useful`: whether they resolve or ask for a choice."""
    return decided.withColumn("useful", F.col("entity_id").isNotNull() | (F.size("options") > 0))


def fallback(first: DataFrame, second: DataFrame, mode: str = "FALLBACK", voice: bool = False) -> DataFrame:
    """(mention_id, strategy, entity_id, confidence, options, origin): two resolvers of the same mentions in turn.

    OFF and SHADOW keep the first one's decision. FALLBACK takes the second's where the first
    resolved nothing and the second is of use. By `voice` a second decision is never applied
    but offered. `origin` is first, second or both (both resolve alike).
    """
    if mode not in ("OFF", "SHADOW", "FALLBACK"):
        raise ValueError(f"no such mode: {mode}")
    columns = ("strategy", "entity_id", "confidence", "options")
    a = useful(first).select("mention_id", F.struct(*columns, "useful").alias("a"))
    b = useful(second).select("mention_id", F.struct(*columns, "useful").alias("b"))
    joined = a.join(b, "mention_id", "left")
    take = F.lit(mode == "FALLBACK") & F.col("a.entity_id").isNull() & F.coalesce(F.col("b.useful"), F.lit(False))
    offers = take & F.lit(voice) & F.col("b.entity_id").isNotNull()
    origin = F.when(take, "second").when(F.coalesce(F.col("a.entity_id") == F.col("b.entity_id"), F.lit(False)), "both").otherwise("first")
    return joined.select(
        "mention_id", F.when(offers, "voice_clarification").when(take, F.col("b.strategy")).otherwise(F.col("a.strategy")).alias("strategy"),
        F.when(offers, None).when(take, F.col("b.entity_id")).otherwise(F.col("a.entity_id")).alias("entity_id"),
        F.when(take, F.col("b.confidence")).otherwise(F.col("a.confidence")).alias("confidence"),
        F.when(offers, F.array("b.entity_id")).when(take, F.col("b.options")).otherwise(F.col("a.options")).alias("options"), origin.alias("origin"),
    )


def outcome_counts(decided: DataFrame, *groups: str) -> DataFrame:
    """(groups, strategy, n, resolved, asked): how often each outcome came."""
    return decided.groupBy(*groups, "strategy").agg(F.count(F.lit(1)).alias("n"), F.count("entity_id").alias("resolved"), F.count_if(F.size("options") > 0).alias("asked"))


def eligible(people: DataFrame, role: str) -> DataFrame:
    """The people (driver_id, codriver_id) that can be meant in a role: DRIVER, CO_DRIVER or ANY."""
    has = {"DRIVER": F.col("driver_id").isNotNull(), "CO_DRIVER": F.col("codriver_id").isNotNull()}
    return people.where(has.get(role, F.col("driver_id").isNotNull() | F.col("codriver_id").isNotNull()))


def origins(by_sql: DataFrame, by_index: DataFrame) -> DataFrame:
    """(mention_id, entity_id, origin): candidates of two sources, `both` where both have them."""
    left = by_sql.select("mention_id", "entity_id").distinct().withColumn("s", F.lit(True))
    right = by_index.select("mention_id", "entity_id").distinct().withColumn("i", F.lit(True))
    joined = left.join(right, ["mention_id", "entity_id"], "full_outer")
    return joined.select("mention_id", "entity_id", F.when(F.col("s") & F.col("i"), "both").when(F.col("s"), "sql").otherwise("index").alias("origin"))
