"""The queries of this package by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmacade.functions.clean import language_code, present, source_name, stripped
from tarmacade.functions.countries import country_code
from tarmacade.llm.linking import link
from tarmacade.llm.mixture import mix, share_report
from tarmacade.llm.names import Nicknames
from tarmacade.llm.packing import fill_report, pack
from tarmacade.llm.percentiles import counted, daily_sketch, multi_select, sketch_values, wide
from tarmacade.llm.quality import COLUMNS, quality
from tarmacade.llm.tokens import sized
from tarmacade.llm.topn import top_n
from tarmacade.operators.orphans import latest_rows
from tarmacade.session import cut_lineage, merged
from tarmacade.sources.tables import table

# --- 1: percentiles of latencies

PERCENTILES = {"p50": 500, "p90": 900, "p95": 950, "p99": 990}
SLOWEST_MS = 3_600_000  # beyond an hour a latency is a sentinel or a broken clock
SKETCH_ERROR = 0.01


def latencies(spark: SparkSession, sf: str, whole: bool = False) -> DataFrame:
    """(period, language, metric, value, w): how often each valid latency occurs on each day,
    and, if the whole is wanted too, on all days together (period `all`).

    A run delivered repeatedly counts once, as delivered last. Its language is the primary
    subtag of `language`, else of `locale`, else `und`. Null, NaN, negative and latencies over
    SLOWEST_MS are no measurements.
    """
    runs = latest_rows(
        table(spark, sf, "voice_results"), F.col("result_id"), F.col("ingested_at"),
        language=F.coalesce(language_code("language"), language_code("locale"), F.lit("und")),
        period=F.coalesce(F.date_format("run_at", "yyyy-MM-dd"), F.lit("unknown")),
        total=F.col("total_latency_ms"), stt=F.col("stt_latency_ms").cast("double"),
    )
    metric = F.array(
        F.struct(F.lit("total_latency_ms").alias("metric"), F.col("total").alias("value")),
        F.struct(F.lit("stt_latency_ms").alias("metric"), F.col("stt").alias("value")),
    )
    long = runs.select("period", "language", F.explode(metric).alias("m")).select("period", "language", "m.metric", "m.value")
    long = long.where(F.col("value").between(0, SLOWEST_MS))
    if whole:
        long = long.withColumn("period", F.explode(F.array("period", F.lit("all"))))
    return counted(long, ["period", "language", "metric"])


def p1_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Exact percentiles per day and language, and per language over all days (period `all`)."""
    groups = ["period", "language", "metric"]
    found = multi_select(latencies(spark, sf, whole=True), groups, [*PERCENTILES.values()])
    return wide(found, groups, PERCENTILES, 0)


def percentiles_by_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """The percentiles per language over all days, selected in rounds down to ranges of 200 values.

    The result is that of any other limit; with this one small inputs go through the rounds too.
    """
    groups = ["language", "metric"]
    values = latencies(spark, sf).groupBy(*groups, "value").agg(F.sum("w").alias("w"))
    return wide(multi_select(values, groups, [*PERCENTILES.values()], small=200), groups, PERCENTILES, 0)


def p1_daily_sketches(spark: SparkSession, sf: str) -> DataFrame:
    """The mergeable summaries of each day: counts of logarithmic buckets."""
    return daily_sketch(latencies(spark, sf), ["period", "language", "metric"], SKETCH_ERROR)


def p1_combined_sketches(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles per language from the sum of the days' sketches, within SKETCH_ERROR."""
    groups = ["language", "metric"]
    values = sketch_values(p1_daily_sketches(spark, sf), groups, SKETCH_ERROR)
    found = wide(multi_select(values, groups, [*PERCENTILES.values()]), groups, PERCENTILES, SKETCH_ERROR)
    return found.select(*groups, "n", *[F.round(p, 6).alias(p) for p in PERCENTILES], "error_bound")


# --- 4: the best of each rally

BEST = 5


def _classified(spark: SparkSession, sf: str) -> DataFrame:
    held = latest_rows(
        table(spark, sf, "final_results"), F.col("id"), F.col("loaded_at"),
        event_id=stripped("event_id"), pos_overall=F.col("pos_overall"),
    ).where("event_id is not null and pos_overall >= 1")
    return cut_lineage(held)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return top_n(_classified(spark, sf), "event_id", "pos_overall", "id", BEST).select("event_id", "rnk", "id")


def top_n_split(spark: SparkSession, sf: str) -> DataFrame:
    """The same, with every rally of more than 100 results split as a heavy one; the result is the same."""
    return top_n(_classified(spark, sf), "event_id", "pos_overall", "id", BEST, hot=100).select("event_id", "rnk", "id")


# --- 5: spellings of names


def name_records(spark: SparkSession, sf: str) -> DataFrame:
    """(key, name, country, typed): every name of every people record and hand-typed entry.

    All deliveries of a record contribute names; its country is that of the row that holds, or
    else any that was delivered.
    """
    people = table(spark, sf, "people").withColumn("key", present("person_id")).where("key is not null")
    known = people.select("key", F.struct("loaded_at", country_code("country").alias("code")).alias("c"))
    countries = known.where("c.code is not null").groupBy("key").agg(F.max("c").alias("c")).select("key", F.col("c.code").alias("country"))
    names = people.select("key", F.explode(F.concat(F.array("display_name"), F.coalesce("searchable_names", F.array()))).alias("name"))
    records = merged(names, countries, "key", "left").select("key", "name", "country", F.lit(False).alias("typed"))
    entries = table(spark, sf, "participation").where(present("person_id").isNull() & F.col("row_id").isNotNull())
    return records.unionByName(
        entries.select(F.concat(F.lit("entry:"), "row_id").alias("key"), F.col("driver_name").alias("name"), F.lit(None).cast("string").alias("country"), F.lit(True).alias("typed"))
    )


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    short = table(spark, sf, "given_names").select("full_form", "short_form")
    nicknames = Nicknames([(r[0], r[1]) for r in short.collect()])  # a fixed table of short forms
    return link(name_records(spark, sf), nicknames)


# --- 6: containers of texts


def p6_packed(spark: SparkSession, sf: str) -> DataFrame:
    """The container of every text, or piece of a text, for every capacity, and its fill."""
    return pack(sized(table(spark, sf, "documents")), table(spark, sf, "pack_sizes"))


def p6_fill(spark: SparkSession, sf: str) -> DataFrame:
    """How many containers of each kind there are and how full they are."""
    return fill_report(p6_packed(spark, sf))


# --- 7: the mixture of sources


def _targets(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "mix_targets").withColumn("source", source_name("source"))


def p7_mixture(spark: SparkSession, sf: str) -> DataFrame:
    """The texts drawn, one row per use, in the order of their shards."""
    documents = table(spark, sf, "documents").withColumn("source", source_name("source"))
    return mix(sized(documents, "source"), _targets(spark, sf))


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    """What each source was to contribute and what it does."""
    return share_report(p7_mixture(spark, sf), _targets(spark, sf))


# --- 8: text quality


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return quality(table(spark, sf, "documents")).where(F.col("form").isin("list", "table", "junk")).select("doc_id", "form")


def p8_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """All statistics of every text, with the reason of each rule that it fails."""
    return quality(table(spark, sf, "documents")).select("doc_id", *COLUMNS)


QUERIES = {
    "p1_percentiles": p1_percentiles,
    "percentiles_by_rounds": percentiles_by_rounds,
    "p1_daily_sketches": p1_daily_sketches,
    "p1_combined_sketches": p1_combined_sketches,
    "p4_found": p4_found,
    "top_n_split": top_n_split,
    "p5_found": p5_found,
    "p6_packed": p6_packed,
    "p6_fill": p6_fill,
    "p7_mixture": p7_mixture,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_statistics": p8_statistics,
}

_CODE = "nullif(lower(regexp_extract({0}, '^\\s*([A-Za-z]+)', 1)), '')"
_LATENCIES = f"""WITH runs AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY result_id ORDER BY ingested_at DESC) AS k FROM voice_results) WHERE k = 1),
long AS (
  SELECT coalesce(strftime(run_at, '%Y-%m-%d'), 'unknown') AS period,
         coalesce(CASE WHEN lower(trim(language)) NOT IN ('null', 'none') THEN {_CODE.format('language')} END, {_CODE.format('locale')}, 'und') AS language,
         metric, value
  FROM (SELECT run_at, language, locale, 'total_latency_ms' AS metric, total_latency_ms AS value FROM runs
        UNION ALL SELECT run_at, language, locale, 'stt_latency_ms', CAST(stt_latency_ms AS DOUBLE) FROM runs)
  WHERE value BETWEEN 0 AND {SLOWEST_MS} AND NOT isnan(value)),
sketch AS (
  SELECT period, language, metric, CASE WHEN value > 0 THEN CAST(ceil(ln(value) / ln({1 + SKETCH_ERROR} / {1 - SKETCH_ERROR})) AS INT) ELSE -1000000 END AS bucket, count(*) AS w
  FROM long GROUP BY ALL)"""


def _picked(groups: str, error: float) -> str:
    picks = ", ".join(f"max(CASE WHEN k = (n * {p} + 999) // 1000 THEN value END) AS {name}" for name, p in PERCENTILES.items())
    return f"SELECT {groups}, max(n) AS n, {picks}, CAST({error} AS DOUBLE) AS error_bound FROM ranked GROUP BY {groups}"


_BASE = f"({1 + SKETCH_ERROR} / {1 - SKETCH_ERROR})"

SQL = {
    "p1_percentiles": f"""{_LATENCIES}, both_ AS (SELECT * FROM long UNION ALL SELECT 'all', language, metric, value FROM long),
ranked AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY period, language, metric) AS n FROM both_
  WINDOW w AS (PARTITION BY period, language, metric ORDER BY value)) {_picked('period, language, metric', 0)}""",
    "percentiles_by_rounds": f"""{_LATENCIES}, ranked AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY language, metric) AS n FROM long
  WINDOW w AS (PARTITION BY language, metric ORDER BY value)) {_picked('language, metric', 0)}""",
    "p1_daily_sketches": f"{_LATENCIES} SELECT * FROM sketch",
    "p1_combined_sketches": f"""{_LATENCIES}, unpacked AS (
  SELECT language, metric, CASE WHEN bucket > -1000000 THEN round(pow({_BASE}, bucket) * (2 / ({_BASE} + 1)), 6) ELSE 0 END AS value, unnest(range(w)) AS i
  FROM (SELECT language, metric, bucket, CAST(sum(w) AS BIGINT) AS w FROM sketch GROUP BY ALL)),
ranked AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY language, metric) AS n FROM unpacked
  WINDOW w AS (PARTITION BY language, metric ORDER BY value)) {_picked('language, metric', SKETCH_ERROR)}""",
    "p4_found": f"""SELECT event_id, CAST(rnk AS INT) AS rnk, id FROM (
  SELECT trim(event_id) AS event_id, id, row_number() OVER (PARTITION BY trim(event_id) ORDER BY pos_overall, id) AS rnk
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) AS k FROM final_results)
  WHERE k = 1 AND event_id IS NOT NULL AND pos_overall >= 1) WHERE rnk <= {BEST}""",
}
SQL["top_n_split"] = SQL["p4_found"]
