"""Text kernels, entity search, evaluation and sessions as queries, and the same in SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmacade.functions import kernels
from tarmacade.functions import text as T
from tarmacade.functions.clean import language_code, leading_number, present, stripped
from tarmacade.functions.countries import CODES_SQL, country_code
from tarmacade.integrity import ORDER_SQL, given
from tarmacade.operators import entities as R
from tarmacade.operators import evaluation as V
from tarmacade.operators import sessions as S
from tarmacade.operators.best import best_scored
from tarmacade.operators.orphans import latest_rows
from tarmacade.operators.strategies import seconds
from tarmacade.session import cut_lineage, spread
from tarmacade.sources.tables import table


def _names(spark: SparkSession, sf: str) -> DataFrame:
    """The distinct rally names ever delivered."""
    return table(spark, sf, "rallies").select(F.col("event_name").alias("name")).where("name is not null").distinct()


def ngrams_explode(spark: SparkSession, sf: str) -> DataFrame:
    """How many rally names have each trigram of their collapsed form."""
    return _names(spark, sf).select(F.explode(T.grams(T.collapse(F.col("name")), 3)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("names"))


def gram_anchors(spark: SparkSession, sf: str) -> DataFrame:
    """The anchor grams of every rally name: the first five and the last."""
    return _names(spark, sf).select("name", F.array_join(T.gram_anchors(F.col("name")), ",").alias("anchors"))


def page_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    """Drivers that stand on several pages, or several times on one, of ten results of a rally."""
    rows = table(spark, sf, "final_results").select(stripped("event_id").alias("group"), F.floor(F.col("pos_overall") / 10).alias("page"), present("driver_id").alias("id"))
    pages = rows.where("group is not null and page is not null and id is not null").groupBy("group", "page").agg(F.collect_list("id").alias("ids"))
    return V.page_overlaps(pages)


def name_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """(a, b): each rally's name and the other spellings of the same rally."""
    names = table(spark, sf, "rallies").select(stripped("event_id").alias("id"), F.col("event_name").alias("name")).where("name is not null").distinct()
    norm = names.select("id", T.normalize(F.col("name")).alias("n")).groupBy("id").agg(F.min("n").alias("a"))
    other = names.select("id", T.normalize(F.col("name")).alias("b")).distinct()
    return norm.join(other, "id").select("id", "a", "b")


def similarity_pairs(spark: SparkSession, sf: str) -> DataFrame:
    pairs = name_pairs(spark, sf)
    a, b = F.col("a"), F.col("b")
    return pairs.select(
        "id", "a", "b", F.round(T.set_dice(T.grams(a, 2), T.grams(b, 2)), 6).alias("dice"), F.round(T.jaccard(T.words(a), T.words(b)), 6).alias("jaccard"),
        F.levenshtein(a, b).alias("edits"), F.round(T.levenshtein_similarity(a, b), 6).alias("levenshtein"),
    )


def kernel_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Similarities that only kernels express."""
    pairs = name_pairs(spark, sf)
    scores = {n: F.round(kernels.pairwise(k)(F.col("a"), F.col("b")), 6).alias(n) for n, k in {"jaro_winkler": kernels.jaro_winkler, "articulatory": kernels.articulatory, "dice_multiset": lambda x, y: kernels.dice(x, y, 2), "wer": kernels.word_error_rate}.items()}
    return pairs.select("id", "a", "b", *scores.values())


def composite_score_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The composite score of every spelling of a rally's name against the others'."""
    from tarmacade.functions.composite import composited, formed

    pairs = name_pairs(spark, sf)
    of = formed(pairs.select(F.col("a").alias("n")).union(pairs.select("b")).distinct(), "n", "f")
    joined = pairs.join(of.select(F.col("n").alias("a"), F.col("f").alias("q")), "a").join(of.select(F.col("n").alias("b"), F.col("f").alias("c")), "b")
    return composited(joined, F.lit(False)).select("id", "a", "b", "score")


def entities_of(spark: SparkSession, sf: str) -> DataFrame:
    """Rallies, stages and people of the deliveries as entities, one name each."""
    people = table(spark, sf, "people").select(present("person_id").alias("entity_id"), F.lit("person").alias("entity_type"), F.col("display_name").alias("name"))
    stages = table(spark, sf, "stages").select(present("stage_id").alias("entity_id"), F.lit("stage").alias("entity_type"), F.col("stage_name").alias("name"))
    rallies = table(spark, sf, "rallies").select(stripped("event_id").alias("entity_id"), F.lit("rally").alias("entity_type"), F.col("event_name").alias("name"))
    every = people.unionByName(stages).unionByName(rallies).where("entity_id is not null and trim(name) <> ''")
    return every.groupBy("entity_type", "entity_id").agg(F.min("name").alias("name"))


def mentions_of(spark: SparkSession, sf: str) -> DataFrame:
    """The names typed by hand, once each, as mentions of people."""
    typed = table(spark, sf, "participation").where("person_id is null").select(F.trim("driver_name").alias("mention")).where("mention <> ''").distinct()
    return typed.select(F.col("mention").alias("mention_id"), F.lit("person").alias("entity_type"), "mention")


def _people(spark: SparkSession, sf: str) -> DataFrame:
    return entities_of(spark, sf).where("entity_type = 'person'")


def postings_build(spark: SparkSession, sf: str) -> DataFrame:
    """The index, counted: keys and postings per entity type and family."""
    index = R.postings(entities_of(spark, sf))
    return index.groupBy("entity_type", "family").agg(F.countDistinct("key").alias("keys"), F.count(F.lit(1)).alias("postings"))


def index_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """How large the index is per entity type."""
    return R.index_statistics(R.postings(entities_of(spark, sf)))


def candidates_ranked(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best candidates of every mention."""
    return R.candidates(mentions_of(spark, sf), R.postings(_people(spark, sf)), most=10)


def entity_resolution_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """What each mention resolves to, every candidate of its pool scored."""
    mentions, people = cut_lineage(mentions_of(spark, sf)), cut_lineage(_people(spark, sf))
    return R.decisions(mentions, best_scored(mentions, people, R.OPTIONS))


def recall_mrr(spark: SparkSession, sf: str) -> DataFrame:
    """How well the index finds people by their other recorded names, per role."""
    rows = table(spark, sf, "people").select(present("person_id").alias("entity_id"), F.coalesce("role", F.lit("none")).alias("group"), F.explode("searchable_names").alias("mention"))
    rows = rows.where("entity_id is not null and trim(mention) <> '' and lower(trim(mention)) not in ('null', 'none')").distinct()
    truth = rows.select(F.concat_ws("|", "entity_id", "mention").alias("mention_id"), "entity_id", "group", "mention").distinct()
    pool = R.candidates(truth.select("mention_id", F.lit("person").alias("entity_type"), "mention").distinct(), R.postings(_people(spark, sf)), wanted=truth.select("mention_id", "entity_id"))
    return _rounded(R.retrieval_metrics(truth, pool))


def _rounded(frame: DataFrame) -> DataFrame:
    return frame.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in frame.dtypes])


def index_coverage(spark: SparkSession, sf: str) -> DataFrame:
    every = entities_of(spark, sf)
    return R.coverage(every, R.postings(every))


def runs_of(spark: SparkSession, sf: str) -> DataFrame:
    columns = ["case_id", "language", "stt_latency_ms", "llm_parse_latency_ms", "entity_resolution_latency_ms", "db_latency_ms", "total_latency_ms", "error_message"]
    return latest_rows(table(spark, sf, "voice_results"), F.col("result_id"), F.col("ingested_at"), **{c: F.col(c) for c in columns})


def latency_summary(spark: SparkSession, sf: str) -> DataFrame:
    runs = runs_of(spark, sf).withColumn("language", F.coalesce(language_code("language"), F.lit("und")))
    return V.latency_summary(runs, ["language"], F.when(F.col("total_latency_ms") <= 3_600_000, F.col("total_latency_ms")))


def phase_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Milliseconds per phase and case; sentinels do not count."""
    phases = {"stt": "stt_latency_ms", "parse": "llm_parse_latency_ms", "resolve": "entity_resolution_latency_ms", "db": "db_latency_ms"}
    runs = runs_of(spark, sf).withColumns({c: F.when(F.col(c) < 3_600_000, F.col(c)) for c in phases.values()})
    return V.phase_totals(runs.where("case_id is not null"), "case_id", phases)


def failure_taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    has = lambda x: F.coalesce(F.contains("error_message", F.lit(x)), F.lit(False))
    classes = [("none", present("error_message").isNull()), ("speech", has("stt") | has("audio") | has("transcript")), ("database", has("db")), ("model", has("model"))]
    return V.failure_classes(runs_of(spark, sf).withColumn("language", F.coalesce(language_code("language"), F.lit("und"))), "language", classes)


def query_f1(spark: SparkSession, sf: str) -> DataFrame:
    """People records against their own other deliveries: names and countries scored as fields, per role."""
    rows = table(spark, sf, "people").where("person_id is not null")
    names = F.array(F.lower(F.trim("display_name")))
    first = rows.groupBy("person_id").agg(F.min(F.struct("loaded_at", names.alias("expected_names"), F.array(country_code("country")).alias("expected_countries"), F.coalesce("role", F.lit("none")).alias("role"))).alias("f")).select("person_id", "f.expected_names", "f.expected_countries", "f.role")
    actual = rows.select("person_id", F.transform(F.coalesce("searchable_names", F.array().cast("array<string>")), lambda n: F.lower(F.trim(n))).alias("actual_names"), F.array(country_code("country")).alias("actual_countries"))
    drop = lambda c: F.filter(c, lambda x: x.isNotNull())
    pairs = first.join(actual, "person_id").withColumns({c: drop(F.col(c)) for c in ("expected_names", "expected_countries", "actual_names", "actual_countries")})
    return _rounded(V.field_scores(pairs, ["names", "countries"], ["role"]))


def parity_report(spark: SparkSession, sf: str) -> DataFrame:
    """The first and the last snapshot's rallies per year and country code, in order, compared."""
    from tarmacade.operators.snapshot_diff import snapshot_order

    order = snapshot_order(table(spark, sf, "meta"))
    rows = table(spark, sf, "rallies").withColumns({"snapshot_id": stripped("snapshot_id"), "event_id": stripped("event_id")})
    case = F.concat_ws("/", F.coalesce(F.col("year").cast("string"), F.lit("none")), F.coalesce(country_code("country"), F.lit("none")))

    def side(condition: str) -> DataFrame:
        chosen = rows.join(order.where(condition).select("snapshot_id"), "snapshot_id", "left_semi")
        items = chosen.groupBy(case.alias("case_id"), "event_id").agg(F.max("load_ord").alias("o"))
        return items.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "event_id"))), lambda x: x["event_id"]).alias("ids"))

    return V.parity(side("n = 1"), side("next_id is null"))


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    """The event stream as turns of users: views name a rally, clicks a driver, errors are late answers."""
    kind = F.col("event_type")
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("turn"),
        (F.floor(F.col("event_id") / 10) - F.when(kind == "error", 20).otherwise(0)).cast("long").alias("generation"),
        F.when(kind == "view", F.concat(F.lit("r"), (F.col("event_id") % 50).cast("string"))).alias("rally"),
        F.when(kind == "click", F.concat(F.lit("d"), (F.col("event_id") % 30).cast("string"))).alias("driver"),
    )


def session_carried(spark: SparkSession, sf: str) -> DataFrame:
    return S.carried(_turns(spark, sf), "session", ["turn"], ["rally", "driver"]).select("session", "turn", "active_rally", "active_driver")


def inherited_fields(spark: SparkSession, sf: str) -> DataFrame:
    turns = S.inherited(_turns(spark, sf), "session", ["turn"], ["rally", "driver"])
    return turns.select("session", "turn", F.array_join("inherited", ",").alias("inherited"), F.array_join("refined", ",").alias("refined"))


def stale_generation(spark: SparkSession, sf: str) -> DataFrame:
    return S.stale(_turns(spark, sf), "session", ["turn"], "generation").groupBy("session").agg(F.count_if("stale").alias("stale"), F.count(F.lit(1)).alias("turns"))


def session_fold(spark: SparkSession, sf: str) -> DataFrame:
    from tarmacade.streaming.sessions import session_folds

    return session_folds(_turns(spark, sf))


def parser_batch(spark: SparkSession, sf: str) -> DataFrame:
    """What the deterministic parser makes of every rally name with its country."""
    from tarmacade.plans.parser import parse

    texts = table(spark, sf, "rallies").select(F.concat_ws(" ", "event_name", "country").alias("text")).where("text <> ''").distinct()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                p = parse(text)
                q = p.query
                rows.append((text, q.intent.value if q else None, list(q.years) if q else [], list(q.countries) if q else [], " ".join(p.residual)))
            yield pd.DataFrame(rows, columns=["text", "intent", "years", "countries", "residual"])

    return spread(texts).mapInPandas(read, "text string, intent string, years array<int>, countries array<string>, residual string")


def scalars(spark: SparkSession, sf: str) -> DataFrame:
    """Lenient numbers, durations and country codes over the delivered stages and videos."""
    videos = table(spark, sf, "video_meta").select("video_id", F.col("stage_number").alias("number"), F.col("length_seconds").cast("string").alias("length"), "loaded_at")
    return videos.select("video_id", "loaded_at", leading_number("number").alias("stage"), F.round(seconds(F.col("length")), 6).alias("seconds")).distinct()


QUERIES = {
    "normalize_text": lambda spark, sf: table(spark, sf, "documents").select("doc_id", T.normalize(F.col("text")).alias("normalized")),
    "strip_year_descriptor": lambda spark, sf: _names(spark, sf).select("name", T.strip_year(F.col("name")).alias("base"), T.strip_descriptors(F.col("name")).alias("core"), T.extract_year(F.col("name")).alias("year")),
    "acoustic_fold": lambda spark, sf: _names(spark, sf).select("name", T.acoustic_fold(T.normalize(F.col("name"))).alias("fold"), T.consonant_skeleton(F.col("name")).alias("skeleton")),
    "phonetic_key": lambda spark, sf: _names(spark, sf).select("name", T.phonetic_key(F.col("name")).alias("key")),
    "soundex_variant": lambda spark, sf: _names(spark, sf).select("name", T.soundex(T.normalize(F.col("name"))).alias("code")),
    "ngrams_explode": ngrams_explode, "gram_anchors": gram_anchors, "page_overlaps": page_overlaps, "similarity_pairs": similarity_pairs, "kernel_pairs": kernel_pairs, "composite_score_pairs": composite_score_pairs, "scalars": scalars,
    "postings_build": postings_build, "index_statistics": index_statistics, "candidates_ranked": candidates_ranked, "entity_resolution_decisions": entity_resolution_decisions,
    "recall_mrr": recall_mrr, "index_coverage": index_coverage,
    "latency_summary": latency_summary, "phase_totals": phase_totals, "failure_taxonomy": failure_taxonomy, "query_f1": query_f1, "parity_report": parity_report,
    "session_carried": session_carried, "inherited_fields": inherited_fields, "stale_generation": stale_generation, "session_fold": session_fold,
    "parser_batch": parser_batch,
}

# --- SQL


def norm_sql(x: str) -> str:
    marked, plain = "".join(T.MARKED), "".join(T.MARKED.values())
    t = f"translate(lower({x}), '{marked}', '{plain}')"
    for letter, two in T.DOUBLE.items():
        t = f"replace({t}, '{letter}', '{two}')"
    t = f"regexp_replace(regexp_replace({t}, '([0-9])([a-z])', '\\1 \\2', 'g'), '([a-z])([0-9])', '\\1 \\2', 'g')"
    return f"trim(regexp_replace({t}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def _once(x: str, letters: str) -> str:
    for c in letters:
        x = f"regexp_replace({x}, '{c}+', '{c}', 'g')"
    return x


def _replaced(x: str, pairs: list[tuple[str, str]]) -> str:
    for a, b in pairs:
        x = f"replace({x}, '{a}', '{b}')"
    return x


_RALLY_NAMES = "WITH names AS (SELECT DISTINCT event_name AS name FROM rallies WHERE event_name IS NOT NULL), n AS (SELECT name, " + norm_sql("name") + " AS t FROM names)"
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_GRAMS = "list_distinct(CASE WHEN length({0}) <= {1} THEN CASE WHEN {0} = '' THEN [] ELSE [{0}] END ELSE list_transform(range(1, length({0}) - {1} + 2), lambda i: substr({0}, i, {1})) END)"
_TRIM = "regexp_replace(regexp_replace({0}, '^\\s+', ''), '\\s+$', '')"


def trim_sql(x: str) -> str:
    return _TRIM.format(x)


PAIRS_SQL = f"""WITH names AS (SELECT DISTINCT {_TRIM.format('event_id')} AS id, {norm_sql('event_name')} AS n FROM rallies WHERE event_name IS NOT NULL),
pairs AS (SELECT f.id, f.a, o.n AS b FROM (SELECT id, min(n) AS a FROM names GROUP BY id) f JOIN names o USING (id))"""
SOUND_SQL = _once(_replaced("t", T.SOUNDS), _LETTERS + "0123456789")
_DIGITS = "translate(letters, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '" + "".join(T.SOUNDEX.get(chr(65 + i), "0") for i in range(26)) + "')"
CODE_SQL = "nullif(lower(regexp_extract(CASE WHEN lower(trim(language)) NOT IN ('null', 'none') THEN language END, '^\\s*([A-Za-z]+)', 1)), '')"
RUNS_SQL = "WITH runs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY result_id ORDER BY ingested_at DESC) AS k FROM voice_results) WHERE k = 1)"
_TURNS = """WITH turns AS (SELECT CAST(user_id AS VARCHAR) AS session, event_id AS turn, CAST(floor(event_id / 10) AS BIGINT) - CASE WHEN event_type = 'error' THEN 20 ELSE 0 END AS generation,
  CASE WHEN event_type = 'view' THEN concat('r', event_id % 50) END AS rally, CASE WHEN event_type = 'click' THEN concat('d', event_id % 30) END AS driver FROM events)"""

def _keyed(source: str, core: bool) -> str:
    """The keys of (id, name) rows: SQL that gives (id, family, key)."""
    t = norm_sql("name")
    t = f"trim(regexp_replace(regexp_replace({t}, '\\b({T.DESCRIPTORS})\\b', ' ', 'g'), ' +', ' ', 'g'))" if core else t
    base = f"(SELECT id, name, t, replace(t, ' ', '') AS c, list_filter(list_distinct(string_split(t, ' ')), lambda x: x <> '') AS w FROM (SELECT id, name, {t} AS t FROM ({source})))"
    families = [
        ("canonical", "SELECT id, lower(trim(name)) AS key FROM b"), ("exact", "SELECT id, t AS key FROM b"), ("token", "SELECT id, unnest(w) AS key FROM b"),
        ("prefix", "SELECT id, substr(x, 1, n) AS key FROM (SELECT id, unnest(w) AS x FROM b), range(2, 6) r(n) WHERE n <= length(x)"),
        ("bigram", f"SELECT id, unnest({_GRAMS.format('c', 2)}) AS key FROM b"), ("trigram", f"SELECT id, unnest({_GRAMS.format('c', 3)}) AS key FROM b"),
        ("phonetic", f"SELECT id, replace(upper({SOUND_SQL}), ' ', '') AS key FROM b"),
    ]
    return f"(WITH b AS {base} SELECT DISTINCT id, family, key FROM ({' UNION ALL '.join(f'SELECT id, {chr(39)}{f}{chr(39)} AS family, key FROM ({q})' for f, q in families)}) WHERE key <> '')"


_PEOPLE = f"SELECT CASE WHEN lower({_TRIM.format('person_id')}) NOT IN ('', 'null', 'none') THEN {_TRIM.format('person_id')} END AS id, min(display_name) AS name FROM people WHERE trim(display_name) <> '' GROUP BY 1 HAVING id IS NOT NULL"
_TYPED = "SELECT DISTINCT trim(driver_name) AS id, trim(driver_name) AS name FROM participation WHERE person_id IS NULL AND trim(driver_name) <> ''"
_WEIGHT = "CASE family WHEN 'canonical' THEN 12000 WHEN 'exact' THEN 10000 WHEN 'token' THEN 200 WHEN 'trigram' THEN 20 WHEN 'bigram' THEN 4 WHEN 'phonetic' THEN 300 ELSE 5 * length(key) END"

_NAMED = f"""SELECT concat(entity_type, '|', entity_id) AS id, min(name) AS name FROM (
  SELECT 'person' AS entity_type, {given('person_id')} AS entity_id, display_name AS name FROM people UNION ALL SELECT 'stage', {given('stage_id')}, stage_name FROM stages
  UNION ALL SELECT 'rally', {trim_sql('event_id')}, event_name FROM rallies) WHERE entity_id IS NOT NULL AND trim(name) <> '' GROUP BY entity_type, entity_id"""
_OTHER_NAMES = f"""SELECT DISTINCT concat_ws('|', entity_id, mention) AS id, entity_id, "group", mention AS name FROM (
  SELECT {given('person_id')} AS entity_id, coalesce(role, 'none') AS "group", unnest(searchable_names) AS mention FROM people)
  WHERE entity_id IS NOT NULL AND lower(trim(mention)) NOT IN ('', 'null', 'none')"""
_SAMENESS = f"""WITH d AS (SELECT person_id, loaded_at, lower(trim(display_name)) AS shown, coalesce(code, u) AS country, coalesce(role, 'none') AS role, searchable_names FROM (SELECT *, upper({given('country')}) AS u FROM people WHERE person_id IS NOT NULL) LEFT JOIN {CODES_SQL} ON spelling = u),
  f AS (SELECT person_id, shown AS s0, country AS c0, role AS r0 FROM d QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY loaded_at NULLS FIRST, shown NULLS FIRST, country NULLS FIRST, role) = 1),
  p AS (SELECT r0 AS role, list_distinct(list_filter([s0], lambda x: x IS NOT NULL)) AS en, list_distinct(list_transform(list_filter(coalesce(searchable_names, []), lambda x: x IS NOT NULL), lambda x: lower(trim(x)))) AS an,
    list_filter([c0], lambda x: x IS NOT NULL) AS ec, list_filter([country], lambda x: x IS NOT NULL) AS ac FROM d JOIN f USING (person_id)),
  t AS (SELECT role, CAST(sum(len(list_intersect(en, an)) + len(list_intersect(ec, ac))) AS BIGINT) AS tp, CAST(sum(len(en) + len(ec)) AS BIGINT) AS e, CAST(sum(len(an) + len(ac)) AS BIGINT) AS a FROM p GROUP BY role),
  q AS (SELECT role, tp, a - tp AS fp, e - tp AS fn, CASE WHEN a = 0 THEN 1 ELSE tp / a END AS precision, CASE WHEN e = 0 THEN 1 ELSE tp / e END AS recall FROM t)"""
_LISTED = f"""WITH {ORDER_SQL}, r AS (SELECT {trim_sql('event_id')} AS event_id, {trim_sql('snapshot_id')} AS snapshot_id, load_ord, concat_ws('/', coalesce(CAST(year AS VARCHAR), 'none'), coalesce(code, u, 'none')) AS case_id
    FROM (SELECT *, upper({given('country')}) AS u FROM rallies) LEFT JOIN {CODES_SQL} ON spelling = u),
  i AS (SELECT n = 1 AS old, case_id, event_id, max(load_ord) AS o FROM r JOIN orders_ USING (snapshot_id) WHERE n = 1 OR next_id IS NULL GROUP BY ALL),
  l AS (SELECT old, case_id, list(event_id ORDER BY o, event_id) AS ids FROM i GROUP BY ALL)"""

SQL = {
    "gram_anchors": f"""{_RALLY_NAMES}, c AS (SELECT name, replace(t, ' ', '') AS c FROM n), g AS (SELECT name, c, list_transform(range(1, length(c) - 1), lambda i: substr(c, i, 3)) AS g FROM c),
  d AS (SELECT name, c, list_filter(g, lambda x, i: list_position(g, x) = i)[1:5] AS g FROM g)
  SELECT name, CASE WHEN length(c) < 3 THEN c ELSE array_to_string(CASE WHEN list_contains(g, substr(c, length(c) - 2, 3)) THEN g ELSE list_append(g, substr(c, length(c) - 2, 3)) END, ',') END AS anchors FROM d""",
    "page_overlaps": f"""SELECT "group", id, count(*) AS times FROM (SELECT {trim_sql('event_id')} AS "group", pos_overall, {given('driver_id')} AS id FROM final_results)
  WHERE "group" IS NOT NULL AND pos_overall IS NOT NULL AND id IS NOT NULL GROUP BY ALL HAVING count(*) > 1""",
    "postings_build": f"SELECT split_part(id, '|', 1) AS entity_type, family, count(DISTINCT key) AS keys, count(*) AS postings FROM {_keyed(_NAMED, True)} GROUP BY ALL",
    "index_statistics": f"SELECT split_part(id, '|', 1) AS entity_type, count(DISTINCT id) AS entities, count(*) AS postings, CAST(sum(octet_length(encode(key))) AS BIGINT) AS key_bytes FROM {_keyed(_NAMED, True)} GROUP BY ALL",
    "index_coverage": f"""WITH n AS ({_NAMED}), k AS MATERIALIZED (SELECT DISTINCT id FROM {_keyed(_NAMED, True)})
  SELECT split_part(n.id, '|', 1) AS entity_type, count(*) AS sources, count(k.id) AS indexed, count(*) - count(k.id) AS missing FROM n LEFT JOIN k USING (id) GROUP BY ALL""",
    "recall_mrr": f"""WITH t AS ({_OTHER_NAMES}), e AS MATERIALIZED {_keyed(_PEOPLE, True)}, m AS MATERIALIZED {_keyed(f"SELECT id, name FROM ({_OTHER_NAMES})", False)},
  s AS (SELECT m.id AS id, e.id AS entity_id, sum({_WEIGHT}) AS weight FROM m JOIN e USING (family, key) GROUP BY 1, 2),
  k AS (SELECT id, entity_id, row_number() OVER (PARTITION BY id ORDER BY weight DESC, entity_id) AS rank FROM s QUALIFY rank <= {R.POOL['person']})
  SELECT "group", count(*) AS cases, {', '.join(f"round(avg(CASE WHEN rank <= {n} THEN 1.0 ELSE 0 END), 6) AS recall_{n}" for n in (1, 5, 10))}, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr FROM t LEFT JOIN k USING (id, entity_id) GROUP BY "group\"""",
    "query_f1": f"{_SAMENESS} SELECT role, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END, 6) AS f1 FROM q",
    "parity_report": f"""{_LISTED} SELECT coalesce(a.case_id, b.case_id) AS case_id, CASE WHEN a.ids IS NULL THEN 'MISSING_LEFT' WHEN b.ids IS NULL THEN 'MISSING_RIGHT' WHEN a.ids = b.ids THEN 'EXACT'
  WHEN list_sort(a.ids) = list_sort(b.ids) THEN 'UNDEFINED_ORDERING' ELSE 'MISMATCH' END AS verdict FROM (FROM l WHERE old) a FULL JOIN (FROM l WHERE NOT old) b USING (case_id)""",
    "candidates_ranked": f"""WITH e AS MATERIALIZED {_keyed(_PEOPLE, True)}, m AS MATERIALIZED {_keyed(_TYPED, False)},
  s AS (SELECT m.id AS mention_id, e.id AS entity_id, CAST(sum({_WEIGHT}) AS BIGINT) AS weight FROM m JOIN e USING (family, key) GROUP BY 1, 2)
  SELECT mention_id, entity_id, weight, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY weight DESC, entity_id) AS rank FROM s) WHERE rank <= 10""",
    "normalize_text": f"SELECT doc_id, {norm_sql('text')} AS normalized FROM documents",
    "strip_year_descriptor": f"""{_RALLY_NAMES} SELECT name, trim(regexp_replace(regexp_replace(t, '\\b(19|20)[0-9]{{2}}\\b', ' ', 'g'), ' +', ' ', 'g')) AS base,
  trim(regexp_replace(regexp_replace(t, '\\b({T.DESCRIPTORS})\\b', ' ', 'g'), ' +', ' ', 'g')) AS core, try_cast(nullif(regexp_extract(name, '\\b((19|20)[0-9]{{2}})\\b', 1), '') AS INT) AS year FROM n""",
    "acoustic_fold": f"{_RALLY_NAMES} SELECT name, {_once(_replaced('t', [('x', 'ks'), ('ph', 'f'), ('ck', 'k')]), 'bcdfghjklmnpqrstvwxyz')} AS fold, regexp_replace(t, '[aeiou ]', '', 'g') AS skeleton FROM n",
    "phonetic_key": f"{_RALLY_NAMES} SELECT name, upper({SOUND_SQL}) AS key FROM n",
    "soundex_variant": f"""{_RALLY_NAMES}, l AS (SELECT name, regexp_replace(upper(t), '[^A-Z]', '', 'g') AS letters FROM n),
  d AS (SELECT name, letters, replace(substr({_once(_DIGITS, '0123456')}, 2), '0', '') AS tail FROM l) SELECT name, CASE WHEN letters = '' THEN '' ELSE concat(letters[1], rpad(substr(tail, 1, 3), 3, '0')) END AS code FROM d""",
    "ngrams_explode": f"{_RALLY_NAMES}, c AS (SELECT replace(t, ' ', '') AS c FROM n) SELECT gram, count(*) AS names FROM (SELECT unnest({_GRAMS.format('c', 3)}) AS gram FROM c) GROUP BY gram",
    "similarity_pairs": f"""{PAIRS_SQL}, g AS (SELECT *, {_GRAMS.format('a', 2)} AS ga, {_GRAMS.format('b', 2)} AS gb, list_distinct(string_split(a, ' ')) AS wa, list_distinct(string_split(b, ' ')) AS wb FROM pairs)
  SELECT id, a, b, round(CASE WHEN len(ga) = 0 OR len(gb) = 0 THEN 0 ELSE 2.0 * len(list_intersect(ga, gb)) / (len(ga) + len(gb)) END, 6) AS dice,
  round(CASE WHEN a = '' AND b = '' THEN 0 ELSE len(list_intersect(wa, wb)) / len(list_distinct(list_concat(wa, wb))) END, 6) AS jaccard,
  CAST(levenshtein(a, b) AS INT) AS edits, round(CASE WHEN a = '' OR b = '' THEN 0 ELSE 1.0 - levenshtein(a, b) / greatest(length(a), length(b)) END, 6) AS levenshtein FROM g""",
    "scalars": """SELECT DISTINCT video_id, loaded_at, coalesce(try_cast(nullif(regexp_extract(stage_number, '^\\s*(\\d+)', 1), '') AS INT), 0) AS stage, round(CASE WHEN length_seconds >= 0 AND NOT isnan(length_seconds) THEN length_seconds END, 6) AS seconds FROM video_meta""",
    "latency_summary": f"""{RUNS_SQL}, v AS (SELECT coalesce({CODE_SQL}, 'und') AS language, total_latency_ms AS v FROM runs WHERE total_latency_ms >= 0 AND total_latency_ms <= 3600000 AND NOT isnan(total_latency_ms)),
  r AS (SELECT *, row_number() OVER (PARTITION BY language ORDER BY v) AS k, count(*) OVER (PARTITION BY language) AS n FROM v)
  SELECT language, max(n) AS n, round(avg(v), 6) AS mean, {', '.join(f"max(CASE WHEN k = (n * {p} + 99) // 100 THEN v END) AS p{p}" for p in (50, 75, 90, 95, 99))}, max(v) AS max FROM r GROUP BY language""",
    "phase_totals": f"""{RUNS_SQL} SELECT case_id, {', '.join(f"CAST(sum(CASE WHEN {c} >= 0 AND {c} < 3600000 THEN {c} ELSE 0 END) AS BIGINT) AS {n}" for n, c in (('stt', 'stt_latency_ms'), ('parse', 'llm_parse_latency_ms'), ('resolve', 'entity_resolution_latency_ms'), ('db', 'db_latency_ms')))} FROM runs WHERE case_id IS NOT NULL GROUP BY case_id""",
    "failure_taxonomy": f"""{RUNS_SQL}, k AS (SELECT coalesce({CODE_SQL}, 'und') AS language, CASE WHEN error_message IS NULL OR lower(trim(error_message)) IN ('', 'null', 'none') THEN 'none'
  WHEN contains(error_message, 'stt') OR contains(error_message, 'audio') OR contains(error_message, 'transcript') THEN 'speech' WHEN contains(error_message, 'db') THEN 'database' WHEN contains(error_message, 'model') THEN 'model' ELSE 'other' END AS kind FROM runs)
  SELECT language, count(*) AS cases, {', '.join(f"count(*) FILTER (kind = '{c}') AS {c if c != 'none' else 'none'}" for c in ('none', 'speech', 'database', 'model', 'other'))} FROM k GROUP BY language""",
    "session_carried": f"{_TURNS} SELECT session, turn, last_value(rally IGNORE NULLS) OVER w AS active_rally, last_value(driver IGNORE NULLS) OVER w AS active_driver FROM turns WINDOW w AS (PARTITION BY session ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    "inherited_fields": f"""{_TURNS}, l AS (SELECT *, lag(rally) OVER w AS r0, lag(driver) OVER w AS d0, row_number() OVER w AS k FROM turns WINDOW w AS (PARTITION BY session ORDER BY turn))
  SELECT session, turn, CASE WHEN k = 1 THEN '' ELSE concat_ws(',', CASE WHEN rally = r0 THEN 'rally' END, CASE WHEN driver = d0 THEN 'driver' END) END AS inherited,
  CASE WHEN k = 1 THEN '' ELSE concat_ws(',', CASE WHEN rally IS NOT NULL AND rally IS DISTINCT FROM r0 THEN 'rally' END, CASE WHEN driver IS NOT NULL AND driver IS DISTINCT FROM d0 THEN 'driver' END) END AS refined FROM l""",
    "stale_generation": f"""{_TURNS}, m AS (SELECT *, max(generation) OVER (PARTITION BY session ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM turns)
  SELECT session, count(*) FILTER (before > generation) AS stale, count(*) AS turns FROM m GROUP BY session""",
    "session_fold": f"""{_TURNS}, g AS (SELECT *, coalesce(max(generation) OVER (PARTITION BY session ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > generation, FALSE) AS stale FROM turns)
  SELECT session, turn, generation, last_value(CASE WHEN NOT stale THEN rally END IGNORE NULLS) OVER w AS active_rally, last_value(CASE WHEN NOT stale THEN driver END IGNORE NULLS) OVER w AS active_driver, stale FROM g
  WINDOW w AS (PARTITION BY session ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
}
