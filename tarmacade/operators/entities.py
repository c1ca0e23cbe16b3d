"""Entity search: an inverted index of names, ranked candidates, scores and decisions.

Entities are (entity_id, entity_type, name), one row per name (an entity may have several),
mentions (mention_id, entity_type, mention). The index is one table of postings; candidates come
from a weighted sum over the postings of a mention's keys, in arrays, for blocks of entities. Mentions
are resolved once per distinct text.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmacade.functions import text as T
from tarmacade.functions.kernels import dice, jaro_winkler, pairwise
from tarmacade.session import cut_lineage, merged, spread

# What a hit in each family of keys counts; prefixes count 5 per letter.
WEIGHTS = {"canonical": 12_000, "exact": 10_000, "token": 200, "trigram": 20, "bigram": 4, "phonetic": 300}
PREFIX_WEIGHT = 5
POOL = {"person": 1_200}
OTHER_POOL = 600
#: A smaller pool is not trusted: the mention meets every entity of its type.
LEAST_POOL = 25

# Thresholds of a decision.
ACCEPT, GAP, PLAUSIBLE, ALTERNATIVE = 0.75, 0.15, 0.50, 0.65
LEAST_SIGNAL = 0.18
# Fixed value: options shown.
OPTIONS = 5
#: Signals from which a candidate counts as matched by them.
MATCHED = {"token": 0.50, "ngram": 0.45, "lexical": 0.65, "phonetic": 0.65}

#: Entities that are weighed at once; mentions at least and at most, and at most where few candidates each come out.
KEY_ROWS, LEAST_CHUNK, MOST_CHUNK, MOST_CHUNK_FEW = 200_000, 50, 1_000, 10_000


def _keys(raw: Column, norm: Column) -> Column:
    flat = F.replace(norm, F.lit(" "), F.lit(""))
    tag = lambda family, keys: F.transform(keys, lambda k: F.struct(F.lit(family).alias("family"), k.alias("key")))
    one = lambda family, key: tag(family, F.filter(F.array(key), lambda k: k != ""))
    tokens = T.words(norm)
    return F.array_distinct(F.concat(
        one("canonical", F.lower(F.trim(raw))), one("exact", norm), tag("token", tokens),
        tag("prefix", F.array_distinct(F.flatten(F.transform(tokens, lambda w: T.prefixes(w))))),
        tag("bigram", T.grams(flat, 2)), tag("trigram", T.grams(flat, 3)),
        one("phonetic", F.replace(T.phonetic_key(norm), F.lit(" "), F.lit(""))),
    ))


def postings(entities: DataFrame) -> DataFrame:
    """(entity_type, family, key, entity_id): the index, without generic rally words."""
    keyed = entities.where(F.trim("name") != "").select("entity_type", "entity_id", F.explode(_keys(F.col("name"), T.strip_descriptors(F.col("name")))).alias("k"))
    return keyed.select("entity_type", "k.family", "k.key", "entity_id").distinct()


def _coded(mentions: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mention_id, codes, weights) and (entity_type, entity_id, codes): the keys that mentions ask for, as numbers."""
    on = ["entity_type", "family", "key"]
    keyed = mentions.select("mention_id", "entity_type", F.explode(_keys(F.col("mention"), T.normalize(F.col("mention")))).alias("k"))
    keyed = keyed.select("mention_id", "entity_type", "k.family", "k.key").distinct()
    weight = F.when(F.col("family") == "prefix", PREFIX_WEIGHT * F.length("key"))
    for family, w in WEIGHTS.items():
        weight = weight.when(F.col("family") == family, w)
    # The keys asked for, each with a number: written down so that the numbers stay.
    codes = cut_lineage(keyed.select(*on).distinct().select(*on, weight.cast("long").alias("weight"), F.monotonically_increasing_id().alias("code")))
    asked = merged(keyed, codes, on).groupBy("mention_id").agg(F.collect_list("code").alias("codes"), F.collect_list("weight").alias("weights"))
    held = merged(index, codes.drop("weight"), on).groupBy("entity_type", "entity_id").agg(F.collect_list("code").alias("codes"))
    return asked, held


def _pool_size() -> Column:
    pool = F.lit(OTHER_POOL)
    for kind, n in POOL.items():
        pool = F.when(F.col("entity_type") == kind, F.lit(n)).otherwise(pool)
    return pool


def candidates(mentions: DataFrame, index: DataFrame, most: int | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """(mention_id, entity_id, weight, rank): the pool of each mention, best first, ties by id.

    A mention that shares no key with any entity has no candidates. With `most` only the first of
    a pool come out, with `wanted` (mention_id, entity_id) at least those pairs of it; ranks are
    the same. Weights are summed in arrays, one chunk of mentions and block of entities at a time,
    so that no pair of a mention and a posting becomes a row.
    """
    asked, held = _coded(mentions, index)
    if wanted is not None:
        asked = merged(asked, wanted.groupBy("mention_id").agg(F.collect_set("entity_id").alias("wanted")), "mention_id", "left")
    pool = _pool_size()
    held = cut_lineage(held.select("entity_id", "codes", (pool if most is None else F.least(pool, F.lit(most))).alias("pool")))
    asked = cut_lineage(asked)

    blocks = max(1, -(-held.count() // KEY_ROWS))
    few = most is not None or (wanted is not None and blocks == 1)
    n, parts = asked.count(), int(mentions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = max(1, min(2 * parts, n // LEAST_CHUNK), -(-n // (MOST_CHUNK_FEW if few else MOST_CHUNK)))
    side = lambda frame, mine, count, id_, other, others: frame.withColumns({mine: F.pmod(F.xxhash64(id_), F.lit(count)).cast("int"), other: F.explode(F.sequence(F.lit(0), F.lit(others - 1)))})
    left = side(held, "block", blocks, "entity_id", "chunk", chunks).groupBy("block", "chunk")
    right = side(asked, "chunk", chunks, "mention_id", "block", blocks).groupBy("block", "chunk")
    kinds = dict(asked.dtypes)["mention_id"], dict(held.dtypes)["entity_id"]
    found = left.cogroup(right).applyInArrow(lambda h, a: heaviest(h, a, blocks == 1), f"mention_id {kinds[0]}, entity_id {kinds[1]}, weight long, rank int, pool int")
    if blocks > 1:
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("mention_id").orderBy(F.desc("weight"), F.col("entity_id"))))
    return found.where("rank <= pool").select("mention_id", "entity_id", "weight", "rank")


def heaviest(held: pa.Table, asked: pa.Table, whole: bool = True) -> pa.Table:
    """(mention_id, entity_id, weight, rank, pool): the heaviest entities of each mention, ties by id.

    `held` is (entity_id, codes, pool), `asked` (mention_id, codes, weights) and perhaps `wanted`,
    the only ids that come out if the entities are `whole`. A code occurs once in a list.
    """
    held = held.take(pc.sort_indices(held["entity_id"]))
    pools = held["pool"].to_numpy()
    most = int(pools.max(initial=0))
    wants = asked["wanted"].to_pylist() if whole and "wanted" in asked.column_names else None
    place = {e: i for i, e in enumerate(held["entity_id"].to_pylist())} if wants else {}

    mentions, entities, sums, ranks = [], [], [], []
    for m, total in weighed(held, asked):
        if wants:
            places = np.array(sorted(place[e] for e in wants[m] or () if e in place), np.int64)
            best = places[total[places] > 0]
            rank = np.array([1 + np.count_nonzero(total > total[e]) + np.count_nonzero(total[:e] == total[e]) for e in best], np.int32)
        else:
            best = np.flatnonzero(total)
            if len(best) > most:
                best = best[total[best] >= np.partition(total[best], len(best) - most)[len(best) - most]]
            best = best[np.argsort(-total[best], kind="stable")][:most]
            rank = np.arange(1, len(best) + 1, dtype=np.int32)
        mentions.append(np.full(len(best), m))
        entities.append(best)
        sums.append(total[best])
        ranks.append(rank)
    joined = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts]).astype(kind)
    entity = joined(entities, np.int64)
    return pa.table({
        "mention_id": asked["mention_id"].take(pa.array(joined(mentions, np.int64))), "entity_id": held["entity_id"].take(pa.array(entity)),
        "weight": joined(sums, np.int64), "rank": joined(ranks, np.int32), "pool": pools[entity].astype(np.int32),
    })


def weighed(held: pa.Table, asked: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """Each row of `asked` with the weight of every row of `held`; the array is used again."""
    codes, owner = _listed(held["codes"])
    order = np.argsort(codes, kind="stable")
    keys, start = np.unique(codes[order], return_index=True)
    postings = np.split(owner[order], start[1:])
    mine, mention = _listed(asked["codes"])
    weights = _listed(asked["weights"])[0]
    at = np.searchsorted(keys, mine)
    known = at < len(keys)
    known[known] = keys[at[known]] == mine[known]
    at, weights, mention = at[known], weights[known], mention[known]
    ends = np.searchsorted(mention, np.arange(asked.num_rows + 1))
    total = np.zeros(held.num_rows, np.int64)
    for m in range(asked.num_rows):
        total[:] = 0
        for k in range(ends[m], ends[m + 1]):
            total[postings[at[k]]] += weights[k]
        yield m, total


def _listed(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The items of all lists, and the row of each."""
    sizes = pc.list_value_length(lists).to_numpy()
    return pc.list_flatten(lists).to_numpy(), np.repeat(np.arange(len(sizes)), sizes)


def full_scan(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """(mention_id, entity_id): every named entity of each mention's type."""
    named = entities.where(F.trim("name") != "").select("entity_type", "entity_id").distinct()
    return mentions.select("mention_id", "entity_type").distinct().join(named, "entity_type").select("mention_id", "entity_id")


def escaped(mentions: DataFrame, entities: DataFrame, pool: DataFrame) -> DataFrame:
    """(mention_id, entity_id): the whole pool of each mention, a full scan where it is below LEAST_POOL."""
    trusted = pool.groupBy("mention_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_POOL).select("mention_id")
    rest = mentions.join(trusted, "mention_id", "left_anti")
    return pool.join(trusted, "mention_id", "left_semi").select("mention_id", "entity_id").unionByName(full_scan(rest, entities))


def context_score(mentions: DataFrame, attributes: DataFrame, keys: tuple[str, ...] = ("year", "country", "event_id")) -> DataFrame:
    """(mention_id, entity_id, context): the share of a mention's known context that an entity meets.

    Both sides have the columns `keys`; a null of the mention asks nothing, and a mention that
    asks nothing has no rows. Only pairs that meet something come out: joined by each key.
    """
    asked = sum((F.col(k).isNotNull().cast("int") for k in keys), F.lit(0))
    parts = []
    for k in keys:
        m = mentions.where(F.col(k).isNotNull()).select("mention_id", F.col(k).cast("string").alias("k"), asked.alias("asked"))
        parts.append(m.join(attributes.where(F.col(k).isNotNull()).select("entity_id", F.col(k).cast("string").alias("k")).distinct(), "k").select("mention_id", "entity_id", "asked"))
    met = parts[0]
    for part in parts[1:]:
        met = met.unionByName(part)
    return met.groupBy("mention_id", "entity_id").agg((F.count(F.lit(1)) / F.max("asked")).alias("context"))


def scored(mentions: DataFrame, entities: DataFrame, pool: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """(mention_id, entity_id, name, score, matched_by, signals...): the pool scored by each entity's best name.

    Six signals in 0..1; the score is .62 of the strongest, .23 of the second, .10 of the token
    signal and .05 of the context (mention_id, entity_id, context), 0 without one. Of several
    names of an entity the best scored one counts, of equal ones the first; if it has no signal of
    LEAST_SIGNAL, the pair is dropped.
    """
    jw, d2, d3 = pairwise(jaro_winkler), pairwise(lambda a, b: dice(a, b, 2)), pairwise(lambda a, b: dice(a, b, 3))
    form = lambda frame, key, name, p: frame.select(
        key, F.col(name).alias(f"{p}_raw"), T.normalize(F.col(name)).alias(f"{p}_norm"), T.collapse(F.col(name)).alias(f"{p}_flat"),
        F.replace(T.phonetic_key(F.col(name)), F.lit(" "), F.lit("")).alias(f"{p}_sound"),
        T.grams(T.collapse(F.col(name)), 2).alias(f"{p}_2"), T.grams(T.collapse(F.col(name)), 3).alias(f"{p}_3"), T.words(T.normalize(F.col(name))).alias(f"{p}_words"),
    )
    joined = spread(pool.select("mention_id", "entity_id")).join(form(mentions, "mention_id", "mention", "m"), "mention_id").join(form(entities, "entity_id", "name", "e"), "entity_id")
    c = F.col
    ngram = 0.4 * T.set_dice(c("m_2"), c("e_2")) + 0.6 * T.set_dice(c("m_3"), c("e_3"))
    signals = joined.withColumns({
        "exact": (F.lower("m_raw") == F.lower("e_raw")).cast("double"), "normalized": (c("m_norm") == c("e_norm")).cast("double"),
        "token": T.token_score(c("m_words"), c("e_words"), c("m_norm"), c("e_norm")), "ngram": ngram,
        "lexical": F.greatest(jw("m_flat", "e_flat"), d3("m_flat", "e_flat")), "phonetic": F.greatest(jw("m_sound", "e_sound"), d2("m_sound", "e_sound")),
    })
    strongest = F.sort_array(F.array("exact", "normalized", "token", "ngram", "lexical", "phonetic"), asc=False)
    signals = signals.withColumn("context", F.lit(0.0)) if context is None else signals.join(context, ["mention_id", "entity_id"], "left").na.fill(0.0, ["context"])
    score = F.least(F.lit(1.0), 0.62 * strongest[0] + 0.23 * strongest[1] + 0.10 * c("token") + 0.05 * c("context"))
    tags = F.filter(F.array(*[F.when(c(s) >= least, F.lit(s)) for s, least in MATCHED.items()]), lambda t: t.isNotNull())
    kept = ("exact", "normalized", "token", "ngram", "lexical", "phonetic")
    # The filter comes after the aggregate: before it, it would be pushed below the kernels and run them twice.
    rows = signals.select("mention_id", "entity_id", F.struct((-score).alias("order"), c("e_raw").alias("name"), strongest[0].alias("strongest"), tags.alias("matched_by"), *kept).alias("r"))
    best = rows.groupBy("mention_id", "entity_id").agg(F.min("r").alias("r")).where(F.col("r.strongest") >= LEAST_SIGNAL)
    return best.select("mention_id", "entity_id", "r.name", (-c("r.order")).alias("score"), "r.matched_by", *[f"r.{s}" for s in kept])


def decisions(mentions: DataFrame, ranked: DataFrame) -> DataFrame:
    """(mention_id, strategy, entity_id, confidence, options): what each mention resolves to.

    A clear best candidate resolves; anything close, a second identity of the same name and
    score, or a single given name with several bearers asks for a choice among up to five.
    `ranked` may have `base_score`, the score without context: a gap in either is clear.
    """
    ranked = ranked if "base_score" in ranked.columns else ranked.withColumn("base_score", F.col("score"))
    best = Window.partitionBy("mention_id").orderBy(F.desc("score"), F.col("name"), F.col("entity_id"))
    whole = Window.partitionBy("mention_id")
    top = ranked.withColumns({"k": F.row_number().over(best), "second": F.lead("score").over(best), "base_second": F.lead("base_score").over(best), "n": F.count(F.lit(1)).over(whole), "form": T.normalize(F.col("name"))})
    twin = F.count(F.lit(1)).over(Window.partitionBy("mention_id", "form", F.round("score", 6)))
    option = F.when((F.col("k") <= OPTIONS) & (F.col("score") >= PLAUSIBLE), F.struct("k", "entity_id"))
    top = top.withColumns({"twins": twin, "options": F.transform(F.array_sort(F.collect_list(option).over(whole)), lambda o: o["entity_id"])}).where("k = 1")
    joined = mentions.select("mention_id", "entity_type", T.normalize(F.col("mention")).alias("m")).join(top, "mention_id", "left")
    gap = F.greatest(F.col("score") - F.coalesce("second", F.lit(0.0)), F.col("base_score") - F.coalesce("base_second", F.lit(0.0)))
    strategy = (
        F.when(F.col("score").isNull(), "none")
        .when((F.col("entity_type") == "person") & ~F.contains("m", F.lit(" ")) & (F.col("n") >= 2), "partial_name_ambiguity")
        .when((F.col("entity_type") == "person") & (F.col("score") >= ACCEPT) & (F.col("twins") > 1), "duplicate_person_identity")
        .when(F.col("score") < PLAUSIBLE, "below_threshold")
        .when(F.col("score") < ACCEPT, "plausible_candidates")
        .when(F.col("n") == 1, "unique_match")
        .when(gap >= GAP, "clear_winner")
        .otherwise("insufficient_gap")
    )
    decided = joined.withColumn("strategy", strategy)
    resolved = F.col("strategy").isin("unique_match", "clear_winner")
    asks = ~resolved & ~F.col("strategy").isin("none", "below_threshold")
    return decided.select(
        "mention_id", "strategy", F.when(resolved, F.col("entity_id")).alias("entity_id"), F.round(F.coalesce("score", F.lit(0.0)), 6).alias("confidence"),
        F.when(asks, F.col("options")).otherwise(F.array().cast("array<string>")).alias("options"),
    )


def snapshot_entities(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(entity_id, entity_type, name): the entities of a snapshot's tables, one row per distinct name.

    Rallies, stages, people with all their names, and uploaders. `searchable_names` may be an
    array or, as some stores keep it, its JSON text.
    """
    people = tables["people"]
    if dict(people.dtypes)["searchable_names"] == "string":
        people = people.withColumn("searchable_names", F.from_json("searchable_names", "array<string>"))
    names = F.explode(F.concat(F.array("display_name"), F.coalesce("searchable_names", F.array().cast("array<string>"))))
    parts = [
        tables["rallies"].select(F.col("event_id").alias("entity_id"), F.lit("rally").alias("entity_type"), F.col("event_name").alias("name")),
        tables["stages"].select("stage_id", F.lit("stage"), "stage_name"), people.select("person_id", F.lit("person"), names),
        tables["uploader_stats"].select("uploader_id", F.lit("uploader"), "uploader_name"),
    ]
    every = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    return every.where("entity_id is not null and trim(name) <> ''").distinct()


def index_statistics(index: DataFrame) -> DataFrame:
    """(entity_type, entities, postings, key_bytes): how large the index of each type is."""
    return index.groupBy("entity_type").agg(F.countDistinct("entity_id").alias("entities"), F.count(F.lit(1)).alias("postings"), F.sum(F.octet_length("key").cast("long")).alias("key_bytes"))


def coverage(sources: DataFrame, index: DataFrame) -> DataFrame:
    """(entity_type, sources, indexed, missing): which source ids the index has."""
    indexed = index.select("entity_type", "entity_id").distinct().withColumn("found", F.lit(1))
    return sources.select("entity_type", "entity_id").distinct().join(indexed, ["entity_type", "entity_id"], "left").groupBy("entity_type").agg(
        F.count(F.lit(1)).alias("sources"), F.count("found").alias("indexed"), F.sum(F.when(F.col("found").isNull(), 1).otherwise(0)).alias("missing")
    )


def retrieval_metrics(truth: DataFrame, ranked: DataFrame) -> DataFrame:
    """(group, cases, recall_1, recall_5, recall_10, mrr): by group of (mention_id, entity_id, group)."""
    placed = truth.join(ranked.select("mention_id", "entity_id", "rank"), ["mention_id", "entity_id"], "left")
    within = lambda k: F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0))
    return placed.groupBy("group").agg(
        F.count(F.lit(1)).alias("cases"), within(1).alias("recall_1"), within(5).alias("recall_5"), within(10).alias("recall_10"),
        F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"),
    )
