"""Linking records whose names are spellings of one name.

Work goes from words to names to records, so that Python only sees distinct words and the few
pairs of names that are left:

1. Words. The distinct words of all names are blocked by their phonetic codes (and by codes with
   letters left out, so that a typing error in the code itself loses nothing) and compared by
   Jaro-Winkler similarity and edit distance: `alike_words`. Two more relations tell which words
   can stand for one given name: the nickname table, initials and shortened forms (`fitting_words`).
2. Names. Two names are candidates if a word of one is alike a word of the other and a second
   word of one fits a second word of the other. Both relations are turned towards the more
   frequent word, so a rare spelling travels to the usual one and never the other way; names
   that meet at a pair of words are candidates. Every pair that the comparison accepts meets
   there, at any size: no block is capped or dropped, and frequent words alone bring nobody
   together.
3. Records. Connected components over the accepted pairs and over the names of one record are
   the clusters.

A name typed a million times is compared once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmacade.llm.components import connected_components
from tarmacade.llm.names import Nicknames, alike, anchors, same_name, short_keys, spelt_keys, tokens
from tarmacade.session import cut_lineage, merged


def with_forms(records: DataFrame, *columns: str) -> DataFrame:
    """(*columns, form): the distinct forms of the column `name`; nameless rows drop out."""

    @F.pandas_udf("string")
    def form(names: pd.Series) -> pd.Series:
        return pd.Series([" ".join(tokens(n)) if n else "" for n in names], dtype=object)

    return records.select(*columns, form("name").alias("form")).where("form <> ''").distinct()


def _spread(frame: DataFrame) -> DataFrame:
    """The frame in as many parts as a shuffle has, however few its bytes: Python works on them."""
    return frame.repartition(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def word_id(word: Column | str) -> Column:
    """A word as a number; two words with one number would only add a candidate."""
    return F.xxhash64(word)


def word_pairs(forms: DataFrame) -> DataFrame:
    """(name, joined, anchor, other): every pair of words of every form (name, form), and those
    with two words written as one, which are marked."""

    @F.pandas_udf("array<struct<joined: boolean, anchor: string, other: string>>")
    def parts(names: pd.Series) -> pd.Series:
        return pd.Series([[{"joined": w, "anchor": x, "other": y} for w, x, y in anchors(n.split())] for n in names], dtype=object)

    return _spread(forms).select("name", F.explode(parts("form")).alias("p")).select("name", "p.*")


def alike_words(words: DataFrame) -> DataFrame:
    """(x, y), x < y: the pairs of different words that are alike.

    `words` is (word, whole); of a pair at least one is `whole`, i.e. not only made of two words
    written as one.
    """

    @F.pandas_udf("array<long>")
    def keys(column: pd.Series) -> pd.Series:
        return pd.Series(spelt_keys(list(column)), dtype=object)

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[[alike(x, y) for x, y in zip(batch["x"], batch["y"])]]

    keyed = cut_lineage(_spread(words).select("word", "whole", F.explode(F.array_distinct(keys("word"))).alias("key")))
    other = keyed.select("key", F.col("word").alias("y"), F.col("whole").alias("wy"))
    met = merged(keyed, other, "key").where("word < y and (whole or wy)")
    return _spread(met.select(F.col("word").alias("x"), "y").distinct()).mapInPandas(check, "x string, y string")


def fitting_words(words: DataFrame, near: DataFrame, nicknames: Nicknames) -> DataFrame:
    """(x, y): pairs of different words that can stand for one given name, as `names.fits` has it.

    Each pair comes at least once, in either direction. An initial stands for itself as a word.
    """
    shared = words.sparkSession.sparkContext.broadcast(nicknames)  # the fixed table of short forms

    @F.pandas_udf("array<string>")
    def full(column: pd.Series) -> pd.Series:
        return pd.Series([sorted(shared.value.forms(w)) for w in column], dtype=object)

    @F.pandas_udf("array<string>")
    def short(column: pd.Series) -> pd.Series:
        return pd.Series([sorted(short_keys(w)) for w in column], dtype=object)

    every = words.select("word")
    formed = cut_lineage(_spread(every).select("word", F.explode(full("word")).alias("form")))
    at = formed.select(F.col("form").alias("y"), F.col("word").alias("b"))
    same_form = merged(formed, at, formed["form"] == at["y"]).select(F.col("word").alias("x"), F.col("b").alias("y"))
    alike_form = merged(merged(near, formed, near["x"] == formed["form"]).select(F.col("word").alias("x"), "y"), at, "y").select("x", F.col("b").alias("y"))
    letter = formed.select("word", F.substring("form", 1, 1).alias("letter")).distinct()
    initial = merged(letter.select(F.col("word").alias("x"), "letter"), letter.where("length(word) = 1").select(F.col("word").alias("y"), "letter"), "letter").select("x", "y")
    starts = every.where("length(word) > 3").select(F.col("word").alias("x"), F.explode(F.expr("transform(sequence(3, length(word) - 1), k -> substring(word, 1, k))")).alias("y"))
    ends = every.where("length(word) > 4").select(F.col("word").alias("x"), F.explode(F.expr("transform(sequence(2, length(word) - 3), k -> substring(word, k))")).alias("y"))
    known = every.select(F.col("word").alias("y"))
    parts = merged(starts.union(ends), known, "y", "left_semi").select("x", "y")
    letters = every.where("length(word) in (3, 4)").select("word", F.explode(short("word")).alias("key"))
    letters = merged(letters, letters.select(F.col("word").alias("y"), "key"), "key").where("substring(word, 1, 1) = substring(y, 1, 1) and least(length(word), length(y)) = 3").select(F.col("word").alias("x"), "y")
    return near.union(same_form).union(alike_form).union(initial).union(parts).union(letters).where("x <> y").distinct()


def _upwards(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """(word, up): the pairs as word numbers, from the rarer word to the more frequent one."""
    count = lambda name: counts.select(F.col("word").alias(name), F.col("n").alias(f"n_{name}"))
    known = merged(merged(pairs, count("x"), "x"), count("y"), "y")
    first = F.col("n_x") < F.col("n_y")
    first = first | ((F.col("n_x") == F.col("n_y")) & (F.col("x") < F.col("y")))
    rare, usual = F.when(first, F.col("x")).otherwise(F.col("y")), F.when(first, F.col("y")).otherwise(F.col("x"))
    return known.select(word_id(rare).alias("word"), word_id(usual).alias("up")).distinct()


def candidate_pairs(forms: DataFrame, nicknames: Nicknames) -> DataFrame:
    """(a, b), a < b: the names (name, form) that share an alike word and a fitting one.

    `names.same_name` accepts no other pair of different forms. A name stands at each of its
    pairs of words and at each pair that the two relations lead up to; of two names that meet,
    one is at home in the first word and one in the second, and no others are joined.
    """
    rows = cut_lineage(word_pairs(forms))
    seen = rows.select(F.col("anchor").alias("word"), (~F.col("joined")).alias("whole")).union(rows.select("other", ~F.col("joined")))
    words = cut_lineage(seen.groupBy("word").agg(F.max("whole").alias("whole"), F.count(F.lit(1)).alias("n")))
    # The full forms of short words are compared too, though no name may have them.
    shared = forms.sparkSession.sparkContext.broadcast(sorted({f for fs in nicknames.full.values() for f in fs}))

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _ in batch["id"]:
                yield pd.DataFrame({"word": shared.value, "whole": True})

    full = forms.sparkSession.range(1).mapInPandas(listed, "word string, whole boolean")
    compared = words.select("word", "whole").union(full).groupBy("word").agg(F.max("whole").alias("whole"))
    near = cut_lineage(alike_words(compared))
    up_near = cut_lineage(_upwards(near, words))
    up_fits = cut_lineage(_upwards(fitting_words(words, near, nicknames), words))

    home = rows.select("name", "joined", word_id("anchor").alias("p"), word_id("other").alias("q"), F.lit(True).alias("hp"))
    moved = merged(home, up_near, F.col("p") == F.col("word")).select("name", "joined", F.col("up").alias("p"), "q", F.lit(False).alias("hp"))
    placed = home.union(moved).withColumn("hq", F.lit(True))
    away = merged(placed, up_fits, F.col("q") == F.col("word")).select("name", "joined", "p", F.col("up").alias("q"), "hp", F.lit(False).alias("hq"))
    placed = cut_lineage(placed.union(away))
    side = lambda frame, name, joined: frame.select("p", "q", F.col("name").alias(name), F.col("joined").alias(joined))
    met = merged(side(placed.where("hp and hq"), "a", "ja"), side(placed, "b", "jb"), ["p", "q"]).union(
        merged(side(placed.where("hp and not hq"), "a", "ja"), side(placed.where("hq and not hp"), "b", "jb"), ["p", "q"])
    )
    met = met.where("a <> b and not (ja and jb)")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def similar_forms(pairs: DataFrame, forms: DataFrame, nicknames: Nicknames, slack: int = 0) -> DataFrame:
    """The pairs (a, b) of names (name, form) that can be one name."""
    shared = pairs.sparkSession.sparkContext.broadcast(nicknames)

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ok = [same_name(a.split(), b.split(), shared.value, slack) for a, b in zip(batch["fa"], batch["fb"])]
            yield batch.loc[ok, ["a", "b"]]

    of = lambda name, form: forms.select(F.col("name").alias(name), F.col("form").alias(form))
    spelt = merged(merged(pairs.select("a", "b"), of("a", "fa"), "a"), of("b", "fb"), "b").select("a", "b", "fa", "fb")
    return _spread(spelt).mapInPandas(check, "a long, b long")


def numbered(forms: DataFrame) -> DataFrame:
    """(name, form): the distinct forms with numbers, written down so that they stay."""
    return cut_lineage(forms.select("form").distinct().select(F.monotonically_increasing_id().alias("name"), "form"))


def accepted_pairs(forms: DataFrame, nicknames: Nicknames) -> DataFrame:
    """(a, b), a < b: the names (name, form) that can be one name."""
    return similar_forms(candidate_pairs(forms, nicknames), forms, nicknames)


def link(records: DataFrame, nicknames: Nicknames) -> DataFrame:
    """(left_key, right_key): the pairs of different records that mean one person.

    `records` is (key, name, country, typed): any number of rows per key, one per name; `typed`
    marks entries that are paired with the other records but not with each other; `country` is
    one code per key or null. Pairs come once, the smaller key first. Records with different
    known countries are never paired. Two records of one cluster are paired if a name of the
    one can be a name of the other, spelling errors on both sides allowed; the cluster of an
    initial thus doesn't join relatives with different given names. Null, blank and stand-in
    names link nothing. Names in any script link within it, and Cyrillic and Greek ones with
    Latin ones. A family name of two or three letters must be equal, and no given name of the
    table; names of one word, texts of more than eight words and those with a word of more than 30
    letters link only to the same words in any order. Repeated rows count once; other columns are ignored.
    """
    known = cut_lineage(with_forms(records, "key", "country", "typed"))
    forms = numbered(known)
    named = cut_lineage(merged(known, forms, "form").select("key", "country", "typed", "name"))
    similar = cut_lineage(accepted_pairs(forms, nicknames))
    recorded = named.where("not typed")
    own = merged(recorded.groupBy("key").agg(F.min("name").alias("a")), recorded.select("key", F.col("name").alias("b")), "key").where("a <> b").select("a", "b")
    clusters = cut_lineage(connected_components(similar.unionByName(own)))
    # Only a name of a record starts a pair; what was accepted before isn't compared again.
    left = merged(clusters, recorded.select(F.col("name").alias("node")).distinct(), "node", "left_semi").select("component", F.col("node").alias("x"))
    inside = merged(left, clusters.select("component", F.col("node").alias("y")), "component").where("x <> y")
    inside = merged(inside.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), similar, ["a", "b"], "left_anti")
    within = cut_lineage(similar.unionByName(similar_forms(inside, forms, nicknames, slack=2)))
    every = forms.select(F.col("name").alias("a"), F.col("name").alias("b"))
    allowed = within.unionByName(within.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(every)
    people = recorded.select(F.col("key").alias("k"), F.col("country").alias("c"), F.col("name").alias("a"))
    reach = merged(people, allowed, "a").select("k", "c", F.col("b").alias("name")).distinct()
    met = merged(reach, named, "name").where("k <> key and (typed or k < key)")
    met = met.where("c is null or country is null or c = country")
    return met.select(F.least("k", "key").alias("left_key"), F.greatest("k", "key").alias("right_key")).distinct()
