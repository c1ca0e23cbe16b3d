"""The best scored entities of each mention's pool, weighed and scored in one step.

What `entities.candidates`, `escaped` and `scored` find by way of a row per mention and candidate comes from
arrays here, a chunk of mentions and a block of entities at a time: the whole pool is scored, with the
same values, and only the rows that a decision or a lookup can depend on leave the step.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarmacade.functions import text as T
from tarmacade.functions.batched import LONGEST, gram_places, lettered, multiset_dice, places, winkler
from tarmacade.functions.kernels import dice, jaro_winkler
from tarmacade.operators import entities as R
from tarmacade.session import cut_lineage, spread

#: Words of a name that are compared in arrays; letters whose places are kept for a whole block; copies of a block at least allowed.
MOST_WORDS, KEPT_LETTERS, COPIES = 12, 64, 24
#: What is compared of a name; rows that are scored at once, at least where there are as many; bytes of weights by key that are kept.
FORMS, AT_ONCE, KEPT_BYTES = ("lower", "norm", "sound", "two", "three"), 3_000, 1 << 27
#: Namesakes of the best come out if their score is so near that both may round to the same.
NEAR = 1e-5


def _compared(frame: DataFrame, name: str, indexed: Column) -> DataFrame:
    """The frame with what is compared of a name (FORMS) and its `keys`, each the family and the key."""
    staged = frame.withColumns({"norm": T.normalize(F.col(name)), "indexed": indexed})
    flat = F.replace("norm", F.lit(" "), F.lit(""))
    return staged.withColumns({
        "lower": F.lower(name), "sound": F.replace(T.phonetic_key(F.col(name)), F.lit(" "), F.lit("")), "two": F.size(T.grams(flat, 2)), "three": F.size(T.grams(flat, 3)),
        "keys": F.transform(R._keys(F.col(name), F.col("indexed")), lambda k: F.concat(k["family"], F.lit(":"), k["key"])),
    }).drop("indexed")


def even_labels(spark: SparkSession, count: int, parts: int) -> list[int]:
    """Numbers of groups that a shuffle by (0, number) sends to all of its parts alike."""
    tried = spark.range(64 * max(count, parts), numPartitions=1).select(F.col("id").cast("int"), F.pmod(F.hash(F.lit(0), F.col("id").cast("int")), F.lit(parts)))
    of: dict[int, list[int]] = {}
    for label, part in tried.collect():
        of.setdefault(part, []).append(label)
    return [label for labels in zip(*of.values()) for label in labels][:count]


def best_scored(mentions: DataFrame, entities: DataFrame, most: int) -> DataFrame:
    """(mention_id, entity_id, name, score): of each mention's pool at least the `most` best, by score, name and id.

    Scores are those of `scored` without context, over the pool or, where it is below LEAST_POOL, all entities of the
    type. Namesakes of the best with its score come out, however many; so do at least two
    candidates where there are two. `decisions` are those of the whole pool if `most` is 5 or more.
    """
    # Entities of the same names are one row with all their ids; keys and forms are made once per name, in all tasks.
    spark, one = mentions.sparkSession, ["entity_type", "names"]
    same = entities.where(F.trim("name") != "").groupBy("entity_type", "entity_id").agg(F.array_sort(F.collect_set("name")).alias("names"))
    same = spread(same.groupBy(*one).agg(F.array_sort(F.collect_list("entity_id")).alias("ids")))
    held = _compared(same.select("*", F.explode("names").alias("raw")), "raw", T.strip_descriptors(F.col("raw")))
    held = held.groupBy(*one).agg(F.first("ids").alias("ids"), F.collect_list(F.struct("raw", *FORMS)).alias("forms"), F.array_distinct(F.flatten(F.collect_list("keys"))).alias("keys"))
    held = held.select("entity_type", "ids", F.col("forms").alias("names"), "keys", R._pool_size().alias("pool"), F.col("forms")[0]["raw"].alias("of"))
    asked = _compared(spread(mentions.select("mention_id", "entity_type", "mention")), "mention", T.normalize(F.col("mention")))
    asked = asked.select("mention_id", "entity_type", *FORMS, "keys", T.without_year(F.col("norm")).alias("of"))
    held, asked = cut_lineage(held), cut_lineage(asked)

    blocks, n, parts = max(1, -(-held.count() // R.KEY_ROWS)), asked.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = max(1, min(2 * parts, COPIES, n // R.LEAST_CHUNK), -(-n // R.MOST_CHUNK_FEW))
    labels = F.array(*map(F.lit, even_labels(spark, chunks, parts)))
    kinds = dict(asked.dtypes)["mention_id"], dict(held.dtypes)["ids"].removeprefix("array<").removesuffix(">")
    # Mentions that differ in the year only come together: most of their keys are the same.
    part = lambda count: F.pmod(F.xxhash64("of"), F.lit(count)).cast("int")
    every = lambda count: F.sequence(F.lit(0), F.lit(count - 1))
    left = held.withColumns({"block": part(blocks), "chunk": F.explode(labels)}).drop("of").groupBy("block", "chunk")
    right = asked.withColumns({"chunk": F.get(labels, part(chunks)), "block": F.explode(every(blocks))}).drop("of").groupBy("block", "chunk")
    found = left.cogroup(right).applyInArrow(
        lambda h, a: scored_pools(h, a, most if blocks == 1 else None), f"mention_id {kinds[0]}, entity_id {kinds[1]}, name string, score double, weight long, pool int"
    )
    if blocks > 1:  # only all blocks together tell which candidates are the pool
        of = Window.partitionBy("mention_id")
        found = found.withColumns({"rank": F.row_number().over(of.orderBy(F.desc("weight"), F.col("entity_id"))), "n": F.count_if(F.col("weight") > 0).over(of)})
        found = found.where((F.col("n") < R.LEAST_POOL) | (F.col("weight") > 0) & (F.col("rank") <= F.col("pool"))).where("score is not null")
    return found.select("mention_id", "entity_id", "name", "score")


class _Names:
    """The names of a block of entities, as arrays."""

    def __init__(self, names: pa.StructArray) -> None:
        self.raw, self.lower, self.norm, self.sound = (names.field(f).to_pylist() for f in ("raw", "lower", "norm", "sound"))
        self.two, self.three = (names.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("two", "three"))
        self.order = {t: i for i, t in enumerate(sorted(set(self.raw)))}
        self.place = np.fromiter((self.order[t] for t in self.raw), np.int64, len(self.raw))
        self.lowers: dict[str, int] = {}
        self.lower_at = np.fromiter((self.lowers.setdefault(t, len(self.lowers)) for t in self.lower), np.int64, len(self.raw))
        self.norms = sorted(set(self.norm))
        self.norm_of = {t: i for i, t in enumerate(self.norms)}
        self.norm_at = np.fromiter((self.norm_of[t] for t in self.norm), np.int64, len(self.raw))
        self.norm_size = np.fromiter(map(len, self.norm), np.int64, len(self.raw))
        words = [_words(t) for t in self.norm]
        self.word_count = np.fromiter(map(len, words), np.int64, len(words))
        self.vocabulary = sorted({w for ws in words for w in ws})
        self.word_of = {w: i for i, w in enumerate(self.vocabulary, 1)}
        self.words = np.zeros((min(MOST_WORDS, int(self.word_count.max(initial=1))), len(words)), np.int32)
        for i, ws in enumerate(words):
            for k, w in enumerate(ws[:MOST_WORDS]):
                self.words[k, i] = self.word_of[w]
        self.flat = _Letters([t.replace(" ", "") for t in self.norm])
        self.heard = _Letters(self.sound)
        self.long = (self.flat.size > LONGEST) | (self.heard.size > LONGEST) | (self.word_count > MOST_WORDS)

    def scores(self, texts: list[tuple[str, str, str, int, int]], at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The score and the strongest signal of mentions (FORMS) against names: texts[at[i]] against rows[i], `at` ascending."""
        flats = [norm.replace(" ", "") for _, norm, *_ in texts]
        single = np.array([max(len(f), len(t[2])) > LONGEST for f, t in zip(flats, texts)])[at] | self.long[rows]
        score, strongest = np.zeros(len(rows)), np.zeros(len(rows))
        for i in np.flatnonzero(single):
            r = rows[i]
            score[i], strongest[i] = _scored_one(texts[at[i]][:3], (self.lower[r], self.norm[r], self.sound[r]))
        kept = np.flatnonzero(~single)
        if not len(kept):
            return score, strongest
        r, at = rows[kept], at[kept]
        ends = np.searchsorted(at, np.arange(len(texts) + 1))
        token = np.concatenate([self._token(t[1], r[ends[m] : ends[m + 1]]) for m, t in enumerate(texts)])
        of = lambda each: np.array(each, np.int64)[at]
        short = lambda each: ["" if len(t) > LONGEST else t for t in each]
        jw, triples, both = self.flat.likeness(short(flats), at, r, 3)
        ngram = 0.4 * _set_dice(both(2), of([t[3] for t in texts]), self.two[r]) + 0.6 * _set_dice(both(3), of([t[4] for t in texts]), self.three[r])
        jw_heard, pairs, _ = self.heard.likeness(short([t[2] for t in texts]), at, r, 2)
        exact = (self.lower_at[r] == of([self.lowers.get(t[0], -1) for t in texts])) * 1.0
        normalized = (self.norm_at[r] == of([self.norm_of.get(t[1], -1) for t in texts])) * 1.0
        signals = np.sort(np.stack([exact, normalized, token, ngram, np.maximum(jw, triples), np.maximum(jw_heard, pairs)]), axis=0)
        score[kept], strongest[kept] = np.minimum(1.0, 0.62 * signals[-1] + 0.23 * signals[-2] + 0.10 * token + 0.05 * 0.0), signals[-1]
        return score, strongest

    def _token(self, norm: str, r: np.ndarray) -> np.ndarray:
        """`text.token_score` of a mention and some names."""
        mine = _words(norm)
        if not mine:
            return np.zeros(len(r))
        words, count = self.words[:, r], self.word_count[r]
        both, hits = np.zeros(len(r), np.int64), np.zeros(len(r), np.int64)
        for w in mine:
            if w in self.word_of:
                both += (words == self.word_of[w]).any(axis=0)
            if len(w) >= 3:
                low, high = bisect_left(self.vocabulary, w), bisect_left(self.vocabulary, w + "\U0010ffff")
                begins = (words > low) & (words <= high)
                for p in {self.word_of[w[:k]] for k in range(3, len(w)) if w[:k] in self.word_of}:
                    begins |= words == p
                hits += begins.any(axis=0)
        size = self.norm_size[r]
        n = self.norm_at[r]
        starts = (n >= bisect_left(self.norms, norm)) & (n < bisect_left(self.norms, norm + "\U0010ffff"))
        for p in {self.norm_of[norm[:k]] for k in range(1, len(norm)) if norm[:k] in self.norm_of}:
            starts |= n == p
        phrase = np.where(starts, np.minimum(size, len(norm)) / np.maximum(size, len(norm)), 0.0)
        return np.where(count == 0, 0.0, np.maximum(np.maximum(_set_dice(both, len(mine), count), hits / np.maximum(len(mine), count)), phrase))


class _Letters:
    """One form of all names, with the places of each letter as they are asked for."""

    def __init__(self, texts: list[str]) -> None:
        self.of: dict[str, int] = {}
        self.at = np.fromiter((self.of.setdefault(t, len(self.of)) for t in texts), np.int64, len(texts))
        self.letters, self.size = lettered(texts, 64)
        if self.size.max(initial=0) <= 32:
            self.letters = np.ascontiguousarray(self.letters[:, :32])
        #: The row of a letter in `kept`, where the places of each are; the first row is no letter's.
        self.row: dict[str, int] = {}
        self.kept = np.zeros((KEPT_LETTERS + 1, len(texts)), np.uint64)

    def masks(self, texts: list[str], at: np.ndarray, r: np.ndarray) -> list[np.ndarray]:
        """By place in the texts, where its letter is in each name; nowhere beyond the end of a text."""
        place, rare = np.zeros((len(texts), max(map(len, texts))), np.int64), []
        for m, text in enumerate(texts):
            for i, c in enumerate(text):
                if c not in self.row and len(self.row) < KEPT_LETTERS:
                    self.row[c] = len(self.row) + 1
                    self.kept[self.row[c]] = places(self.letters == ord(c) + 1)
                if c in self.row:
                    place[m, i] = self.row[c]
                else:
                    rare.append((m, i, c))
        flat, starts = self.kept.reshape(-1), place * self.kept.shape[1]
        found = [flat.take(starts[:, i].take(at) + r) for i in range(place.shape[1])]
        for m, i, c in rare:
            low, high = np.searchsorted(at, (m, m + 1))
            found[i][low:high] = places(self.letters[r[low:high]] == ord(c) + 1)
        return found

    def likeness(self, texts: list[str], at: np.ndarray, r: np.ndarray, n: int):  # noqa: ANN201
        """Jaro-Winkler and the Dice of multisets of n-grams of texts[at] and names, and a function to count their common distinct k-grams."""
        of = lambda each: np.array(each)[at]
        sizes = [len(t) for t in texts]
        size, mine, equal = self.size[r], of(sizes), self.at[r] == of([self.of.get(t, -1) for t in texts])
        masks, prefix, so_far = self.masks(texts, at, r), np.zeros(len(r), np.int64), np.ones(len(r), bool)
        for i in range(4):
            so_far &= self.letters[r, i] == of([ord(t[i]) + 1 if i < len(t) else -1 for t in texts])
            prefix += so_far

        def both(k: int) -> np.ndarray:
            shared, grams = np.zeros(len(r), np.int64), gram_places(masks, k)
            seen: list[set[str]] = [set() for _ in texts]
            for i, hit in enumerate(grams):
                first = []
                for t, known in zip(texts, seen):
                    first.append(i + k <= len(t) and (g := t[i : i + k]) not in known)
                    if first[-1]:
                        known.add(g)
                shared += (hit != 0) & of(first)
            return np.where(mine < k, equal, shared)

        return winkler(masks, mine, size, prefix, equal), multiset_dice(masks, n, mine, size, equal), both


def _words(norm: str) -> list[str]:
    return list(dict.fromkeys(w for w in norm.split(" ") if w))


def _set_dice(both: np.ndarray | int, n: int, m: np.ndarray) -> np.ndarray:
    return np.where((m == 0) | (n == 0), 0.0, 2.0 * both / np.maximum(n + m, 1))


def _scored_one(a: tuple[str, str, str], b: tuple[str, str, str]) -> tuple[float, float]:
    """The score and the strongest signal of two texts (lower case, normalised, as they sound), one by one."""
    x, y = _words(a[1]), _words(b[1])
    hits = sum(len(w) >= 3 and any(len(v) >= 3 and (w.startswith(v) or v.startswith(w)) for v in y) for w in x)
    ratio = min(len(a[1]), len(b[1])) / max(len(a[1]), len(b[1]), 1) if a[1].startswith(b[1]) or b[1].startswith(a[1]) else 0.0
    dices = lambda p, q: 2.0 * len(p & q) / (len(p) + len(q)) if p and q else 0.0
    token = max(dices(set(x), set(y)), hits / max(len(x), len(y)), ratio) if x and y else 0.0
    f, g = a[1].replace(" ", ""), b[1].replace(" ", "")
    grams = lambda t, n: {t[i : i + n] for i in range(max(len(t) - n + 1, 1))} - {""}
    ngram = 0.4 * dices(grams(f, 2), grams(g, 2)) + 0.6 * dices(grams(f, 3), grams(g, 3))
    lexical, phonetic = max(jaro_winkler(f, g), dice(f, g, 3)), max(jaro_winkler(a[2], b[2]), dice(a[2], b[2], 2))
    first, second, *_ = sorted((float(a[0] == b[0]), float(a[1] == b[1]), token, ngram, lexical, phonetic), reverse=True)
    return min(1.0, 0.62 * first + 0.23 * second + 0.10 * token + 0.05 * 0.0), first


class _Weights:
    """The weight of every row of a block for the keys of one mention after another."""

    def __init__(self, held: pa.Table, asked: pa.Table, kinds: dict[str, int]) -> None:
        keys = pc.list_flatten(asked["keys"]).combine_chunks()
        known = pc.unique(keys)
        number = lambda items: pc.index_in(items, known).to_numpy(zero_copy_only=False)
        side = lambda table: (pc.list_value_length(table["keys"]).to_numpy(), np.array([kinds[k] for k in table["entity_type"].to_pylist()], np.int64))
        # A key counts within its type only.
        each, kind = side(asked)
        self.mine, self.ends = number(keys).astype(np.int64) * len(kinds) + np.repeat(kind, each), np.concatenate([[0], np.cumsum(each)])
        families = [k.split(":", 1) for k in known.to_pylist()]
        self.weight = np.array([R.PREFIX_WEIGHT * len(k) if f == "prefix" else R.WEIGHTS[f] for f, k in families], np.int64).repeat(len(kinds))
        each, kind = side(held)
        at = number(pc.list_flatten(held["keys"]).combine_chunks())
        code, owner = at * len(kinds) + np.repeat(kind, each), np.repeat(np.arange(len(each)), each)
        code, owner = code[(there := ~np.isnan(at))].astype(np.int64), owner[there]
        order = np.argsort(code, kind="stable")
        self.owner, self.start = owner[order], np.searchsorted(code[order], np.arange(len(self.weight) + 1))
        self.total, self.counted, self.kept = np.zeros(held.num_rows, np.int64), frozenset(), {}

    def of(self, m: int) -> np.ndarray:
        """The weights for the mention's keys; the array is used again, and what the mention before had too stays in it."""
        keys = frozenset(self.mine[self.ends[m] : self.ends[m + 1]].tolist())
        if len(keys ^ self.counted) > len(keys):
            self.total[:], self.counted = 0, frozenset()
        for k in keys - self.counted:
            self._add(k, 1)
        for k in self.counted - keys:
            self._add(k, -1)
        self.counted = keys
        return self.total

    def _add(self, k: int, sign: int) -> None:
        rows = self.owner[self.start[k] : self.start[k + 1]]
        if len(rows) < len(self.total) // 16:
            self.total[rows] += sign * self.weight[k]
            return
        if k not in self.kept:
            if (len(self.kept) + 1) * self.total.nbytes > KEPT_BYTES:
                self.kept.clear()
            self.kept[k] = np.zeros_like(self.total)
            self.kept[k][rows] = self.weight[k]
        (np.add if sign > 0 else np.subtract)(self.total, self.kept[k], out=self.total)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers from each start on, as many as its size."""
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def scored_pools(held: pa.Table, asked: pa.Table, most: int | None) -> pa.Table:
    """(mention_id, entity_id, name, score, weight, pool): see `best_scored`.

    `held` has a row for the entities (`ids`) of the same names. Without `most` every candidate of the block comes out, its
    score null if it has no signal of LEAST_SIGNAL, and, where there are fewer than LEAST_POOL, every entity with weight 0.
    """
    asked = asked.take(pc.sort_indices(asked["norm"]))
    pools, kinds = held["pool"].to_numpy(), np.array(held["entity_type"].to_pylist(), object)
    asked_kinds = asked["entity_type"].to_pylist()
    of_kind = {k: np.flatnonzero(kinds == k) for k in set(kinds)}
    sizes = pc.list_value_length(held["ids"]).to_numpy().astype(np.int64)
    ids, first_id = pc.list_flatten(held["ids"]), np.cumsum(sizes) - sizes
    group, order = np.repeat(np.arange(len(sizes)), sizes), np.empty(len(ids), np.int64)
    order[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    each = pc.list_value_length(held["names"]).to_numpy().astype(np.int64)
    first_name, owner = np.cumsum(each) - each, np.repeat(np.arange(len(each)), each)
    flat = pc.list_flatten(held["names"])
    names = _Names(flat.combine_chunks() if flat.num_chunks != 1 else flat.chunk(0))
    texts = list(zip(*(asked[c].to_pylist() for c in FORMS)))
    weights = _Weights(held, asked, {k: i for i, k in enumerate(dict.fromkeys([*of_kind, *asked_kinds]))})

    def pool_of(m: int) -> tuple[np.ndarray, np.ndarray]:
        """The entities of a mention's pool, and their weights."""
        total, largest = weights.of(m), int(pools.max(initial=0))
        # As many groups as the largest pool has entities are enough.
        least = np.partition(total, len(total) - largest)[len(total) - largest] if len(total) > largest else 0
        met = np.flatnonzero(total >= max(1, least))
        n = sizes[met]
        if n.sum() < R.LEAST_POOL:
            met = of_kind.get(asked_kinds[m], met)
        elif n.sum() > (size := pools[met[0]]):
            of = total[met]
            down = np.argsort(-of, kind="stable")
            last = of[down][np.searchsorted(np.cumsum(n[down]), size)]
            # The heaviest, of equal weights the first by id.
            full, edge = met[of > last], met[of == last]
            edge = _ranges(first_id[edge], sizes[edge])
            entities = np.concatenate([_ranges(first_id[full], sizes[full]), edge[np.argsort(order[edge])]])[:size]
            return entities, total[group[entities]]
        entities = _ranges(first_id[met], sizes[met])
        return entities, total[group[entities]]

    def scored() -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Mention, entities of its pool, their best names, scores and signals, and weights; some mentions at once."""
        waiting, n = [], 0
        for m in range(asked.num_rows):
            entities, weight = pool_of(m)
            if len(entities):
                met, back = np.unique(group[entities], return_inverse=True)
                waiting.append((m, entities, weight, met, back))
                n += len(met)
            if n < AT_ONCE and m + 1 < asked.num_rows or not waiting:
                continue
            met = np.concatenate([w[3] for w in waiting])
            rows = _ranges(first_name[met], each[met])
            of = np.repeat(np.arange(len(met)), each[met])
            at = np.repeat(np.arange(len(waiting)), [len(w[3]) for w in waiting])[of]
            score, strongest = names.scores([texts[w[0]] for w in waiting], at, rows)
            if len(rows) > len(met):
                best = np.lexsort((names.place[rows], -score, of))
                best = best[np.unique(of[best], return_index=True)[1]]
                rows, score, strongest = rows[best], score[best], strongest[best]
            low = 0
            for m_, entities, weight, met, back in waiting:
                back = back + low
                yield m_, entities, rows[back], score[back], strongest[back], weight
                low += len(met)
            waiting, n = [], 0

    out = []
    for m, e, r, score, strongest, weight in scored():
        if most is None:
            score = np.where(strongest < R.LEAST_SIGNAL, np.nan, score)
        else:
            kept = np.flatnonzero(strongest >= R.LEAST_SIGNAL)
            kept = kept[np.lexsort((order[e[kept]], names.place[r[kept]], -score[kept]))]
            if len(kept) > most:
                top, rest = kept[0], kept[most:]
                twins = rest[(score[rest] >= score[top] - NEAR) & (names.norm_at[r[rest]] == names.norm_at[r[top]])]
                kept = np.concatenate([kept[:most], twins])
            e, r, score, weight = e[kept], r[kept], score[kept], weight[kept]
        out.append((np.full(len(e), m), e, r, score, weight))
    joined = lambda i, kind: np.concatenate([np.zeros(0, kind), *[o[i] for o in out]]).astype(kind)
    entity = joined(1, np.int64)
    return pa.table({
        "mention_id": asked["mention_id"].take(pa.array(joined(0, np.int64))), "entity_id": ids.take(pa.array(entity)),
        "name": pa.array([names.raw[i] for i in joined(2, np.int64)], pa.string()), "score": pa.array(joined(3, np.float64), from_pandas=True),
        "weight": joined(4, np.int64), "pool": pools[group[entity]].astype(np.int32),
    })
