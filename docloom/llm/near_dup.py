"""MinHash near-duplicates: universal minima, banding, signature and exact verification, star components.

1. Each text becomes the set of its distinct k-word shingles (64-bit hashes), minima of multiply-shift universal
   hashes, and keys of `rows` minima each; as many that a pair at the threshold shares none with a probability of at
   most MISS.
2. Equal sets are one class, found by a 128-bit digest; only a class goes on, under a number of its own. So copies cost
   nothing, and documents are told apart by their texts, whatever their ids are.
3. Every member of a key is compared with the key's head (a star, not all pairs): the member that shares the most
   keys with others. Confirmed links are joined to components.
4. Keys whose members still lie in different components get the rest: their members are compared in blocks by the
   stored signature, each pair in the first key that it shares. Pairs across components whose estimate is within five
   standard deviations of the threshold are confirmed on the full sets: few pairs of a block by a join, many within
   the block, to which its members then bring their sets. Keys of more than DENSE members (a boilerplate family, whose
   texts are alike but mostly below the threshold) are first dealt again, by prefixes: with the shingles of all their
   members sorted by how many hold them, two sets at the threshold share one of the rarest `n - ceil(t n) + 1` of each,
   so only members that share such a shingle are compared. Nothing is capped, so no link between components is lost.
5. Components by alternating large-star and small-star over the confirmed links, one table per iteration. Joins by the
   head of a star or the centre of a component deal keys of many rows to parts.

Defined cases: null or empty texts have an empty set, link with nothing and are kept; rows that share a doc_id are one
document, so `near_duplicates` joins the components of their texts; a row without an id has its component's smallest id,
and is kept if the component has none. `deduplicated` goes by texts alone: it keeps one row of each component, the one
of the smallest id (a missing one comes last, of equal ones the text of the smaller hash), and all rows of empty texts.
An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import WORD, discard, join_hot, map_texts, mix64, shingle_hashes, small, stage, words_of

#: Members of a key that are compared with each other in one block.
BLOCK = 500
#: Members of a key beyond which they are dealt by the prefixes of their sets.
DENSE = 2000
#: A pair at the threshold shares no key with at most this probability.
MISS = 1e-6


@dataclass(frozen=True)
class Banding:
    """rows minima to a key; bands keys, enough for MISS at the threshold of percent."""

    percent: int
    rows: int = 8

    @property
    def bands(self) -> int:
        return max(1, math.ceil(math.log(MISS) / math.log1p(-((self.percent / 100) ** self.rows)))) if self.percent < 100 else 1

    @property
    def minima(self) -> int:
        return self.rows * self.bands

    def constants(self) -> tuple[np.ndarray, ...]:
        rng = np.random.default_rng(7)
        a = rng.integers(0, 1 << 31, self.minima, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        b = rng.integers(0, 1 << 32, self.minima, dtype=np.uint32)
        m = rng.integers(1, 1 << 63, (self.bands, self.rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        return a, b, m, mix64(np.arange(1, self.bands + 1, dtype=np.uint64))


def shingle_set(text: str | None, k: int = 3) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's k-word shingles, A-Z lower-cased."""
    return np.unique(shingle_hashes(words_of(text, lower=True), k))


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least value of a * x + b (mod 2^32) over the set, for every (a, b); in steps that stay in the cache."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 512):
        np.minimum(out, (a[:, None] * low[None, i : i + 512] + b[:, None]).min(axis=1), out=out)
    return out


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _signatures(k: int, banding: Banding):
    def signed(texts: list) -> list:
        a, b, m, band = banding.constants()
        out: list[list] = [[], [], [], []]
        for t in texts:
            s = shingle_set(t, k)
            row = (0, None, None, None)
            if len(s):
                mins = minima(s, a, b)
                keys = mix64(((mins.reshape(m.shape).astype(np.uint64) + np.uint64(1)) * m).sum(axis=1, dtype=np.uint64) ^ band)
                row = (len(s), digest(s), keys.view(np.int64), (mins & np.uint32(255)).astype(np.uint8).tobytes())
            for column, value in zip(out, row, strict=True):
                column.append(value)
        return out

    return signed


def located(docs: DataFrame, text: str) -> DataFrame:
    """doc_id, h1, h2 (128 bits of the text's hash) and text: the first three find a text again."""
    t = F.col(text)
    return docs.select("doc_id", F.xxhash64(t).alias("h1"), F.xxhash64(F.lit(1), t).alias("h2"), t.alias("text"))


def signatures(docs: DataFrame, banding: Banding, text: str = "text", k: int = 3) -> DataFrame:
    """doc_id, h1, h2, n (set size), set (digest), keys, sig; the last three null for empty sets."""
    return map_texts(located(docs, text), _signatures(k, banding), "n long, set binary, keys array<long>, sig binary")


def _sets(k: int):
    def sets(texts: list) -> list:
        return [[shingle_set(t, k).tobytes() for t in texts]]

    return sets


def _both(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def same_text(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["h1"] == b["h1"]) & (a["h2"] == b["h2"])


def shingle_sets(ids: DataFrame, docs: DataFrame, classes: DataFrame, text: str, k: int) -> DataFrame:
    """id and shingles (the class's full set) for ids (id, distinct), from the texts: a written table, a row for each
    place that holds the text, one but for rows that stand twice."""
    found = stage(ids.join(classes.select("id", "place.*"), "id"), "ids")
    rows, wanted = located(docs, text), small(found, 48)
    rows = rows.join(wanted, same_text(rows, wanted)).select("id", "text")
    sets = stage(map_texts(rows, _sets(k), "shingles binary"), "sets")
    discard(found)
    return sets


def confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame, text: str, k: int, percent: int) -> DataFrame:
    """Those (u, v) of pairs whose full sets have 100 * intersection >= percent * union: a written table."""
    pairs = stage(pairs, "pairs")
    sets = shingle_sets(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct(), docs, classes, text, k)
    once = sets.dropDuplicates(["id"])
    u, v = once.toDF("u", "su"), once.toDF("v", "sv")
    # either end may stand in very many pairs
    joined = join_hot(pairs, v, "v")
    joined = join_hot(joined, u, "u", hot=pairs.groupBy("u").count()).select("u", "v", F.struct("su", "sv").alias("sets"))

    def check(rows: list) -> list:
        linked = []
        for r in rows:
            a, b = np.frombuffer(r["su"], np.uint64), np.frombuffer(r["sv"], np.uint64)
            both = _both(a, b) if len(a) and len(b) else 0
            linked.append(both > 0 and 100 * both >= percent * (len(a) + len(b) - both))
        return [linked]

    out = stage(map_texts(joined, check, "linked boolean").where("linked").select("u", "v"), "confirmed")
    discard(pairs)
    discard(sets)
    return out


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of edges (u, v), by alternating large-star and small-star: a
    written table.

    Each round shortens every path to a component's smallest node, so the edges settle.
    """
    edges = stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = stage(join_hot(both, least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        discard(edges)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = join_hot(large, least, "u")
        star = joined.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = stage(star.distinct(), "small")
        discard(large)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = stage(nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")
    discard(edges)
    return out


class _Block:
    """Members of a key (or of two parts of a large one) and the pairs in it that may be links."""

    def __init__(self, key: int | None, members: list[dict], percent: int, minima: int):
        members = sorted(members, key=lambda r: r["id"])
        self.members, self.key, self.percent = members, key, percent
        self.ids, self.comps, self.n, self.sides = (np.array([r[c] for r in members], np.int64) for c in ("id", "comp", "n", "side"))
        self.keys = np.array([r["keys"] for r in members], np.int64)
        self.sigs = np.frombuffer(b"".join(r["sig"] for r in members), np.uint8).reshape(len(members), minima)
        self.least = percent / 100 - 5 * math.sqrt(percent * (100 - percent)) / 100 / math.sqrt(minima)

    def after(self, i: int) -> np.ndarray:
        """Members beyond i that may link with it across components; with a key, each pair only in the first that it shares."""
        rest = slice(i + 1, None)
        fits = (self.comps[rest] != self.comps[i]) & (100 * np.minimum(self.n[rest], self.n[i]) >= self.percent * np.maximum(self.n[rest], self.n[i]))
        if self.sides.any():
            fits &= self.sides[rest] != self.sides[i]
        j = np.flatnonzero(fits) + i + 1
        if len(j) and self.key is not None:
            j = j[self.keys[i, (self.keys[j] == self.keys[i]).argmax(axis=1)] == self.key]
        if len(j):
            j = j[(self.sigs[j] == self.sigs[i]).mean(axis=1) >= self.least]
        return j


MEMBER = "id: long, n: long, comp: long, keys: array<long>, sig: binary, side: int"


def _candidates(percent: int, minima: int):
    """For each block its candidate pairs, or, where they are many, the members that have any."""

    def found(blocks: list) -> list:
        pairs, dense = [], []
        for b in blocks:
            block = _Block(None if b["prefix"] else b["key"], b["members"], percent, minima)
            near = [block.after(i) for i in range(len(block.ids))]
            few = sum(map(len, near)) <= 4 * len(near)
            pairs.append([{"u": int(block.ids[x]), "v": int(block.ids[i])} for i, j in enumerate(near) for x in j] if few else [])
            has = set() if few else {i for i, j in enumerate(near) if len(j)}.union(*(j.tolist() for j in near))
            dense.append([block.members[i] for i in sorted(has)])
        return [pairs, dense]

    return found


def _linked(percent: int, minima: int):
    """Links across components within dense blocks, whose members bring their sets; a link joins their components."""

    def found(blocks: list) -> list:
        out = []
        for b in blocks:
            block, links = _Block(None if b["prefix"] else b["key"], b["members"], percent, minima), []
            sets = [np.frombuffer(r["shingles"], np.uint64) for r in block.members]
            for i in range(len(sets)):
                for j in block.after(i):
                    if block.comps[i] != block.comps[j]:
                        both = _both(sets[i], sets[j])
                        if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                            links.append({"u": int(block.ids[j]), "v": int(block.ids[i])})
                            block.comps[block.comps == block.comps[j]] = block.comps[i]
            out.append(links)
        return [out]

    return found


def _prefixes(dense: DataFrame, classes: DataFrame, docs: DataFrame, text: str, k: int, percent: int) -> DataFrame:
    """key (a shingle), id, n, members, comp: members of dense keys that share one of the rarest shingles of each.

    A shingle that no other member has only takes its place in the prefix, so those are not joined with anything.
    """
    ids = stage(dense.select("id", "n", "comp").distinct(), "dense")
    sets = shingle_sets(ids.select("id"), docs, classes, text, k)
    listed = map_texts(sets.dropDuplicates(["id"]).select("id", "shingles"), lambda many: [[np.frombuffer(b, np.int64) for b in many]], "xs array<long>")
    rows = listed.select("id", F.explode("xs").alias("shingle"))
    counts = stage(rows.groupBy("shingle").agg(F.count("*").alias("count")).where("count > 1"), "shingles")
    shared = join_hot(rows, counts, "shingle", hot=counts).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("count", "shingle"))).alias("xs"))
    alone = F.col("n") - F.size("xs")
    length = F.col("n") - F.ceil(percent * F.col("n") / 100) + 1 - alone
    taken = shared.join(ids, "id").where(length > 0).select("id", "n", "comp", F.explode(F.slice("xs", F.lit(1), length.cast("int"))).alias("x")).select("x.shingle", "id", "n", "comp")
    taken = stage(taken.withColumnRenamed("shingle", "key"), "prefixes")
    for done in (ids, sets, counts):
        discard(done)
    met = taken.groupBy("key").agg(F.count("*").alias("members"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    return taken.join(met.select("key", "members"), "key").select("key", "id", "n", "members", "comp")


def _across(placed: DataFrame, classes: DataFrame, docs: DataFrame, text: str, k: int, banding: Banding) -> DataFrame:
    """Links (u, v) between components within keys: a written table. placed: key, id, n, members, comp."""
    percent, minima = banding.percent, banding.minima
    split = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("members").alias("most")).where("lo <> hi")
    split = stage(split.select("key", "most"), "split")
    rest = placed.join(split.where(F.col("most") <= DENSE).select("key"), "key").withColumn("prefix", F.lit(False))
    dense = split.where(F.col("most") > DENSE).select("key")
    if not dense.isEmpty():
        # as few keys as members in them make room for
        again = _prefixes(placed.join(small(dense, 16), "key"), classes, docs, text, k, percent)
        rest = rest.unionByName(again.withColumn("prefix", F.lit(True)))
    rest = rest.join(classes.select("id", "keys", "sig"), "id")
    # a large key is dealt to parts, and every two parts are a block: BLOCK members on either side at most, about
    parts = F.ceil(F.col("members") / BLOCK).cast("int")
    rest = rest.withColumn("part", F.pmod(F.xxhash64("id", "key"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    side = F.when(F.col("part") <= F.col("other"), 0).otherwise(1)
    at = ("key", "prefix", "bi", "bj")
    rest = rest.select("key", "prefix", F.least("part", "other").alias("bi"), F.greatest("part", "other").alias("bj"), F.struct("id", "n", "comp", "keys", "sig", side.alias("side")).alias("m"))

    def gathered(rows: DataFrame) -> DataFrame:
        blocks = rows.groupBy(*at).agg(F.collect_list("m").alias("members"))
        return blocks.select(*at, F.struct("key", "prefix", "members").alias("block"))

    found = map_texts(gathered(rest), _candidates(percent, minima), f"pairs array<struct<u: long, v: long>>, dense array<struct<{MEMBER}>>")
    found = stage(found, "candidates")
    sparse = confirmed(found.select(F.explode("pairs").alias("p")).select("p.u", "p.v").distinct(), docs, classes, text, k, percent)
    dense = found.select(*at, F.explode("dense").alias("m"))
    sets = shingle_sets(dense.select("m.id").distinct(), docs, classes, text, k)
    dense = dense.join(sets.dropDuplicates(["id"]), F.col("m.id") == F.col("id")).select(*at, F.col("m").withField("shingles", F.col("shingles")).alias("m"))
    close = map_texts(gathered(dense), _linked(percent, minima), "links array<struct<u: long, v: long>>")
    out = stage(sparse.unionByName(close.select(F.explode("links").alias("p")).select("p.u", "p.v")), "more")
    for done in (split, found, sparse, sets):
        discard(done)
    return out


def _classes(signed: DataFrame) -> DataFrame:
    """id (a number), set, n, keys, sig, first (smallest doc_id, null if none), place (of one text), count of each set."""
    first = lambda c: F.first(c).alias(c)
    found = signed.where("n > 0").withColumn("place", F.struct("doc_id", "h1", "h2")).groupBy("set")
    found = found.agg(F.min("doc_id").alias("first"), F.count("*").alias("count"), *map(first, ("n", "keys", "sig", "place")))
    # unique whatever the order of rows; fixed by being written
    return stage(found.withColumn("id", F.monotonically_increasing_id()), "classes")


def _text_links(docs: DataFrame, classes: DataFrame, banding: Banding, text: str, k: int) -> tuple[DataFrame, DataFrame | None]:
    """Confirmed links (u, v) that join classes to components, and the components if these are all their links."""
    percent = banding.percent
    dealt = classes.select("id", "n", F.explode("keys").alias("key"))
    counts = stage(dealt.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), "keys")
    members = stage(dealt.join(counts, "key").select("key", "id", "n", "members"), "members")
    # a key's head is the member that shares the most keys with others: the text that a group's copies were made from
    company = members.groupBy("id").agg(F.sum("members").alias("company"))
    ranked = members.join(company, "id").select("key", F.struct("company", (-F.col("id")).alias("id"), "n").alias("rank"))
    heads = ranked.groupBy("key").agg(F.max("rank").alias("rank")).select("key", (-F.col("rank.id")).alias("head"), F.col("rank.n").alias("hn"))
    headed = stage(join_hot(members, heads, "key", hot=counts.withColumnRenamed("members", "count")), "headed")
    discard(counts)
    discard(members)
    fits = 100 * F.least("n", "hn") >= percent * F.greatest("n", "hn")
    stars = headed.where("id <> head").where(fits).select(F.col("id").alias("u"), F.col("head").alias("v")).distinct()
    links = confirmed(stars, docs, classes, text, k, percent)
    found = components(links)

    # keys whose members are not yet joined
    placed = headed.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("component", "id"))
    placed = stage(placed.select("key", "id", "n", "members", "comp"), "placed")
    discard(headed)
    more = _across(placed, classes, docs, text, k, banding)
    discard(placed)
    return (links, found) if more.isEmpty() else (links.unionByName(more), None)


def _id_links(signed: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Links (u, v) between classes that a doc_id stands in; None if there is no such id."""
    rows = signed.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", "set")
    marks = rows.select("doc_id", F.xxhash64("set").alias("m")).groupBy("doc_id").agg(F.min("m").alias("lo"), F.max("m").alias("hi"))
    shared = stage(marks.where("lo <> hi").select("doc_id"), "shared")
    if shared.isEmpty():
        return None
    rows = stage(rows.join(small(shared, 16), "doc_id").distinct().join(classes.select("set", "id"), "set").select("doc_id", F.col("id").alias("u")), "of_shared")
    return join_hot(rows, rows.groupBy("doc_id").agg(F.min("u").alias("v")), "doc_id").select("u", "v")


def _judged(docs: DataFrame, text: str, k: int, percent: int, by_id: bool) -> DataFrame:
    """doc_id, h1, h2, n, comp (a number, null for empty sets), component_id (smallest doc_id, null if none) of every row."""
    banding = Banding(percent)
    signed = stage(signatures(docs, banding, text, k), "signatures")
    classes = _classes(signed)
    links, found = _text_links(docs, classes, banding, text, k)
    ids = _id_links(signed, classes) if by_id else None
    if found is None or ids is not None:
        found = components(links if ids is None else links.unionByName(ids))
    joined = stage(found.join(classes.select(F.col("id").alias("node"), "first"), "node"), "joined")
    least = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    joined = join_hot(joined, least, "component").select(F.col("node").alias("id"), "component", "component_id")
    named = classes.select("id", "set", "first").join(joined, "id", "left")
    named = named.select("set", F.coalesce("component", "id").alias("comp"), F.when(F.col("component").isNull(), F.col("first")).otherwise(F.col("component_id")).alias("component_id"))
    return join_hot(signed.select("doc_id", "h1", "h2", "n", "set"), small(named, 64), "set", "left", hot=classes.select("set", "count")).drop("set")


def near_duplicates(docs: DataFrame, text: str = "text", k: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept (it is its own component's id)."""
    rows = _judged(docs, text, k, percent, by_id=True)
    component = F.coalesce("component_id", "doc_id")
    kept = F.coalesce(F.col("doc_id") == component, component.isNull())
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"))


def deduplicated(docs: DataFrame, text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component of texts, and all rows without words."""
    rows = _judged(docs, text, k, percent, by_id=False).where("comp IS NOT NULL")
    rows = rows.groupBy("comp", "doc_id", "h1", "h2").agg(F.count("*").alias("times"))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "h2", "times")
    chosen = stage(rows.groupBy("comp").agg(F.min(rank).alias("r")).select("r.*").drop("none"), "chosen")
    worded = F.coalesce(F.col(text).rlike(WORD), F.lit(False))
    marked = docs.withColumns({"__h1": F.xxhash64(text), "__h2": F.xxhash64(F.lit(1), text), "__words": worded})
    keys = chosen.select(F.col("doc_id").alias("__id"), F.col("h1").alias("__k1"), F.col("h2").alias("__k2"), F.col("times").alias("__times"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__h1") == F.col("__k1")) & (F.col("__h2") == F.col("__k2"))
    rows = marked.join(small(keys, 64), same, "left").where("NOT __words OR __times IS NOT NULL")
    if chosen.where("times > 1").isEmpty():
        return rows.select(*docs.columns)
    again = (F.col("__times") > 1) & F.col("__words")
    once = rows.where(~F.coalesce(again, F.lit(False))).select(*docs.columns)
    return once.unionByName(rows.where(again).dropDuplicates(["doc_id", "__h1", "__h2"]).select(*docs.columns))
