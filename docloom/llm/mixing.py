"""Mixing sources to target weights by min-cost flow over membership patterns.

A document may belong to several sources. Documents are aggregated by membership pattern (the sorted set of their
sources); patterns and sources form a flow network: a pattern offers its words once at cost 0, a second time at cost 1
and so on (convex repetition costs), and each source asks for its target. Documents of a pattern are then laid out in a
seeded order; the flow cuts that line, whole documents on one side of a cut get one repetition more.

Up to `max_patterns` patterns and sources the network is solved on the driver. Beyond that targets are found by sums over
the table of sources, sources that no pattern joins to others take their flow by an expression, and the network of the
others is solved for each connected component of sources by itself, on executors. The results are the same.

The seeded order never sorts a whole source in one task: a uniform hash deals documents to buckets of about
`bucket_docs`, buckets are summed, and only the order inside a bucket is sorted.

Defined cases: null text has size 0; a null source is a source, last in order; equal doc_ids are separate documents
whose order among themselves follows their size; no rows or no words give no targets above 0; other columns are kept
out.
"""

from __future__ import annotations

import math
from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import WORD, join_hot, local_table, map_texts, small, stage
from docloom.llm.near_dup import components


def cycle_weights(n: int, weights: tuple[float, ...] = (3, 1, 2)) -> list[float]:
    return [weights[i % len(weights)] for i in range(n)]


def targets(sizes: list[int], weights: list[float], share: float = 1.5, most: float = 2.0, floor: float = 0.0) -> list[float]:
    """Words for each source: share * all words dealt by weight between floor and most times each source's size.

    What a source can't take is dealt again by weight among the others until no target is above its limit.
    """
    base = [floor * s for s in sizes]
    left, room = share * sum(sizes) - sum(base), [(most - floor) * s for s in sizes]
    got, active = [0.0] * len(sizes), set(range(len(sizes)))
    while active and left > 0:
        per = left / sum(weights[i] for i in sorted(active))
        full = [i for i in sorted(active) if per * weights[i] > room[i]]
        if not full:
            for i in active:
                got[i] = per * weights[i]
            break
        for i in full:
            got[i] = room[i]
            left -= room[i]
            active.discard(i)
    return [b + g for b, g in zip(base, got, strict=True)]


def min_cost_flow(patterns: list[tuple[list[int], int]], wanted: list[int], repeats: int) -> list[dict[int, int]]:
    """Words that each pattern sends to each of its sources, by successive shortest augmenting paths.

    patterns: (sources, words). A path's cost is the number of repetitions of the pattern at its start; taking words
    back from another source on the way is free, so a path of least cost is found by a breadth-first search from the
    sources with unmet demand, pass by pass of the repetition count.
    """
    sent: list[dict[int, int]] = [dict.fromkeys(s, 0) for s, _ in patterns]
    of = [[] for _ in wanted]  # patterns of a source
    for p, (sources, _) in enumerate(patterns):
        for s in sources:
            of[s].append(p)
    unmet, used = list(wanted), [0] * len(patterns)
    for level in range(1, repeats + 1):
        free = [size * level - u for (_, size), u in zip(patterns, used, strict=True)]
        for s in range(len(wanted)):
            while unmet[s] > 0:
                # from source s back to a pattern with free words; a visited source gives up words of a shared pattern
                came: dict[int, tuple[int, int]] = {}
                seen, queue, end = {s}, deque([s]), -1
                while queue and end < 0:
                    at = queue.popleft()
                    for p in of[at]:
                        if p in came:
                            continue
                        came[p] = (at, -1)
                        if free[p] > 0:
                            end = p
                            break
                        for other, words in sent[p].items():
                            if words > 0 and other not in seen:
                                seen.add(other)
                                came[-1 - other] = (p, other)
                                queue.append(other)
                if end < 0:
                    break
                path, p = [], end
                while True:
                    at = came[p][0]
                    path.append((p, at))
                    if at == s:
                        break
                    p = came[-1 - at][0]
                amount = min([unmet[s], free[end], *(sent[q][at] for (_, at), (q, _) in zip(path, path[1:], strict=False))])
                for k, (p, at) in enumerate(path):
                    sent[p][at] += amount
                    if k + 1 < len(path):
                        sent[path[k + 1][0]][at] -= amount
                free[end] -= amount
                used[end] += amount
                unmet[s] -= amount
    return sent


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


_PARTS = "array<struct<source: string, words: long>>"


def _driver_plan(found: list, owned: list, share: float, most: int, floor: float, weights: tuple[float, ...]) -> tuple[list, list]:
    """(pattern, flow, parts) rows and (source, source_size, target) rows."""
    names = sorted({s for r in found for s in r.pattern} | {r.source for r in owned}, key=lambda s: (s is None, s or ""))
    number, size_of = {s: i for i, s in enumerate(names)}, {r.source: r.words for r in owned}
    sizes = [size_of.get(s, 0) for s in names]
    goal = targets(sizes, cycle_weights(len(names), weights), share, most, floor)
    found.sort(key=lambda r: [(s is None, s or "") for s in r.pattern])
    sent = min_cost_flow([([number[s] for s in r.pattern], r.words) for r in found], [round(g) for g in goal], most)
    flows = [(r.pattern, sum(f.values()), [{"source": names[i], "words": w} for i, w in sorted(f.items()) if w]) for r, f in zip(found, sent, strict=True)]
    return flows, [(s, z, float(g)) for s, z, g in zip(names, sizes, goal, strict=True)]


def _numbered(sources: DataFrame) -> DataFrame:
    """sources (source, words) with their number in order, null last, from 0: sorted in ranges."""
    none = F.col("source").isNull()
    dealt = stage(sources.withColumn("none", none).repartitionByRange("none", "source").withColumn("range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # a row per range
    offsets = dealt.groupBy("range").agg(F.count("*").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("range").orderBy("none", "source")
    rows = dealt.join(F.broadcast(offsets), "range").withColumn("i", F.col("offset") + F.row_number().over(within) - 1)
    return stage(rows.select("source", "words", "i"), "numbered")


def _spread_targets(sources: DataFrame, share: float, most: float, floor: float, weights: tuple[float, ...]) -> DataFrame:
    """source, words, i, target: as targets() deals them, by sums over the table of sources."""
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("i") % len(weights) + 1).cast("int"))
    rows = _numbered(sources).withColumns({"weight": weight, "room": (most - floor) * F.col("words")})
    total = rows.agg(F.sum("words")).first()[0] or 0
    left, per = (share - floor) * total, 0.0
    while left > 0:
        full = F.col("room") < per * F.col("weight")
        r = rows.agg(F.sum(F.when(full, F.col("room")).otherwise(0.0)).alias("held"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open")).first()
        after = (left - r.held) / r.open if r.open else math.inf
        if after <= per or after == math.inf:
            per = max(per, after)
            break
        per = after
    got = F.least(F.lit(per) * F.col("weight"), "room") if left > 0 else F.lit(0.0)
    return stage(rows.select("source", "words", "i", (floor * F.col("words") + got).alias("target")), "targets")


def _spread_plan(totals: DataFrame, own: DataFrame, share: float, most: int, floor: float, weights: tuple[float, ...]) -> tuple[DataFrame, DataFrame]:
    """What _driver_plan finds, as tables."""
    named = totals.select(F.explode("pattern").alias("source")).distinct().withColumn("words", F.lit(0).cast("long"))
    sources = own.unionByName(named).groupBy("source").agg(F.sum("words").alias("words"))
    aims = _spread_targets(sources, share, most, floor, weights)
    goal = F.rint("target").cast("long")
    # networks: components of sources that some pattern joins
    joined = totals.where(F.size("pattern") > 1).select("pattern", F.explode("pattern").alias("source"))
    ends = joined.join(aims, joined["source"].eqNullSafe(aims["source"])).groupBy("pattern").agg(F.min("i").alias("v"), F.collect_set("i").alias("all"))
    net = components(ends.select(F.explode("all").alias("u"), "v"))
    placed = aims.join(net.withColumnRenamed("node", "i"), "i", "left").withColumn("goal", goal)
    members = totals.select("pattern", "words", F.explode("pattern").alias("source")).join(placed.select(F.col("source").alias("s"), "i", "goal", "component"), F.col("source").eqNullSafe(F.col("s")))
    members = members.select("pattern", "words", "source", "i", "goal", "component")

    flow = F.least(F.col("goal"), most * F.col("words"))
    alone = members.where("component IS NULL").select("pattern", flow.alias("flow"), F.when(flow > 0, F.array(F.struct("source", flow.alias("words")))).otherwise(F.array()).cast(_PARTS).alias("parts"))
    grouped = members.where("component IS NOT NULL").groupBy("component", "pattern", "words").agg(F.array_sort(F.collect_list(F.struct("i", "source", "goal"))).alias("sources"))
    grouped = grouped.groupBy("component").agg(F.collect_list(F.struct("pattern", "words", "sources")).alias("net"))

    def solved(nets: list) -> list:
        out = []
        for net in nets:
            net.sort(key=lambda p: [s["i"] for s in p["sources"]])
            known = {s["i"]: s for p in net for s in p["sources"]}
            order = sorted(known)
            number = {i: k for k, i in enumerate(order)}
            sent = min_cost_flow([([number[s["i"]] for s in p["sources"]], p["words"]) for p in net], [known[i]["goal"] for i in order], most)
            out.append([{"pattern": p["pattern"], "flow": sum(f.values()), "parts": [{"source": known[order[k]]["source"], "words": w} for k, w in sorted(f.items()) if w]} for p, f in zip(net, sent, strict=True)])
        return [out]

    flows = map_texts(grouped, solved, f"flows array<struct<pattern: array<string>, flow: long, parts: {_PARTS}>>")
    flows = stage(alone.unionByName(flows.select(F.explode("flows").alias("f")).select("f.pattern", "f.flow", "f.parts")), "flows")
    return flows, aims.select("source", F.col("words").alias("source_size"), "target")


def mix(sized: DataFrame, share: float = 1.5, most: int = 2, floor: float = 0.0, weights: tuple[float, ...] = (3, 1, 2), seed: int = 17, bucket_docs: int = 4096, max_patterns: int = 100_000) -> DataFrame:
    """sized: doc_id, size (long), sources (array of string, its own first). Adds source_size and target (of the first
    source), copies, taken (size * copies) and given (source, words: what the document gives to each source).
    """
    spark = sized.sparkSession
    sized = sized.select("doc_id", "size", F.coalesce("sources", F.array(F.lit(None).cast("string"))).alias("sources"))
    sized = stage(sized.withColumns({"pattern": F.array_sort(F.array_distinct("sources")), "own": F.slice("sources", 1, 1)}), "sized")
    totals = stage(sized.groupBy("pattern").agg(F.sum("size").alias("words"), F.count("*").alias("docs")), "patterns")
    own = sized.groupBy("own").agg(F.sum("size").alias("words"), F.count("*").alias("docs"))
    own = stage(own.select(F.col("own")[0].alias("source"), "words", "docs"), "own")
    if max(totals.count(), own.count()) <= max_patterns:
        flows, aims = _driver_plan(totals.collect(), own.collect(), share, most, floor, weights)
        flows = local_table(spark, flows, f"pattern array<string>, flow long, parts {_PARTS}")
        aims = local_table(spark, aims, "source string, source_size long, target double")
    else:
        flows, aims = _spread_plan(totals, own.select("source", "words"), share, most, floor, weights)
    flows = totals.select("pattern", "words", F.greatest(F.lit(1), F.ceil(F.col("docs") / bucket_docs)).cast("long").alias("buckets")).join(flows, "pattern")

    # position of each document on its pattern's seeded line
    rows = join_hot(sized, small(flows, 256), "pattern", hot=totals.select("pattern", F.col("docs").alias("count")))
    rows = rows.withColumns({"order": F.xxhash64(F.lit(seed), "doc_id"), "bucket": F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "size"), F.col("buckets"))})
    within = Window.partitionBy("pattern", "bucket").orderBy("order", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bucket_sums = rows.groupBy("pattern", "bucket").agg(F.sum("size").alias("sum")).withColumn("offset", F.coalesce(F.sum("sum").over(before), F.lit(0))).select(F.col("pattern").alias("p"), F.col("bucket").alias("b"), "offset")
    rows = rows.withColumn("upto", F.sum("size").over(within))
    rows = rows.join(bucket_sums, (F.col("pattern") == F.col("p")) & (F.col("bucket") == F.col("b"))).withColumn("at", F.col("offset") + F.col("upto") - F.col("size"))

    # whole repetitions, and one more for documents whose middle lies before the cut
    whole = F.when(F.col("words") > 0, F.expr("flow div words")).otherwise(F.lit(0))
    more = (2 * F.col("at") + F.col("size") <= 2 * (F.col("flow") - whole * F.col("words"))) & (whole < most)
    copies = (whole + more.cast("long")).cast("long")
    rows = rows.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(F.lit(1 if floor >= 1 else 0)).cast("long"))

    # copy k of a document lies at k * words + at on the line; parts are laid along it in order
    ends = F.expr("transform(parts, (x, i) -> named_struct('source', x.source, 'end', aggregate(slice(parts, 1, i + 1), 0L, (a, y) -> a + y.words)))")
    rows = rows.withColumn("ends", ends)
    given = F.expr("transform(if(copies > 0, sequence(0L, copies - 1), array()), k -> named_struct('source', coalesce(element_at(filter(ends, e -> 2 * (k * words + at) + size <= 2 * e.end), 1).source, element_at(ends, -1).source), 'words', size))")
    rows = rows.withColumn("given", F.when(F.size("ends") > 0, given))
    aims = aims.select(F.array("source").alias("own"), "source", "source_size", "target")
    rows = join_hot(rows, small(aims, 64), "own", hot=own.select(F.array("source").alias("own"), F.col("docs").alias("count")))
    return rows.select("doc_id", "size", "sources", "source", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), "given")


def mixed_documents(docs: DataFrame, **kwargs) -> DataFrame:
    """docs as the mix takes them: a document that it takes twice stands twice, one it leaves out goes.

    Documents are matched to the mix by doc_id; rows that share a doc_id take the most copies of any of them.
    """
    sized = docs.select("doc_id", word_count("text").alias("size"), F.array("source").alias("sources"))
    taken = mix(sized, **kwargs).groupBy(F.col("doc_id").alias("__id")).agg(F.max("copies").alias("__copies"))
    taken = stage(taken, "taken")
    # rows without an id share one row, apart from the others, who may be joined by a shuffle
    none = docs.where("doc_id IS NULL").crossJoin(F.broadcast(taken.where("__id IS NULL")))
    rows = docs.join(small(taken, 24), F.col("doc_id") == F.col("__id")).unionByName(none).where("__copies > 0")
    return rows.select("*", F.explode(F.expr("sequence(1L, __copies)")).alias("__copy")).select(*docs.columns)
