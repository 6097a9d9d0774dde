"""The mix beyond max_patterns against the driver's, and its flow against brute force."""

import itertools
import random

import pytest

from docloom.llm import common, mixing

SCHEMA = "doc_id long, size long, sources array<string>"


def rows_of(seed, overlap):
    rng = random.Random(seed)
    names = [f"s{i}" for i in range(9)] + [None]
    rows = []
    for d in range(300):
        own = rng.choice(names[: 4 if d % 3 else 10])
        more = [rng.choice(names)] if overlap and d % 4 == 0 else []
        rows.append((d if d % 50 else None, rng.randrange(0, 40), [own, *(m for m in more if m != own)]))
    return rows


@pytest.mark.parametrize(("seed", "overlap", "floor"), [(1, False, 0.0), (2, True, 0.0), (3, True, 1.0)])
def test_both_ways_agree(spark, seed, overlap, floor):
    docs = spark.createDataFrame(rows_of(seed, overlap), SCHEMA)
    one = mixing.mix(docs, floor=floor, bucket_docs=20).collect()
    other = mixing.mix(docs, floor=floor, bucket_docs=20, max_patterns=3).collect()
    whole = lambda rows: sorted(str((r.doc_id, r.size, r.sources, r.source, r.source_size, round(r.target, 6), r.copies, r.taken)) for r in rows)
    assert whole(one) == whole(other) and len(one) == 300
    # totals per source, whichever of several equal flows was found
    assert sum(r.taken for r in one) == sum(r.taken for r in other)


def test_hot_patterns(spark):
    docs = spark.createDataFrame(rows_of(4, False), SCHEMA)
    want = sorted(str(tuple(r)) for r in mixing.mix(docs, bucket_docs=20).collect())
    old, common.HOT_ROWS = common.HOT_ROWS, 10
    try:
        assert sorted(str(tuple(r)) for r in mixing.mix(docs, bucket_docs=20).collect()) == want
    finally:
        common.HOT_ROWS = old


def test_flow_is_of_least_cost():
    """All that can be met is met, with the fewest words taken a second time (brute force over small networks)."""
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randint(1, 3)
        patterns = [(sorted(rng.sample(range(n), rng.randint(1, n))), rng.randint(0, 2)) for _ in range(rng.randint(1, 3))]
        wanted = [rng.randint(0, 3) for _ in range(n)]
        sent = mixing.min_cost_flow(patterns, wanted, 2)
        arcs = [(p, s) for p, (sources, _) in enumerate(patterns) for s in sources]
        best = None
        for amounts in itertools.product(*(range(min(2 * patterns[p][1], wanted[s]) + 1) for p, s in arcs)):
            used = [sum(a for a, (q, _) in zip(amounts, arcs, strict=True) if q == p) for p in range(len(patterns))]
            met = [sum(a for a, (_, t) in zip(amounts, arcs, strict=True) if t == s) for s in range(n)]
            if all(u <= 2 * w for u, (_, w) in zip(used, patterns, strict=True)) and all(m <= w for m, w in zip(met, wanted, strict=True)):
                cost = (-sum(met), sum(max(0, u - w) for u, (_, w) in zip(used, patterns, strict=True)))
                best = cost if best is None else min(best, cost)
        used = [sum(f.values()) for f in sent]
        assert (-sum(used), sum(max(0, u - w) for u, (_, w) in zip(used, patterns, strict=True))) == best
