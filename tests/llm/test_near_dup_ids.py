"""Near-duplicates where ids are missing or shared, hot groups, and joins by hot keys."""

from docloom.llm import common, near_dup

SCHEMA = "doc_id long, text string, h1 string"


def words(tag, n=40, changed=()):
    return " ".join(f"{tag}{i}" if i not in changed else f"new{tag}{i}" for i in range(n))


def test_shared_ids_join_components(spark):
    rows = [(3, words("a"), "x"), (3, words("b"), "x"), (1, words("a", changed=(39,)), "x"), (2, words("b", changed=(39,)), "x"), (9, words("c"), "x")]
    got = {(r.doc_id, r.component_id, r.kept) for r in near_dup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(3, 1, False), (1, 1, True), (2, 1, False), (9, 9, True)}


def test_deduplicated_goes_by_texts(spark):
    rows = [(3, words("a"), "x"), (3, words("b"), "y"), (3, words("b"), "z"), (4, words("b"), "w"), (None, words("c"), "x"), (None, words("c", changed=(39,)), "x"), (None, words("d"), "x"), (7, words("d"), "x"), (8, "", "x"), (8, "", "x"), (None, None, "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = near_dup.deduplicated(docs).collect()
    assert sorted((r.doc_id or 0, (r.text or "")[:2]) for r in kept) == [(0, ""), (0, "c0"), (3, "a0"), (3, "b0"), (7, "d0"), (8, ""), (8, "")]


def test_many_copies_without_ids_and_hot_keys(spark):
    old, common.HOT_ROWS = common.HOT_ROWS, 20
    try:
        rows = [(None if i % 2 else i, words("a", 60, changed=(i % 60,) if i % 3 else ()), "x") for i in range(150)] + [(1000 + i, words("a", 60), "x") for i in range(60)]
        docs = spark.createDataFrame(rows, SCHEMA)
        got = near_dup.near_duplicates(docs).collect()
        assert len(got) == len(rows) and {r.component_id for r in got} == {0}
        assert sum(r.kept for r in got) == 1 and near_dup.deduplicated(docs).count() == 1
    finally:
        common.HOT_ROWS = old


def test_join_hot(spark):
    old, common.HOT_ROWS = common.HOT_ROWS, 10
    try:
        many = spark.createDataFrame([(0, i) for i in range(95)] + [(k, k) for k in range(1, 30)] + [(99, 1)], "k long, x long")
        one = spark.createDataFrame([(k, k * 2) for k in range(30)], "k long, y long")
        want = sorted(tuple(r) for r in many.join(one, "k").select("k", "x", "y").collect())
        assert sorted(tuple(r) for r in common.join_hot(many, one, "k").select("k", "x", "y").collect()) == want
        assert common.join_hot(many, one, "k", "left").count() == 125
    finally:
        common.HOT_ROWS = old


def test_boilerplate_family(spark, monkeypatch):
    """Texts of one long boilerplate with parts of their own: few links among many texts that share keys."""
    import random

    from tests.llm.test_brute_force import linked, shingles

    rng = random.Random(6)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for d in range(240):
        own = [f"own{d}_{i}" for i in range(rng.choice([10, 22, 30]))]
        if d % 12 == 5:
            own = [w if rng.random() < 0.9 else "other" for w in rows[-1][1].split()[150:]]
        rows.append((d, " ".join(base + own), "x"))
    want = linked({d: shingles(t, 3) for d, t, _ in rows}, 85)
    assert 10 < len(set(want.values())) < 240
    docs = spark.createDataFrame(rows, SCHEMA)
    whole = lambda: {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs).collect()}
    assert whole() == want
    calls, real = [], near_dup._prefixes
    monkeypatch.setattr(near_dup, "DENSE", 20)
    monkeypatch.setattr(near_dup, "_prefixes", lambda *a: calls.append(1) or real(*a))
    assert whole() == want and calls
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    assert whole() == want
