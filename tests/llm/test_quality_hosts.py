"""Host verdicts against a plain version, on hosts that fail at many rates; symbols; the prior's moments."""

import math
import random
import re

import pytest

from docloom.llm import quality_rules
from docloom.llm.quality_rules import Limits

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    rng = random.Random(9)
    rows = []
    for h in range(14):
        rate = (0.02, 0.05, 0.1, 0.97, 0.6, 0.08, 0.04)[h % 7]
        for _ in range((5, 40, 200)[h % 3]):
            kind = rng.random()
            if kind < rate:
                text = rng.choice(["too short", " ".join(["again and again"] * 40), " ".join(f"w{i} ## $$" for i in range(60))])
            else:
                n = rng.choice([55, 80, 120, 300])
                text = " ".join(f"word{rng.randrange(10**6)}" for _ in range(n)) + rng.choice(["", " ##", " # * # * # *"])
            rows.append((len(rows), text, None if h == 13 else f"host{h}"))
    return rows


def plain(rows, limits=Limits()):
    """Verdicts and kept ids by hand."""
    measured = {d: (quality_rules.measure(t), h) for d, t, h in rows}

    def failed(m, strict):
        n, _, symbols, _, repeat = m
        return n < strict * limits.min_words or strict * 100 * repeat > limits.max_repeat * n or strict * limits.symbol_words * symbols > n

    hosts = {}
    for m, h in measured.values():
        hosts.setdefault(h, []).append(failed(m, 1))
    n, f = {h: len(x) for h, x in hosts.items()}, {h: sum(x) for h, x in hosts.items()}
    total, k = sum(n.values()), len(n)
    mean = sum(f.values()) / total
    spread = sum(n[h] * (f[h] / n[h] - mean) ** 2 for h in n)
    rest = total - sum(x * x for x in n.values()) / total - (k - 1)
    rho = (spread - mean * (1 - mean) * (k - 1)) / (mean * (1 - mean) * rest)
    strength = 1 / min(0.5, max(1e-6, rho)) - 1
    far = max(limits.suspect_rate, mean + 2 * math.sqrt(mean * (1 - mean) / (strength + 1)))
    verdict = {}
    for h in n:
        rate = (f[h] + mean * strength) / (n[h] + strength)
        verdict[h] = "rejected" if rate >= limits.host_rate else "suspect" if rate >= far else None
    kept = {d for d, (m, h) in measured.items() if not failed(m, 1) and verdict[h] != "rejected" and not (verdict[h] == "suspect" and failed(m, 2))}
    return verdict, kept, {d for d, (m, _) in measured.items() if not failed(m, 1)}


@pytest.mark.parametrize("limits", [Limits(), Limits(host_rate=0.55, suspect_rate=0.05)])
def test_verdicts(spark, limits):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    verdict, kept, passing = plain(rows, limits)
    got = quality_rules.judge(docs, limits=limits).collect()
    assert {r.host: r.host_verdict for r in got} == verdict
    assert {r.doc_id for r in got if r.kept} == kept
    assert kept < passing and "rejected" in verdict.values()
    assert {r.doc_id for r in quality_rules.filtered(docs, limits=limits).collect()} == kept


def test_a_suspect_host_keeps_its_clear_documents(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(200 if i % 2 else 60)), "mixed") for i in range(40)]
    rows += [(100 + i, "short", "mixed") for i in range(40)]
    rows += [(1000 + i, " ".join(f"v{i}x{k}" for k in range(60)), f"h{i % 30}") for i in range(3000)]
    verdict, kept, _ = plain(rows)
    got = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert verdict["mixed"] == "suspect" and {r.doc_id for r in got if r.kept} == kept
    assert {r.doc_id for r in got if r.kept and r.host == "mixed"} == {i for i in range(40) if i % 2}


def test_symbols(spark):
    text = " ".join(f"word{i}" for i in range(99))
    rows = [(1, text + " #########", "s"), (2, text + " #*$%&|<>#*#", "s"), (3, text, "s")]
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert (got[1].n_symbols, got[1].kept) == (9, True) and (got[2].n_symbols, got[2].kept, got[2].base_failed) == (11, False, False) and got[3].kept
