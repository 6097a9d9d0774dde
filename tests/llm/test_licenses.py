"""License scans: edited copies in long texts against exact windows, rows without or with shared ids, what bands leave."""

import random
import re

from pyspark.sql import functions as F

from docloom.llm import license_scan


def exact(text, containment=0.8):
    """license: best containment over all windows, by brute force."""
    words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    found = [" ".join(words[i : i + 5]) for i in range(len(words) - 4)]
    known, out = {}, {}
    for name, s, m, scale in license_scan.template_shingles(license_scan.TEMPLATES):
        known.setdefault(name, (set(), m, scale))[0].add(s)
    for name, (own, m, scale) in known.items():
        best = max((len(own & set(found[a : a + 2 * scale])) / m for a in range(0, max(len(found), 1), scale)), default=0)
        if best >= containment:
            out[name] = best
    return out


def edited(rng):
    name = rng.choice(sorted(license_scan.TEMPLATES))
    words = license_scan.TEMPLATES[name].split()
    for _ in range(rng.randrange(0, 4)):
        words[rng.randrange(len(words))] = rng.choice(["altered", "", "two words"])
    before, after = (" ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(0, 300))) for _ in range(2))
    return f"{before} {' '.join(words)} {after}"


def test_planted_edits_are_all_found(spark):
    rng = random.Random(8)
    rows = [(i, edited(rng)) for i in range(250)]
    want = {(i, name): share for i, text in rows for name, share in exact(text).items()}
    got = license_scan.licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(want) > 120 and {(r.doc_id, r.license): r.containment for r in got} == want and len(got) == len(want)


def test_rows_are_scanned_one_by_one(spark):
    words = license_scan.TEMPLATES["MIT"].split()
    half = len(words) // 2
    rows = [(1, " ".join(words[:half])), (1, " ".join(words[half:])), (None, " ".join(words)), (None, " ".join(words)), (7, " ".join(words)), (7, "plain")]
    got = sorted((r.doc_id or 0, r.license) for r in license_scan.licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, "MIT"), (0, "MIT"), (7, "MIT")]


def test_bands_retrieve_few_of_the_windows(spark):
    """A window that shares a passage with a template, but little else, is cut out and sketched, and rarely retrieved."""
    rng = random.Random(3)
    words = license_scan.TEMPLATES["BSD-3-Clause"].split()
    rows = [(i, " ".join(words[(a := rng.randrange(0, 60)) : a + 12] + [f"w{rng.randrange(10**6)}" for _ in range(400)])) for i in range(60)]
    known = license_scan._template_table(spark, license_scan.TEMPLATES, 5).where("license = 'BSD-3-Clause'")
    cut = license_scan.windows(spark.createDataFrame(rows, "doc_id long, text string"), known)
    sketched = license_scan.sketched(cut.select("row", "scale", "window", F.explode("held").alias("shingle")), "row", "scale", "window")
    theirs = license_scan.sketched(known, "license", "scale")
    retrieved = sketched.join(theirs, ["scale", "band", "minimum"]).select("row", "window").distinct().count()
    assert 0 < cut.count() and retrieved <= cut.count()
    agreed = sketched.join(theirs, ["scale", "band", "minimum"]).count() / (cut.count() * license_scan.BANDS)
    assert agreed < 0.12


def test_texts_without_a_templates_words_are_left_out_unsplit(spark, monkeypatch):
    taken, shingled = [], license_scan.shingled
    monkeypatch.setattr(license_scan, "shingled", lambda docs, *a: taken.append(docs.count()) or shingled(docs, *a))
    rows = [(i, " ".join(f"w{(i * 7 + j) % 90}" for j in range(60))) for i in range(40)] + [(40, license_scan.TEMPLATES["ISC"].upper()), (41, None), (42, "")]
    got = license_scan.licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.doc_id, r.license) for r in got] == [(40, "ISC")] and taken == [1]


def test_what_contains_enough_of_a_template_holds_a_mark():
    rng = random.Random(5)
    for containment in (0.0, 0.3, 0.8, 1.0):
        for own in ({"one": license_scan.TEMPLATES["MIT"]}, license_scan.TEMPLATES, {"a": "x y z x y z x y", "b": "too short", "c": "v 2 0 if a copy"}):
            found = license_scan.template_shingles(own)
            marks = license_scan.marks(found, containment)
            by: dict = {}
            for name, s, m, _ in found:
                by.setdefault(name, (m, []))[1].append(s)
            for m, shingles in by.values():
                # the fewest that may be found, and those without a mark first: the worst choice
                least = max(1, next(h for h in range(m + 1) if h / m >= containment))
                rng.shuffle(shingles)
                worst = sorted(shingles, key=lambda s: any(w in s for w in marks))[:least]
                assert any(w in s for s in worst for w in marks)
