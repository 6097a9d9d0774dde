from pyspark.sql import functions as F

from docloom.operators import entities, index

TEXT = "Under Section 302 of the Indian Penal Code the Supreme Court of India, in AIR 1973 SC 1461, on 12 March 2001 held Article 21 of the Constitution of India. Justice R.M. Lodha granted bail; fine of Rs. 5,000."


def spans(spark, text, strict=False):
    rows = spark.createDataFrame([(text,)], "t string").select(entities.extract_spans("t", strict).alias("e"))
    return [(e.label, e.text) for e in rows.first().e]


def test_labels(spark):
    got = spans(spark, TEXT)
    assert ("STATUTE", "Section 302 of the Indian Penal Code") in got and ("COURT", "Supreme Court of India") in got and ("DATE", "12 March 2001") in got
    assert ("PROVISION", "Article 21 of the Constitution of India") in got and ("JUDGE", "Justice R.M. Lodha") in got and ("LEGAL_ACTION", "bail") in got and ("CASE_CITATION", "AIR 1973 SC 1461") in got


def test_matches_inside_words_unless_strict(spark):
    assert ("COURT", "cat") in spans(spark, "education") and spans(spark, "education", strict=True) == []
    assert spans(spark, None) == [] and spans(spark, "") == []


def test_native_matches_equal_spans(spark, sf):
    from docloom.plans import catalog

    docs = catalog.documents(spark, sf, catalog.LEGAL)
    a = docs.select("doc_id", F.explode(entities.extract_spans("text")).alias("e")).groupBy("doc_id", "e.label", "e.text").count()
    b = entities.matches(docs, "doc_id").groupBy("doc_id", "label", "text").count()
    assert a.exceptAll(b).count() == 0 == b.exceptAll(a).count()


def test_first_characters_rule_out_no_match(spark):
    """Every alternative, in forms that fold to it, with and without the look ahead."""
    courts = ["Hon'ble Supreme Court of India", "Honble High Court of Delhi", "District Court of Pune", "Sessions Court", "Magistrate's Court", "National Company Law Tribunal", "NCLAT", "NCLT", "NGT", "SAT", "CAT", "ITAT", "CESTAT", "Civil Court", "Criminal Court", "Family Court", "Labour Court"]
    actions = "bail|anticipatory bail|regular bail|appeal|cross-appeal|special leave petition|writ petition|habeas corpus|FIR|first information report|chargesheet|charge sheet|conviction|acquittal|sentence|sentencing|remand|parole|probation|injunction|stay order|interim order|review petition|curative petition|arbitration|mediation|conciliation|summons|warrant|notice|plea bargain|plea bargaining|cognizable offence|non cognizable|bailable|non-bailable".split("|")
    dates = [f"{m} 3, 1999" for m in "January February March April May June July August September October November December".split()] + ["3rd May 2001", "\u0663 May 2001", "12/03/2001"]
    parties = "the accused|appellant|respondents|petitioner|defendant|plaintiff|complainant|accused|prosecution|applicant|opposite party|intervener|claimant|counter-claimant|counterclaimant".split("|")
    judges = ["Hon'ble Justice R. Lodha", "Honourable Chief Justice A. B. Rao", "Chief Justice Dr. X. Sen", "Justice R.M. Lodha", "J. Rao", "J, and J. Rao"]
    plain = {"PARTY": parties, "JUDGE": judges, "COURT": courts, "LEGAL_ACTION": actions, "DATE": dates}
    folded = lambda t: {t, t.lower(), t.upper(), t.swapcase(), *(t.lower().replace(a, b) for a, b in (("s", "\u017f"), ("i", "\u0131"), ("i", "\u0130"), ("k", "\u212a")))}
    rows = [(label, f"x {v} {v}x,{v}\n{v}") for label, texts in plain.items() for t in texts for v in folded(t)]
    docs = spark.createDataFrame(rows, "want string, t string")
    for label, pattern, fold in entities.ENTITY_PATTERNS:
        for strict in (False, True):
            bounded = entities._bounded(label, pattern, strict)
            got, want = (F.regexp_extract_all("t", F.lit(p), F.lit(0)) for p in (entities.jvm_pattern(bounded, fold, label), entities.jvm_pattern(bounded, fold)))
            assert docs.where(got != want).count() == 0
            assert docs.where((F.col("want") == label) & (F.col("t") == F.lower("t")) & (F.size(want) == 0) & (F.col("want") != "JUDGE")).count() == 0 or strict


def test_offsets_are_unstripped(spark):
    e = spark.createDataFrame([("x imprisonment for life",)], "t string").select(F.explode(entities.extract_spans("t")).alias("e")).select("e.*").collect()
    assert [(r.text, r.start, r.end) for r in e if r.label == "PENALTY"] == [("imprisonment for life", 1, 23)]


def test_merge_keeps_first(spark):
    rows = spark.createDataFrame([([("Bail", "X", 0, 4, "a"), ("bail", "X", 5, 9, "b"), ("bail", "Y", 5, 9, "b")],)], "e array<struct<text: string, label: string, start: int, end: int, source: string>>")
    assert [(x.text, x.label) for x in rows.select(entities.merge(F.col("e"), F.col("e")).alias("m")).first().m] == [("Bail", "X"), ("bail", "Y")]


def test_canonical(spark):
    cases = [("Sec. 302", "STATUTE", "SECTION_302"), ("Section 302 of the IPC", "STATUTE", "SECTION_302_IPC"), ("Article 21", "PROVISION", "ARTICLE_21"), ("High Court of Delhi", "COURT", "HIGH_COURT_DELHI"), ("Justice R.M. Lodha", "JUDGE", "JUSTICE_RM_LODHA"), ("Hon'ble Chief Justice X", "JUDGE", "JUSTICE_HON'BLE_X"), ("habeas corpus", "LEGAL_ACTION", "HABEAS_CORPUS")]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, t string, l string, want string")
    got = rows.select("i", "want", entities.canonical(F.col("t"), F.col("l")).alias("got")).orderBy("i").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_model_labels(spark):
    cases = [("ORG", "High Court", "COURT"), ("ORG", "Acme", "ORG"), ("PERSON", "Justice X", "JUDGE"), ("PERSON", "CJ, Y", "JUDGE"), ("LAW", "Act", "STATUTE"), ("NORP", "x", None), ("EVENT", "x", "EVENT")]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, l string, t string, want string")
    assert [r.got == r.want for r in rows.select("want", entities.model_label(F.col("l"), F.col("t")).alias("got")).collect()] == [True] * len(cases)
    assert spans(spark, "") == []


def test_plugged_model(spark):
    import pandas as pd

    def load():
        return lambda texts: pd.Series([[{"text": t.split()[0], "label": "ORG", "start": 0, "end": 5, "source": ""}, {"text": "12", "label": "CARDINAL", "start": 0, "end": 2, "source": ""}] for t in texts])

    got = spark.createDataFrame([("Court of x",)], "t string").select(entities.extract_with_model("t", load).alias("e")).first().e
    assert [(e.text, e.label) for e in got] == [("Court", "COURT")]


def test_index(spark):
    m = spark.createDataFrame([("c1", "COURT", "Supreme Court", 0), ("c1", "ORG", "supreme court ", 1), ("c2", "ACT", "The Evidence Act 1872", 0), ("c3", "ACT", "the evidence act", 0)], "chunk_id string, label string, text string, pos int")
    p, labels = index.postings(m).cache(), index.labels(m)
    assert {(r.key, r.chunk_id, r.label) for r in p.collect()} == {("supreme court", "c1", "COURT"), ("the evidence act 1872", "c2", "ACT"), ("the evidence act", "c3", "ACT")}
    assert {(r.name, r.value) for r in index.statistics(p, labels).collect()} == {("total_entities", 3), ("total_postings", 3), ("label:COURT", 1), ("label:ORG", 1), ("label:ACT", 2)}
    asked = spark.createDataFrame([(1, "The evidence Act"), (1, "Supreme Court")], "query_id int, entity string")
    assert {(r.chunk_id, r.similarity) for r in index.lookup_fuzzy(p, asked).collect()} == {("c3", 1.0), ("c2", 0.75), ("c1", 1.0)}
    ranked = index.retrieve(p, asked, top_k=2).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in ranked] == [("c1", 0.5), ("c3", 0.5)]
    assert index.without_documents(p, spark.createDataFrame([("c1",)], "chunk_id string"), "chunk_id").count() == 2


def _related_plainly(rows, asked, most):
    found = []
    names = {c for _, c in rows}
    first = {c: min(d for d, x in rows if x == c) for c in names}
    for t in set(asked) & names:
        docs = {d for d, c in rows if c == t}
        near = sorted({c for d, c in rows if d in docs and c != t}, key=lambda c: (first[c], c))
        found += [(t, c, i + 1) for i, c in enumerate(near[:most])]
    return sorted(found)


def test_related_broadcasts_stated_names_only(spark, tmp_path, monkeypatch):
    """Mentions repeat, so their files are far below any broadcast threshold; what is joined isn't."""
    rows = [(d, c) for d in range(3000) for c in ("ALL", f"A_{d % 7}", f"B_{d % 50}", f"C_{d % 3 * d % 11}")]
    spark.createDataFrame(rows, "doc_name long, canonical string").write.parquet(str(tmp_path / "linked"))
    linked = spark.read.parquet(str(tmp_path / "linked"))
    asked = ["A_1", "B_7", "ALL", "not there"]
    targets = spark.createDataFrame([(c,) for c in [*asked, *asked]], "canonical string")
    want = _related_plainly(rows, asked, 10)
    for most_bytes, broadcasts in ((entities.MAX_TARGET_BYTES, 1), (0, 0)):
        monkeypatch.setattr(entities, "MAX_TARGET_BYTES", most_bytes)
        df = entities.related(linked, targets)
        assert sorted(map(tuple, df.collect())) == want
        final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert final.count("BroadcastHashJoin") == broadcasts
    assert entities.related(linked, targets.where("canonical = 'not there'")).count() == 0 == entities.related(linked, targets.where("false")).count()
