"""What the pipeline's steps leave on executors: no Python workers for small tables, no grown heaps."""

import corpus_pipeline
from docloom.llm import mixing
from docloom.llm.common import local_table

PARTS = "pattern array<string>, flow long, parts array<struct<source: string, words: long>>"


def test_small_tables_pass_through_no_python_worker(spark):
    rows = [(["a", None], 3, [{"source": None, "words": 1}, {"source": "a", "words": 2}]), ([], None, [])]
    made = local_table(spark, rows, PARTS)
    assert [(r.pattern, r.flow, [p.asDict() for p in r.parts]) for r in made.collect()] == [tuple(r) for r in rows]
    assert made.schema == spark.createDataFrame([], PARTS).schema
    assert local_table(spark, [], PARTS).collect() == []


def test_the_mix_has_no_python_rows(spark):
    sized = spark.range(40).selectExpr("id AS doc_id", "id % 7 AS size", "array(concat('s', id % 3)) AS sources")
    plan = mixing.mix(sized)._jdf.queryExecution().logical().toString()
    assert "LogicalRDD" not in plan and "ExistingRDD" not in plan


def test_steps_start_with_collected_heaps(spark, sf):
    beans = lambda: spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, step in corpus_pipeline.STAGES[2:3] + corpus_pipeline.STAGES[4:]:
        before = full()
        step(spark, docs, sf)
        assert full() > before
