"""What keeps an executor of the pipeline small: no shuffle of texts for the few that go, and heaps that shrink between stages."""

import corpus_pipeline
from patchloom.llm import decontamination


def test_texts_are_not_shuffled_for_hits(spark):
    item = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(i, item if i % 3 else "other words", "x") for i in range(60)] + [(None, item, "y"), (None, "z", "y"), (7, "z", "y"), (8, None, "y")], "doc_id long, text string, kind string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where the documents with hits are larger than it
    try:
        found = []
        for limit, shuffled in (({}, False), ({"hit_limit": 41}, False), ({"hit_limit": 40}, True)):
            kept = decontamination.drop_contaminated(docs, bench, **limit)
            found.append(sorted(map(str, kept.collect())))
            plan = kept._jdf.queryExecution().executedPlan().toString()
            assert ("SortMergeJoin" in plan) == shuffled and ("hashpartitioning" in plan) == shuffled
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert found[0] == found[1] == found[2] and len(found[0]) == 23


def test_heaps_shrink_before_a_stage(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(10)
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())  # noqa: E731  here the driver's JVM is the executor
    for _, stage in corpus_pipeline.STAGES[2:]:
        before = full()
        stage(spark, docs, small)
        assert full() > before
