from __future__ import annotations

import corpus_pipeline
from tests.llm.helpers import documents, prose

SMALL = "/root/testdata/sf0.001"


def test_stages_take_effect_and_keep_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SMALL)
        assert after.columns == docs.columns
        assert 0 < after.count() <= docs.count()


def test_near_copies_and_leaks_go(spark):
    test = spark.read.parquet(f"{SMALL}/benchmark.parquet").first().text
    docs = documents(spark, [prose(1, 80), prose(1, 80) + " more", prose(2, 60) + " " + test, prose(3, 50)])
    kept = corpus_pipeline.drop_near_copies(spark, docs, SMALL)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3]
    assert sorted(r.doc_id for r in corpus_pipeline.drop_leaks(spark, kept, SMALL).collect()) == [0, 3]


def test_run_packs_what_is_left(spark):
    rows = corpus_pipeline.run(spark, SMALL).collect()
    used: dict[int, int] = {}
    for r in rows:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert rows and max(used.values()) <= 2048
