"""Stages of the corpus pipeline on planted documents."""

import corpus_pipeline


def test_near_duplicates_from_080_on(spark):
    words = [f"w{i}" for i in range(54)]
    edited = [*words[:27], "edited", *words[28:]]  # 45 of 55 shingles are shared, 0.818
    other = [f"v{i}" for i in range(54)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(edited)), (3, " ".join(other))], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == [1, 3]
