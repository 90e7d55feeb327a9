"""The near stage of the pipeline: one row of each group, whatever its ids."""

import corpus_pipeline


def test_one_row_of_each_group_stays(spark, tmp_path):
    text = lambda t, n: " ".join([f"{t}{k}" for k in range(60)] + [f"x{n}"])
    rows = [(None, text("a", 1)), (None, text("a", 2)), (5, text("b", 1)), (5, text("b", 2)), (6, text("b", 3)), (5, text("c", 1)), (None, text("c", 2)), (None, text("d", 1)), (None, ""), (7, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    got = corpus_pipeline.near(spark, spark.read.parquet(f"{tmp_path}/docs"), "").collect()
    assert sorted(((r.text or " ")[0], r.doc_id or 0) for r in got if r.text) == [("a", 0), ("b", 5), ("c", 5), ("d", 0)] and len(got) == 6
