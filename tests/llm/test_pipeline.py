import corpus_pipeline
from voxelweave.llm.scratch import Scratch


def test_stages_keep_columns_and_only_remove_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    scratch = Scratch(spark, "t")
    seen = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch.put(stage(spark, docs, sf), name)
        assert sorted(docs.columns) == ["doc_id", "lang", "n_chars", "source", "text"]
        ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert ids and len(ids) == len(set(ids)) and set(ids) <= seen
        seen = set(ids)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == seen


def test_odd_and_empty_documents(spark, sf, odd, empty, tmp_path):
    for name, docs in (("odd", odd), ("empty", empty)):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.read.parquet(f"{sf}/labels.parquet").write.parquet(str(tmp_path / name / "labels.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert (len(out) > 0) == (name == "odd")


def test_stages_compose_without_a_write(spark, sf):
    stages = [f for _, f in corpus_pipeline.STAGES]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for stage in stages[:3]:
        docs = stage(spark, docs, sf)
    other = stages[1](spark, stages[0](spark, spark.read.parquet(f"{sf}/documents.parquet"), sf), sf)
    kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert kept and kept <= {r["doc_id"] for r in other.select("doc_id").collect()}


def test_two_runs_over_one_input_side_by_side(spark, sf):
    one, two = (corpus_pipeline.run(spark, sf) for _ in range(2))
    rows = lambda df: sorted(map(tuple, df.select("doc_id", "piece", "start", "length").collect()))
    assert rows(one) == rows(two) != []
