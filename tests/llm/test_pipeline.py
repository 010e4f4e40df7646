import corpus_pipeline
from emberline.llm import decontaminate, jaccard_join, pii
from emberline.llm.common import table


def test_each_stage_on_what_the_one_before_kept(spark, folder):
    docs = table(spark, folder, "documents")
    columns, schema = docs.columns, docs.schema
    held = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, held, folder)
        before, after = held.toPandas(), out.toPandas()
        if name != "pack":
            assert out.columns == columns and out.schema == schema
            assert after.doc_id.is_unique and set(after.doc_id) <= set(before.doc_id)
        if name == "language":
            assert len(after) >= 0.97 * before.text.str.contains(r"[^\W\d_]").sum()
        if name == "near_duplicates":
            linked = jaccard_join.join_documents(held).toPandas()
            assert set(after.doc_id) == set(linked[linked.doc_id == linked.component_id].doc_id)
        if name == "decontaminate":
            gone = {r["doc_id"] for r in decontaminate.find_leaks(held, table(spark, folder, "benchmark")).collect()}
            assert gone and set(after.doc_id) == set(before.doc_id) - gone
        if name == "personal_data":
            assert len(after) == len(before) and not any(pii.base_spans(t)[0] for t in after.text)
            assert (after.n_chars == after.text.str.len()).all()
        if name == "pack":
            assert set(after.doc_id) == set(before.doc_id) and after.groupby("sequence_id").length.sum().max() <= 2048
        held = spark.createDataFrame(after, out.schema)
    assert len(corpus_pipeline.STAGES) == 5


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13
    assert names["pipeline"] is corpus_pipeline.run
