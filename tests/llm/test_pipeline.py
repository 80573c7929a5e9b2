"""The pipeline's stages: each works on all that its predecessor kept."""

import corpus_pipeline
from skyledger.llm import near_duplicates, quality_rules
from skyledger.sources.tables import table


def test_stages_hand_on_documents(spark, data):
    docs = table(spark, data, "documents")
    names = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "pii", "mixing", "packing"]
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, data).cache()
        assert docs.columns == names
        after = [(r["doc_id"], r["text"]) for r in docs.collect()]
        ids = {d for d, _ in after}
        if name == "quality_rules":
            kept = {r["doc_id"] for r in quality_rules.judge(table(spark, data, "documents")).where("kept").collect()}
            assert ids == kept
        if name == "near_duplicates":
            groups = {r["doc_id"]: r["component_id"] for r in near_duplicates.near_duplicate_groups(table(spark, data, "documents")).collect()}
            assert len(after) == len(ids) <= len({groups[d] for d in ids})
        if name == "pii":
            assert ids == before.keys() and not any("@mail" in (t or "") for _, t in after)
        before = dict(after)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    assert pieces.where("start = 0").count() == docs.count()


def test_run_equals_the_stages(spark, data):
    assert corpus_pipeline.run(spark, data).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
