"""The pipeline against its stages by brute force on what each predecessor kept."""

import corpus_pipeline
from tests.llm.test_documents import brute_components
from tests.llm.test_tokens import packed_well
from wirecorpus.llm import langid, line_crf
from wirecorpus.llm.common import table


def test_stages(spark, data, tmp_path):
    docs, columns = table(spark, data, "documents"), table(spark, data, "documents").columns
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "language ID", "MinHash near-dedup", "best-fit packing"]
    left = []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, data)
        assert number == 3 or made.columns == columns
        made.write.parquet(str(tmp_path / str(number)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(number)))
        left.append((before, docs))
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    judged = line_crf.judge(left[0][0], line_crf.fit(left[0][0], table(spark, data, "labels")))
    assert ids(left[0][1]) == ids(judged.where("kept"))
    told = langid.predict(left[1][0], langid.fit(left[1][0]))
    assert ids(left[1][1]) == ids(told.where("not rejected"))
    pairs = [(r.doc_id, r.text) for r in left[2][0].collect()]
    assert ids(left[2][1]) == {i for i, _, _, kept in brute_components(pairs, 5, 80) if kept}
    packed = left[3][1].collect()
    assert {r.doc_id for r in packed} == ids(left[3][0])
    total = sum(r.length for r in packed)
    assert packed_well(packed, 4096) <= total / 4096 * 1.05 + 1


def test_run(spark, data):
    assert corpus_pipeline.run(spark, data).count() > 0


def test_empty_table(spark, data):
    docs = table(spark, data, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, data)
        assert docs.count() == 0
