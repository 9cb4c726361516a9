import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent.parent.parent))
import corpus_pipeline as pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in pipeline.STAGES] == ["quality classifier", "near duplicates", "decontamination", "personal data", "packing"]
    source = spark.read.parquet(f"{SF}/documents.parquet")
    docs, kept = source, [source.count()]
    for k, (_, stage) in enumerate(pipeline.STAGES[:-1]):
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == source.columns and docs.dtypes == source.dtypes
        kept.append(docs.count())
    assert kept == sorted(kept, reverse=True) and kept[0] > kept[2] and kept[3] == kept[4]
    out = pipeline.run(spark, SF)
    assert out.select("doc_id").distinct().count() == kept[-1]


def test_odd_documents_pass_every_stage(spark, docs, nothing):
    for table in (docs, nothing):
        for _, stage in pipeline.STAGES:
            assert stage(spark, table, SF).count() <= 10 * max(1, docs.count()) * 100
