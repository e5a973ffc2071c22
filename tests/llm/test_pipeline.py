"""The pipeline's stages over documents, each against a plain version of what it decides."""

import corpus_pipeline
from twinspect.llm import decontam, mixing, neardup, registry, sharding, toxicity
from twinspect.session import load

SF = "/root/testdata/sf0.001"


def test_stages_follow_their_operators(spark, tmp_path):
    docs = load(spark, SF, "documents")
    columns, ids = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        after = sorted(r.doc_id for r in out.select("doc_id").collect())
        if name == "toxicity":
            bad = {r.doc_id for r in toxicity.toxicity(docs, load(spark, SF, "labels")).where("predicted = 1").collect()}
            assert after == sorted(before - bad)
        elif name == "near_duplicates":
            assert after == sorted(r.doc_id for r in neardup.near_duplicates(docs, corpus_pipeline.NEAR).where("kept").collect()) and len(after) < len(before)
        elif name == "decontamination":
            assert after == sorted(before - {r.doc_id for r in decontam.contaminated(docs, load(spark, SF, "benchmark")).collect()})
        elif name == "mixing":
            want = [r.doc_id for r in mixing.mix(docs).collect() for _ in range(r.taken // r["size"] if r["size"] else 0)]
            assert after == sorted(want)
        else:
            assert after == sorted(r.doc_id for r in docs.collect()) and set(out.columns) >= {"doc_id", "shard", "slot"}
        if name != "sharding":
            assert out.columns == columns
        ids[name], docs = after, out
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == ids["sharding"]


def test_every_operator_is_registered():
    assert [int(n[2:].split("_")[0]) for n in registry.QUERIES] == list(range(1, 14))
    assert set(registry.SQL) <= set(registry.QUERIES)
