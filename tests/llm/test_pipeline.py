"""The pipeline against plain Python over the same documents."""

import hashlib

import corpus_pipeline
from seedforest.llm import mixing, pieces, toxicity
from tests.llm.test_documents import near_brute

SF = "/root/testdata/sf0.001"


def test_pipeline_matches_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scorer = toxicity.Scorer(*toxicity.fit(docs, labels))
    rows = [r for r in docs.collect() if scorer.score(scorer.features(r["text"])[0]) < toxicity.THRESHOLD]
    last = {}
    for r in rows:
        last[r["text"] or ""] = max(r["doc_id"], last.get(r["text"] or "", -1))
    rows = [r for r in rows if last[r["text"] or ""] == r["doc_id"]]
    near = near_brute([(r["doc_id"], r["text"]) for r in rows])
    rows = [r for r in rows if near[r["doc_id"]][1] == r["doc_id"]]
    passes = {r["doc_id"]: r["passes"] for r in mixing.mix_sources(spark.createDataFrame(rows, docs.schema)).collect()}
    model = pieces.Lattice(pieces.load())
    want = sorted((r["doc_id"], model.nbest_ids(r["text"])[0][1]) for r in rows for _ in range(passes[r["doc_id"]]))
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r["doc_id"], r["tokens"]) for r in got) == want and all(r["round_trip"] for r in got)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs.limit(60).unionByName(docs.limit(0))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, extra, SF).columns == docs.columns, name
    assert all(stage(spark, docs.limit(0), SF).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_text_key_of_mixing_matches_python(spark):
    docs = spark.createDataFrame([(1, "a b", "s"), (2, None, None)], "doc_id long, text string, source string")
    assert {r["id"]: r["digest"] for r in mixing.mix_plan(docs).select("id", "digest").collect()} == {1: hashlib.md5(b"a b").hexdigest(), 2: hashlib.md5(b"").hexdigest()}
