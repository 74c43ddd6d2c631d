"""The registered op2 query returns the ids themselves."""

from seedforest.llm import pieces, queries

SF = "/root/testdata/sf0.001"


def test_op2_returns_tokens_that_decode_to_the_texts(spark):
    found = queries.op2_sentencepiece(spark, SF)
    assert {"tokens", "nbest_changes"} <= set(found.columns)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r["doc_id"]: r["text"] for r in pieces.decode_tokens(found).collect()} == texts
    assert all(len(r["tokens"]) == r["n_tokens"] and len(r["nbest_changes"]) == len(r["nbest_scores"]) for r in found.collect())
