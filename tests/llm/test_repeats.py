"""Repeated rows, hot ids and columns named like anything that an operator uses inside."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seedforest.llm import common, exact_dedup, licenses, minhash, mixing, pieces, sharding, suffix_dedup, telephony, toxicity, url_filter

INSIDE = "id key size turn digest number position pass before target taken part rank may _may _id _word _mask _n_bytes _sha256 hash keep_id kept group_size n_bytes full_hash prefix_hash component node label cell hub y label_id score media feature codec pcm n_samples crc doc bucket ranges shard slot kind first mark parts tokens n_tokens no_source".split()


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, "a b c d", "s"), (1, "a b c d", "s"), (1, "e f", "s"), (1, "e f", "t"), (2, "a b c d", None), (None, "g", "s"), (None, "g", "s"), (3, None, None), (3, "", "t"), (4, "you moron", "t")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(f"own {c}") for c in INSIDE})


def texts_of(df):
    return Counter((r["doc_id"], r["text"], r["source"]) for r in df.collect())


def test_clashing_columns(spark, odd):
    labels = spark.createDataFrame([(1, 0), (4, 1), (4, 0), (9, 1)], "doc_id long, toxic int").withColumn("y", F.lit("own")).withColumn("label_id", F.lit(7))
    model = toxicity.fit(odd, labels)
    for out in (toxicity.drop_toxic(odd, model), exact_dedup.drop_copies(odd), minhash.drop_near_copies(odd), mixing.mixed_documents(odd)):
        assert out.columns == odd.columns and all(r[c] == f"own {c}" for r in out.collect() for c in INSIDE)
    n = odd.count()
    for out in (toxicity.score_texts(odd, model), exact_dedup.exact_dedup(odd), mixing.mix_sources(odd), minhash.near_dedup(odd), sharding.shard_documents(odd, 3), suffix_dedup.substring_dedup(odd), licenses.find_licenses(odd), pieces.encode_texts(odd), telephony.store_audio(odd)):
        assert len(set(out.columns)) == len(out.columns) and out.count() == n
    media = telephony.store_audio(odd).withColumns({c: F.lit("own") for c in ("codec", "Feature", "payload_bytes", "other")})
    for out in (telephony.decode_audio(media), telephony.audio_features(media)):
        rows = out.collect()
        assert len({c.lower() for c in out.columns}) == len(out.columns) and all(r["other"] == "own" for r in rows) and len(rows) == n
    pages = odd.select(F.col("doc_id").alias("page_id"), F.lit("http://a.net/").alias("url"), F.lit("own").alias("host"), F.lit("own").alias("rule"))
    assert url_filter.filter_urls(pages).count() == n


def test_stages_take_odd_rows(spark, odd):
    docs = odd.select("doc_id", "text", "source", F.lit("en").alias("lang"), F.lit(1).cast("long").alias("n_chars"), "turn", "position", "_may", "y")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns and out.count() > 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001").count() == docs.count()


def test_mixed_documents_of_repeated_rows(spark, odd):
    plan = mixing.mix_sources(odd).where("taken > 0")
    got, want = texts_of(mixing.mixed_documents(odd)), plan.agg(F.sum("passes")).first()[0]
    assert sum(got.values()) == want
    two = spark.createDataFrame([(1, "a b c d", "s"), (1, "a b c d", "s")], "doc_id long, text string, source string")
    assert texts_of(mixing.mixed_documents(two)) == {(1, "a b c d", "s"): 2}


def test_drop_copies_of_repeated_rows(spark, odd):
    assert texts_of(exact_dedup.drop_copies(odd.select("doc_id", "text", F.lit("s").alias("source")))) in [Counter({(2, "a b c d", "s"): 1, (1, "e f", "s"): 1, (None, "g", "s"): 1, (3, t, "s"): 1, (4, "you moron", "s"): 1}) for t in (None, "")]


def test_no_more_labelled_rows_than_the_sample(spark, monkeypatch):
    docs = spark.createDataFrame([(1, f"calm text {k}") for k in range(50)] + [(4, "you moron")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (4, 1)], "doc_id long, toxic int")
    seen = []
    real = toxicity.fit_logistic
    monkeypatch.setattr(toxicity, "fit_logistic", lambda x, y: seen.append(len(x)) or real(x, y))
    toxicity.fit(docs, labels, sample=2)
    assert seen == [2]


@pytest.mark.parametrize("kind", ["null", "one", "same text"])
def test_an_id_of_all_rows_fills_all_shards(spark, kind):
    key = F.lit(None).cast("long") if kind == "null" else F.lit(5).cast("long")
    docs = spark.range(2000).select(key.alias("doc_id"), (F.lit("same") if kind == "same text" else F.concat(F.lit("text "), F.col("id"))).alias("text"))
    rows = sharding.shard_documents(docs, 8, slack=0.02).collect()
    load = Counter()
    for r in rows:
        load[r["shard"]] += r["size"]
    assert len(rows) == 2000 and len(load) == 8 and max(load.values()) <= 1.02 * sum(load.values()) / 8 + 16
    assert sorted((r["shard"], r["slot"]) for r in rows) == sorted((s, k) for s in load for k in range(sum(r["shard"] == s for r in rows)))


def test_keys_by_bits(spark, monkeypatch):
    docs = spark.range(1000).select(F.when(F.col("id") != 7, F.col("id")).alias("id"), F.lit("x").alias("_word"))
    for rows in (1 << 20, 16):  # enough bits, and far too few
        monkeypatch.setattr(common, "FILTER_ROWS", rows)
        for some in ([], [3, 5, 5000, None], list(range(0, 1000, 2))):
            keys = common.cut(spark.createDataFrame([(k,) for k in some], "k long"))
            own = [docs["id"]]
            inside = {r["id"] for r in common.with_keys(docs, own, keys, "left_semi").collect()}
            outside = common.with_keys(docs, own, keys, "left_anti").collect()
            every = {None if k == 7 else k for k in range(1000)}
            assert inside == every & set(some) and {r["id"] for r in outside} == every - set(some) and len(outside) == 1000 - len(inside)
