"""Of op9's band keys only those that may have several members are dealt out again."""

import random

from seedforest.llm import minhash


def test_single_keys_stay_where_they_are(spark, monkeypatch):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(10**6)) for _ in range(60)) for _ in range(200)]
    texts += [texts[0] + " more", texts[0] + " less"]
    seen = []

    def recorded(docs, on, keys, name):
        out = may_meet(docs, on, keys, name)
        if "key" in docs.columns:
            seen.append((out.count(), out.where(name).count()))
        return out

    may_meet = minhash.may_meet
    monkeypatch.setattr(minhash, "may_meet", recorded)
    rows = minhash.near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == {k: 0 if k >= 200 else k for k in range(202)}
    ((every, dealt),) = seen
    assert every == 202 * minhash.BANDS and dealt < every / 8
