"""Terms that the toxicity model learns and the spellings it finds."""

import random

from seedforest.llm import toxicity


def test_rarer_terms_are_tried_whatever_number_of_common_forms(spark):
    rng = random.Random(5)
    common = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(7000))
    rows = [(i, common + (" zorgle" if i < 20 else ""), int(i < 40)) for i in range(160)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    terms, _ = toxicity.fit(docs, labels)
    assert any("zorgle".startswith(t) for t, _, _ in terms)


def test_signs_swaps_and_second_edits():
    scorer = toxicity.Scorer([(w, False, 3.0) for w in ("scum", "stupid", "idiot", "worthless", "disgusting")])
    at = {t: k for k, (t, _, _) in enumerate(scorer.terms)}
    wanted = {"$cum": ("scum", 0), "$tupid!": ("stupid", 0), "**$tupid**": ("stupid", 1), "*idiot*": ("idiot", 0), "idoit": ("idiot", 1), "1doit": ("idiot", 1), "worhtless": ("worthless", 1), "disgutsin": ("disgusting", 2), "disgsting": ("disgusting", 1), "dsgstng": None, "scmu": None, "todii": None, "wrothlses": None, "!!!": None}
    found = scorer.hits(set(wanted))
    for word, hit in wanted.items():
        assert found.get(word) == (hit and (at[hit[0]], hit[1])), word
