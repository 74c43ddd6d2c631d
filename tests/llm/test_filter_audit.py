"""op11 against filters applied one after another, order by order."""

import random
import re
from itertools import permutations

from seedforest.llm import filter_audit

NAMES = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def fails(rows, i):
    doc_id, text = rows[i][0], rows[i][1] or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    smaller = any((r[1] or "") == text and r[0] is not None and doc_id is not None and r[0] < doc_id for r in rows)
    return {
        "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
        "D": any(c in text for c in "#$%&*|"), "E": smaller,
    }


def plain(rows, labels):
    bad = [fails(rows, i) for i in range(len(rows))]
    mark = lambda doc_id, k: any(r[0] == doc_id and doc_id is not None and r[k] == 1 for r in labels)
    out, total = {}, {}
    for part in {r[2] or "" for r in rows}:
        own = [i for i in range(len(rows)) if (rows[i][2] or "") == part]
        for order in map("".join, permutations("ABCDE")):
            left = list(own)
            for step, f in enumerate(order, 1):
                gone = [i for i in left if bad[i][f]]
                left = [i for i in left if not bad[i][f]]
                redundant = sum(bad[i][f] for i in own) - len(gone)
                alone = sum(bad[i][f] and sum(bad[i].values()) == 1 for i in own)
                out[part, order, step] = [len(left), len(gone), redundant, alone, sum(mark(rows[i][0], 1) for i in gone), sum(mark(rows[i][0], 2) for i in gone)]
                total[part, f] = total.get((part, f), 0) + len(gone)
    return {(*k, *v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, Mask int, digest string")


def test_every_order_equals_filters_applied_in_turn(spark):
    rng = random.Random(3)
    words = ["red", "Blue", "GREEN", "a#b", "x", "yy", "zzz", "50%", "é", "漢"]
    texts = [None, "", " \t\n ", "ABC", "#", *(" ".join(rng.choice(words[: rng.choice((2, 6, 10))]) + str(rng.randrange(rng.choice((1, 90)))) for _ in range(rng.choice((3, 49, 50, 51, 90)))) for _ in range(25))]
    rows = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice([None, "", "s", "t"]), 1, "x") for _ in range(120)]
    rows += rows[:9]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in [*range(30), *range(5), None]]
    marks = spark.createDataFrame([(*r, 1) for r in labels], "doc_id long, quality int, toxic int, part int")
    found = filter_audit.audit_filters(table(spark, rows), marks).collect()
    assert {tuple(r[n] for n in NAMES) for r in found} == plain(rows, labels) and len(found) == 3 * 600


def test_sums_and_counts_are_each_others_transform(spark):
    rng = random.Random(4)
    masks = [("p", rng.choice([0, 3, 5, 31, rng.randrange(32)]), rng.random() < 0.5, rng.random() < 0.5) for _ in range(500)]
    sums = filter_audit.parity_sums(spark.createDataFrame(masks, "part string, mask int, good boolean, toxic boolean"))
    for r in sums.collect():
        own = [m for _, m, g, t in masks if (g, t) == (r["good"], r["toxic"])]
        assert r["sums"] == [sum((-1) ** (m & s).bit_count() for m in own) for s in range(32)]
    (counts,) = filter_audit.mask_counts(sums).collect()
    assert counts["every"] == [sum(m == k for _, m, _, _ in masks) for k in range(32)]
    assert counts["toxic"] == [sum(m == k and t for _, m, _, t in masks) for k in range(32)]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_filters(table(spark, []), empty).count() == 0
    (one, *rest) = filter_audit.audit_filters(table(spark, [(1, "x", None, 1, "x")]), empty).collect()
    assert len(rest) == 599 and one["part"] == ""
