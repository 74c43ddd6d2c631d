"""Links of the near-dedup that hashes alone or stars alone get wrong."""

import random

import numpy as np
import pyarrow as pa
import pytest

from seedforest.llm import minhash, vec
from tests.llm.test_documents import near_brute, table


def thue_morse(n):
    word = "ab"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word


def test_words_that_share_a_hash_modulo_a_power_of_two_stay_apart(spark):
    one = thue_morse(1024)
    other = one.translate(str.maketrans("ab", "ba"))
    docs = [(1, one), (2, other), (3, f"head {one}"), (4, f"head {other}"), (5, f"head {one}")]
    rows = minhash.near_dedup(table(spark, docs)).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 3}
    raw = np.frombuffer((one + other).encode(), np.uint8)
    ends = np.array([0, 1024, 2048])
    assert len(set(vec.Fingerprint(raw).of(ends[:-1], ends[1:]).tolist())) == 2
    assert len(set(vec.Prefix(raw).of(ends[:-1], ends[1:]).tolist())) == 1


def test_fingerprints_do_not_depend_on_the_place():
    raw = np.frombuffer(b"x" + b"some words" * 50 + b"some wordz", np.uint8)
    at = np.array([1 + 10 * k for k in range(51)])
    found = vec.Fingerprint(raw).of(at, at + 10).tolist()
    assert len(set(found[:50])) == 1 and found[50] != found[0] and 0 <= min(found) and max(found) < 1 << 62


def test_sets_are_told_apart_by_bytes_where_hashes_fail(monkeypatch):
    texts = ["a b c d e f", "a b c d e g", "A b  c d e f", "a b", "x y", ""]
    want = [len(s) for s in minhash.exact_sets(pa.array(texts))]
    for name in ("word_hashes", "shingle_hashes"):
        real = getattr(vec, name)

        def flat(*args, real=real):
            hashes, at = real(*args)
            return hashes & np.uint64(1), at

        monkeypatch.setattr(vec, name, flat)
        sets = minhash.exact_sets(pa.array(texts))
        assert [len(s) for s in sets] == want == [2, 2, 2, 1, 1, 0]
        assert len(np.intersect1d(sets[0], sets[1])) == 1 and sets[0].tolist() == sets[2].tolist() and not set(sets[3].tolist()) & set(sets[4].tolist())


@pytest.mark.parametrize("block", [150_000, 100])
def test_families_on_templates(spark, block):
    """Documents share half of their words or more with all others, and chains of links run within."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    template = [word() for _ in range(120)]
    docs = []
    for _ in range(12):
        own = [word() for _ in range(rng.randint(30, 130))]
        for _ in range(rng.randint(1, 6)):
            text = template + own
            for _ in range(rng.randint(0, 5)):
                text[rng.randrange(len(text))] = word()
            docs.append((len(docs), " ".join(text)))
            own = own[:-3] + [word() for _ in range(3)]
    rows = minhash.near_dedup(table(spark, docs), block=block).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == near_brute(docs)


def test_texts_of_one_id_are_one_node(spark):
    rng = random.Random(2)
    a, b = (" ".join("".join(rng.choices("abcdef", k=4)) for _ in range(40)) for _ in range(2))
    rows = minhash.near_dedup(table(spark, [(3, a), (3, b), (5, a + " tail"), (7, b + " end"), (9, "else")])).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in rows) == [(3, 3), (3, 3), (5, 3), (7, 3), (9, 9)]
