"""The N best segmentations that encode_texts returns."""

import hashlib
import random
import time

import numpy as np

from seedforest.llm import pieces
from seedforest.llm.queries import op2_sentencepiece

TEXTS = ["Hello world", "  two  spaces ", "aaaaaaa", "émotion über 漢字 \U0001f600", "a", "therheonand, thentint " * 9, "", None, "▁ literal"]


def digest(ids) -> str:
    return hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest()


def test_nbest_segmentations_are_returned(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    own, values = pieces.Lattice(pieces.load()), dict(zip(pieces.load()[1], pieces.load()[2], strict=True))
    for row in pieces.encode_texts(docs).collect():
        text, made = TEXTS[row["doc_id"]], []
        for changes in row["nbest_changes"]:
            ids = list(row["tokens"])
            for c in reversed(changes):
                ids[c["at"] : c["at"] + c["n"]] = c["ids"]
            made.append(ids)
        assert made[0] == row["tokens"] and [digest(x) for x in made] == row["nbest_sha256"]
        assert len(set(row["nbest_sha256"])) == len(row["nbest_scores"]), text
        assert made == [ids for _, ids in own.nbest_ids(text)]
        assert all(own.decode(x) == (text or "") for x in made)
        if text and text.isascii():
            assert np.allclose([sum(values[i] for i in x) for x in made], row["nbest_scores"])


def test_equal_scores_give_no_segmentation_twice():
    own = pieces.Lattice(pieces.load(), nbest=6)
    for text in ("aaaaaaa", "aaaaa aaaaa", "ababababab", "eeeeeeeee", "ooooooo", "lllllllll", "ssssssss"):
        found = [tuple(ids) for _, ids in own.nbest_ids(text)]
        assert len(found) == 6 == len(set(found)), text


def test_op2_digests_all_of_the_nbest(spark):
    rows = op2_sentencepiece(spark, "/root/testdata/sf0.001").limit(50).collect()
    assert all(len(set(r["nbest_sha256"])) == len(r["nbest_scores"]) and r["nbest_sha256"][0] == r["tokens_sha256"] for r in rows)


def test_a_long_lattice_is_the_same_looked_up_or_held(monkeypatch):
    rng = random.Random(4)
    own = pieces.Lattice(pieces.load())
    for text in ("".join(rng.choice("etaoinshrdlu漢é\U0001f600▁") for _ in range(3000)), "ab" * 1500):
        held = own.word_entry(text), own.search(text)
        monkeypatch.setattr(pieces, "LONG", 100)
        assert (own.word_entry(text), own.search(text)) == held
        monkeypatch.undo()


def test_a_million_letters_without_a_space():
    rng = random.Random(5)
    text = "".join(rng.choice("etaoinshrdlucmfwypvbgk") for _ in range(1_000_000))
    own = pieces.Lattice(pieces.load())
    began = time.time()
    found = own.nbest_ids(text)
    assert time.time() - began < 120 and len(found) == 4
    scores = [s for s, _ in found]
    assert scores == sorted(scores, reverse=True) and len({tuple(ids) for _, ids in found}) == 4
    values = dict(zip(pieces.load()[1], pieces.load()[2], strict=True))
    assert all(abs(sum(values[i] for i in ids) - s) < 1e-3 and own.decode(ids) == text for s, ids in found)
