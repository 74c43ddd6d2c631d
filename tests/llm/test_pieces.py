"""SentencePiece operator against the library's own N-best search over the same pieces and scores."""

import struct

import pytest

from seedforest.llm import pieces

sentencepiece = pytest.importorskip("sentencepiece")


def varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return varint(number << 3 | 2) + varint(len(value)) + value
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3) + varint(value)


def unigram_model(vocabulary: tuple):
    """The library's model with the same pieces and scores, and its lattice search. Written out by hand: nothing is trained."""
    names, ids, scores, byte_ids = vocabulary
    table = {i: (n, s, 1) for n, i, s in zip(names, ids, scores, strict=True)} | {i: (f"<0x{b:02X}>", 0.0, 6) for b, i in enumerate(byte_ids)}
    table |= {0: ("<unk>", 0.0, 2), 1: ("<s>", 0.0, 3), 2: ("</s>", 0.0, 3)}
    proto = b"".join(field(1, field(1, table[i][0].encode()) + field(2, float(table[i][1])) + field(3, table[i][2])) for i in sorted(table))
    trainer = field(3, 1) + field(35, 1)
    normalizer = field(1, b"identity") + field(3, 1) + field(4, 0) + field(5, 1)
    return sentencepiece.SentencePieceProcessor(model_proto=proto + field(2, trainer) + field(3, normalizer))


TEXTS = ["Hello world", "  two  spaces ", "tab\tand\nline", "émotion über 漢字 \U0001f600", "aaaaaaa", "Orin***", "a", "1,234.50", "therheonand, thentint"]


def test_best_and_nbest_scores_match_the_library():
    vocabulary = pieces.load()
    library, own = unigram_model(vocabulary), pieces.Lattice(vocabulary, nbest=5)
    value = {i: s for i, s in zip(vocabulary[1], vocabulary[2], strict=True)}

    def total(ids, text):
        raw = sum(i in vocabulary[3] for i in ids)
        spelled, out = 0, sum(value.get(i, 0.0) for i in ids)
        for c in " " + text:
            n = len(c.encode())
            if c.replace(" ", pieces.SPACE) not in own.pieces and spelled + n <= raw:
                spelled, out = spelled + n, out + own.unknown
        return out

    for text in TEXTS:
        mine = own.nbest_ids(text)
        theirs = library.nbest_encode(text, nbest_size=5, out_type=int)
        assert [round(s, 2) for s, _ in mine] == [round(total(t, text), 2) for t in theirs], text
        assert mine[0][1] == library.encode(text, out_type=int), text


def brute(own: pieces.Lattice, text: str):
    """All segmentations of a short text."""
    arcs = own.arcs(own.inner(" " + text))
    paths = {0: [(0.0, b"")]}
    for j in range(1, len(arcs)):
        paths[j] = [(s + a, ids + more) for i, more, s in arcs[j] for a, ids in paths[i]]
    return sorted((round(s, 9) for s, _ in paths[len(arcs) - 1]), reverse=True)


@pytest.mark.parametrize("text", ["Hello it", "on the", "a b, c", "é?x"])
def test_all_segmentations(text):
    own = pieces.Lattice(pieces.load(), nbest=6)
    assert [round(s, 9) for s, _ in own.nbest_ids(text)] == brute(own, text)[:6]


def test_round_trip_and_edges(spark):
    texts = [*TEXTS, "", None, "▁ literal ▁▁", "x" * 5000, " ", "\n\n", "same", "same", "".join(map(chr, range(0x250, 0x600)))]
    docs = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(texts)], "doc_id long, text string, tokens string")
    encoded = pieces.encode_texts(docs)
    rows = {r["doc_id"]: r for r in encoded.collect()}
    assert len(rows) == len(texts) and all(r["round_trip"] for r in rows.values())
    assert rows[texts.index(None)]["n_tokens"] == 0 and rows[texts.index("same")]["tokens_sha256"] == rows[texts.index("same") + 1]["tokens_sha256"]
    decoded = {r["doc_id"]: r["text"] for r in pieces.decode_tokens(encoded).collect()}
    assert decoded == {i: t or "" for i, t in enumerate(texts)}
    assert pieces.encode_texts(docs.limit(0)).count() == 0
