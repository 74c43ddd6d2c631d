"""op2's array search, op4's features and op8's ring against plain versions."""

import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from seedforest.llm import pieces, sharding, telephony


def test_words_searched_together_equal_words_searched_alone():
    rng = random.Random(5)
    words = {" " + "".join(rng.choice("etaoinshrdlucmfw-.0é漢\U0001f600▁") for _ in range(rng.randint(1, 9))) for _ in range(3000)}
    words |= {" " + "".join(rng.choice("etaoinshrdlu") for _ in range(n)) for n in (20, 47, 48, 60) for _ in range(12)}
    together, alone = pieces.Lattice(pieces.load()), pieces.Lattice(pieces.load())
    together.entries(sorted(words))
    assert together.words.keys() == words
    for w in words:
        ids, score, loss = together.words[w]
        own = alone.word_entry(w)
        assert ids == own[0] and abs(score - own[1]) < 1e-9 and (loss == own[2] or abs(loss - own[2]) < 1e-9), w


def sample(code: int, codec: int) -> int:
    """G.711 by its definition: sign, segment and step."""
    if codec == telephony.MULAW:
        code = 255 - code
        size = (2 * (code % 16) + 33 << code // 16 % 8) - 33 << 2
        return -size if code > 127 else size
    code ^= 0x55
    segment, step = code // 16 % 8, code % 16
    size = 16 * step + 8 if segment == 0 else (16 * step + 264) << segment - 1
    return size if code > 127 else -size


def adpcm(block: bytes) -> list[int]:
    value = int.from_bytes(block[:2], "little", signed=True)
    index, out = min(block[2], 88), [value]
    for byte in block[4:]:
        for code in (byte % 16, byte // 16):
            step = int(telephony.step_sizes()[index])
            change = step // 8 + (step if code & 4 else 0) + (step // 2 if code & 2 else 0) + (step // 4 if code & 1 else 0)
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + telephony.INDEX_STEPS[code & 7]))
            out.append(value)
    return out


def doubled(pcm: list[int]) -> list[int]:
    """Output 2k and 2k + 1: taps over the eight samples around k."""
    filt = telephony.taps(2, 1).tolist()
    near = lambda k: pcm[k] if 0 <= k < len(pcm) else 0
    return [max(-32768, min(32767, sum(near(n // 2 + j - 3) * filt[n % 2][j] for j in range(8)) + (1 << 13) >> 14)) for n in range(2 * len(pcm))]


def test_features_of_the_query(spark):
    rng = random.Random(9)
    texts = [None, "", "a", "x" * 64, "é" * 32, *("".join(rng.choice("abc é漢\n") for _ in range(rng.randint(0, 300))) for _ in range(24))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in telephony.audio_features(telephony.store_audio(docs)).collect()}
    assert len(rows) == len(texts)
    codecs = set()
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        codec = telephony.codec_for(payload)
        codecs.add(codec)
        pcm = [x for k in range(0, len(payload), 64) for x in adpcm(payload[k : k + 64])] if codec == telephony.ADPCM else [sample(c, codec) for c in payload]
        pcm = doubled(pcm)
        crossings = sum((a < 0) != (b < 0) for a, b in zip(pcm, pcm[1:], strict=False))
        rms = int((sum(x * x for x in pcm) // len(pcm)) ** 0.5)
        checksum = zlib.crc32(b"".join(x.to_bytes(2, "little", signed=True) for x in pcm))
        assert rows[i]["feature"] == f"{telephony.NAMES[codec]};n={len(pcm)};peak={max(map(abs, pcm))};rms={rms};zc={crossings};crc={checksum:08x}", i
        assert (rows[i]["n_bytes"], rows[i]["payload_bytes"], rows[i]["tail_crc32"]) == (len(raw), len(payload), zlib.crc32(payload[-64:]))
        assert rows[i]["payload_sha256"] == hashlib.sha256(payload).hexdigest()
    assert len(codecs) == 3


def test_ring_with_bounded_loads():
    """Shard by shard clockwise from the cell's position, largest class first; the bound holds and rows get gapless slots."""
    rng = random.Random(2)
    cells = [(rng.randrange(256), rng.randint(3, 12), part, rng.randint(1, 9), 0) for part in range(800)]
    cells = [(p, k, part, n, n * (rng.randrange(1 << k, 2 << k))) for p, k, part, n, _ in cells]
    shards, slack, nodes, ring = 6, 0.01, 5, 256
    placed = sharding.place_cells(cells, shards, slack, nodes, ring)
    owners = [(sharding.ring_position(f"shard {s} node {v}", ring), s) for s in range(shards) for v in range(nodes)]
    room = (1 + slack) * sum(c[4] for c in cells) / shards
    load, rows = dict.fromkeys(range(shards), 0), dict.fromkeys(range(shards), 0)
    for p, k, part, n, size in sorted(cells, key=lambda c: (-c[1], hashlib.md5(f"{c[0]},{c[1]},{c[2]}".encode()).digest())):
        clockwise = [s for _, s in sorted(owners, key=lambda o: ((o[0] - p) % ring, o))]
        shard = next((s for s in clockwise if load[s] + size <= room), None)
        if shard is None:
            shard = min(dict.fromkeys(clockwise), key=load.get)
        assert placed[p, k, part] == (shard, rows[shard])
        load[shard] += size
        rows[shard] += n
    assert len(placed) == len(cells)


def test_shards_of_rows_follow_their_cells(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("é "), (F.col("id") % 70).cast("int")).alias("text"))
    rows = sharding.shard_documents(docs, 7).collect()
    load = np.bincount([r["shard"] for r in rows], [r["size"] for r in rows], 7)
    assert len(rows) == 4000 and load.max() <= 1.0001 * load.mean() + 8 + 3 * 70
    assert all(r["size"] == 8 + 3 * (r["doc_id"] % 70) for r in rows)


def test_shards_do_not_depend_on_partitions(spark):
    docs = spark.range(900).select(F.when(F.col("id") < 300, 7).when(F.col("id") > 320, F.col("id")).alias("doc_id"), F.repeat(F.lit("x"), F.when(F.col("id") < 250, 5).otherwise(F.col("id") % 90).cast("int")).alias("text"))
    one, other = (sorted(sharding.shard_documents(docs.repartition(n), 7).collect(), key=repr) for n in (1, 5))
    assert one == other and len({r["shard"] for r in one if r["doc_id"] == 7}) > 3
