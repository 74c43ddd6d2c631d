"""Operators on documents against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import struct
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seedforest.llm import exact_dedup, licenses, minhash, mixing, queries, sharding, suffix_dedup, telephony, toxicity, url_filter

SCHEMA = "doc_id long, text string, source string, size string, kept int, component_id string"


def table(spark, texts, sources=None):
    return spark.createDataFrame([(i, t, (sources or {}).get(i, f"s{(i or 0) % 3}"), "x", 7, "y") for i, t in texts], SCHEMA)


def sentences(rng, n, words=60):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega", "kappa"]) + rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(n or words))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = [sentences(rng, rng.randint(20, 120)) for _ in range(25)]
    out = [*base, *base[:6], base[0], base[0], None, None, "", " \n\t", "one two", "one two", "One TWO", "x" * 400, "é" * 300, sentences(rng, 6000)]
    for b in base[:10]:  # near copies of several degrees
        for edits in (1, 2, 3, 4):
            w = b.split()
            for _ in range(edits):
                w[rng.randrange(len(w))] = "edit"
            out.append(" ".join(w))
    out += [base[1] + "\n" + base[2], base[3][50:] + base[4][:150], base[2] * 3]
    return list(enumerate(out))


def test_url_filter(spark):
    cases = [
        (1, "http://a.net/x"), (2, "http://example.net/en/1"), (3, "https://b.example.net/en/"), (4, "http://example.com/de/x"), (5, "http://Z.ORG/fr/"), (6, "http://casino-win.example.com/"), (7, "http://x.com/free-bonus"),
        (8, "http://x.com/freebonus"), (9, None), (10, "no scheme"), (11, "http://a.net"), (12, "http://a.net?x=/"), (13, "x://y://z/"), (14, ""), (15, "http://x.com/free/free"), (1, "http://a.net/x"), (None, "ftp://q.net/")
    ]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in cases], "page_id long, url string, verdict string")
    rows = {r["page_id"]: r for r in url_filter.filter_urls(pages).collect()}
    assert url_filter.filter_urls(pages).count() == len(cases)
    verdicts = {i: rows[i]["verdict"] for i in rows}
    assert verdicts == {1: "block", 2: "allow", 3: "allow", 4: "block", 5: "allow", 6: "block", 7: "block", 8: "allow", 9: "allow", 10: "allow", 11: "allow", 12: "allow", 13: "allow", 14: "allow", 15: "allow", None: "block"}
    assert rows[2]["rule"] == "example.net/en/" and rows[5]["host"] == "z.org" and (rows[9]["host"], rows[9]["path"]) == ("", "") and rows[12]["path"] == ""
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def test_url_terms(spark):
    cases = {
        "http://a.com/%63asino": ("block", 1, 0), "http://a.com/%43ASINO": ("block", 1, 0), "http://a.com/%2563asino": ("allow", 0, 0), "http://a.com/x%20porn%20y": ("allow", 0, 0), "http://a.com/essex/sextant": ("allow", 0, 0),
        "http://a.com/poker/bonus": ("block", 0, 2), "http://a.com/poker/poker": ("allow", 0, 1), "http://a.com/scunthorpe-analysis": ("allow", 0, 0), "http://a.com/%70%6f%72n%": ("block", 1, 0), "http://a.com/%": ("allow", 0, 0),
        "http://a.com/" + "long-" * 200_000 + "casino": ("block", 1, 0), "http://casino.example.net/en/": ("allow", 1, 0), "http://a.com/\n%6e%73fw": ("block", 1, 0), "http://a.com/é%35": ("allow", 0, 0),
    }
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "page_id long, url string")
    rows = {r["page_id"]: r for r in url_filter.filter_urls(pages).collect()}
    assert {u: (rows[i]["verdict"], rows[i]["strict_terms"], rows[i]["soft_terms"]) for i, u in enumerate(cases)} == cases
    small = duckdb.from_arrow(pa.table({"page_id": pa.array(range(len(cases))), "url": pa.array(list(cases))}))
    found = small.query("pages", url_filter.url_filter_sql()).fetchall()
    assert sorted(found) == sorted(tuple(r) for r in rows.values())


@pytest.mark.parametrize("options", [{"digest_all": True}, {}])
def test_exact_dedup(spark, texts, options):
    rows = exact_dedup.exact_dedup(table(spark, texts), **options).collect()
    groups = {}
    for i, t in texts:
        groups.setdefault(t or "", []).append(i)
    assert len(rows) == len(texts)
    for r in rows:
        own = next(g for g in groups.values() if r["doc_id"] in g)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(own), len(own), r["doc_id"] == max(own))
        if options.get("digest_all") or len(own) > 1:
            assert r["text_sha256"] == hashlib.sha256((texts[r["doc_id"]][1] or "").encode()).hexdigest()
    assert exact_dedup.exact_dedup(table(spark, []), **options).count() == 0


def test_drop_copies_keeps_one_of_repeated_rows(spark):
    docs = table(spark, [(1, "a"), (1, "a"), (2, "a"), (2, "a"), (3, "b"), (4, None), (5, "")])
    assert sorted(r["doc_id"] for r in exact_dedup.drop_copies(docs).collect()) == [2, 3, 5]
    assert exact_dedup.drop_copies(docs).columns == docs.columns


def test_mixing(spark, texts):
    sources = {i: None if i % 11 == 0 else "hot" if i % 3 else f"s{i % 4}" for i, _ in texts}
    rows = mixing.mix_sources(table(spark, texts, sources)).collect()
    assert len(rows) == len(texts)
    size = {i: len((t or "").split()) for i, t in texts}
    names = sorted({s for s in sources.values() if s is not None}) + [None]
    total = {s: sum(size[i] for i in size if sources[i] == s) for s in names}
    target, full, whole = {s: 0.0 for s in names}, set(), sum(total.values())
    while True:  # share out, cut off, share the excess again
        rest = whole - sum(3 * total[s] for s in full)
        open_weight = sum((5, 2, 1)[k % 3] for k, s in enumerate(names) if s not in full)
        target = {s: 3 * total[s] if s in full else rest * (5, 2, 1)[k % 3] / open_weight for k, s in enumerate(names)}
        above = {s for s in names if s not in full and target[s] > 3 * total[s]}
        if not above:
            break
        full |= above
    taken = {s: 0 for s in names}
    for r in rows:
        s = sources[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == total[s] and abs(r["target"] - target[s]) < 1e-6
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["position"] is None) == (r["taken"] == 0) and (r["position"] is None or 0 <= r["position"] <= 1)
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    again = {r["doc_id"]: tuple(r) for r in mixing.mix_sources(table(spark, texts, sources).repartition(3)).collect()}
    assert again == {r["doc_id"]: tuple(r) for r in rows}
    assert mixing.mix_sources(table(spark, [])).count() == 0 and mixing.mix_sources(table(spark, [(1, None), (2, "")])).where("taken = 0").count() == 2
    mixed = mixing.mixed_documents(table(spark, texts, sources))
    assert mixed.columns == SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    passes = {r["doc_id"]: r["passes"] for r in rows if r["taken"]}
    assert {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == passes


@pytest.mark.parametrize("schedule", mixing.SCHEDULES)
def test_inverse_demand(spark, schedule):
    ys = [k / 50 for k in range(51)]
    got = [r[0] for r in spark.createDataFrame([(y,) for y in ys], "y double").select(F.expr(mixing.invert_sql(schedule, "y"))).collect()]
    grid = np.linspace(0, 1, 200_001)
    weight = np.interp(grid, *zip(*schedule, strict=True))
    demand = np.concatenate([[0], np.cumsum((weight[1:] + weight[:-1]) / 2)])
    assert np.allclose(got, np.interp(ys, demand / demand[-1], grid), atol=1e-4)


def test_sharding(spark, texts):
    docs = table(spark, [*texts, texts[0], (None, "q")])
    rows = sharding.shard_documents(docs, 5).collect()
    assert len(rows) == len(texts) + 2
    for s in range(5):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    load = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(5)]
    assert sum(load) == sum(len((t or "").encode()) + 8 for _, t in [*texts, texts[0], (None, "q")])
    rest = [sum(r["size"] for r in sharding_rows(spark) if r["shard"] == s) for s in range(5)]
    assert max(rest) <= 1.02 * min(rest)
    assert all(r["text_crc32"] == zlib.crc32((dict(texts).get(r["doc_id"]) or "").encode()) for r in rows if r["doc_id"] is not None)
    assert sharding.shard_documents(table(spark, []), 5).count() == 0


def sharding_rows(spark):
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab "), (F.col("id") % 50).cast("int")).alias("text"))
    return sharding.shard_documents(many, 5).collect()


def test_ring_moves_little():
    """Where nothing overflows, a new shard only takes keys from others."""
    cells = [(p, 3, 0, 1, 1) for p in range(0, sharding.RING, 4)]
    before, after = sharding.place_cells(cells, 8, 1.0), sharding.place_cells(cells, 9, 1.0)
    moved = [c for c in before if before[c][0] != after[c][0]]
    assert all(after[c][0] == 8 for c in moved) and 0 < len(moved) < len(cells) / 5


def test_codec_tables():
    """The two companding laws written out one code at a time."""

    def mulaw(c):
        c = ~c & 255
        t = (((c & 15) * 2 + 33) << ((c >> 4) & 7)) - 33
        return -4 * t if c & 128 else 4 * t

    def alaw(c):
        c ^= 0x55
        e, m = (c >> 4) & 7, c & 15
        t = 2 * m + 1 if e == 0 else (2 * m + 33) << (e - 1)
        return 8 * t if c & 128 else -8 * t

    assert telephony.expansion(telephony.MULAW).tolist() == [mulaw(c) for c in range(256)]
    assert telephony.expansion(telephony.ALAW).tolist() == [alaw(c) for c in range(256)]


def test_adpcm_blocks():
    rng = np.random.default_rng(1)
    blocks = rng.integers(0, 256, (7, telephony.BLOCK), dtype=np.uint8)
    got = telephony.decode_adpcm(blocks)
    for b, row in zip(blocks, got, strict=True):
        value, index, out = struct.unpack("<h", b[:2].tobytes())[0], min(int(b[2]), 88), []
        out.append(value)
        for byte in b[4:].tolist():
            for code in (byte & 15, byte >> 4):
                step = int(telephony.step_sizes()[index])
                delta = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                value = max(-32768, min(32767, value - delta if code & 8 else value + delta))
                index = max(0, min(88, index + telephony.INDEX_STEPS[code & 7]))
                out.append(value)
        assert out == row.tolist()


def test_resampling():
    wave = (10000 * np.sin(2 * np.pi * 440 * np.arange(800) / 8000)).astype(np.int16)
    up = telephony.resample(wave, 2, 1)
    want = 10000 * np.sin(2 * np.pi * 440 * np.arange(1600) / 16000)
    assert len(up) == 1600 and np.abs(up[50:-50] - want[50:-50]).max() < 200
    assert len(telephony.resample(up, 1, 2)) == 800 and len(telephony.resample(wave, 3, 2)) == 1200 and len(telephony.resample(wave[:0], 2, 1)) == 0


def test_media_round_trip(spark, texts):
    media = telephony.store_audio(table(spark, texts))
    rows = {r["doc_id"]: r for r in telephony.audio_features(media).collect()}
    stored = {r["doc_id"]: r["media"] for r in media.collect()}
    assert len(rows) == len(texts)
    for i, t in texts:
        raw = (t or "").encode()
        padded = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored[i]), hashlib.sha256(bytes(stored[i])).hexdigest())
    assert rows[0]["feature"] == rows[25]["feature"]  # equal texts
    decoded = telephony.decode_audio(media).collect()
    assert all(len(r["pcm"]) == 2 * r["n_samples"] for r in decoded)
    broken = spark.createDataFrame([(1, bytearray(b"RIFFxxxx")), (2, None)], "doc_id long, media binary")
    assert [r["pcm"] for r in telephony.decode_audio(broken).collect()] == [None, None]
    assert telephony.audio_features(telephony.store_audio(table(spark, []))).count() == 0


def near_brute(texts):
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = {}
    for i, t in texts:
        w = [x for x in (t or "").encode().translate(lower).replace(b"\n", b" ").replace(b"\t", b" ").split(b" ") if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("block", [512, 2])
def test_near_dedup(spark, texts, block):
    rows = minhash.near_dedup(table(spark, texts), block=block).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == near_brute(texts)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows) and len(rows) == len(texts)


def test_near_dedup_edges(spark):
    docs = table(spark, [(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, None), (3, "")])
    rows = sorted(tuple(r) for r in minhash.near_dedup(docs).collect() if r["doc_id"] is not None)
    assert rows == [(1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True), (3, 0, 3, True)]
    assert minhash.near_dedup(table(spark, [])).count() == 0
    assert minhash.drop_near_copies(docs).columns == docs.columns


def test_signatures_agree_with_similarity():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    a, b = np.unique(pool[:3000]), np.unique(pool[1000:])
    s = minhash.signatures([a, b, a[[0, -1]], a[:0]], 1000)
    assert abs((s[0] == s[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.06
    assert set(s[2].tolist()) == set(a[[0, -1]].tolist()) and not s[3].any()


def test_substring_dedup(spark, texts):
    rows = suffix_dedup.substring_dedup(table(spark, texts)).collect()
    want = suffix_dedup.brute_force([(i, (t or "").encode()) for i, t in texts])
    assert sorted(tuple(r)[:5] for r in rows) == want
    for r in rows:
        assert hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"] and sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"]
    assert suffix_dedup.substring_dedup(table(spark, [])).count() == 0


def test_substring_dedup_of_few_letters(spark):
    rng = random.Random(9)
    out = []
    for i in range(40):
        t = "".join(rng.choice("ab") for _ in range(rng.randint(0, 300)))
        out.append((i, t if i % 4 else t + "ab" * 120 + out[-1][1] if out else t))
    got = sorted(tuple(r)[:5] for r in suffix_dedup.substring_dedup(table(spark, out)).collect())
    assert got == suffix_dedup.brute_force([(i, t.encode()) for i, t in out])


def test_substring_dedup_repeated_ids(spark):
    long = "".join(random.Random(1).choices("abcdefgh", k=150))
    rows = suffix_dedup.substring_dedup(table(spark, [(1, long), (1, long), (1, "z" + long), (None, "short")])).collect()
    assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_removed"]) for r in rows) in ([(-1, 5, 0), (1, 150, 0), (1, 150, 0), (1, 151, 150)], [(-1, 5, 0), (1, 150, 150), (1, 150, 150), (1, 151, 0)])


def test_suffix_sort():
    rng = np.random.default_rng(2)
    buffer = rng.integers(97, 99, 3000).astype(np.uint8)
    starts, groups = rng.permutation(2900)[:800], np.sort(rng.integers(0, 9, 800))
    order = suffix_dedup.Suffixes(buffer, 12).sort(starts, groups)
    keys = [(int(groups[i]), buffer[starts[i] : starts[i] + 12].tobytes()) for i in range(800)]
    assert order.tolist() == sorted(range(800), key=lambda i: (*keys[i], i))


def test_licenses(spark):
    mit, gpl = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["GPL-3.0-short"]
    words = mit.split()
    docs = table(spark, [(1, "head " * 40 + mit + " tail" * 30), (2, gpl.upper()), (3, " ".join(w if k % 60 else "zzz" for k, w in enumerate(words))), (4, " ".join(words[::2])), (5, None), (6, "a b"), (7, "x " * 30_000 + gpl)])
    found = {r["doc_id"]: {m["template"]: m["contained"] for m in r["matches"]} for r in licenses.find_licenses(docs).collect()}
    assert found[1] == {"MIT": 1.0} and found[2] == {"GPL-3.0-short": 1.0} and 0.75 <= found[3]["MIT"] < 1 and found[4] == found[5] == found[6] == {} and found[7] == {"GPL-3.0-short": 1.0}
    assert licenses.find_licenses(table(spark, [])).count() == 0


def occurrences(text: bytes, templates: dict[str, str]) -> list[tuple[str, int, float]]:
    """What a scan gives, from sets of words at every window."""
    words = re.findall(rb"[a-z0-9\x80-\xff]+", bytes(c + 32 if 65 <= c <= 90 else c for c in text))
    own = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    out = []
    for name, form in sorted(templates.items()):
        parts = re.findall(rb"[a-z0-9]+", form.lower().encode())
        wanted = {tuple(parts[k : k + 5]) for k in range(len(parts) - 4)}
        m = len(wanted)
        found = [(len(wanted & set(own[k : k + math.ceil(1.25 * m)])), k) for k in range(0, len(own), max(1, m // 4))]
        left, taken = [x for x in found if x[0] >= 0.75 * m], []
        while left:
            best = max(left, key=lambda x: (x[0], -x[1]))
            taken.append(best)
            left = [x for x in left if abs(x[1] - best[1]) >= max(2, min(m, 4 * max(1, m // 4)))]
        out += [(name, k, n / m) for n, k in sorted(taken, key=lambda x: x[1])]
    return out


def test_licenses_against_all_windows():
    rng = random.Random(4)
    pieces = [w for t in licenses.TEMPLATES.values() for w in t.split()]
    texts = []
    for _ in range(60):
        t = []
        for _ in range(rng.randint(0, 6)):
            t += rng.choice(list(licenses.TEMPLATES.values())).split()[rng.randint(0, 4) :] if rng.random() < 0.4 else [rng.choice(pieces) for _ in range(rng.randint(1, 80))]
        texts.append(" ".join(w if rng.random() < 0.98 else "q" for w in t).encode())
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    known = [licenses.Template(n, t) for n, t in sorted(licenses.TEMPLATES.items())]
    hashes, at = licenses.shingles_of(np.frombuffer(b"".join(texts), np.uint8), offsets)
    found = licenses.scan(hashes, at, known)
    assert found == [occurrences(t, licenses.TEMPLATES) for t in texts] and sum(map(len, found)) > 20


@pytest.mark.parametrize("name", ["MIT", "Zlib", "GPL-3.0-short", "BSD-disclaimer"])
def test_every_occurrence_of_a_license(spark, name):
    notice, filler = licenses.TEMPLATES[name], " and now for something else " * 40
    docs = table(spark, [(1, filler.join([notice] * 4)), (2, " ".join([notice] * 3)), (3, (filler + notice) * 300), (1, filler.join([notice] * 4))])
    rows = licenses.find_licenses(docs).collect()
    counts = [(r["doc_id"], sum(m["template"] == name and m["contained"] == 1.0 for m in r["matches"])) for r in rows]
    assert sorted(counts) == [(1, 4), (1, 4), (2, 3), (3, 300)]


def test_license_query_against_sets_of_words(spark, tmp_path):
    names = sorted(licenses.TEMPLATES)
    rng = random.Random(8)
    texts = [None, "", "one two", *(" ".join(rng.choice([sentences(rng, 40), licenses.TEMPLATES[rng.choice(names)]]) for _ in range(rng.randint(1, 5))) for _ in range(40))]
    table(spark, list(enumerate(texts))).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in queries.op10_licenses(spark, str(tmp_path)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        want = occurrences((t or "").encode(), licenses.TEMPLATES)
        kinds = list(dict.fromkeys(n for n, _, _ in want))
        r = rows[i]
        assert (r["n_licenses"], r["licenses"], r["n_matches"]) == (len(kinds), ",".join(kinds), len(want)), i
        assert (r["contained"], r["first_word"]) == ((max(c for *_, c in want), min(k for _, k, _ in want)) if want else (None, None)), i


def test_automaton_matches_edit_distance():
    terms = [("idiot", False, 1.0), ("worthless", False, 2.0), ("scum", False, 1.5), ("réeux", True, 1.0)]
    own = toxicity.Automaton(terms)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(6)
    for _ in range(4000):
        word = list(rng.choice(terms)[0])
        for _ in range(rng.randint(0, 2)):
            k, how = rng.randrange(len(word)), rng.randint(0, 2)
            word[k : k + 1] = [] if how == 0 else [rng.choice("abcxé")] if how == 1 else [word[k], rng.choice("abcxé")]
            word = word or ["a"]
        word = "".join(word)
        near = min(distance(word, t) if len(t) >= 5 else 9 * (word != t) for t, stem, _ in terms if not stem)
        got = own.look(word)
        if word.startswith("réeux"):
            assert got is not None
        else:
            assert (got is not None) == (near <= 1), word
            assert got is None or got[1] == near
    assert own.look("1d10t") == (0, 0)


def test_context_tells_quotation_from_abuse():
    scorer = toxicity.Scorer([(w, False, 3.0) for w in toxicity.SEED])
    abuse, quoted = scorer.features("you are such an idiot")[0], scorer.features('the paper said "idiot" was the word')[0]
    assert abuse[3] == 0 and abuse[4] == 1 and quoted[3] == 1 and scorer.score(abuse) > scorer.score(quoted)
    assert scorer.features(None) == scorer.features("") and 0 <= scorer.score(scorer.features("")[0]) < 0.3


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    rows = toxicity.score_texts(docs.join(labels, "doc_id", "left_semi"), model).join(labels, "doc_id").where(toxicity.held_out("doc_id")).select("predicted", "toxic", "score").collect()
    right = sum(r["predicted"] and r["toxic"] for r in rows)
    assert right / sum(r["predicted"] for r in rows) > 0.9 and right / sum(r["toxic"] for r in rows) > 0.9 and all(0 <= r["score"] <= 1 for r in rows)


def test_toxicity_edges(spark):
    docs = table(spark, [(1, None), (2, ""), (3, "x" * 100_000), (4, "you moron"), (4, "you moron")])
    labels = spark.createDataFrame([(9, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    rows = toxicity.score_texts(docs, model).collect()
    assert len(rows) == 5 and rows[0]["score"] == rows[1]["score"] and rows[3]["predicted"] == rows[4]["predicted"] == 1
    assert toxicity.score_texts(docs.limit(0), model).count() == 0
    assert sorted(r["doc_id"] for r in toxicity.drop_toxic(docs, model).collect()) == [1, 2, 3]
