"""Members of a cluster that share a few rare shingles each with the next one: op9 makes no group of them whose texts would go to all of its blocks, and loses no link."""

from seedforest.llm import minhash


def rest(spark, monkeypatch, **options):
    words = [f"w{k}" for k in range(60 * 25 + 100)]
    texts = {k: words[25 * k : 25 * k + 50] for k in range(60)}  # the last 25 words are the first of the next text
    texts[60] = [*words[25 * 30 : 25 * 30 + 48], "other", "end"]  # linked with 30
    members = spark.createDataFrame([(k, max(len(t) - 4, 1), 0, k) for k, t in texts.items()], "node long, n long, cluster long, label long")
    copies = []
    monkeypatch.setattr(minhash, "_packs", lambda placed, n="n": copies.append(placed.count()) or packs(placed, n))
    links = minhash.rest_links(members, spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "id long, text string"), 75, block=200, **options)
    found = {tuple(sorted(r)) for r in links.collect()}
    minhash.drop(links)  # one table, as near_dedup takes it
    return found, sum(copies)


packs = minhash._packs


def test_few_shared_shingles_copy_no_texts(spark, monkeypatch):
    links, copies = rest(spark, monkeypatch)
    assert links == {(30, 60)} and copies <= 2 * 61


def test_large_cells_lose_no_link(spark, monkeypatch):
    assert rest(spark, monkeypatch, light=1)[0] == {(30, 60)}
