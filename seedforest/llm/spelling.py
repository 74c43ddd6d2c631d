"""Spelling variant grouping: words one edit apart, found by a rare-first prefix filter on positional bigrams.

A word of n letters has n - 1 bigrams, each with its position. One inserted, deleted or replaced letter touches two bigrams of a word at most and moves the others by one
position at most, without changing their order. Bigrams are ordered by how many places of the vocabulary they have, the rarest first (then by letters, then by position), the same way for all
words. Of two words one edit apart, the first bigram in that order which the edit leaves alone stands behind two touched ones at most, in either word. So it is
among the three rarest of both: words are joined on their three rarest bigrams only, with equal positions where lengths are equal and with equal or neighbouring ones where lengths
differ by one. The edit also lies in one third of the word (of the shorter one), and the letters outside this third are part of the key, which keeps keys small however many words
there are. What the join meets is verified by edit distance inside the join, so that pairs which fail are never rows.

The table of bigram counts is the only thing broadcast: 90 letters make 8,100 rows at most, whatever the corpus. A bigram, position and length that very many words have
among their rarest make a large key; Spark splits it as a skewed join, and only verified pairs leave it, once each after a distinct.

Forms are followed to their roots by doubling: a form has ten times the occurrences, so a chain is as short as the digits of a count and a few joins end it.

Null and empty texts have no words. A null id is spelled as nothing before the colon. Rows that repeat count as often as they come. A run of any length is a word; texts are
read whole. Columns other than those named aren't read. An empty table, or one without words, gives an empty table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, drop

LEAST_LETTERS, LEAST_TIMES, TIMES, ONE_IN = 7, 2, 10, 31
LETTERS = "a-zÀ-ÿ"
PREFIX, PARTS = 3, 3


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = LEAST_LETTERS, least_times: int = LEAST_TIMES, one_in: int = ONE_IN) -> DataFrame:
    """word and n: runs of letters, A-Z lowered; where one_in divides the checksum of id and run, the run loses one letter first."""
    run = F.regexp_extract_all(ascii_lower(F.col(text_col).cast("string")), F.lit(f"[{LETTERS}]{{{least_letters},}}"), F.lit(0))
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(run).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % one_in == 0, less).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least_letters).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_times)


def rarest_bigrams(words: DataFrame, most: int = PREFIX) -> DataFrame:
    """word, n, size, gram, pos: the `most` rarest bigrams of each word."""
    size = F.length("word")
    grams = words.select("word", "n", size.alias("size"), F.posexplode(F.transform(F.sequence(F.lit(1), size - 1), lambda i: F.substring("word", i, F.lit(2)))).alias("pos", "gram"))
    often = cut(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("often")))
    ranked = grams.join(F.broadcast(often), "gram").groupBy("word", "n", "size").agg(F.slice(F.array_sort(F.collect_list(F.struct("often", "gram", "pos"))), 1, most).alias("rarest"))
    return ranked.select("word", "n", "size", F.explode("rarest").alias("r")).select("word", "n", "size", "r.gram", "r.pos")


def near_words(words: DataFrame) -> DataFrame:
    """a, n_a, b, n_b: each pair of words one edit apart once (of one length: a first in code point order; else a is the longer one)."""
    rare = cut(rarest_bigrams(words))

    def keyed(word: str, n: str, key: str, part: int, shorter: int, moved: int, when: Column) -> DataFrame:
        """The rarest bigrams as they stand, `moved` places to the left, in a word of `shorter` letters less, and that word's letters outside one part."""
        size = F.col("size") - shorter
        outside = F.concat(F.substring("word", F.lit(1), _bound(size, part)), F.lit(" "), F.substring("word", F.col("size") - size + _bound(size, part + 1) + 1, size))
        return rare.where(when).select(F.col("word").alias(word), F.col("n").alias(n), F.col("size").alias(f"size_{word}"), F.xxhash64("gram", F.col("pos") - moved, size, F.lit(part), outside).alias(key))

    there, asking = [], []
    for part in range(PARTS):
        there.append(keyed("b", "n_b", "key", part, 0, 0, F.lit(True)))
        asking.append(keyed("a", "n_a", "asked", part, 0, 0, F.lit(True)))
        # the letter too many is behind the bigram, which stays, or before it
        asking.append(keyed("a", "n_a", "asked", part, 1, 0, F.col("pos") + 1 < _bound(F.col("size") - 1, part + 1)))
        asking.append(keyed("a", "n_a", "asked", part, 1, 1, F.col("pos") > _bound(F.col("size") - 1, part)))
    close = ((F.col("size_a") > F.col("size_b")) | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1)
    return reduce(DataFrame.unionAll, asking).join(reduce(DataFrame.unionAll, there), (F.col("asked") == F.col("key")) & close).select("a", "n_a", "b", "n_b").distinct()


def _bound(size: Column, part: int) -> Column:
    """Where a part of a word begins (from 0)."""
    return F.floor(size * part / PARTS).cast("int")


def roots(forms: DataFrame) -> DataFrame:
    """forms: word, form. Returns word and root, the last that forms lead to."""
    known = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        on = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut(known.join(on, "root", "left"))
        moved = not step.where("next is not null").isEmpty()
        drop(known)
        if not moved:
            return step.select("word", "root")
        known = cut(step.select("word", F.coalesce("next", "root").alias("root")))
        drop(step)


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the vocabulary."""
    words = cut(vocabulary(docs, id_col, text_col))
    pairs = cut(near_words(words))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("n_other")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("n_other")))
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_other")).alias("less"), "other")).alias("best"))
    joined = words.join(near, "word", "left")
    enough = -F.col("best.less") >= times * F.col("n")
    judged = cut(joined.select("word", F.when(enough, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, -F.col("best.less")).alias("form_n")))
    drop(words, pairs)
    last = roots(judged.where("form is not null").select("word", "form"))
    return judged.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


# CRC-32 by its table of 256, over the UTF-8 bytes of characters below U+0800
SPELLING_SQL = r"""
WITH RECURSIVE k AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda d, j: xor(d >> 1, 3988292384 * (d & 1)))) AS crc),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{7,}')) AS run FROM documents),
d AS MATERIALIZED (SELECT doc_id, run, count(*) AS n, concat(coalesce(doc_id::VARCHAR, ''), ':', run) AS said FROM r GROUP BY doc_id, run),
b AS (SELECT doc_id, run, n, flatten(list_transform(string_split(said, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [(192 | (unicode(x) >> 6))::BIGINT, (128 | (unicode(x) & 63))::BIGINT] END)) AS bytes FROM d),
h AS (SELECT run, n, xor(4294967295, list_reduce([4294967295::BIGINT] || bytes, lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1]))) AS h FROM b, k),
o AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, n FROM h),
w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM o WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
x AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM w)),
p AS MATERIALIZED (SELECT a.word, b.word AS other, b.n AS n_other FROM x a JOIN x b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
      UNION SELECT a.word, b.word, b.n FROM x a JOIN w b ON a.less = b.word UNION SELECT b.word, a.word, a.n FROM x a JOIN w b ON a.less = b.word),
m AS (SELECT word, count(*) AS n_near, max(n_other) AS most FROM p GROUP BY word),
f AS MATERIALIZED (SELECT m.word, min(p.other) AS form, any_value(m.most) AS form_n FROM m JOIN w USING (word) JOIN p ON p.word = m.word AND p.n_other = m.most WHERE m.most >= 10 * w.n GROUP BY m.word),
t(word, root, far) AS (SELECT word, form, 1 FROM f UNION ALL SELECT t.word, f.form, far + 1 FROM t JOIN f ON f.word = t.root)
SELECT w.word, f.form, coalesce(q.root, w.word) AS root, w.n, coalesce(n_near, 0)::BIGINT AS n_near, f.form_n::BIGINT AS form_n
FROM w LEFT JOIN m USING (word) LEFT JOIN f USING (word) LEFT JOIN (SELECT word, arg_max(root, far) AS root FROM t GROUP BY word) q USING (word)"""
