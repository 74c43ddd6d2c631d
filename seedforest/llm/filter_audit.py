"""Filter interaction audit: what each of five filters removes, in every order of them, from one pass over the corpus.

A document's mask has a bit for each filter that it fails (FILTERS). The corpus pass aggregates, for each part (source) and label, the 32 signed parity
sums W[S] = sum over documents of (-1)^|mask & S|, which is the Walsh-Hadamard transform of the 32 counts of masks. The transform is its own inverse but for
the factor 32, so the counts come back exactly, in whole numbers. All that an order of filters does follows from these counts: a filter f behind the
filters P removes the masks that hold f and nothing of P. Summed over all 120 orders, a mask of k failures is removed by each of its filters in 120 / k of them
(the first of its k failures in the order takes it, and each is first equally often), which is the closed form of the Shapley value times 120.

Copies (filter E) are found by digest: SHA-256 of each text, the smallest id of each digest that several rows have, and a join of narrow rows with
these. Texts enter no shuffle; sums are formed within tasks first, so a source or a text of very many rows costs no more than others.

Null and empty texts are the same, as are null and empty sources. Rows with a null id have no smaller id before them and no label. Rows that repeat an id count one by one, and
none of them is a copy of another. A label holds if any row of the labels for that id has it. Columns other than those named aren't read; very long texts are read
whole, one at a time. An empty table gives an empty table.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
MASKS = 1 << len(FILTERS)


def text_failures(text: str, words: str) -> Column:
    """Bits 0 to 3 from a text and its words: A few words, B few different words, C many capitals, D code signs."""
    n = F.size(words)
    fails = (n < 50, 100 * F.size(F.array_distinct(words)) < 65 * n, 100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.length(text), F.col(text).rlike("[#$%&*|]"))
    return sum((F.when(x, 1 << k).otherwise(0) for k, x in enumerate(fails)), F.lit(0))


def failure_masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, mask, good and toxic for every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    judged = cut(
        docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
        .withColumn("words", F.array_remove(F.split(F.translate("text", "\t\n\x0b\x0c\r", "     "), " "), ""))
        .select("id", "part", text_failures("text", "words").alias("mask"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))
    )
    first = cut(judged.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first"))
    marks = labels.groupBy(F.col(id_col).alias("id")).agg(F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic"))
    copied = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    full = judged.join(first, "digest", "left").withColumn("mask", F.col("mask") + F.when(copied, 1 << FILTERS.index("E")).otherwise(0))
    held = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return full.join(marks, "id", "left").select("part", "mask", held("good"), held("toxic"))


def _parity(mask: Column, subset) -> Column:
    """+1 or -1 as mask & subset has an even or odd number of bits."""
    return 1 - 2 * (F.bit_count(mask.bitwiseAND(subset)) % 2)


def parity_sums(masks: DataFrame) -> DataFrame:
    """part, good, toxic and the array of the 32 sums."""
    sums = [F.sum(_parity(F.col("mask"), s)).cast("long").alias(f"w{s}") for s in range(MASKS)]
    return masks.groupBy("part", "good", "toxic").agg(*sums).select("part", "good", "toxic", F.array(*[f"w{s}" for s in range(MASKS)]).alias("sums"))


def mask_counts(sums: DataFrame) -> DataFrame:
    """The inverse transform. part and, for all, good and toxic documents, the array of the counts of masks 0 to 31."""
    at = F.sequence(F.lit(0), F.lit(MASKS - 1))
    total = lambda m: F.aggregate(at, F.lit(0).cast("long"), lambda t, s: t + _parity(m, s) * F.get("sums", s))
    counts = sums.withColumn("counts", F.transform(at, lambda m: F.call_function("div", total(m), F.lit(MASKS))))
    cells = counts.select("part", "good", "toxic", F.posexplode("counts").alias("mask", "n"))
    kinds = {"every": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    cells = cells.groupBy("part", "mask").agg(*[F.sum(F.when(k, F.col("n")).otherwise(0)).alias(c) for c, k in kinds.items()])
    in_order = lambda c: F.array_sort(F.collect_list(F.struct("mask", c)))[c].alias(c)  # noqa: E731  32 of a part
    return cells.groupBy("part").agg(*[in_order(c) for c in kinds])


def filter_orders(counts: DataFrame) -> DataFrame:
    """counts: part, and arrays of 32 named every, good, toxic. One row per part, order and step."""
    steps = counts.withColumn("filter_order", F.explode(F.array(*[F.lit(o) for o in ORDERS]))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    earlier = F.substring("filter_order", F.lit(1), F.col("step") - 1)
    bits = lambda within: sum((F.when(F.contains(within, F.lit(f)), 1 << k).otherwise(0) for k, f in enumerate(FILTERS)), F.lit(0))
    steps = steps.withColumns({"own": bits(letter), "before": bits(earlier)})
    own, before, at = F.col("own"), F.col("before"), F.sequence(F.lit(0), F.lit(MASKS - 1))

    def total(of: str, keep, weight=lambda m: F.lit(1)) -> Column:
        return F.aggregate(at, F.lit(0).cast("long"), lambda t, m: t + F.when(keep(m), F.get(of, m) * weight(m)).otherwise(0))

    fails = lambda m: m.bitwiseAND(own) != 0
    gone = lambda m: m.bitwiseAND(before) != 0
    removed = lambda m: fails(m) & ~gone(m)
    return steps.select(
        "part", "filter_order", "step",
        total("every", lambda m: ~fails(m) & ~gone(m)).alias("kept"),
        total("every", removed).alias("removed"),
        total("every", lambda m: fails(m) & gone(m)).alias("redundant"),
        total("every", lambda m: m == own).alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        total("every", fails, lambda m: F.call_function("div", F.lit(len(ORDERS)), F.bit_count(m))).alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    return filter_orders(mask_counts(parity_sums(failure_masks(docs, labels, id_col, text_col, part_col))))


AUDIT_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
f AS (SELECT part, doc_id, len(words) < 50 AS a, 100 * len(list_distinct(words)) < 65 * len(words) AS b, 100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text) AS c,
      regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e FROM t),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
g AS (SELECT part, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END, CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS fails,
      coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM f LEFT JOIN l USING (doc_id)),
h AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM g GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k),
o AS (SELECT concat(p.k, q.k, r.k, s.k, t.k) AS filter_order FROM x p, x q, x r, x s, x t WHERE len(list_distinct([p.k, q.k, r.k, s.k, t.k])) = 5),
st AS (SELECT filter_order, step, substr(filter_order, step, 1) AS own, '[' || substr(filter_order, 1, step - 1) || '.]' AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
z AS (SELECT filter_order, step, h.*, contains(fails, own) AS bad, regexp_matches(fails, before) AS gone, fails = own AS alone FROM st, h),
-- the share of a document that each of its filters takes over all orders, counted from the orders themselves
sh AS (SELECT part, own, sum(n) AS shapley FROM st, h WHERE contains(fails, own) AND NOT regexp_matches(fails, before) GROUP BY ALL)
SELECT z.part, z.filter_order, z.step, coalesce(sum(n) FILTER (NOT bad AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (bad AND NOT gone), 0)::BIGINT AS removed,
       coalesce(sum(n) FILTER (bad AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (alone), 0)::BIGINT AS unique_fails,
       coalesce(sum(good) FILTER (bad AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (bad AND NOT gone), 0)::BIGINT AS toxic_lost,
       coalesce(any_value(sh.shapley), 0)::BIGINT AS shapley
FROM z LEFT JOIN sh ON sh.part = z.part AND sh.own = substr(z.filter_order, z.step, 1) GROUP BY ALL"""
