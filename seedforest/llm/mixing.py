"""Mixing sources to target weights with a time-varying curriculum.

Each source has a weight schedule over training time t in [0, 1], linear between knots. Its integral gives the cumulative
token demand, scaled to the source's target; inverting that curve at a document's cumulative tokens gives the
document's training position, and the result is range-sorted by position.

Targets share `share` of all words by weight; a target stops at `max_passes` times its source and the excess is shared anew
among the rest by weight. Documents of a source follow in the order of md5(id): whole passes first, then the
documents up to the remainder; the document on the edge gives the words that are still missing.

Null and empty texts have size 0, take nothing and have no position. A null source is a source of its own, last in order. Rows that
repeat an id are separate documents (ties in the order are of equal id and fall by size and digest; rows that agree in these as well are told apart by a number that
means nothing else). Very long texts are only counted. An empty table gives an empty table. Other columns are not read; mixed_documents passes them on, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, unused, with_keys

WEIGHTS = (5, 2, 1)
MAX_PASSES = 3
#: Relative weight over time of the sources of each weight class: heavy sources early, light ones late.
SCHEDULES = (((0.0, 1.25), (0.5, 1.0), (1.0, 0.75)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))
WORD = r"[^\x20\x09-\x0D]+"


def words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _digest(text: Column) -> Column:
    """Tells the texts of one id and source apart."""
    return F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def segments(schedule) -> list[tuple[float, float, float, float, float]]:
    """(start, width, weight at start, weight at end, demand before it) of each piece; all demand adds up to 1."""
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(schedule, schedule[1:]))
    out, before = [], 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        out.append((t0, t1 - t0, w0 / area, w1 / area, before))
        before += (t1 - t0) * (w0 + w1) / 2 / area
    return out


def invert_sql(schedule, y: str) -> str:
    """SQL for the time at which the demand reaches y (0 to 1): in each piece a quadratic's root, in the form that also holds for flat pieces."""
    cases = []
    for t0, width, w0, w1, before in reversed(segments(schedule)):
        slope = (w1 - w0) / width
        cases.append(f"WHEN {y} >= CAST({before!r} AS DOUBLE) THEN CAST({t0!r} AS DOUBLE) + CAST(2.0 AS DOUBLE) * ({y} - CAST({before!r} AS DOUBLE)) / (CAST({w0!r} AS DOUBLE) + sqrt(CAST({w0 * w0!r} AS DOUBLE) + CAST({2 * slope!r} AS DOUBLE) * ({y} - CAST({before!r} AS DOUBLE))))")
    return f"(CASE {' '.join(cases)} ELSE CAST(NULL AS DOUBLE) END)"


def position_sql(schedules, rank: str, y: str) -> str:
    arms = " ".join(f"WHEN {k} THEN {invert_sql(s, y)}" for k, s in enumerate(schedules))
    return f"(CASE {rank} % {len(schedules)} {arms} END)"


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_passes: int = MAX_PASSES, share: float = 1.0) -> DataFrame:
    """sizes: one row per source (no_source, source, source_size). Adds rank and target. The windows see one row per source, not documents."""
    order = Window.partitionBy().orderBy("no_source", "source")
    weighed = sizes.withColumn("rank", F.row_number().over(order) - 1)
    weighed = weighed.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")))
    weighed = weighed.withColumn("most", F.col("source_size") * max_passes)
    by_need = Window.partitionBy().orderBy(F.col("most").cast("double") / F.col("weight"), "rank")
    weighed = weighed.withColumns({
        "total": F.sum("source_size").over(Window.partitionBy()),
        "full": F.coalesce(F.sum("most").over(by_need.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "rest": F.sum("weight").over(by_need.rowsBetween(0, Window.unboundedFollowing)),
    })
    # filling up: while the sources before this one are full, a unit of weight gets `level` words
    level = (F.col("total").cast("double") * F.lit(float(share)) - F.col("full").cast("double")) / F.col("rest").cast("double")
    weighed = weighed.withColumn("level", level)
    fits = F.when(F.col("most").cast("double") / F.col("weight") >= F.col("level"), F.struct(F.col("most").cast("double") / F.col("weight"), "rank", "level"))
    weighed = weighed.withColumn("level", F.min(fits).over(Window.partitionBy())["level"])
    target = F.when(F.col("level").isNull(), F.col("most").cast("double")).otherwise(F.least(F.col("most").cast("double"), F.col("level") * F.col("weight")))
    return weighed.select("no_source", "source", "source_size", "rank", target.alias("target"))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, max_passes: int = MAX_PASSES, share: float = 1.0) -> DataFrame:
    """id, no_source, source, digest (of the text), size, source_size, rank, target, turn, before (words of the source ahead of the row), full_passes, part, taken for every row.

    The running sums over a source are made in two levels: sums of buckets of the md5 order, then rows of one bucket, so that a source with most
    of the rows is still dealt out to many tasks.
    """
    base = cut(docs.select(
        F.col(id_col).alias("id"), words(text_col).alias("size"), F.col(source_col).isNull().alias("no_source"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("turn"),
        _digest(F.col(text_col)).alias("digest"),
    ))
    bits = min(17, max(3, (base.count().bit_length() + 1) // 2))
    base = base.withColumn("bucket", F.shiftright(F.conv(F.substring("turn", 1, 5), 16, 10).cast("int"), 20 - bits))
    key = ["no_source", "source"]
    buckets = cut(base.groupBy(*key, "bucket").agg(F.sum("size").alias("bucket_size")))
    targets = source_targets(buckets.groupBy(*key).agg(F.sum("bucket_size").alias("source_size")), weights, max_passes, share)
    ahead = Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = cut(buckets.withColumn("ahead", F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0))).join(targets, key).drop("bucket_size"))
    within = Window.partitionBy(*key, "bucket").orderBy("turn", "size", "digest").rowsBetween(Window.unboundedPreceding, -1)
    rows = base.join(buckets, [*key, "bucket"]).withColumn("before", F.col("ahead") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    whole = F.floor("target").cast("long")
    rows = rows.withColumn("full_passes", F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as long) div source_size")).otherwise(F.lit(0).cast("long")))
    rest = whole - F.col("full_passes") * F.col("source_size")
    part = F.greatest(F.lit(0).cast("long"), F.least("size", rest - F.col("before")))
    return rows.withColumn("part", part).withColumn("taken", F.col("full_passes") * F.col("size") + F.col("part"))


def _positioned(rows: DataFrame, number, schedules) -> DataFrame:
    """rows with the position of their pass of that number."""
    y = (number * F.col("source_size") + F.col("before") + F.col("size").cast("double") / 2) / F.col("target")
    rows = rows.withColumn("y", F.when(F.col("taken") > 0, y))
    return rows.withColumn("position", F.round(F.expr(position_sql(schedules, "rank", "y")), 9))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, max_passes: int = MAX_PASSES, share: float = 1.0, schedules=SCHEDULES) -> DataFrame:
    """id_col, size, source_size, target, taken, passes, position (of the first pass) for every row, range-sorted by position."""
    rows = _positioned(mix_plan(docs, id_col, text_col, source_col, weights, max_passes, share), F.lit(0), schedules)
    # what isn't taken has no position and is spread over the sort's ranges behind the rest
    last = F.coalesce(F.col("position"), 2 + (F.col("before") + F.conv(F.substring("turn", 1, 5), 16, 10).cast("double")) / (F.col("source_size") + 1048576))
    out = rows.withColumn("_at", last).repartitionByRange("_at", "turn").sortWithinPartitions("_at", "turn")
    passes = F.col("full_passes") + (F.col("part") > 0).cast("long")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "taken", passes.alias("passes"), "position")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, max_passes: int = MAX_PASSES, share: float = 1.0, schedules=SCHEDULES) -> DataFrame:
    """The rows of docs in training order, with all their columns: one for each pass that takes words of the document. The document on a target's edge comes whole."""
    plan = cut(mix_plan(docs, id_col, text_col, source_col, weights, max_passes, share).where("taken > 0").select("id", "no_source", "source", "digest", "rank", "turn", "size", "source_size", "before", "target", "full_passes", "part", "taken"))
    key = ["id", "no_source", "source", "digest"]
    names = dict(zip([*key, "number", "turn", "position"], unused(docs.columns, *key, "number", "turn", "position"), strict=True))
    source = F.coalesce(docs[source_col].cast("string"), F.lit(""))
    on = [docs[id_col], docs[source_col].isNull(), source]
    twice = cut(plan.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*key))
    same_order = Window.partitionBy(*key).orderBy("before")
    if twice.isEmpty():
        plan, own = plan.withColumn("number", F.lit(1)), docs.withColumn(names["number"], F.lit(1))
    else:  # rows that agree in id, source and text are numbered on both sides
        plan = plan.withColumn("number", F.row_number().over(same_order))
        digest = _digest(docs[text_col])
        first = Window.partitionBy(F.col(id_col), F.col(source_col), _digest(F.col(text_col))).orderBy(F.lit(0))
        many = with_keys(docs, on, twice, "left_semi", [digest]).withColumn(names["number"], F.row_number().over(first))
        own = with_keys(docs, on, twice, "left_anti", [digest]).withColumn(names["number"], F.lit(1)).unionByName(many)
    passes = plan.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full_passes") + (F.col("part") > 0).cast("long") - 1)))
    passes = _positioned(passes, F.col("pass"), schedules).select(*[F.col(k).alias(v) for k, v in names.items()])
    own = own.withColumns({names["id"]: F.col(id_col), names["no_source"]: F.col(source_col).isNull(), names["source"]: F.coalesce(F.col(source_col).cast("string"), F.lit("")), names["digest"]: _digest(F.col(text_col))})
    # null ids are keys like any other
    same = [own[names[k]].eqNullSafe(passes[names[k]]) for k in (*key, "number")]
    joined = own.join(passes.hint("shuffle_hash"), same).select(*[own[c] for c in docs.columns], passes[names["position"]], passes[names["turn"]])
    order = [names["position"], names["turn"]]
    return joined.repartitionByRange(*order).sortWithinPartitions(*order).select(*docs.columns)


def mixing_sql() -> str:
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, md5(doc_id::VARCHAR) AS turn FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 3 AS most FROM s),
f AS (SELECT *, (sum(source_size) OVER ())::DOUBLE AS total,
             coalesce(sum(most) OVER (ORDER BY most::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS full_before,
             (sum(weight) OVER (ORDER BY most::DOUBLE / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS rest FROM w),
l AS (SELECT *, (total - full_before) / rest AS level FROM f),
m AS (SELECT level FROM l WHERE most::DOUBLE / weight >= level ORDER BY most::DOUBLE / weight, rank LIMIT 1),
t AS (SELECT source, source_size, rank, CASE WHEN (SELECT level FROM m) IS NULL THEN most::DOUBLE ELSE least(most::DOUBLE, (SELECT level FROM m) * weight) END AS target FROM w),
r AS (SELECT d.doc_id, d.size, t.source_size, t.rank, t.target,
             coalesce(sum(d.size) OVER (PARTITION BY t.rank ORDER BY d.turn, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS full_passes FROM r),
q AS (SELECT *, greatest(0, least(size, floor(target)::BIGINT - full_passes * source_size - before)) AS part FROM p),
x AS (SELECT *, full_passes * size + part AS taken, CASE WHEN full_passes * size + part > 0 THEN (before + size::DOUBLE / 2) / target END AS y FROM q)
SELECT doc_id, size, source_size, target, taken::BIGINT AS taken, (full_passes + (part > 0)::INT)::BIGINT AS passes,
       round({position_sql(SCHEDULES, "rank", "y")}, 9) AS position FROM x"""
