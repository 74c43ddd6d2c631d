"""Exact dedup by progressive refinement: length, then a hash of the prefix, then the full hash.

Only JVM expressions. A first scan takes lengths and hashes of prefixes. Only rows whose length other rows have too are grouped by length and
prefix, and only rows whose length and prefix other rows have too are grouped by SHA-256, from a second scan. Rows reach a step through a filter of
bits, so a length or prefix that very many rows share lands in no single task; each step counts its groups within tasks first. Content never enters
a shuffle, only lengths and digests do.

Null counts as empty; texts are equal when their bytes are; of equal texts the row with the largest id stays (a null id is smallest). Rows that
repeat an id and a text count one by one and only kept = (id = keep_id) tells them apart from other copies. Very long texts are read whole, one at a time. Other columns are
not read; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, may_meet, unused, with_keys


def _several(df: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that more than one row has, written."""
    return cut(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 256, digest_all: bool = False) -> DataFrame:
    """id_col, n_bytes, keep_id, group_size, kept, text_sha256 for every row.

    Only rows that survive length and prefix are hashed in full to be compared; text_sha256 is null for the rest. digest_all=True: the caller wants every
    digest, so the second scan makes those of the rest as well, which are compared with nothing.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    sketch = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), F.xxhash64(F.substring(text, 1, prefix)).alias("prefix_hash"), text.alias("text"))
    lengths = cut(sketch.select("n_bytes", "prefix_hash"))
    common = _several(lengths, ["n_bytes"])
    keys = _several(may_meet(lengths, [lengths["n_bytes"]], common, "may").where("may"), ["n_bytes", "prefix_hash"])
    asked = may_meet(sketch, [sketch["n_bytes"], sketch["prefix_hash"]], keys, "may")
    full = F.sha2(F.col("text").cast("binary"), 256)
    every = cut(asked.select("id", "n_bytes", "may", (full if digest_all else F.when(F.col("may"), full)).alias("full_hash")))
    drop(lengths, common, keys)
    left = every.where("may").drop("may")
    groups = left.groupBy("n_bytes", "full_hash").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    # written, so that the join is planned from its size and, where it is large, split at groups that very many rows share
    grouped = left.join(cut(groups), ["n_bytes", "full_hash"], "left").select("id", "n_bytes", "full_hash", "keep_id", "group_size")
    alone = every.where("not may").select("id", "n_bytes", "full_hash", F.lit(None).cast(every.schema["id"].dataType).alias("keep_id"), F.lit(None).cast("long").alias("group_size"))
    keep = F.coalesce("keep_id", "id")
    return grouped.unionByName(alone).select(
        F.col("id").alias(id_col), "n_bytes", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"), F.col("full_hash").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that stay: one of each text, that of the largest id (one of the rows that repeat id and text)."""
    names = unused(docs.columns, "_id", "_n_bytes", "_sha256")
    judged = exact_dedup(docs, id_col, text_col).where("group_size > 1").select(F.col(id_col).alias(names[0]), F.col("n_bytes").alias(names[1]), F.col("text_sha256").alias(names[2]), "kept")
    judged = cut(judged)
    gone = cut(judged.where("not kept").drop("kept").distinct())
    repeated = _several(judged.where("kept"), names)
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    on, exact = [docs[id_col], F.octet_length(text).cast("long")], [F.sha2(text.cast("binary"), 256)]
    out = with_keys(docs, on, gone, "left_anti", exact)
    if not repeated.isEmpty():
        more = cut(gone.unionByName(repeated).distinct())
        digest = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), 256)
        one = with_keys(docs, on, repeated, "left_semi", exact).withColumn(names[2], digest).dropDuplicates([id_col, names[2]]).drop(names[2])
        out = with_keys(docs, on, more, "left_anti", exact).unionByName(one)
    drop(judged)
    return out


EXACT_DEDUP_SQL = """
SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""
