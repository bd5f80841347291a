"""Documents in ascending doc_id order over many partitions, without a global sort in one task.

Bounds are approximate quantiles of doc_id alone (a scan of one column); each row computes its own part from
them, and ``repartitionById`` sends part p to partition p. Rows of a part are sorted there, so part order plus
in-part order is the global order. The bounds only steer balance: any bounds give the same order.
Null doc_ids come last, in as many parts of their own as their number asks for, by a hash of text and place; equal doc_ids are ordered by text
(ties). An empty table has one part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import width


def part_bounds(docs: DataFrame, parts: int) -> list[int]:
    """At most parts - 1 increasing doc_ids that cut the table into parts of about equal row count."""
    if parts < 2:
        return []
    row = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 20 * parts).alias("q")).first()
    return sorted(set(row.q or []))


def part_column(bounds: list[int], values: list | None = None) -> Column:
    """The part of a doc_id: how many bounds are at or below it, as a balanced tree of comparisons. With ``values``, the
    part's value instead."""
    out = values if values is not None else list(range(len(bounds) + 1))

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(out[low]).cast("bigint" if values is not None else "int")
        mid = (low + high) // 2
        return F.when(F.col("doc_id") < F.lit(int(bounds[mid])), tree(low, mid)).otherwise(tree(mid + 1, high))

    return tree(0, len(bounds))


def in_order(docs: DataFrame) -> tuple[DataFrame, int]:
    """docs with a column part, dealt out by part and sorted by (doc_id, text); and the number of parts."""
    parts = width(docs.sparkSession)
    bounds = part_bounds(docs, parts)
    n = len(bounds) + 1
    count = docs.agg(F.count(F.lit(1)).alias("all"), F.count("doc_id").alias("ids")).first()
    # as many parts for rows without an id as others have for as many rows
    nulls = -(-(count.all - count.ids) * parts // max(1, count.all))
    part = part_column(bounds)
    if nulls:
        part = F.when(F.col("doc_id").isNull(), F.lit(n) + F.pmod(F.xxhash64("text", F.monotonically_increasing_id() % 64), F.lit(nulls)).cast("int")).otherwise(part)
    dealt = docs.withColumn("part", part).repartitionById(n + nulls, F.col("part"))
    return dealt.sortWithinPartitions(F.col("part"), F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_first()), n + nulls
