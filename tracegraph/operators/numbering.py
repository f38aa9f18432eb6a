"""Gap-free numbering inside groups that may be very large.

``row_number() over (partition by g order by k)`` puts a whole group into one
task. When one group may hold a third of all rows, number it in two levels
instead: split each group into buckets of a monotone function of the leading
sort key, count rows per (group, bucket) (a partial aggregation), turn the
counts into offsets with a window over the small count table, and number rows
inside each (group, bucket) only. The result equals the plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_within(df: DataFrame, group_cols: list[str], order_cols: list[str], bucket: Column, out: str = "rank") -> DataFrame:
    """Add ``out`` = 1, 2, ... inside each group in ``order_cols`` order.

    ``bucket`` must be non-decreasing in the ``order_cols`` order (for example
    ``floor(first_key / width)``)."""
    b = df.withColumn("_bucket", bucket)
    counts = b.groupBy(*group_cols, "_bucket").agg(F.count("*").alias("_cnt"))
    w_off = Window.partitionBy(*group_cols).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group_cols, "_bucket", F.coalesce(F.sum("_cnt").over(w_off), F.lit(0)).alias("_off"))
    w_loc = Window.partitionBy(*group_cols, "_bucket").orderBy(*order_cols)
    local = b.withColumn("_loc", F.row_number().over(w_loc))
    j = local.join(offsets, group_cols + ["_bucket"])
    return j.withColumn(out, (F.col("_off") + F.col("_loc")).cast("bigint")).drop("_bucket", "_loc", "_off")


#: items whose text is brought together at once
TEXT_BUCKET = 1024


def joined_text(df: DataFrame, group_cols: list[str], ord_col: str, text_col: str, sep: str, out: str = "text", bucket: int = TEXT_BUCKET) -> DataFrame:
    """One text per group: its items in the order of ``ord_col`` (1, 2, ...), joined by ``sep``.

    Two levels: the items of a bucket of ranks become one text, then the bucket texts of a
    group are joined in order. A list in memory has at most ``bucket`` items, or one text
    per bucket."""

    def level(rows: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
        listed = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
        return rows.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x["t"]), sep).alias(out))

    placed = df.withColumn("_bucket", F.floor((F.col(ord_col) - 1) / bucket))
    return level(level(placed, [*group_cols, "_bucket"], ord_col, text_col), group_cols, "_bucket", out)
