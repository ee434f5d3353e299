"""Running numbers and sums without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import written


def ranked(df: DataFrame, by: list, name: str, size: str | None = None) -> DataFrame:
    """Rows numbered from 0 in the order of any columns, or with `size` the running sum of that column before each row.

    Rows are dealt by ranges of the columns and numbered in each; a table with one row a range has what lies before it.  Equal rows may stand in
    any order, but no two have one number, and a range of equal rows is as large as their number.
    """
    by = [F.col(c) if isinstance(c, str) else c for c in by]
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    # written, so that the ranges and the places in them stay as they are
    rows = written(df.repartitionByRange(*by).sortWithinPartitions(*by).select("*", F.spark_partition_id().alias("__range"), place.alias("__place")), "ranked")
    inside = F.col("__place")
    if size:
        inside = F.coalesce(F.sum(size).over(W.partitionBy("__range").orderBy("__place").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    each = rows.groupBy("__range").agg((F.sum(size) if size else F.count("*")).alias("__n"))
    before = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    first = each.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    return rows.withColumn("__inside", inside).join(F.broadcast(first), "__range").withColumn(name, F.col("__first") + F.col("__inside")).drop("__range", "__place", "__inside", "__first")


def numbered(df: DataFrame, key: str, name: str, width: int = 100_000, size: str | None = None) -> DataFrame:
    """Rows numbered from 0 in the order of a whole-number key, or with `size` the running sum of that column before each row.

    Ranges of `width` keys are numbered apart and their totals summed up.
    """
    at = df.withColumn("__b", F.floor(F.col(key) / width))
    before = W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    each = F.sum(size) if size else F.count("*")
    base = at.groupBy("__b").agg(each.alias("n")).select("__b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    w = W.partitionBy("__b").orderBy(key)
    inside = F.coalesce(F.sum(size).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) if size else F.row_number().over(w) - 1
    return at.withColumn("__i", inside).join(base, "__b").withColumn(name, F.col("__base") + F.col("__i")).drop("__b", "__i", "__base")
