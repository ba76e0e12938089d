"""Work along one order over a whole table: neighbours, running sums, as-of lookups.

Rows are stored in ranges of the order, each range is a window of its own, and what a range needs of the others is one row for each of them, which is all
that reaches the driver.  No window holds the table, and no result depends on the number of ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.storage import kept

_PART, _OTHER = "_part", "_other"


def in_ranges(df: DataFrame, order: list[str], name: str = "ranges") -> DataFrame:
    """``df``, stored in ranges of about equal size by ``order``, each row with the number of its range."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return kept(df.repartitionByRange(n, *order).withColumn(_PART, F.spark_partition_id()), name)


def _beside(ranged: DataFrame, rows: list[tuple[int, object]], dtype: T.DataType) -> DataFrame:
    """``ranged`` with a value for each range as a column."""
    table = ranged.sparkSession.createDataFrame(rows, T.StructType([T.StructField(_PART, T.IntegerType()), T.StructField(_OTHER, dtype)]))
    return ranged.join(F.broadcast(table), _PART, "left")  # a row for each range


def _edges(ranged: DataFrame, edge: Column) -> list:
    """(range, value) of an aggregate over each range, in order."""
    return ranged.groupBy(_PART).agg(edge.alias("e")).orderBy(_PART).collect()  # a row for each range


def with_next(df: DataFrame, order: list[str], column: str, alias: str, cyclic: bool = False) -> DataFrame:
    """``df`` with ``column`` of the next row in ``order``; after the last row comes the first if ``cyclic``, else null.  Rows equal in ``order`` follow one another in any order."""
    ranged = in_ranges(df, order)
    firsts = _edges(ranged, F.min(F.struct(*order, F.col(column).alias(_OTHER))))
    after = [r["e"][_OTHER] for r in firsts[1:]] + [firsts[0]["e"][_OTHER] if cyclic and firsts else None]
    joined = _beside(ranged, [(r[_PART], a) for r, a in zip(firsts, after, strict=False)], ranged.schema[column].dataType)
    row = W.partitionBy(_PART).orderBy(*order)
    last = F.row_number().over(row) == F.count("*").over(W.partitionBy(_PART))
    return joined.withColumn(alias, F.when(last, F.col(_OTHER)).otherwise(F.lead(column).over(row))).drop(_PART, _OTHER)


def running(df: DataFrame, order: list[str], column: str, alias: str) -> DataFrame:
    """``df`` with the sum of ``column`` over all rows before and at each row in ``order``, which must tell rows apart."""
    ranged = in_ranges(df, order)
    total, rows = 0, []
    for r in _edges(ranged, F.sum(F.col(column).cast("long"))):
        rows.append((r[_PART], total))
        total += r["e"] or 0
    so_far = W.partitionBy(_PART).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return _beside(ranged, rows, T.LongType()).withColumn(alias, F.coalesce(F.sum(F.col(column).cast("long")).over(so_far), F.lit(0)) + F.col(_OTHER)).drop(_PART, _OTHER)


def as_of(left: DataFrame, right: DataFrame, at: str, value: str, by: list[str] | None = None) -> DataFrame:
    """``left`` with ``value`` of the last row of ``right`` whose ``at`` is at most its own, of the same ``by``; null where there is none.

    Both sides are sorted together, a row of ``right`` before the rows of ``left`` that are equal to it.  A place that is null has no value;
    of rows of ``right`` that are equal in ``by`` and ``at`` the largest value counts.
    """
    by = by or []
    keys = [*by, at]
    payload = F.struct(*(F.col(c) for c in left.columns))
    ours = left.select(*keys, F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_value"), payload.alias("_row"))
    theirs = right.filter(F.col(at).isNotNull()).select(*keys, F.lit(0).alias("_side"), F.col(value).alias("_value"), F.lit(None).cast(ours.schema["_row"].dataType).alias("_row"))
    found = F.struct(*(F.col(b).alias(f"k{i}") for i, b in enumerate(by)), F.col("_value").alias("v"))
    order = [*keys, "_side", "_value"]
    ranged = in_ranges(ours.unionByName(theirs).withColumn("_found", F.when(F.col("_side") == 0, found)), order)
    before, rows = None, []
    for r in _edges(ranged, F.max_by("_found", F.when(F.col("_side") == 0, F.struct(*order)))):
        rows.append((r[_PART], before))
        before = r["e"] or before
    so_far = W.partitionBy(_PART).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    joined = _beside(ranged, rows, ranged.schema["_found"].dataType)
    last = joined.withColumn("_last", F.coalesce(F.last("_found", ignorenulls=True).over(so_far), F.col(_OTHER))).filter("_side = 1")
    same = F.col(at).isNotNull()
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_last.k{i}"))
    return last.select("_row.*", F.when(same, F.col("_last.v")).alias(value))
