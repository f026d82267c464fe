"""Dense ordered row numbers and running totals without a single-task global window.

Node indices are positions in file order and ties are resolved by them, so ordinals are data.
A global window would move every row to one task. Here the order is split into a coarse prefix
(buckets of bounded size) and a fine remainder: buckets are pre-aggregated, only the small
bucket table is accumulated in order, and rows are accumulated inside their bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ID_BUCKET_BITS = 20


def id_bucket(column: str | Column, bits: int = ID_BUCKET_BITS) -> Column:
    """Bucket of a unique integer id: at most ``2**bits`` rows share one."""
    column = F.col(column) if isinstance(column, str) else column
    return F.shiftright(column.cast("long"), bits)


def running_total(
    df: DataFrame,
    out: str,
    weight: Column,
    coarse: Sequence[Column],
    fine: Sequence[Column],
    within: Sequence[str] = (),
    inclusive: bool = True,
) -> DataFrame:
    """Sum ``weight`` over all rows up to each row in the order ``(coarse..., fine...)``.

    Totals restart per ``within`` group, which may be of any size: a group that holds a large
    share of all rows still spreads over its coarse buckets. ``coarse`` columns sort ascending,
    must not be NULL and must bound the rows per bucket (:func:`id_bucket` does that for ids).
    """
    groups = list(within)
    buckets = [f"__bucket{k}" for k in range(len(coarse))]
    bucketed = df.withColumns({**dict(zip(buckets, coarse)), "__weight": weight})
    keys = groups + buckets
    earlier = Window.partitionBy(*groups).orderBy(*buckets)
    earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        bucketed.groupBy(*keys)
        .agg(F.sum("__weight").alias("__size"))
        # One row per bucket: the only ordered pass that spans buckets.
        .select(*keys, F.coalesce(F.sum("__size").over(earlier), F.lit(0)).alias("__offset"))
    )
    last = 0 if inclusive else -1
    inside = Window.partitionBy(*keys).orderBy(*fine).rowsBetween(Window.unboundedPreceding, last)
    total = F.col("__offset") + F.coalesce(F.sum("__weight").over(inside), F.lit(0))
    return (
        bucketed.join(offsets, keys)
        .withColumn(out, total)
        .drop(*buckets, "__weight", "__offset")
    )


def dense_index(
    df: DataFrame,
    out: str,
    coarse: Sequence[Column],
    fine: Sequence[Column],
    within: Sequence[str] = (),
    start: int = 0,
) -> DataFrame:
    """Number rows ``start, start+1, ...`` in the order ``(coarse..., fine...)``."""
    counted = running_total(df, out, F.lit(1).cast("long"), coarse, fine, within)
    return counted.withColumn(out, F.col(out) + F.lit(start - 1))


def dense_index_by_id(df: DataFrame, out: str, id_column: str, start: int = 0) -> DataFrame:
    """Number rows by one unique integer id column."""
    return dense_index(df, out, [id_bucket(id_column)], [F.col(id_column)], start=start)
