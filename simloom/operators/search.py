"""One-against-all search, ranking of hits and comparison of result sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked_hits(
    hits: DataFrame,
    query: str,
    top_k: int | None,
    threshold: float | None = None,
    manual_query: bool = False,
) -> DataFrame:
    """Hits ``(header, norm_score, ...)`` by falling score with their ``rank``.

    ``top_k`` is the number of hits wanted, None for all. The threshold applies first, then a stored query loses its own hit and one of its ``top_k``
    places; a manual query keeps both. Equal scores go by header. The top-k is taken per
    partition before it is merged, so ranking only ever sees ``top_k`` rows.
    """
    if threshold is not None:
        hits = hits.where(F.col("norm_score") >= threshold)
    if not manual_query:
        hits = hits.where(F.col("header") != query)
    order = [F.desc("norm_score"), F.asc("header")]
    if top_k is not None:
        hits = hits.orderBy(*order).limit(max(0, top_k if manual_query else top_k - 1))
        return hits.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    from simloom.plans.numbering import running_total

    # Unlimited ranking: count the rows above through score buckets instead of one global sort.
    bucket = -F.floor(F.col("norm_score") * 1_000_000)
    return running_total(hits, "rank", F.lit(1).cast("long"), [bucket], order)


def search_report(ranked: DataFrame) -> DataFrame:
    """Metadata-shaped report with the fixed column names."""
    return ranked.select(
        F.col("header").alias("Node ID"),
        F.col("rank").alias("Rank"),
        F.col("norm_score").alias("Norm_Score"),
        F.col("raw_score").alias("Raw_Score"),
        F.col("seq_len").alias("Sequence_Length"),
        F.col("aln_len").alias("Alignment_Length"),
    )


def result_differences(
    first: DataFrame, second: DataFrame, keys: list[str], tolerance: float = 1e-3
) -> DataFrame:
    """One row counting differences between two scored results ``(keys..., score, aln_len)``.

    Results are equivalent if all three counts are zero: same keys, same path lengths, and a
    score drift per aligned position within the tolerance.
    """
    a = first.select(*keys, F.col("score").alias("score_a"), F.col("aln_len").alias("len_a"))
    b = second.select(*keys, F.col("score").alias("score_b"), F.col("aln_len").alias("len_b"))
    drift = F.abs(F.col("score_a") - F.col("score_b")) / F.greatest(F.lit(1), F.col("len_a"))
    return a.join(b, keys, "full").agg(
        F.count_if(F.col("len_a").isNull() | F.col("len_b").isNull()).alias("unmatched"),
        F.count_if(F.col("len_a") != F.col("len_b")).alias("length_differences"),
        F.count_if(drift > tolerance).alias("score_drifts"),
    )


def nearest_to_point(nodes: DataFrame, x: float, y: float) -> DataFrame:
    """Visible node closest to a point; ties go to the one drawn last."""
    distance: Column = F.sqrt(F.pow(F.col("x") - x, 2) + F.pow(F.col("y") - y, 2))
    return (
        nodes.where("visible").withColumn("distance", distance).orderBy("distance", F.desc("render_rank")).limit(1)
    )
