"""Network building: canonical edges, node filters, cutoffs, neighbour limits and statistics.

Nodes are ``(node_id, header, seq_len)`` and edges ``(i, j, score, ...)``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simloom.functions.headers import first_token
from simloom.functions.scores import normalized_score, normalized_score_floored
from simloom.plans.numbering import dense_index_by_id
from simloom.plans.ranking import kth_largest
from simloom.plans.runtime import materialized


def canonical_edges(hits: DataFrame, score: str = "score") -> DataFrame:
    """Undirected edges ``i < j`` with the best score; self hits are dropped."""
    return (
        hits.where(F.col("i") != F.col("j"))
        .groupBy(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
        .agg(F.max(score).alias("score"))
    )


def nodes_named_in(nodes: DataFrame, headers: DataFrame) -> DataFrame:
    """Nodes whose full header, or whose first token, occurs among the given headers.

    Two left joins on distinct keys instead of one OR-join, which would be a nested loop.
    """
    full = headers.select("header").distinct().withColumn("by_header", F.lit(True))
    token = (
        headers.select(first_token(F.col("header")).alias("token"))
        .where(F.col("token") != "")
        .distinct()
        .withColumn("by_token", F.lit(True))
    )
    return (
        nodes.withColumn("token", first_token(F.col("header")))
        .join(full, "header", "left")
        .join(token, "token", "left")
        .where(F.col("by_header") | F.col("by_token"))
        .select(*nodes.columns)
    )


def missing_from_network(headers: DataFrame, nodes: DataFrame) -> DataFrame:
    """First tokens of the given headers that name no node."""
    token = headers.select(first_token(F.col("header")).alias("token")).where(F.col("token") != "").distinct()
    known = nodes.select(F.explode(F.array("header", first_token(F.col("header")))).alias("token"))
    return token.join(known, "token", "left_anti")


def reindexed(nodes: DataFrame) -> DataFrame:
    """Kept nodes with a gap-free ``new_id`` in the old order."""
    return dense_index_by_id(nodes, "new_id", "node_id")


def induced_edges(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges with both endpoints among the kept nodes, on their new ids.

    ``kept`` comes from :func:`reindexed`. Other edge columns and directions are retained.
    """
    left = kept.select(F.col("node_id").alias("i"), F.col("new_id").alias("__i"))
    right = kept.select(F.col("node_id").alias("j"), F.col("new_id").alias("__j"))
    return (
        edges.join(left, "i")
        .join(right, "j")
        .withColumns({"i": F.col("__i"), "j": F.col("__j")})
        .select(*edges.columns)
    )


def edges_within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both endpoints among the nodes, on their old ids."""
    ids = nodes.select("node_id")
    return edges.join(ids.withColumnRenamed("node_id", "i"), "i", "left_semi").join(
        ids.withColumnRenamed("node_id", "j"), "j", "left_semi"
    )


def with_lengths(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the sequence lengths of both endpoints."""
    return edges.join(nodes.select(F.col("node_id").alias("i"), F.col("seq_len").alias("len_i")), "i").join(
        nodes.select(F.col("node_id").alias("j"), F.col("seq_len").alias("len_j")), "j"
    )


def normalized_edges(
    edges: DataFrame, nodes: DataFrame, mode: str, floor: float | None = None
) -> DataFrame:
    """Edge scores ``(i, j, score)`` divided by the chosen length."""
    args = [F.col(c) for c in ("score", "aln_len", "len_i", "len_j")]
    value = (
        normalized_score(*args, mode)
        if floor is None
        else normalized_score_floored(*args, mode, floor)
    )
    return with_lengths(edges, nodes).select("i", "j", value.alias("score"))


def at_least(edges: DataFrame, threshold: float) -> DataFrame:
    """Score threshold, compared in the precision the scores are stored in."""
    stored = edges.schema["score"].dataType
    return edges.where(F.col("score") >= F.lit(threshold).cast(stored))


def top_percent_cutoff(edges: DataFrame, n_nodes: int, percent: float):
    """Score of the last edge among the top percent of all *possible* edges (0.0 without edges)."""
    wanted = int(n_nodes * (n_nodes - 1) / 2.0 * (percent / 100.0))
    cutoff = kth_largest(edges, "score", wanted, clamp=True)
    return 0.0 if cutoff is None else cutoff


def top_percent(edges: DataFrame, n_nodes: int, percent: float) -> DataFrame:
    """Edges at or above the top-percent cutoff, ties included.

    Finding the cutoff takes several scans of the scores, so the edges are written once.
    """
    edges = materialized(edges)
    cutoff = top_percent_cutoff(edges, n_nodes, percent)
    return edges.where(F.col("score") >= F.lit(cutoff))


def nearest_edges(edges: DataFrame, k: int) -> DataFrame:
    """Edges among the ``k`` best of their source or the ``k`` best of their target.

    Both ranks are limited before the shuffle (window group limit), so that a hub sends at most
    ``k`` rows per task. Equal scores go to the lower node pair.
    """

    def best(side: str) -> DataFrame:
        order = Window.partitionBy(side).orderBy(F.desc("score"), "i", "j")
        return edges.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= k).drop("__rank")

    return best("i").union(best("j")).distinct()


def endpoints(edges: DataFrame) -> DataFrame:
    """Both endpoints of every edge as ``(node_id, other)``."""
    return edges.select(
        F.inline(
            F.array(
                F.struct(F.col("i").alias("node_id"), F.col("j").alias("other")),
                F.struct(F.col("j").alias("node_id"), F.col("i").alias("other")),
            )
        )
    )


def degrees(edges: DataFrame) -> DataFrame:
    return endpoints(edges).groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"))


def neighbours(edges: DataFrame, selected: DataFrame) -> DataFrame:
    """Nodes adjacent to a selection, without the selection itself."""
    chosen = selected.select("node_id")
    reached = (
        endpoints(edges).join(chosen, "node_id", "left_semi").select(F.col("other").alias("node_id")).distinct()
    )
    return reached.join(chosen, "node_id", "left_anti")


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without any edge."""
    return nodes.join(endpoints(edges).select("node_id"), "node_id", "left_anti")


def visible_edges(edges: DataFrame, nodes: DataFrame, slider: float) -> DataFrame:
    """Edges at or above the slider with both endpoints visible."""
    return edges_within(at_least(edges, slider), nodes.where("visible"))


def score_statistics(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: node and edge counts, possible edges and score range."""
    n = nodes.agg(F.count(F.lit(1))).scalar()
    return edges.agg(
        F.count(F.lit(1)).alias("edges"),
        F.min("score").cast("double").alias("min_score"),
        F.max("score").cast("double").alias("max_score"),
        F.avg("score").alias("mean_score"),
    ).select(
        n.alias("nodes"),
        F.shiftright(n * (n - 1), 1).alias("possible_edges"),
        "*",
    )


def sweep_thresholds(lowest: float, highest: float, evalue: bool) -> list[float]:
    """Thresholds of the sweep: steps of 0.1, or for E-values 1 up to 100 and 5 beyond."""
    if evalue:
        top = math.ceil(highest)
        marks = range(math.floor(lowest), min(100, top) + 1)
        return [float(t) for t in (*marks, *range(105, top + 5, 5))]
    start = math.floor(lowest * 10) / 10.0
    return [start + 0.1 * k for k in range(math.ceil((highest + 0.1 - start) / 0.1))]


def threshold_sweep(edges: DataFrame, possible: int, thresholds: list[float]) -> DataFrame:
    """Edges at or above each threshold and their share of all possible edges.

    One pass: each edge counts at the last threshold it reaches, and only the threshold table is
    accumulated from the top.
    """
    marks = edges.sparkSession.createDataFrame(
        [(k, float(t)) for k, t in enumerate(thresholds)], "step INT, threshold DOUBLE"
    )
    limits = F.array(*[F.lit(float(t)) for t in thresholds])
    reached = F.size(F.filter(limits, lambda t: t <= F.col("score").cast("double"))) - 1
    counted = edges.groupBy("score").count().groupBy(reached.alias("step")).agg(F.sum("count").alias("n"))
    above = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    return marks.join(counted, "step", "left").select(
        "threshold",
        F.sum(F.coalesce("n", F.lit(0))).over(above).alias("edges"),
        (F.sum(F.coalesce("n", F.lit(0))).over(above) * 100.0 / F.lit(possible)).alias("percent"),
    )


def histogram(df: DataFrame, value: Column, bins: int) -> DataFrame:
    """Equal-width histogram ``(bin, low, high, count)``; the maximum falls in the last bin."""
    values = df.select(value.cast("double").alias("v"))
    low, high = values.agg(F.min("v"), F.max("v")).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "bin INT, low DOUBLE, high DOUBLE, count BIGINT")
    if low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    slot = F.least(F.floor((F.col("v") - low) / F.lit(high - low) * bins), F.lit(bins - 1))
    counted = values.groupBy(slot.cast("int").alias("bin")).count()
    return (
        df.sparkSession.range(bins)
        .select(F.col("id").cast("int").alias("bin"))
        .join(counted, "bin", "left")
        .select(
            "bin",
            (F.lit(low) + F.col("bin") * width).alias("low"),
            (F.lit(low) + (F.col("bin") + 1) * width).alias("high"),
            F.coalesce("count", F.lit(0)).alias("count"),
        )
    )


def completeness(edges: DataFrame, n_nodes: int) -> str:
    """``complete`` when every possible pair is stored, from the row count alone."""
    return "complete" if edges.count() == n_nodes * (n_nodes - 1) // 2 else "incomplete"


def edge_violations(edges: DataFrame, n_nodes: int) -> DataFrame:
    """One row counting broken storage rules of an edge table."""
    pairs = edges.groupBy("i", "j").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.isnan("score") | F.col("score").isNull() | (F.abs("score") == float("inf"))).alias("not_finite"),
    )
    return pairs.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("edges"),
        F.coalesce(F.sum("not_finite"), F.lit(0)).alias("not_finite"),
        F.coalesce(F.sum(F.col("rows") - 1), F.lit(0)).alias("duplicates"),
        F.count_if(F.col("i") >= F.col("j")).alias("not_ordered"),
        F.count_if((F.least("i", "j") < 0) | (F.greatest("i", "j") >= n_nodes)).alias("out_of_range"),
    )


def consistency_report(records: DataFrame, nodes: DataFrame, rows: DataFrame, reference: str) -> DataFrame:
    """One row comparing a sequence file with a network, an alignment and a reference name."""
    named = (
        records.select("header")
        .join(nodes.select("header", F.lit(True).alias("in_network")).distinct(), "header", "left")
        .join(rows.select("header", F.lit(True).alias("in_alignment")).distinct(), "header", "left")
    )
    return named.agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(F.col("in_network").isNull()).alias("missing_in_network"),
        F.count_if(F.col("in_alignment").isNull()).alias("missing_in_alignment"),
        F.count_if(F.contains(F.lower("header"), F.lit(reference.lower()))).alias("reference_hits"),
    )


def first_examples(values: DataFrame, column: str, most: int = 10) -> DataFrame:
    """The first few values in order, for messages."""
    return values.select(column).orderBy(column).limit(most)
