"""Identity weights of aligned sequences.

Identity is the share of matching standard residues among columns where either row has one.
A row's weight is the inverse number of rows (itself included) at least that identical.

Whether two rows are similar is looked up for every pair of distinct rows, on the grid of :mod:`simloom.plans.pairs`: a
tile compares blocks of rows by matrix products, one per residue, and keeps a sum per row. The work does not depend on the
threshold nor on how many rows share a stretch of columns, and only sums leave a tile. Copies are collapsed first.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simloom.functions.residues import STANDARD_RESIDUES
from simloom.plans.pairs import block_pairs, map_tiles, place_column
from simloom.plans.runtime import materialized

BLOCK_ROWS = 512
BLOCK_BYTES = 8 << 20


def _standard_only(sequence: Column) -> Column:
    return F.regexp_replace(F.upper(sequence), f"[^{STANDARD_RESIDUES}]", "-")


def similar_rows(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of two matrices of letters (gaps are ``-``) are at least that identical, as a matrix of booleans."""
    gap = ord("-")
    product = lambda x, y: x.astype(np.float32) @ y.astype(np.float32).T  # exact: sums are below 2**24
    in_a, in_b = a != gap, b != gap
    either = in_a.sum(1)[:, None] + in_b.sum(1)[None, :] - product(in_a, in_b)
    same = np.zeros(either.shape, np.float32)
    for letter in np.intersect1d(np.unique(a), np.unique(b)):
        if letter != gap:
            same += product(a == letter, b == letter)
    return (either > 0) & (same.astype(np.float64) >= threshold * either.astype(np.float64) - 1e-12)


def neighbour_counts(sequences: DataFrame, threshold: float) -> DataFrame:
    """``(sequence, neighbours)`` for distinct aligned texts ``(sequence, copies)``."""
    coded = sequences.select("sequence", "copies", _standard_only(F.col("sequence")).alias("coded"))
    by_code = materialized(coded.groupBy("coded").agg(F.sum("copies").alias("copies")).withColumn("id", F.monotonically_increasing_id()))
    width = by_code.agg(F.max(F.length("coded"))).first()[0] or 1
    padded = by_code.withColumn("coded", F.rpad("coded", width, "-"))
    rows = max(1, min(BLOCK_ROWS, BLOCK_BYTES // width))
    pairs = block_pairs(place_column(padded, "id"), "place", ["id", "copies", "coded"], rows)

    def work(tile):
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def add(block: int, ids: np.ndarray, n: np.ndarray) -> None:
            sums[block] = ids, n + (sums[block][1] if block in sums else 0)

        for given in tile:
            a, b = (np.frombuffer("".join(given[f"{side}_coded"]).encode("ascii"), np.uint8).reshape(-1, width) for side in "ab")
            similar = similar_rows(a, b, threshold)
            add(given["bi"], given["a_id"], similar @ given["b_copies"])
            if given["bi"] != given["bj"]:
                add(given["bj"], given["b_id"], similar.T @ given["a_copies"])
        for ids, n in sums.values():
            yield {"id": ids, "n": n}

    counted = map_tiles(pairs, work, "id BIGINT, n BIGINT").groupBy("id").agg(F.sum("n").alias("neighbours"))
    # A row without any standard residue stays one independent observation.
    found = by_code.join(counted, "id").select("coded", F.greatest("neighbours", F.lit(1)).alias("neighbours"))
    return coded.select("sequence", "coded").join(found, "coded").select("sequence", "neighbours")


def identity_weights(aligned: DataFrame, threshold: float) -> DataFrame:
    """``(row_id, weight)`` of aligned rows ``(row_id, sequence)``."""
    rows = aligned.select("row_id", F.upper("sequence").alias("sequence"))
    distinct = rows.groupBy("sequence").agg(F.count(F.lit(1)).alias("copies"))
    counts = neighbour_counts(distinct, threshold)
    return rows.join(counts, "sequence").select("row_id", (F.lit(1.0) / F.col("neighbours")).alias("weight"))
