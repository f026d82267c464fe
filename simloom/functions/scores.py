"""Score conversions and vector measures as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def evalue_score(evalue: Column) -> Column:
    """Score of an expectation value; an E-value of zero scores 300."""
    return -F.log10(evalue + F.lit(1e-300))


def _denominator(mode: str, aln_len: Column, len_i: Column, len_j: Column) -> Column:
    return {
        "shorter_sequence": F.least(len_i, len_j),
        "longer_sequence": F.greatest(len_i, len_j),
        "average_sequence": (len_i + len_j) / F.lit(2.0),
    }.get(mode, aln_len)


def normalized_score(
    score: Column, aln_len: Column, len_i: Column, len_j: Column, mode: str
) -> Column:
    """Score per aligned or sequence length; unknown modes use the alignment length."""
    below = _denominator(mode, aln_len, len_i, len_j).cast("double")
    return F.when(below > 0, score / below).otherwise(F.lit(0.0))


def normalized_score_floored(
    score: Column, aln_len: Column, len_i: Column, len_j: Column, mode: str, floor: float
) -> Column:
    """Variant with a floored denominator, as used by statistics (1e-6) and tree building (1)."""
    below = _denominator(mode, aln_len, len_i, len_j).cast("double")
    return score / F.greatest(below, F.lit(floor))


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda total, x: total + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine clipped to [-1, 1]; a zero vector counts with norm 1e-8."""
    norm_a, norm_b = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    norms = F.when(norm_a == 0, F.lit(1e-8)).otherwise(norm_a) * F.when(
        norm_b == 0, F.lit(1e-8)
    ).otherwise(norm_b)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norms))


def length_ratio(len_i: Column, len_j: Column, power: float = 1.0) -> Column:
    ratio = F.least(len_i, len_j) / F.greatest(len_i, len_j, F.lit(1))
    return ratio if power == 1.0 else F.pow(ratio, F.lit(power))


def pair_index(i: Column, j: Column, n: Column) -> Column:
    """Position of the pair ``i < j`` in the row-major upper triangle of ``n`` nodes."""
    i, j, n = i.cast("long"), j.cast("long"), n.cast("long")
    return n * i - F.shiftright(i * (i + 1), 1) + j - i - 1


def score_distance(score: Column, highest: Column) -> Column:
    """Distance ``highest - score``, never negative and at most ``highest + 0.1``."""
    return F.least(F.greatest(F.lit(0.0), highest - score), highest + F.lit(0.1))
