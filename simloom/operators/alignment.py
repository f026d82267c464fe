"""Multiple-sequence alignments as sparse cells, and their column statistics.

``rows``: ``(row_id, header)``; ``cells``: ``(row_id, col, aa)`` without gaps, ``col`` from 0;
``labels``: ``(col, label)``. Cells are the large table: it is aggregated per ``(col, aa)``
first, which leaves at most 26 rows per column for everything that follows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simloom.functions.positions import in_positions, label_major, label_minor
from simloom.functions.residues import clean_aligned, symbols
from simloom.operators.selection import SelectionExpressionError, boolean_column
from simloom.plans.runtime import materialized


def alignment_cells(aligned: DataFrame) -> DataFrame:
    """Sparse cells of ``(row_id, sequence)`` aligned texts."""
    return (
        aligned.select("row_id", F.posexplode(symbols(clean_aligned(F.col("sequence")))).alias("col", "aa"))
        .where(F.col("aa") != "-")
    )


def canonical_codes(cells: DataFrame, code_table: DataFrame) -> DataFrame:
    """Decode ``(row_id, col, code)``; gap codes vanish and unknown codes become X."""
    return (
        cells.where(F.col("code") != 0)
        .join(code_table, "code", "left")
        .withColumn("aa", F.upper(F.coalesce("aa", F.lit("X"))))
        .where(~F.col("aa").isin("-", "."))
        .withColumn("aa", F.when(F.col("aa").rlike("^[ACDEFGHIKLMNPQRSTVWYBZJXUO]$"), F.col("aa")).otherwise("X"))
        .select("row_id", "col", "aa")
    )


def aligned_text(rows: DataFrame, cells: DataFrame, n_cols: int) -> DataFrame:
    """Aligned text per row, gaps as ``-``."""
    residues = cells.groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("col", "aa"))).alias("m"))
    letters = F.transform(
        F.sequence(F.lit(0), F.lit(n_cols - 1)), lambda c: F.coalesce(F.element_at("m", c), F.lit("-"))
    )
    return rows.join(residues, "row_id", "left").select(
        "row_id", F.coalesce(F.array_join(letters, ""), F.repeat(F.lit("-"), n_cols)).alias("sequence")
    )


def rows_for_nodes(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """``(node_id, row_id)`` by exact header; ``row_id`` is -1 for unaligned nodes."""
    return nodes.join(rows.select("header", "row_id"), "header", "left").select(
        "node_id", F.coalesce("row_id", F.lit(-1)).alias("row_id")
    )


def coverage(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: nodes, aligned nodes and nodes without an alignment row."""
    return rows_for_nodes(nodes, rows).agg(
        F.count(F.lit(1)).alias("nodes"),
        F.count_if(F.col("row_id") >= 0).alias("aligned"),
        F.count_if(F.col("row_id") < 0).alias("missing"),
    )


def header_index(rows: DataFrame) -> DataFrame:
    """Every way to name a row (header, first token, short label); later rows win."""
    from simloom.functions.headers import first_token, simple_label

    names = F.array("header", first_token(F.col("header")), simple_label(F.col("header")))
    return rows.select(F.explode(names).alias("name"), "row_id").groupBy("name").agg(F.max("row_id").alias("row_id"))


def reference_row(rows: DataFrame, wanted: str) -> DataFrame:
    """``(row_id)`` of the reference: exact name in any case, else the first mutual substring."""
    target = wanted.lower()
    exact = header_index(rows).where(F.lower("name") == target).agg(F.min(F.struct(F.lit(0), "row_id")).alias("hit"))
    lowered = F.lower("header")
    partial = rows.where(F.contains(lowered, F.lit(target)) | F.contains(F.lit(target), lowered)).agg(
        F.min(F.struct(F.lit(1), "row_id")).alias("hit")
    )
    best = exact.union(partial).agg(F.min("hit").alias("hit"))
    return best.where("hit IS NOT NULL").select(F.col("hit.row_id").alias("row_id"))


# -- columns and labels ------------------------------------------------------------------------


def column_occupancy(cells: DataFrame) -> DataFrame:
    return cells.groupBy("col").agg(F.count(F.lit(1)).alias("filled"))


def valid_columns(
    cells: DataFrame, n_rows: int, percent: float, reference: DataFrame | None = None
) -> DataFrame:
    """Columns filled in at least ``percent`` of the rows, plus all residues of the reference.

    ``forced`` marks columns kept only because the reference has a residue there.
    """
    filled = column_occupancy(cells).withColumn("enough", F.col("filled") >= F.lit(n_rows * (percent / 100.0)))
    if reference is None:
        return filled.where("enough").select("col", F.lit(False).alias("forced"))
    anchored = cells.join(reference, "row_id", "left_semi").select("col").distinct()
    kept = filled.join(anchored.withColumn("anchored", F.lit(True)), "col", "left")
    return kept.where(F.col("enough") | F.col("anchored")).select("col", (~F.col("enough")).alias("forced"))


def occupancy_labels(columns: DataFrame) -> DataFrame:
    """Labels 1..K over the valid columns (one row per alignment column, a small table)."""
    return columns.select("col", F.row_number().over(Window.orderBy("col")).cast("string").alias("label"))


def reference_labels(
    cells: DataFrame, reference: DataFrame, n_cols: int, columns: DataFrame | None = None, offset: int = 0
) -> DataFrame:
    """Labels that count the residues of the reference; its gaps become insertions ``p.1, p.2``.

    Numbering covers all columns before it is restricted to the valid ones. The tables here have
    one row per alignment column.
    """
    residues = cells.join(reference, "row_id", "left_semi").select("col", F.lit(1).alias("residue"))
    every = cells.sparkSession.range(n_cols).select(F.col("id").cast("int").alias("col"))
    counted = every.join(residues, "col", "left").select(
        "col",
        "residue",
        F.coalesce(F.sum("residue").over(Window.orderBy("col")), F.lit(0)).alias("major"),
    )
    place = F.row_number().over(Window.partitionBy("major").orderBy("col"))
    minor = F.when(F.col("major") == 0, place).otherwise(place - 1)
    shown = (F.col("major") + offset).cast("string")
    label = F.when(F.col("residue") == 1, shown).otherwise(F.concat_ws(".", shown, minor.cast("string")))
    labels = counted.select("col", label.alias("label"))
    return labels if columns is None else labels.join(columns.select("col"), "col", "left_semi")


# -- residue counts ----------------------------------------------------------------------------


def residue_counts(cells: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """``(col, aa, n, first_row)``; ``n`` sums row weights when ``(row_id, weight)`` is given."""
    if weights is None:
        return cells.groupBy("col", F.upper("aa").alias("aa")).agg(
            F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first_row")
        )
    return (
        cells.join(weights, "row_id")
        .groupBy("col", F.upper("aa").alias("aa"))
        .agg(F.sum("weight").alias("n"), F.min("row_id").alias("first_row"))
    )


def consensus(counts: DataFrame, total: Column, columns: DataFrame | None = None) -> DataFrame:
    """``(col, aa, share, occupancy)`` per column; ties go to the residue seen first.

    Columns without residues, listed in ``columns``, yield ``-`` with zeros.
    """
    best = counts.groupBy("col").agg(
        F.min(F.struct((-F.col("n")).alias("minus"), "first_row", "aa")).alias("top"), F.sum("n").alias("filled")
    )
    if columns is not None:
        best = columns.select("col").join(best, "col", "left")
    return best.select(
        "col",
        F.coalesce("top.aa", F.lit("-")).alias("aa"),
        F.coalesce(-F.col("top.minus") / total, F.lit(0.0)).alias("share"),
        F.coalesce(F.col("filled") / total, F.lit(0.0)).alias("occupancy"),
    )


def conserved_labels(consensus_rows: DataFrame, labels: DataFrame, above: float = 0.97) -> DataFrame:
    """Global list of residues conserved strictly above a share, e.g. ``K106``."""
    return (
        consensus_rows.join(labels, "col")
        .where(F.col("share") > above)
        .select("label", F.concat("aa", "label").alias("residue"))
    )


def breakdown(counts: DataFrame, n_rows: Column, labels: DataFrame, minimum: float = 1.0) -> DataFrame:
    """Gap and residue percentages per displayed position, diluted by gaps.

    Residues of at least ``minimum`` percent, most frequent first, as an array of structs.
    """
    shares = counts.withColumn("percent", F.col("n") / n_rows * 100.0)
    entry = F.when(
        F.col("percent") >= minimum, F.struct((-F.col("n")).alias("minus"), "first_row", "aa", "n", "percent")
    )
    per_column = shares.groupBy("col").agg(
        F.sum("n").alias("filled"), F.array_sort(F.collect_list(entry)).alias("entries")
    )
    residues = F.transform("entries", lambda e: F.struct(*[e[c].alias(c) for c in ("aa", "n", "percent")]))
    return labels.join(per_column, "col", "left").select(
        "label",
        F.coalesce((n_rows - F.col("filled")) / n_rows * 100.0, F.lit(100.0)).alias("gap_percent"),
        residues.alias("residues"),
    )


def positions_breakdown(counts: DataFrame, n_rows: Column, labels: DataFrame, positions: str) -> DataFrame:
    """:func:`breakdown` of a typed position list; unknown labels give no row."""
    last = labels.agg(F.max_by("label", F.struct(label_major(F.col("label")), label_minor(F.col("label"))))).scalar()
    return breakdown(counts, n_rows, labels.where(in_positions(F.col("label"), positions, last)))


def profile_text(breakdown_rows: DataFrame) -> DataFrame:
    """``(label, profile)`` such as ``K  45.0% | R  12.0%``, or ``-`` without residues."""
    # format_number rounds the binary value half to even, unlike format_string.
    parts = F.transform(
        "residues", lambda r: F.concat(r["aa"], F.lit(" "), F.lpad(F.format_number(r["percent"], 1), 5, " "), F.lit("%"))
    )
    return breakdown_rows.select(
        "label", F.when(F.coalesce(F.size("residues"), F.lit(0)) < 1, "-").otherwise(F.concat_ws(" | ", parts)).alias("profile")
    )


# Fixed format of one frequency condition.
_CONDITION = re.compile(r"\(\s*([A-Za-z_]+)\s*(>=|<=|>|<)\s*(\d+(?:\.\d+)?%?)\s*\)")


def frequency_search(counts: DataFrame, n_rows: Column, labels: DataFrame, logic: str) -> DataFrame:
    """Positions where a logic over residue and gap shares holds.

    ``[(K>10%) & !(GAP>50%)]``: numbers above 1 count as percent and ``GAP`` or ``_`` is the
    gap share. Each named residue becomes one conditional sum per column.
    """
    text = logic.strip().removeprefix("[").removesuffix("]").strip()
    if not _CONDITION.search(text):
        text = f"({text})"
    needed: dict[str, str] = {}
    atoms: dict[str, Column] = {}

    def replace(match: re.Match) -> str:
        residue, op, value = match.groups()
        residue = residue.upper()
        limit = float(value.rstrip("%"))
        if value.endswith("%") or limit > 1.0:
            limit /= 100.0
        share = F.col(needed.setdefault(residue, f"share_{len(needed)}"))
        name = f"atom{len(atoms)}_"
        atoms[name] = {">": share > limit, "<": share < limit, ">=": share >= limit, "<=": share <= limit}[op]
        return f" {name} "

    text = _CONDITION.sub(replace, text)
    if re.search(r"[<>]", text) or not atoms:
        raise SelectionExpressionError("put every frequency condition in parentheses")
    sums = {
        residue: F.sum(F.when(F.col("aa") == residue, F.col("n")).otherwise(F.lit(0)))
        for residue in needed
        if residue not in {"GAP", "_"}
    }
    shares = counts.groupBy("col").agg(
        F.sum("n").alias("filled"), *[s.alias(f"n_{needed[r]}") for r, s in sums.items()]
    )
    frame = labels.join(shares, "col", "left")
    for residue, name in needed.items():
        count = n_rows - F.col("filled") if residue in {"GAP", "_"} else F.col(f"n_{name}")
        missing = 1.0 if residue in {"GAP", "_"} else 0.0
        frame = frame.withColumn(name, F.coalesce(count / n_rows, F.lit(missing)))
    return frame.where(boolean_column(text, atoms)).select("col", "label")


def length_statistics(cells: DataFrame, rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Ungapped length minimum, maximum, mean and population deviation."""
    lengths = rows.join(cells.groupBy("row_id").agg(F.count(F.lit(1)).alias("len")), "row_id", "left")
    size = F.coalesce("len", F.lit(0))
    return lengths.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(size).alias("min_len"),
        F.max(size).alias("max_len"),
        F.avg(size).alias("mean_len"),
        F.stddev_pop(size).alias("std_len"),
    )


# -- subsets -----------------------------------------------------------------------------------


def cluster_memberships(nodes: DataFrame, node_rows: DataFrame) -> DataFrame:
    """``(row_id, subset)`` of clusters: noise left out, the last node of a shared row wins."""
    return (
        nodes.join(node_rows.where(F.col("row_id") >= 0), "node_id")
        .groupBy("row_id")
        .agg(F.max_by("cluster", "node_id").alias("cluster"))
        .where(F.col("cluster") != -1)
        .select("row_id", F.concat(F.lit("cluster_"), "cluster").alias("subset"))
    )


def group_memberships(nodes: DataFrame, node_rows: DataFrame) -> DataFrame:
    """``(row_id, subset)`` of groups: one row per membership, last node with groups wins."""
    return (
        nodes.where(F.size("groups") > 0)
        .join(node_rows.where(F.col("row_id") >= 0), "node_id")
        .groupBy("row_id")
        .agg(F.max_by("groups", "node_id").alias("groups"))
        .select("row_id", F.explode("groups").alias("subset"))
    )


def subset_specific_residues(
    cells: DataFrame,
    rows: DataFrame,
    memberships: DataFrame,
    subset_min: float = 0.98,
    outside_max: float = 0.40,
    weights: DataFrame | None = None,
) -> DataFrame:
    """Residues conserved in a subset and rare outside all subsets that conserve them.

    ``(col, aa, subset, frequency, outside_frequency)``. A residue must reach ``subset_min`` in
    the subset; outside rows are those in no subset that conserves the same residue, and its
    share there must stay strictly below ``outside_max``.

    Rows with the same set of subsets are interchangeable, so cells are counted once per
    membership signature. Unions of overlapping subsets then add up signatures instead of
    collecting distinct rows.
    """
    weight = F.lit(1.0) if weights is None else F.col("weight")
    signed = rows.select("row_id").join(
        memberships.groupBy("row_id").agg(F.array_sort(F.collect_set("subset")).alias("signature")), "row_id", "left"
    )
    signed = signed.withColumn("signature", F.coalesce("signature", F.array().cast("array<string>")))
    if weights is not None:
        signed = signed.join(weights, "row_id")
    # Both tables are small and used several times below; the cells are read once.
    sizes = materialized(signed.groupBy("signature").agg(F.sum(weight).alias("size")))
    counts = materialized(
        cells.join(signed, "row_id")
        .groupBy("signature", "col", F.upper("aa").alias("aa"))
        .agg(F.sum(weight).alias("n"))
    )
    subset_sizes = sizes.select(F.explode("signature").alias("subset"), "size").groupBy("subset").agg(
        F.sum("size").alias("subset_size")
    )
    conserved = (
        counts.select("col", "aa", F.explode("signature").alias("subset"), "n")
        .groupBy("col", "aa", "subset")
        .agg(F.sum("n").alias("n"))
        .join(subset_sizes, "subset")
        .withColumn("frequency", F.col("n") / F.col("subset_size"))
        .where(F.col("frequency") >= subset_min)
    )
    # Signatures that contain any subset conserving (col, aa) make up the excluded union.
    by_subset = sizes.select("signature", F.explode("signature").alias("subset"), "size")
    excluded = (
        conserved.select("col", "aa", "subset")
        .join(by_subset, "subset")
        .select("col", "aa", "signature", "size")
        .distinct()
        .join(counts, ["col", "aa", "signature"], "left")
        .groupBy("col", "aa")
        .agg(F.sum("size").alias("excluded_size"), F.coalesce(F.sum("n"), F.lit(0.0)).alias("excluded_n"))
    )
    overall = counts.groupBy("col", "aa").agg(F.sum("n").alias("total_n"))
    total = sizes.agg(F.sum("size")).scalar()
    outside = total - F.col("excluded_size")
    return (
        conserved.join(excluded, ["col", "aa"])
        .join(overall, ["col", "aa"])
        .where(outside > 1e-12)
        .withColumn(
            "outside_frequency", F.greatest(F.lit(0.0), F.col("total_n") - F.col("excluded_n")) / outside
        )
        .where(F.col("outside_frequency") < outside_max)
        .select("col", "aa", "subset", "frequency", "outside_frequency")
    )


def subset_cells_text(specific: DataFrame, labels: DataFrame) -> DataFrame:
    """One report cell per subset and position, e.g. ``K106 | R106`` by falling frequency."""
    entry = F.struct((-F.col("frequency")).alias("minus"), "aa")
    return (
        specific.join(labels, "col")
        .groupBy("subset", "label")
        .agg(F.array_sort(F.collect_list(entry)).alias("entries"))
        .select(
            "subset",
            "label",
            F.concat_ws(
                " | ", F.transform("entries", lambda e: F.concat(e["aa"], F.col("label")))
            ).alias("residues"),
        )
    )


# -- logo --------------------------------------------------------------------------------------


def logo_matrix(
    cells: DataFrame,
    rows: DataFrame,
    mode: str = "bits",
    with_gaps: bool = True,
    weights: DataFrame | None = None,
) -> DataFrame:
    """Letter heights ``(col, aa, height)`` of the 20 standard residues.

    Information content carries the small-sample correction ``19 / (2 ln 2 n)``, where ``n`` is
    the row count, or the weight present in the column if rows are reweighted.
    """
    from simloom.functions.residues import STANDARD_RESIDUES

    standard = cells.where(F.upper("aa").isin(*STANDARD_RESIDUES))
    counts = residue_counts(standard, weights)
    total = (rows.agg(F.count(F.lit(1))) if weights is None else rows.join(weights, "row_id").agg(F.sum("weight"))).scalar()
    column = Window.partitionBy("col")
    shares = counts.withColumn("present", F.sum("n").over(column)).withColumn("p", F.col("n") / F.col("present"))
    height = F.col("p")
    if mode == "bits":
        entropy = F.sum(-F.col("p") * F.log2("p")).over(column)
        n = total if weights is None else F.col("present")
        correction = F.lit(19.0) / (F.lit(2.0) * F.log(F.lit(2.0)) * n)
        shares = shares.withColumn(
            "information", F.greatest(F.lit(0.0), F.log2(F.lit(20.0)) - (entropy + correction))
        )
        height = F.col("p") * F.col("information")
    if with_gaps:
        height = height * (F.col("present") / total)
    return shares.select("col", "aa", height.alias("height"))
