"""Column statistics of alignments: labels, consensus, profiles, subset residues and logos."""

from __future__ import annotations

from pyspark.sql import functions as F

from simloom.catalog.registry import Tables, query, sql
from simloom.functions.positions import in_positions, label_order
from simloom.functions.residues import STANDARD_RESIDUES
from simloom.operators import alignment, identity

_ROWS = "(SELECT count(*) FROM aligned)"


@query("src_7_sparse_alignment", sql("cells", "SELECT row_id, col, aa FROM cells"))
def sparse(t: Tables):
    """Aligned texts as sparse cells without gaps."""
    return t.cells


@query("san_11_decoded_cells", sql("cells", """
    SELECT row_id, col, CASE WHEN aa IN ('Q', 'Z') THEN 'X' ELSE aa END AS aa FROM cells WHERE aa <> 'W'"""))
def decoded(t: Tables):
    """Residue codes through a code table that lacks two letters and calls W a gap."""
    code = F.ascii("aa")
    table = (
        t.spark.range(65, 91)
        .select(F.col("id").cast("int").alias("code"), F.char("id").alias("aa"))
        .where(~F.col("aa").isin("Q", "Z"))
        .withColumn("aa", F.when(F.col("aa") == "W", "-").otherwise(F.col("aa")))
    )
    return alignment.canonical_codes(t.cells.select("row_id", "col", code.alias("code")), table)


@query("arr_18_aligned_text", sql("aligned", "SELECT row_id, sequence FROM aligned"))
def aligned_text(t: Tables):
    """Cells back to texts of one width."""
    width = t.cells.agg(F.max("col")).first()[0] + 1
    return alignment.aligned_text(t.rows, t.cells, width)


@query(
    "join_5_alignment_rows",
    sql("nodes", "SELECT node_id, CASE WHEN kind = 'PROMO' THEN -1 ELSE node_id END AS row_id FROM nodes"),
)
def alignment_rows(t: Tables):
    """Alignment row of every node by exact header, -1 without one."""
    rows = t.nodes.where("kind <> 'PROMO'").select(F.col("node_id").alias("row_id"), "header")
    return alignment.rows_for_nodes(t.nodes, rows)


@query(
    "join_5_coverage",
    sql("nodes", "SELECT count(*) AS nodes, count(*) FILTER (kind <> 'PROMO') AS aligned, count(*) FILTER (kind = 'PROMO') AS missing FROM nodes"),
)
def coverage(t: Tables):
    rows = t.nodes.where("kind <> 'PROMO'").select(F.col("node_id").alias("row_id"), "header")
    return alignment.coverage(t.nodes, rows)


@query(
    "join_6_filtered_alignment",
    sql("nodes cells", "SELECT row_id, col, aa FROM cells WHERE row_id IN (SELECT node_id FROM nodes WHERE kind = 'LARGE')"),
)
def filtered_alignment(t: Tables):
    """Alignment restricted to the headers of a sequence file."""
    from simloom.sources.fasta import sparse_alignment

    return sparse_alignment(t.aligned, t.nodes.where("kind = 'LARGE'"))[1]


@query(
    "src_21_header_index",
    sql(
        "nodes",
        """SELECT name, max(row_id) AS row_id FROM (
             SELECT node_id AS row_id, unnest([header, split_part(header, ' ', 1)]) AS name FROM nodes) GROUP BY name""",
    ),
)
def header_index(t: Tables):
    """Full header, first token and short label all name a row; the last row wins."""
    return alignment.header_index(t.rows)


@query("agg_3_column_occupancy", sql("cells", "SELECT col, count(*) AS filled FROM cells GROUP BY col"))
def occupancy(t: Tables):
    return alignment.column_occupancy(t.cells)


_REFERENCE = "(SELECT min(node_id) FROM nodes WHERE contains(lower(header), 'large widget'))"


@query(
    "agg_3_valid_columns",
    sql(
        "nodes cells",
        f"""SELECT col, filled < {_ROWS} * 0.6 AS forced FROM (SELECT col, count(*) AS filled FROM cells GROUP BY col)
            WHERE filled >= {_ROWS} * 0.6 OR col IN (SELECT col FROM cells WHERE row_id = {_REFERENCE})""",
    ),
)
def valid_columns(t: Tables):
    """Columns of sufficient occupancy plus all residues of the reference."""
    reference = alignment.reference_row(t.rows, "large widget")
    return alignment.valid_columns(t.cells, t.table("part").count(), 60.0, reference)


@query("win_6_occupancy_labels", sql("labels", "SELECT col, label FROM labels"))
def occupancy_labels(t: Tables):
    return t.labels


@query(
    "win_5_reference_labels",
    sql(
        "nodes cells",
        f"""WITH w AS (SELECT max(length(sequence)) AS n FROM aligned),
        c AS (SELECT CAST(g AS INTEGER) AS col, EXISTS (SELECT 1 FROM cells WHERE row_id = {_REFERENCE} AND cells.col = g) AS res
              FROM (SELECT unnest(range((SELECT n FROM w))) AS g)),
        m AS (SELECT *, sum(CASE WHEN res THEN 1 ELSE 0 END) OVER (ORDER BY col) AS major FROM c)
        SELECT col, CASE WHEN res THEN CAST(major AS VARCHAR) ELSE CAST(major AS VARCHAR) || '.' ||
               CAST(row_number() OVER (PARTITION BY major ORDER BY col) - CASE WHEN major = 0 THEN 0 ELSE 1 END AS VARCHAR) END AS label FROM m""",
    ),
)
def reference_labels(t: Tables):
    """Positions count the residues of the reference; its gaps are insertions."""
    width = t.cells.agg(F.max("col")).first()[0] + 1
    return alignment.reference_labels(t.cells, alignment.reference_row(t.rows, "large widget"), width)


@query("join_22_position_columns", sql("labels", "SELECT label, col FROM labels WHERE label IN ('2', '3', '4', '9')"))
def position_columns(t: Tables):
    """Columns of a typed position list."""
    last = t.labels.agg(F.max_by("label", F.struct(*label_order(F.col("label"))))).scalar()
    return t.labels.where(in_positions(F.col("label"), "[4-2, 9]", last)).select("label", "col")


_CONSENSUS = f"""SELECT col, aa, round(n / {_ROWS}, 6) AS share, round(filled / {_ROWS}, 6) AS occupancy FROM (
    SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, first_row) AS rn, sum(n) OVER (PARTITION BY col) AS filled FROM counts)
    WHERE rn = 1"""


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query("agg_4_consensus", sql("counts", _CONSENSUS))
def consensus(t: Tables):
    """Most frequent residue per column; ties go to the first row."""
    return _rounded(alignment.consensus(t.counts, t.n_nodes), "share", "occupancy")


@query(
    "agg_5_consensus_with_exclusion",
    sql(
        "nodes cells",
        """WITH kept AS (SELECT * FROM cells WHERE row_id NOT IN (SELECT node_id FROM nodes WHERE cluster = -1)),
        k AS (SELECT count(*) AS n FROM nodes WHERE cluster <> -1),
        c AS (SELECT col, aa, count(*) AS n, min(row_id) AS first_row FROM kept GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, first_row) AS rn, sum(n) OVER (PARTITION BY col) AS filled FROM c)
        SELECT col, aa, round(r.n / k.n, 6) AS share, round(filled / k.n, 6) AS occupancy FROM r, k WHERE rn = 1""",
    ),
)
def consensus_excluding(t: Tables):
    """Consensus without the rows of noise nodes."""
    excluded = t.nodes.where("cluster = -1").select(F.col("node_id").alias("row_id"))
    kept = t.cells.join(excluded, "row_id", "left_anti")
    total = t.nodes.where("cluster <> -1").agg(F.count(F.lit(1))).scalar()
    return _rounded(alignment.consensus(alignment.residue_counts(kept), total), "share", "occupancy")


@query(
    "agg_6_weighted_counts",
    sql("nodes cells", "SELECT col, aa, round(sum(1.0 / seq_len), 6) AS n FROM cells JOIN nodes ON row_id = node_id GROUP BY col, aa"),
)
def weighted(t: Tables):
    """Residue counts under row weights."""
    weights = t.nodes.select(F.col("node_id").alias("row_id"), (1.0 / F.col("seq_len")).alias("weight"))
    return _rounded(alignment.residue_counts(t.cells, weights).select("col", "aa", "n"), "n")


@query(
    "agg_7_position_breakdown",
    sql(
        "labels counts nodes",
        f"""WITH sub AS (SELECT col, aa, count(*) AS n, min(row_id) AS first_row FROM cells
                         WHERE row_id IN (SELECT node_id FROM nodes WHERE length > 25) GROUP BY ALL),
        k AS (SELECT count(*) AS n FROM nodes WHERE length > 25)
        SELECT l.label, round((max(k.n) - coalesce(sum(sub.n), 0)) * 100.0 / max(k.n), 4) AS gap_percent,
               coalesce(string_agg(aa || ':' || CAST(sub.n AS VARCHAR), ' ' ORDER BY sub.n DESC, first_row) FILTER (sub.n * 100.0 / k.n >= 1.0), '') AS residues
        FROM labels l LEFT JOIN sub ON l.col = sub.col, k WHERE CAST(l.label AS INTEGER) BETWEEN 2 AND 7 GROUP BY l.label""",
    ),
)
def breakdown(t: Tables):
    """Gap and residue percentages at positions 2-7 for a node subset."""
    rows = t.nodes.where("length > 25").select(F.col("node_id").alias("row_id"))
    counts = alignment.residue_counts(t.cells.join(rows, "row_id", "left_semi"))
    total = rows.agg(F.count(F.lit(1))).scalar()
    report = alignment.positions_breakdown(counts, total, t.labels, "7-2")
    shown = F.transform("residues", lambda r: F.concat(r["aa"], F.lit(":"), r["n"].cast("string")))
    return report.select("label", F.round("gap_percent", 4).alias("gap_percent"), F.coalesce(F.array_join(shown, " "), F.lit("")).alias("residues"))


@query(
    "agg_8_frequency_search",
    sql(
        "labels counts",
        f"""SELECT l.col, l.label FROM labels l JOIN (
              SELECT col, coalesce(sum(n) FILTER (aa = 'R'), 0) / {_ROWS} AS r, coalesce(sum(n) FILTER (aa = 'L'), 0) / {_ROWS} AS lf,
                     1 - sum(n) / {_ROWS} AS gap FROM counts GROUP BY col) s ON l.col = s.col
            WHERE (r > 0.1 OR lf >= 0.2) AND NOT gap > 0.3""",
    ),
)
def frequency_search(t: Tables):
    return alignment.frequency_search(t.counts, t.n_nodes, t.labels, "[((R>10%) | (L>=20)) & !(GAP > 0.3)]")


@query(
    "pred_19_frequency_logic",
    sql(
        "labels counts",
        f"""SELECT l.col, l.label FROM labels l LEFT JOIN (
              SELECT col, coalesce(sum(n) FILTER (aa = 'E'), 0) / {_ROWS} AS e, coalesce(sum(n) FILTER (aa = 'T'), 0) / {_ROWS} AS t
              FROM counts GROUP BY col) s ON l.col = s.col WHERE (coalesce(e, 0) > 0.05) <> (coalesce(t, 0) <= 0.08)""",
    ),
)
def frequency_logic(t: Tables):
    return alignment.frequency_search(t.counts, t.n_nodes, t.labels, "[(E>5%) ^ (T<=0.08)]")


@query(
    "agg_9_length_statistics",
    sql(
        "cells nodes",
        """SELECT kind, count(*) AS rows, min(n) AS min_len, max(n) AS max_len, round(avg(n), 6) AS mean_len, round(stddev_pop(n), 6) AS std_len
           FROM (SELECT kind, node_id, count(col) AS n FROM nodes LEFT JOIN cells ON node_id = row_id GROUP BY ALL) GROUP BY kind""",
    ),
)
def lengths(t: Tables):
    rows = t.nodes.select(F.col("node_id").alias("row_id"), "kind")
    return _rounded(alignment.length_statistics(t.cells, rows, ["kind"]), "mean_len", "std_len")


_MEMBER_SQL = {
    "clusters": "SELECT node_id AS row_id, 'cluster_' || cluster AS subset FROM nodes WHERE cluster <> -1",
    "groups": "SELECT node_id AS row_id, unnest([group_a, group_b]) AS subset FROM nodes",
}


@query("join_24_cluster_memberships", sql("nodes", _MEMBER_SQL["clusters"]))
def cluster_memberships(t: Tables):
    return alignment.cluster_memberships(t.nodes, _same_rows(t))


@query("join_24_group_memberships", sql("nodes", _MEMBER_SQL["groups"]))
def group_memberships(t: Tables):
    return alignment.group_memberships(t.nodes, _same_rows(t))


def _same_rows(t: Tables):
    return t.nodes.select("node_id", F.col("node_id").alias("row_id"))


_SPECIFIC = """
    WITH members AS ({members}),
    sizes AS (SELECT subset, count(*) AS size FROM members GROUP BY subset),
    conserved AS (SELECT col, aa, subset, count(*) / any_value(size) AS frequency
                  FROM cells JOIN members USING (row_id) JOIN sizes USING (subset) GROUP BY col, aa, subset HAVING count(*) / any_value(size) >= {low}),
    excluded AS (SELECT DISTINCT col, aa, row_id FROM conserved JOIN members USING (subset)),
    ex AS (SELECT e.col, e.aa, count(*) AS size, count(c.row_id) AS n FROM excluded e
           LEFT JOIN cells c ON e.row_id = c.row_id AND e.col = c.col AND e.aa = c.aa GROUP BY ALL),
    total AS (SELECT col, aa, count(*) AS n FROM cells GROUP BY ALL)
    SELECT col, aa, subset, round(frequency, 6) AS frequency,
           round((total.n - ex.n) / ((SELECT count(*) FROM aligned) - ex.size), 6) AS outside_frequency
    FROM conserved JOIN ex USING (col, aa) JOIN total USING (col, aa)
    WHERE ex.size < (SELECT count(*) FROM aligned) AND (total.n - ex.n) / ((SELECT count(*) FROM aligned) - ex.size) < {high}"""


@query(
    "agg_10_subset_residues_groups",
    sql("nodes cells", _SPECIFIC.format(members=_MEMBER_SQL["groups"], low=0.9, high=0.4)),
)
def subset_groups(t: Tables):
    """Residues specific to overlapping groups."""
    members = alignment.group_memberships(t.nodes, _same_rows(t))
    found = alignment.subset_specific_residues(t.cells, t.rows, members, 0.9, 0.4)
    return _rounded(found, "frequency", "outside_frequency")


@query(
    "agg_10_subset_residues_clusters",
    sql("nodes cells", _SPECIFIC.format(members=_MEMBER_SQL["clusters"], low=0.16, high=0.13)),
)
def subset_clusters(t: Tables):
    """Residues specific to disjoint clusters, with thresholds that suit mixed data."""
    members = alignment.cluster_memberships(t.nodes, _same_rows(t))
    found = alignment.subset_specific_residues(t.cells, t.rows, members, 0.16, 0.13)
    return _rounded(found, "frequency", "outside_frequency")


@query(
    "snk_11_subset_cells",
    sql(
        "nodes cells labels",
        "WITH found AS (" + _SPECIFIC.format(members=_MEMBER_SQL["groups"], low=0.4, high=0.2) + """)
        SELECT subset, label, string_agg(aa || label, ' | ' ORDER BY frequency DESC, aa) AS residues
        FROM found JOIN labels USING (col) GROUP BY subset, label""",
    ),
)
def subset_cells(t: Tables):
    """Report cells: all specific residues of a subset at a position."""
    members = alignment.group_memberships(t.nodes, _same_rows(t))
    found = alignment.subset_specific_residues(t.cells, t.rows, members, 0.4, 0.2)
    return alignment.subset_cells_text(found, t.labels)


@query(
    "agg_11_conserved_positions",
    sql("labels counts", f"SELECT label, aa || label AS residue FROM ({_CONSENSUS}) JOIN labels USING (col) WHERE share > 0.2"),
)
def conserved(t: Tables):
    """Positions whose consensus share is above a threshold."""
    return alignment.conserved_labels(alignment.consensus(t.counts, t.n_nodes), t.labels, above=0.2)


@query(
    "agg_12_profile_text",
    sql(
        "labels counts",
        f"""SELECT label, coalesce(string_agg(format('{{}} {{:5.1f}}%', aa, n / {_ROWS} * 100.0), ' | ' ORDER BY n DESC, first_row)
              FILTER (n / {_ROWS} * 100.0 >= 1.0), '-') AS profile FROM labels LEFT JOIN counts USING (col) GROUP BY label""",
    ),
)
def profile(t: Tables):
    return alignment.profile_text(alignment.breakdown(t.counts, t.n_nodes, t.labels))


_IDENTITY = f"""
    WITH u AS (SELECT sequence, count(*) AS m FROM aligned GROUP BY sequence),
    p AS (SELECT a.sequence AS x, b.m, unnest(range(length(a.sequence))) AS k, b.sequence AS y FROM u a, u b),
    q AS (SELECT x, y, any_value(m) AS m,
             count(*) FILTER (instr('{STANDARD_RESIDUES}', substr(x, k + 1, 1)) > 0 OR instr('{STANDARD_RESIDUES}', substr(y, k + 1, 1)) > 0) AS uni,
             count(*) FILTER (instr('{STANDARD_RESIDUES}', substr(x, k + 1, 1)) > 0 AND substr(x, k + 1, 1) = substr(y, k + 1, 1)) AS same
          FROM p GROUP BY x, y),
    nb AS (SELECT x AS sequence, greatest(1, coalesce(sum(m) FILTER (uni > 0 AND same >= 0.6 * uni - 1e-12), 0)) AS neighbours FROM q GROUP BY x),
    w AS (SELECT row_id, 1.0 / neighbours AS weight FROM aligned JOIN nb USING (sequence))"""


@query("agg_13_identity_weights", sql("aligned", _IDENTITY + "SELECT row_id, round(weight, 8) AS weight FROM w"))
def identity_weights(t: Tables):
    """Inverse number of rows at least 60% identical."""
    weights = identity.identity_weights(t.aligned, 0.6)
    return weights.select("row_id", F.round("weight", 8).alias("weight"))


_LOGO = f"""
    WITH s AS (SELECT *, sum(n) OVER (PARTITION BY col) AS present FROM counts WHERE instr('{STANDARD_RESIDUES}', aa) > 0),
    p AS (SELECT *, n / present AS p FROM s),
    h AS (SELECT *, sum(-p * log2(p)) OVER (PARTITION BY col) AS entropy FROM p)
    SELECT col, aa, round(p * greatest(0, log2(20) - (entropy + 19.0 / (2 * ln(2) * {_ROWS}))) * present / {_ROWS}, 6) AS height FROM h"""


def _identity_at(threshold: float) -> str:
    return sql("aligned", _IDENTITY.replace("0.6 * uni", f"{threshold} * uni") + "SELECT row_id, round(weight, 8) AS weight FROM w")


@query("agg_13_identity_weights_strict", _identity_at(0.9))
def strict_identity_weights(t: Tables):
    """Weights where nine columns of ten must agree."""
    return identity.identity_weights(t.aligned, 0.9).withColumn("weight", F.round("weight", 8))


@query("agg_13_identity_weights_loose", _identity_at(0.5))
def loose_identity_weights(t: Tables):
    """Weights where every second column must agree; the work is that of any other threshold."""
    return identity.identity_weights(t.aligned, 0.5).withColumn("weight", F.round("weight", 8))


@query("agg_14_logo_bits", sql("counts", _LOGO))
def logo(t: Tables):
    """Letter heights in bits, scaled by occupancy."""
    return _rounded(alignment.logo_matrix(t.cells, t.rows), "height")


_WEIGHTED_LOGO = _IDENTITY + f""",
    c AS (SELECT col, aa, sum(weight) AS n FROM cells JOIN w USING (row_id) WHERE instr('{STANDARD_RESIDUES}', aa) > 0 GROUP BY ALL),
    s AS (SELECT *, sum(n) OVER (PARTITION BY col) AS present FROM c), pr AS (SELECT *, n / present AS pp FROM s),
    h AS (SELECT *, sum(-pp * log2(pp)) OVER (PARTITION BY col) AS entropy FROM pr)
    SELECT col, aa, round(pp * greatest(0, log2(20) - (entropy + 19.0 / (2 * ln(2) * present))) * present / (SELECT sum(weight) FROM w), 6) AS height FROM h"""


@query("agg_14_logo_reweighted", sql("cells", _WEIGHTED_LOGO))
def weighted_logo(t: Tables):
    """Letter heights under identity weights with their effective counts."""
    weights = identity.identity_weights(t.aligned, 0.6)
    return _rounded(alignment.logo_matrix(t.cells, t.rows, weights=weights), "height")


@query(
    "agg_14_logo_percent",
    sql("counts", f"""SELECT col, aa, round(n / sum(n) OVER (PARTITION BY col), 6) AS height FROM counts WHERE instr('{STANDARD_RESIDUES}', aa) > 0"""),
)
def logo_percent(t: Tables):
    return _rounded(alignment.logo_matrix(t.cells, t.rows, mode="pcts", with_gaps=False), "height")


@query(
    "agg_28_residue_count_of_rows",
    sql(
        "nodes cells",
        """SELECT col, count(*) AS n, round(sum(1.0 / seq_len), 6) AS weight FROM cells JOIN nodes ON row_id = node_id
           WHERE aa = 'E' AND (kind = 'LARGE' OR length > 40) GROUP BY col""",
    ),
)
def residue_count(t: Tables):
    """One residue over a union of row sets, each row counted once."""
    first, second = t.nodes.where("kind = 'LARGE'"), t.nodes.where("length > 40")
    rows = first.union(second).select(F.col("node_id").alias("row_id"), "seq_len").distinct()
    hits = t.cells.where("aa = 'E'").join(rows, "row_id")
    return hits.groupBy("col").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(1.0 / F.col("seq_len")), 6).alias("weight")
    )


@query(
    "agg_29_dense_valid_columns",
    sql(
        "nodes cells",
        f"""SELECT col FROM cells GROUP BY col HAVING count(*) / {_ROWS} >= 0.6
            UNION SELECT col FROM cells WHERE row_id = (SELECT min(node_id) FROM nodes WHERE contains(header, 'large widget'))""",
    ),
)
def dense_columns(t: Tables):
    """Valid columns with a case-sensitive reference match."""
    first = t.nodes.where(F.contains("header", F.lit("large widget"))).agg(F.min("node_id").alias("row_id"))
    return alignment.valid_columns(t.cells, t.table("part").count(), 60.0, first).select("col")
