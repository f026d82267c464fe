"""Selection expressions, set operations on selections and the flagship query."""

from __future__ import annotations

from pyspark.sql import functions as F

from simloom.catalog.registry import Tables, query, sql
from simloom.operators import alignment, network
from simloom.operators.selection import (
    SelectionContext,
    combine_selection,
    invert_selection,
    select_nodes,
)


def _context(t: Tables, strip_spaces: bool = True) -> SelectionContext:
    """All nodes; records of the PROMO kind were not aligned, so residue atoms are unknown there."""
    rows = t.nodes.where("kind <> 'PROMO'").select("node_id", F.col("node_id").alias("row_id"))
    files = {
        "large.txt": t.nodes.where("kind = 'LARGE'").select(F.upper("header").alias("header")),
        "bolts.txt": t.nodes.where("contains(header, ' bolt ')").select(
            F.concat(F.lit("see "), F.lower("header")).alias("header")
        ),
    }
    return SelectionContext(
        nodes=t.nodes,
        properties=["length", "price", "kind"],
        rows=rows,
        cells=t.cells,
        labels=t.labels,
        files=files,
        strip_spaces=strip_spaces,
    )


def _residue_sql(position: int) -> str:
    """Residue at an occupancy label, blank for a gap, NULL for an unaligned node."""
    return f"""CASE WHEN kind = 'PROMO' THEN NULL ELSE coalesce((SELECT c.aa FROM cells c JOIN labels l ON c.col = l.col
        WHERE l.label = '{position}' AND c.row_id = nodes.node_id), '') END"""


def _selection(name: str, expression: str, where: str, needs: str = "nodes", strip_spaces: bool = True):
    @query(name, sql(needs, f"SELECT node_id FROM nodes WHERE coalesce({where}, false)"))
    def selected(t: Tables):
        return select_nodes(_context(t, strip_spaces), expression).select("node_id")


_ALN = "nodes cells labels"
_selection("pred_1_text", '"red bolt"', "contains(lower(header), 'red bolt')")
_selection("pred_1_wildcard", '"wp_*[13]* g?ar*"', r"regexp_full_match(lower(header), 'wp_.*[13].* g.ar.*')")
_selection(
    "pred_2_header_file", "@large.txt@", "lower(header) IN (SELECT lower(header) FROM nodes WHERE kind = 'LARGE')"
)
_selection("pred_3_accession_file", "@[NCBI]bolts.txt@", "contains(header, ' bolt ')")
_selection("pred_5_cluster", "#cluster_7#", "cluster = 7")
_selection("pred_5_noise", "#noise# | #Cluster_3#", "cluster = -1 OR cluster = 3")
_selection("pred_6_group", "#RED# & #economy#", "group_b = 'red' AND group_a = 'economy'")
_selection("pred_7_residue", "R2", f"{_residue_sql(2)} = 'R'", _ALN)
_selection("pred_7_gap", "_9", f"{_residue_sql(9)} = ''", _ALN)
_selection("pred_8_number", "{Length>25}", "length > 25")
_selection("pred_8_not_equal", "{price != 900.1}", "price <> 900.1")
_selection("pred_9_range", "{length=10-20}", "length BETWEEN 10 AND 20")
_selection("pred_9_range_two_dashes", "{length=1--5} | #cluster_2#", "cluster = 2")
_selection("pred_10_text_property", "{kind=mo}", "contains(lower(kind), 'mo')")
_selection("pred_10_wildcard_property", "{kind!=*s?a*}", "NOT regexp_full_match(lower(kind), '.*s.a.*')")
_selection(
    "pred_11_three_valued",
    '!(R2 & E3) ^ (L4 | {length>30})',
    f"""(NOT ({_residue_sql(2)} = 'R' AND {_residue_sql(3)} = 'E'))
        <> ({_residue_sql(4)} = 'L' OR length > 30)""",
    _ALN,
)
_selection(
    "pred_11_precedence",
    '#cluster_1# | #cluster_2# ^ "red" & !{length<=20}',
    "cluster = 1 OR ((cluster = 2) <> (contains(lower(header), 'red') AND NOT length <= 20))",
)
_selection(
    "pred_11_unaligned_never_match", "R2 | !R2", "kind <> 'PROMO'"
)


@query("pred_13_mixed_expression", sql(_ALN, f"""
    SELECT node_id, header FROM nodes WHERE coalesce((contains(lower(header), 'gear') AND length >= 10 AND cluster <> 4)
      OR ({_residue_sql(1)} = 'C' AND price < 1000), false)"""))
def mixed(t: Tables):
    chosen = select_nodes(_context(t), '("gear" & {length>=10} & !#cluster_4#) | (C1 & {price<1000})')
    return chosen.select("node_id", "header")


@query(
    "pred_4_structure_file",
    sql("nodes", "SELECT node_id FROM nodes WHERE seq_len >= 45 OR seq_len IN (3, 4)"),
)
def structure_file(t: Tables):
    """Any four-character structure id of a header is listed; chains are ignored."""
    named = F.concat(
        F.lit("model 2abc, template "), (F.col("seq_len") + 1000).cast("string"), F.lit("_A and "), (F.col("seq_len") + 4996).cast("string")
    )
    listed = t.nodes.where("seq_len >= 45").select(
        F.concat((F.col("seq_len") + 1000).cast("string"), F.lit("_B chain 2abc")).alias("header")
    )
    extra = t.nodes.where("seq_len IN (3, 4)").select((F.col("seq_len") + 4996).cast("string").alias("header"))
    context = SelectionContext(t.nodes.withColumn("header", named), files={"ids.txt": listed.union(extra)})
    return select_nodes(context, "@[PDB]ids.txt@").select("node_id")


@query(
    "pred_14_reference_row",
    sql("nodes", "SELECT min(node_id) AS row_id FROM nodes WHERE contains(lower(header), 'hot bolt')"),
)
def reference_row(t: Tables):
    """First row whose name contains the reference, as no name equals it."""
    return alignment.reference_row(t.rows, "Hot Bolt")


@query(
    "pred_15_reference_match",
    sql("nodes", "SELECT min(node_id) AS node_id, count(*) AS matches FROM nodes WHERE contains(lower(header), 'old ring')"),
)
def reference_match(t: Tables):
    from simloom.functions.headers import header_contains

    found = t.nodes.where(header_contains(F.col("header"), "old ring"))
    return found.agg(F.min("node_id").alias("node_id"), F.count(F.lit(1)).alias("matches"))


@query(
    "pred_16_table_filter",
    """SELECT c_custkey FROM customer WHERE contains(lower(c_name), '7') AND contains(lower(c_mktsegment), 'build')
       AND contains(CAST(c_nationkey AS VARCHAR), '1')""",
)
def table_filter(t: Tables):
    """Conjunction of per-column text filters over the displayed values."""
    from simloom.operators.metadata import filtered_table

    filters = {"c_name": "7", "c_mktsegment": "BUILD", "c_nationkey": "1"}
    return filtered_table(t.table("customer"), filters).select("c_custkey")


@query(
    "pred_20_column_residue",
    sql("nodes cells labels", f"SELECT node_id, {_residue_sql(3)} = 'D' AS found FROM nodes WHERE kind <> 'PROMO'"),
)
def column_residue(t: Tables):
    """Per aligned row: does the column hold this residue."""
    column = t.labels.where("label = '3'").select("col").scalar()
    hits = t.cells.where((F.col("col") == column) & (F.col("aa") == "D")).select("row_id", F.lit(True).alias("hit"))
    rows = t.nodes.where("kind <> 'PROMO'").select("node_id", F.col("node_id").alias("row_id"))
    return rows.join(hits, "row_id", "left").select("node_id", F.coalesce("hit", F.lit(False)).alias("found"))


# -- selections as sets ------------------------------------------------------------------------

_CURRENT, _MATCHED = "length > 25", "kind = 'LARGE'"
_SETS = {
    "set_1_change": ("change", f"visible AND {_MATCHED}"),
    "set_2_add": ("add", f"{_CURRENT} OR (visible AND {_MATCHED})"),
    "set_3_subtract": ("subtract", f"{_CURRENT} AND NOT (visible AND {_MATCHED})"),
    "set_4_filter": ("filter", f"{_CURRENT} AND visible AND {_MATCHED}"),
}


def _set_operation(name: str, mode: str, where: str):
    @query(name, sql("nodes", f"SELECT node_id FROM nodes WHERE {where}"))
    def combined(t: Tables):
        matched = select_nodes(_context(t), "{kind=large}").where("visible")
        return combine_selection(t.nodes.where(_CURRENT), matched, mode)


for _name, (_mode, _where) in _SETS.items():
    _set_operation(_name, _mode, _where)


@query("set_5_invert", sql("nodes", f"SELECT node_id FROM nodes WHERE visible AND NOT ({_CURRENT})"))
def invert(t: Tables):
    return invert_selection(t.nodes, t.nodes.where(_CURRENT))


@query("cmd_select_macro", sql("nodes", f"SELECT node_id FROM nodes WHERE {_CURRENT} AND contains(lower(header), 'rod')"))
def macro(t: Tables):
    """The current selection used inside an expression, as an exact header list."""
    context = _context(t)
    context.files["_sele.txt"] = t.nodes.where(_CURRENT).select("header")
    return select_nodes(context, '@_sele.txt@ & "rod"').select("node_id")


# -- flagship ----------------------------------------------------------------------------------

_FLAGSHIP = """
    WITH kept AS (SELECT * FROM nodes WHERE seq_len > 10),
    inner_edges AS (SELECT * FROM edges WHERE i IN (SELECT node_id FROM kept) AND j IN (SELECT node_id FROM kept)),
    k AS (SELECT greatest(1, least(CAST(floor((SELECT count(*) FROM kept) * ((SELECT count(*) FROM kept) - 1) / 2.0 * 0.005) AS BIGINT),
            (SELECT count(*) FROM inner_edges))) AS k),
    cut AS (SELECT min(score) AS cut FROM (SELECT score, row_number() OVER (ORDER BY score DESC) AS rn FROM inner_edges), k WHERE rn <= k),
    final AS (SELECT i, j FROM inner_edges, cut WHERE score >= cut),
    deg AS (SELECT node_id, count(*) AS degree FROM (SELECT i AS node_id FROM final UNION ALL SELECT j FROM final) GROUP BY node_id)
    SELECT k2.node_id, header, coalesce(degree, 0) AS degree FROM kept k2 LEFT JOIN deg ON k2.node_id = deg.node_id
    WHERE length > 25 AND contains(lower(header), 'ring')"""


@query("flagship_selected_degrees", sql("nodes edges", _FLAGSHIP))
def flagship(t: Tables):
    """Network build, top-percent cutoff, selection and degree of the selected nodes."""
    kept = network.nodes_named_in(t.nodes, t.nodes.where("seq_len > 10").select("header"))
    inside = network.edges_within(t.edges, kept)
    cut = network.top_percent(inside, kept.count(), 0.5)
    chosen = select_nodes(SelectionContext(kept, ["length"]), '{Length>25} & "ring"')
    return chosen.join(network.degrees(cut), "node_id", "left").select(
        "node_id", "header", F.coalesce("degree", F.lit(0)).alias("degree")
    )
