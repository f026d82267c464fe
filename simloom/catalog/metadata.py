"""Metadata, groups, colours, render order and layout coordinates."""

from __future__ import annotations

from pyspark.sql import functions as F

from simloom.catalog.registry import Tables, query, sql
from simloom.operators import layout, metadata, network, search


def _sheet(t: Tables):
    """Order lines as an uploaded sheet: repeated headers, blanks and unreadable numbers."""
    header = F.concat(
        F.lit("WP_"),
        F.lpad((F.col("o_custkey") * 2).cast("string"), 9, "0"),
    )
    names = t.nodes.select(F.split_part("header", F.lit("."), F.lit(1)).alias("acc"), F.col("header").alias("full"))
    price = F.when(F.col("o_orderstatus") == "P", "nan").otherwise(F.col("o_totalprice").cast("decimal(20,2)").cast("string"))
    note = F.when(F.col("o_orderstatus") == "O", " ").otherwise(F.col("o_orderpriority"))
    rows = t.table("orders").select(
        F.col("o_orderkey").alias("ord"), header.alias("acc"), price.alias("price"), note.alias("note")
    )
    return rows.join(names, "acc", "left").select(
        "ord", F.coalesce("full", "acc").alias("header"), "price", "note"
    )


_SHEET = """
    sheet AS (SELECT o_orderkey AS ord, coalesce(n.header, acc) AS header,
                     CASE WHEN o_orderstatus = 'P' THEN 'nan' ELSE CAST(CAST(o_totalprice AS DECIMAL(20,2)) AS VARCHAR) END AS price,
                     CASE WHEN o_orderstatus = 'O' THEN ' ' ELSE o_orderpriority END AS note
              FROM (SELECT *, 'WP_' || lpad(CAST(o_custkey * 2 AS VARCHAR), 9, '0') AS acc FROM orders) o
              LEFT JOIN nodes n ON split_part(n.header, '.', 1) = acc)"""


@query(
    "join_7_merged_metadata",
    sql(
        "nodes",
        f"""WITH {_SHEET},
        last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY header ORDER BY ord DESC) AS rn FROM sheet) WHERE rn = 1)
        SELECT node_id, CASE WHEN s.price IS NULL OR s.price = 'nan' THEN nodes.price ELSE CAST(s.price AS DOUBLE) END AS price,
               nullif(trim(s.note), '') AS note FROM nodes LEFT JOIN last s ON nodes.header = s.header""",
    ),
)
def merged(t: Tables):
    """Uploaded sheet merged into node metadata: last row wins, blanks keep old values."""
    changed = metadata.merged_metadata(t.nodes, _sheet(t), [("price", "number"), ("note", "text")])
    return changed.select("node_id", "price", "note")


@query(
    "agg_23_upload_counters",
    sql(
        "nodes",
        f"""WITH {_SHEET} SELECT count(DISTINCT header) FILTER (header IN (SELECT header FROM nodes)) AS matched_nodes,
            count(*) FILTER (header NOT IN (SELECT header FROM nodes)) AS ignored_rows FROM sheet""",
    ),
)
def counters(t: Tables):
    return metadata.upload_counters(t.nodes, _sheet(t))


@query(
    "join_23_default_lengths",
    """WITH cust AS (SELECT c_custkey, c_mktsegment || ' ' || c_nationkey AS header FROM customer),
       rec AS (SELECT s_suppkey AS ord, CASE WHEN s_nationkey < 12 THEN 'MACHINERY ' || s_nationkey ELSE 'FURNITURE x' || s_suppkey END AS header,
                      s_name AS sequence FROM supplier),
       f AS (SELECT header, max_by(length(sequence), ord) AS n FROM rec GROUP BY header),
       k AS (SELECT split_part(header, ' ', 1) AS token, max_by(length(sequence), ord) AS n FROM rec GROUP BY 1)
       SELECT c_custkey AS node_id, coalesce(f.n, k.n, 0) AS "Length" FROM cust
       LEFT JOIN f ON cust.header = f.header LEFT JOIN k ON split_part(cust.header, ' ', 1) = k.token""",
)
def default_lengths(t: Tables):
    """Length by full header, by first token, or 0."""
    nodes = t.table("customer").select(
        F.col("c_custkey").alias("node_id"),
        F.concat_ws(" ", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("header"),
    )
    records = t.table("supplier").select(
        F.col("s_suppkey").alias("ord"),
        F.when(F.col("s_nationkey") < 12, F.concat(F.lit("MACHINERY "), F.col("s_nationkey").cast("string")))
        .otherwise(F.concat(F.lit("FURNITURE x"), F.col("s_suppkey").cast("string")))
        .alias("header"),
        F.col("s_name").alias("sequence"),
    )
    return metadata.default_lengths(nodes, records).select("node_id", "Length")


@query(
    "snk_8_metadata_sheet",
    """SELECT c_name AS header, nullif(c_mktsegment, 'BUILDING') AS segment, CASE WHEN c_nationkey > 20 THEN NULL ELSE CAST(c_nationkey AS VARCHAR) END AS nation
       FROM customer WHERE c_mktsegment <> 'BUILDING' OR c_nationkey <= 20""",
)
def sheet_export(t: Tables):
    """Exported rows; nodes without any value are left out."""
    nodes = t.table("customer").select(
        F.col("c_name").alias("header"),
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"),
        F.when(F.col("c_nationkey") <= 20, F.col("c_nationkey")).alias("nation"),
    )
    return metadata.export_sheet(nodes, ["segment", "nation"])


@query(
    "snk_16_json_rows",
    """SELECT s_suppkey AS node_id, '{"node_id":' || s_suppkey || ',"header":"' || s_name || '","score":"' ||
              CASE WHEN s_nationkey < 5 THEN '' ELSE CAST(s_nationkey AS VARCHAR) || '.5' END || '"}' AS row FROM supplier""",
)
def json_rows(t: Tables):
    nodes = t.table("supplier").select(
        F.col("s_suppkey").alias("node_id"),
        F.col("s_name").alias("header"),
        F.when(F.col("s_nationkey") < 5, float("nan")).otherwise(F.col("s_nationkey") + 0.5).alias("score"),
    )
    return metadata.json_rows(nodes)


@query("agg_16_group_counts", sql("nodes", "SELECT name, count(*) AS nodes FROM (SELECT unnest([group_a, group_b]) AS name FROM nodes) GROUP BY name"))
def group_counts(t: Tables):
    return metadata.group_counts(t.nodes)


@query(
    "set_7_group_changes",
    sql(
        "nodes",
        """SELECT node_id, unnest(list_distinct(list_filter([group_a, group_b, CASE WHEN length > 40 THEN 'long' END],
             lambda g: g IS NOT NULL AND g <> 'red'))) AS name FROM nodes""",
    ),
)
def group_changes(t: Tables):
    """A group added by expression and another removed everywhere."""
    grown = metadata.with_group(t.nodes, F.col("length") > 40, "Long")
    return metadata.without_groups(grown, ["RED"]).select("node_id", F.explode("groups").alias("name"))


@query(
    "agg_24_color_scale",
    sql(
        "nodes",
        """WITH hit AS (SELECT min(price) AS lo, max(price) AS hi FROM nodes WHERE visible AND kind = 'LARGE')
           SELECT node_id, CASE WHEN visible AND kind = 'LARGE' THEN round((price - lo) / (hi - lo), 6) END AS scale FROM nodes, hit""",
    ),
)
def color_scale(t: Tables):
    scaled = metadata.color_scale(t.nodes, F.col("kind") == "LARGE", "price")
    return scaled.select("node_id", F.round("scale", 6).alias("scale"))


_PALETTE = """
    WITH k AS (SELECT count(DISTINCT cluster) AS n FROM nodes WHERE cluster <> -1),
    s AS (SELECT n, CAST(ceil(n / 12) AS BIGINT) AS shades FROM k), h AS (SELECT *, CAST(ceil(n / shades) AS BIGINT) AS hues FROM s),
    p AS (SELECT cluster, row_number() OVER (ORDER BY cluster) - 1 AS place FROM (SELECT DISTINCT cluster FROM nodes WHERE cluster <> -1))
    SELECT cluster, round((place % hues) / hues, 6) AS hue,
           round(CASE WHEN shades = 1 THEN 0.65 ELSE 0.58 + (place // hues) / (shades - 1) * 0.27 END, 6) AS lightness FROM p, h"""


@query("cmd_13_cluster_palette", sql("nodes", _PALETTE))
def palette(t: Tables):
    colors = metadata.cluster_palette(t.nodes)
    return colors.select("cluster", F.round("hue", 6).alias("hue"), F.round("lightness", 6).alias("lightness"))


def _ranked_nodes(t: Tables):
    """Render ranks in reverse node order."""
    highest = t.table("part").agg(F.max("p_partkey")).scalar()
    return t.nodes.select("node_id", "kind", "visible", "seq_len", (highest - F.col("node_id")).alias("render_rank"))


_RANKED = "ranked AS (SELECT node_id, kind, seq_len, (SELECT max(p_partkey) FROM part) - node_id AS render_rank FROM nodes)"


@query(
    "win_7_promoted_order",
    sql(
        "nodes",
        f"""WITH {_RANKED} SELECT node_id, row_number() OVER (ORDER BY kind = 'SMALL',
              CASE WHEN kind = 'SMALL' THEN node_id ELSE render_rank END) - 1 AS render_rank FROM ranked""",
    ),
)
def promoted(t: Tables):
    """Promoted nodes are drawn last, by index; others keep their order."""
    return metadata.promoted_order(_ranked_nodes(t), F.col("kind") == "SMALL").select("node_id", "render_rank")


@query(
    "win_8_effective_order",
    sql(
        "nodes edges",
        f"""WITH {_RANKED}, sel AS (SELECT node_id FROM ranked WHERE kind = 'PROMO' AND seq_len > 45),
        con AS (SELECT DISTINCT CASE WHEN i IN (SELECT node_id FROM sel) THEN j ELSE i END AS node_id FROM edges
                WHERE (i IN (SELECT node_id FROM sel)) <> (j IN (SELECT node_id FROM sel)))
        SELECT node_id, row_number() OVER (ORDER BY CASE WHEN node_id = 5 THEN 3 WHEN node_id IN (SELECT node_id FROM sel) THEN 2
               WHEN node_id IN (SELECT node_id FROM con) THEN 1 ELSE 0 END, render_rank) - 1 AS draw_rank FROM ranked""",
    ),
)
def effective(t: Tables):
    """Base nodes, then neighbours of the selection, the selection and the clicked node."""
    nodes = _ranked_nodes(t)
    selected = nodes.where("kind = 'PROMO' AND seq_len > 45")
    connected = network.neighbours(t.edges, selected)
    return metadata.effective_order(nodes, selected, connected, 5).select("node_id", "draw_rank")


@query(
    "cmd_14_order_check",
    sql("nodes", "SELECT count(*) AS nodes, 0 AS repeated, 0 AS negative, max(node_id) AS highest FROM nodes"),
)
def order_check(t: Tables):
    return metadata.order_violations(_ranked_nodes(t))


_GRID = """
    grid AS (SELECT node_id, visible, place, CAST(ceil(sqrt(n)) AS BIGINT) AS side, sqrt(n) * 2.5 + 5.0 AS box
             FROM (SELECT node_id, visible, row_number() OVER (ORDER BY node_id) - 1 AS place, count(*) OVER () AS n FROM nodes)),
    pos AS (SELECT node_id, visible, -box * 0.5 + (place % side) * (box / (side - 1)) AS x,
                   -box * 0.5 + (place // side) * (box / (side - 1)) AS y FROM grid)"""


@query("gr_9_grid_layout", sql("nodes", f"WITH {_GRID} SELECT node_id, round(x, 4) AS x, round(y, 4) AS y FROM pos"))
def grid(t: Tables):
    """Initial square grid over the layout box."""
    placed = layout.grid_positions(t.nodes.select("node_id"))
    return placed.select("node_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query(
    "win_9_nearest_node",
    sql("nodes", f"WITH {_GRID} SELECT node_id FROM pos WHERE visible ORDER BY sqrt(pow(x - 3.3, 2) + pow(y - 7.1, 2)), node_id DESC LIMIT 1"),
)
def nearest_node(t: Tables):
    """Visible node nearest to a point; ties go to the topmost."""
    placed = layout.grid_positions(t.nodes.select("node_id", "visible")).withColumn("render_rank", F.col("node_id"))
    return search.nearest_to_point(placed, 3.3, 7.1).select("node_id")


@query(
    "win_11_typed_sort",
    """SELECT nation, count(*) AS n, min(place) AS first_place FROM (
         SELECT nation, row_number() OVER (ORDER BY nation NULLS FIRST, c_custkey) AS place
         FROM (SELECT c_custkey, CASE WHEN c_nationkey < 20 THEN c_nationkey END AS nation FROM customer)) GROUP BY nation""",
)
def typed_sort(t: Tables):
    """Places of a typed sort with missing values first, per value."""
    table = t.table("customer").select(F.when(F.col("c_nationkey") < 20, F.col("c_nationkey")).alias("nation"))
    counted = metadata.sorted_table(table.groupBy("nation").agg(F.count(F.lit(1)).alias("n")), "nation")
    from pyspark.sql import Window

    before = Window.orderBy(F.asc_nulls_first("nation")).rowsBetween(Window.unboundedPreceding, -1)
    return counted.withColumn("first_place", F.coalesce(F.sum("n").over(before), F.lit(0)) + 1)


@query(
    "cmd_1_assignments",
    sql(
        "nodes",
        """SELECT node_id, CASE WHEN length > 45 THEN 'blue' WHEN kind = 'LARGE' THEN 'red' ELSE 'gray' END AS color,
                  CASE WHEN kind = 'LARGE' THEN 2.0 ELSE 1.0 END AS size FROM nodes""",
    ),
)
def assignments(t: Tables):
    """Several expression/colour/size assignments in one step; later ones win."""
    from simloom.session import Session

    session = Session(t.nodes, t.edges, properties=["length", "price", "kind"])
    session.color(("{kind=LARGE}", {"color": "red", "size": 2.0}), ("{length>45}", {"color": "blue"}))
    return session.nodes.select("node_id", "color", "size")


@query(
    "cmd_3_hide_and_undo",
    sql("nodes", "SELECT node_id FROM nodes WHERE NOT (kind = 'LARGE')"),
)
def hide(t: Tables):
    """Hide, hide again and undo the second step."""
    from simloom.session import Session

    session = Session(t.nodes.drop("visible"), t.edges, properties=["length", "price", "kind"])
    session.hide("{kind=LARGE}")
    session.hide("{length>10}")
    session.undo()
    return session.nodes.where("visible").select("node_id")
