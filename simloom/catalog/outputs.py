"""Sinks and reports as the rows they write."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from simloom.catalog.registry import Tables, query, sql
from simloom.operators import layout, metadata, network, search, trees
from simloom.plans.runtime import scratch_folder
from simloom.sources import fasta, hits, lists, sheets, store


def _node_records(t: Tables):
    """A record per node: its header and its aligned text without gaps."""
    text = F.replace("sequence", F.lit("-"), F.lit(""))
    return t.aligned.select(F.col("row_id").alias("ord"), "header", text.alias("sequence"))


_NODE_RECORDS = "recs AS (SELECT row_id AS ord, header, replace(sequence, '-', '') AS sequence FROM aligned JOIN nodes ON row_id = node_id)"


@query("snk_1_fasta_lines", sql("nodes aligned", f"WITH {_NODE_RECORDS} SELECT '>' || header || chr(10) || sequence AS value FROM recs"))
def fasta_lines(t: Tables):
    return fasta.fasta_lines(_node_records(t))


@query(
    "snk_6_group_fasta",
    sql(
        "nodes aligned",
        f"""WITH {_NODE_RECORDS} SELECT name, node_id AS ord, '>' || r.header || chr(10) || sequence AS value
            FROM (SELECT node_id, header, unnest([group_a, group_b]) AS name FROM nodes) g JOIN recs r ON g.header = r.header""",
    ),
)
def group_fasta(t: Tables):
    """Records per group; a node in two groups is written twice."""
    return sheets.membership_fasta(t.nodes, _node_records(t), "groups")


@query(
    "snk_6_cluster_fasta",
    sql(
        "nodes aligned",
        f"""WITH {_NODE_RECORDS} SELECT 'cluster_' || cluster AS name, node_id AS ord, '>' || r.header || chr(10) || sequence AS value
            FROM nodes n JOIN recs r ON n.header = r.header WHERE cluster <> -1""",
    ),
)
def cluster_fasta(t: Tables):
    return sheets.membership_fasta(t.nodes, _node_records(t), "clusters")


@query("snk_7_selected_headers", sql("nodes", "SELECT header AS value FROM nodes WHERE kind = 'LARGE'"))
def selected_headers(t: Tables):
    return sheets.selected_headers(t.nodes, t.nodes.where("kind = 'LARGE'"))


@query(
    "snk_7_selected_records",
    sql("nodes aligned", f"WITH {_NODE_RECORDS} SELECT ord, '>' || r.header || chr(10) || sequence AS value FROM recs r JOIN nodes ON ord = node_id WHERE kind = 'LARGE'"),
)
def selected_records(t: Tables):
    return sheets.selected_records(t.nodes, t.nodes.where("kind = 'LARGE'"), _node_records(t))


@query("snk_17_numbered_records", sql("nodes aligned", f"WITH {_NODE_RECORDS} SELECT ord, CAST(ord AS VARCHAR) AS header, sequence FROM recs"))
def numbered(t: Tables):
    """Records named by their number for an external aligner."""
    return fasta.numbered_records(_node_records(t))[0]


@query(
    "snk_2_stored_network",
    sql("edges", "SELECT i, j, CAST(score AS DOUBLE) AS l_score, aln_len AS l_len FROM edges"),
)
def stored_network(t: Tables):
    """A network written to the shared folder and read back with only the local scores."""
    folder = f"{scratch_folder(t.spark)}/network-{uuid.uuid4().hex}"
    edges = t.scored_edges.select(
        "i", "j", F.col("score").alias("l_score"), F.col("aln_len").alias("l_len"),
        (F.col("score") * 2).alias("g_score"), (F.col("aln_len") + 1).alias("g_len"),
    )
    store.write_network(folder, t.nodes.select("node_id", "header", "seq_len"), edges, "model-a")
    scores = store.network_scores(store.read_network(t.spark, folder), "local")
    return scores.select("i", "j", F.col("score").cast("double").alias("l_score"), F.col("aln_len").alias("l_len"))


@query(
    "agg_27_record_fingerprint",
    """WITH d AS (SELECT doc_id AS o, sha256(concat_ws(chr(31), source || ' ' || lang, text)) AS h FROM documents),
       a AS (SELECT o >> 12 AS p, sha256(string_agg(h, '' ORDER BY o)) AS h, count(*) AS n FROM d GROUP BY p),
       b AS (SELECT p >> 12 AS q, sha256(string_agg(h, '' ORDER BY p)) AS h, sum(n) AS n FROM a GROUP BY q),
       c AS (SELECT q >> 12 AS r, sha256(string_agg(h, '' ORDER BY q)) AS h, sum(n) AS n FROM b GROUP BY r)
       SELECT CAST(sum(n) AS BIGINT) AS records, sha256(string_agg(h, '' ORDER BY r)) AS fingerprint FROM c""",
)
def fingerprint(t: Tables):
    """Content fingerprint of all records and their order."""
    records = t.table("documents").select(
        F.col("doc_id").alias("ord"), F.concat("source", F.lit(" "), "lang").alias("header"), F.col("text").alias("sequence")
    )
    return store.table_fingerprint(records)


@query("agg_27_row_digests", "SELECT doc_id AS ord, sha256(concat_ws(chr(31), source, text)) AS digest FROM documents")
def row_digests(t: Tables):
    records = t.table("documents").select(F.col("doc_id").alias("ord"), F.col("source").alias("header"), F.col("text").alias("sequence"))
    return store.row_digests(records)


@query(
    "join_21_consistency",
    sql(
        "nodes",
        """WITH f AS (SELECT header FROM nodes WHERE seq_len > 20 UNION ALL SELECT 'orphan ' || s_name FROM supplier)
           SELECT count(*) AS records, count(*) FILTER (header NOT IN (SELECT header FROM nodes)) AS missing_in_network,
                  count(*) FILTER (header NOT IN (SELECT header FROM nodes WHERE kind <> 'PROMO')) AS missing_in_alignment,
                  count(*) FILTER (contains(lower(header), 'hot ring')) AS reference_hits FROM f""",
    ),
)
def consistency(t: Tables):
    """Sequence file against network, alignment and reference."""
    orphans = t.table("supplier").select(F.concat(F.lit("orphan "), "s_name").alias("header"))
    records = t.nodes.where("seq_len > 20").select("header").unionByName(orphans)
    return network.consistency_report(records, t.nodes, t.nodes.where("kind <> 'PROMO'"), "Hot Ring")


@query(
    "win_12_first_examples",
    sql("nodes", "SELECT header FROM nodes WHERE kind = 'PROMO' ORDER BY header LIMIT 10"),
)
def examples(t: Tables):
    """First ten unaligned headers for a message (a bounded list is the feature)."""
    return network.first_examples(t.nodes.where("kind = 'PROMO'"), "header")


@query(
    "src_4_header_lines",
    "SELECT source || ' ' || lang AS header FROM documents UNION ALL SELECT substr(trim(line, chr(32) || chr(9) || chr(13)), 2) FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line, chr(32) || chr(9) || chr(13)) LIKE '>%'",
)
def header_lines(t: Tables):
    """Header lines of FASTA text, nothing else of it."""
    lines = t.table("documents").select(
        F.explode(F.concat(F.array(F.concat(F.lit(">"), "source", F.lit(" "), "lang")), F.split("text", "\n"))).alias("value")
    )
    return lists.header_lines(lines, fasta=True)


_NAMED = """
    WITH lines AS (SELECT o_orderkey AS line, 'C' || o_custkey AS q, 'C' || (o_orderkey * 7 % 1009) AS s,
                          CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST('1e-' || CAST(CAST(floor(o_totalprice / 10000) AS INTEGER) AS VARCHAR) AS DOUBLE) END AS e FROM orders),
    seen AS (SELECT name, min(place) AS place FROM (SELECT q AS name, line * 2 AS place FROM lines UNION ALL SELECT s, line * 2 + 1 FROM lines) GROUP BY name),
    ids AS (SELECT name, row_number() OVER (ORDER BY place) - 1 AS id FROM seen)
    SELECT least(a.id, b.id) AS i, greatest(a.id, b.id) AS j, round(max(-log10(e + 1e-300)), 4) AS score
    FROM lines JOIN ids a ON q = a.name JOIN ids b ON s = b.name WHERE e >= 0 AND a.id <> b.id GROUP BY 1, 2"""


@query("src_10_named_hit_table", _NAMED)
def named_hits(t: Tables):
    """Hit table with text ids to a network on ids of first appearance."""
    exponent = F.floor(F.col("o_totalprice") / 10000).cast("int").cast("string")
    line = F.concat_ws(
        " ",
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")),
        F.concat(F.lit("C"), (F.col("o_orderkey") * 7 % 1009).cast("string")),
        *[F.lit("0")] * 8,
        F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(F.concat(F.lit("1e-"), exponent)),
        F.lit("50"),
    )
    lines = t.table("orders").select(F.col("o_orderkey").alias("line"), line.alias("value"))
    edges = hits.named_network(hits.parse_named_hits(lines, 10))[1]
    return edges.select("i", "j", F.round("score", 4).alias("score"))


def _hits_report(t: Tables):
    """Suppliers as ranked hits: balance per length as normalised score."""
    scored = t.table("supplier").select(
        F.col("s_name").alias("header"),
        F.round(F.col("s_acctbal") / (F.col("s_nationkey") + 1), 4).alias("norm_score"),
        F.col("s_acctbal").alias("raw_score"),
        F.col("s_nationkey").alias("seq_len"),
        (F.col("s_nationkey") + 1).alias("aln_len"),
    )
    return search.ranked_hits(scored, "Supplier#000000007", top_k=100)


_REPORT = """
    WITH r AS (SELECT s_name AS header, round(s_acctbal / (s_nationkey + 1), 4) AS norm_score, s_acctbal AS raw_score, s_nationkey AS seq_len, s_nationkey + 1 AS aln_len FROM supplier),
    k AS (SELECT *, row_number() OVER (ORDER BY norm_score DESC, header) AS rank FROM r WHERE header <> 'Supplier#000000007' ORDER BY norm_score DESC, header LIMIT 99)"""


@query(
    "snk_10_search_report",
    _REPORT + """ SELECT header AS "Node ID", rank AS "Rank", norm_score AS "Norm_Score", raw_score AS "Raw_Score", seq_len AS "Sequence_Length", aln_len AS "Alignment_Length" FROM k""",
)
def search_report(t: Tables):
    """Ranked hits as a sheet that can be uploaded as metadata."""
    return search.search_report(_hits_report(t))


@query(
    "snk_9_report_lines",
    _REPORT + """ SELECT rank, printf(' %-6d | %9.4f | %9.2f | %8d | %8d | %s', rank, norm_score, CAST(raw_score AS DOUBLE), seq_len, aln_len, header) AS line FROM k""",
)
def report_lines(t: Tables):
    """Text lines of the search report."""
    return sheets.search_lines(_hits_report(t)).select("rank", "line")


@query(
    "arr_15_unit_residues",
    """WITH r AS (SELECT vec_id, res, list_transform(embedding[res * 8 + 1 : res * 8 + 8], lambda x: CAST(x AS DOUBLE)) AS v
                 FROM (SELECT vec_id, embedding, unnest(range(8)) AS res FROM embeddings))
       SELECT vec_id AS node_id, res, k - 1 AS feature, round(CAST(CAST(v[k] / sqrt(list_dot_product(v, v)) AS FLOAT) AS DOUBLE), 5) AS value
       FROM r, unnest(range(1, 9)) AS f(k)""",
)
def unit_residues(t: Tables):
    """Residue vectors scaled to length one."""
    from simloom.catalog.pairs import _residue_embeddings

    flat = trees.unit_profiles(_residue_embeddings(t)).select(F.col("c").alias("node_id"), F.posexplode("profile").alias("res", "v"))
    values = flat.select("node_id", "res", F.posexplode("v").alias("feature", "value"))
    return values.select("node_id", "res", "feature", F.round(F.col("value").cast("double"), 5).alias("value"))


@query(
    "win_10_group_order",
    sql("nodes", "SELECT name, row_number() OVER (ORDER BY n DESC, name) AS place FROM (SELECT name, count(*) AS n FROM (SELECT unnest([group_a, group_b]) AS name FROM nodes) GROUP BY name)"),
)
def group_order(t: Tables):
    """Display order of the group list: by size, then name (one row per group)."""
    from pyspark.sql import Window

    order = Window.orderBy(F.desc("nodes"), "name")
    return metadata.group_counts(t.nodes).select("name", F.row_number().over(order).alias("place"))


@query(
    "san_10_alignment_headers",
    sql("nodes aligned", r"SELECT row_id, regexp_replace(replace(replace(replace(header, '[', '('), ']', ')'), '#', '_'), '[ _]+', '_', 'g') AS header, sequence FROM aligned JOIN nodes ON row_id = node_id"),
)
def alignment_headers(t: Tables):
    """Aligned records through the strict checks: cleaned, never renamed, unique, of one width."""
    return fasta.checked_alignment(t.aligned.select(F.col("row_id").alias("ord"), "header", "sequence"))


@query(
    "snk_12_stored_layout",
    sql(
        "nodes",
        """WITH grid AS (SELECT node_id, header, row_number() OVER (ORDER BY node_id) - 1 AS place, count(*) OVER () AS n FROM nodes),
        box AS (SELECT *, CAST(ceil(sqrt(n)) AS BIGINT) AS side, sqrt(n) * 2.5 + 5.0 AS box FROM grid)
        SELECT node_id, header, round(-box * 0.5 + (place % side) * (box / (side - 1)), 4) AS x,
               round(-box * 0.5 + (place // side) * (box / (side - 1)), 4) AS y FROM box""",
    ),
)
def stored_layout(t: Tables):
    """A layout written with its manifest, found by its settings and read back."""
    folder = f"{scratch_folder(t.spark)}/layouts-{uuid.uuid4().hex}/{store.next_version([])}"
    fields = {"sequences": "aa", "network": "bb", "model": "blast", "threshold": 30.0}
    store.write_layout(folder, layout.grid_positions(t.nodes.select("node_id", "header")), fields)
    found = store.matching_folders(t.spark, [folder], fields)
    return store.read_layout(t.spark, found[0], t.nodes).select("node_id", "header", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query(
    "snk_4_stored_embeddings",
    """SELECT 'vec_' || vec_id AS header, res, k - 1 AS feature, round(CAST(embedding[res * 8 + k] AS DOUBLE), 6) AS value
       FROM embeddings, unnest(range(8)) AS r(res), unnest(range(1, 9)) AS f(k)""",
)
def stored_embeddings(t: Tables):
    """An embedding database written with its manifest and read back complete."""
    from simloom.catalog.pairs import _residue_embeddings

    folder = f"{scratch_folder(t.spark)}/embeddings-{uuid.uuid4().hex}"
    store.write_embeddings(folder, _residue_embeddings(t).select("header", "sequence", "embedding"), "model-a", "float32")
    back = store.read_embeddings(t.spark, folder)["embeddings"]
    residues = back.select("header", F.posexplode("embedding").alias("res", "v"))
    values = residues.select("header", "res", F.posexplode("v").alias("feature", "value"))
    return values.select("header", "res", "feature", F.round(F.col("value").cast("double"), 6).alias("value"))


@query("snk_5_stored_alignment", sql("cells", "SELECT row_id, col, aa FROM cells"))
def stored_alignment(t: Tables):
    """Sparse cells clustered by column, written and read back whole."""
    folder = f"{scratch_folder(t.spark)}/alignment-{uuid.uuid4().hex}"
    store.write_alignment(folder, t.rows, t.cells)
    return store.read_store(t.spark, folder, "msa")["cells"].select("row_id", "col", "aa")
