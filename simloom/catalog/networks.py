"""Network building, cutoffs, statistics and set operations on edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from simloom.catalog.registry import Tables, query, sql
from simloom.functions import scores
from simloom.operators import network


def _out(df, *names, **rounded):
    """Selected columns, with some rounded for comparison."""
    return df.select(*names, *[F.round(F.col(n).cast("double"), d).alias(n) for n, d in rounded.items()])


@query("agg_1_canonical_edges", sql("edges", "SELECT i, j, CAST(score AS DOUBLE) AS score FROM edges"))
def canonical(t: Tables):
    """Undirected deduplication with the best score per pair."""
    return _out(t.edges, "i", "j", score=4)


_HALVES = """
    WITH halves AS (
      SELECT least(i, j) AS i, greatest(i, j) AS j, l_returnflag, max(score) AS score
      FROM (SELECT l_partkey AS i, l_orderkey % (SELECT max(p_partkey) + 1 FROM part) AS j,
                   CAST(l_quantity AS FLOAT) AS score, l_returnflag FROM lineitem)
      WHERE i <> j GROUP BY ALL)
    SELECT i, j, CAST(max(score) AS DOUBLE) AS score FROM halves GROUP BY i, j"""


@query("agg_2_merged_runs", sql("", _HALVES))
def merged_runs(t: Tables):
    """Runs reduced one by one (per return flag) and merged again with the same maximum."""
    n_parts = t.table("part").agg(F.max("p_partkey") + 1).scalar()
    flagged = t.table("lineitem").select(
        F.col("l_partkey").alias("i"),
        (F.col("l_orderkey") % n_parts).alias("j"),
        F.col("l_quantity").cast("float").alias("score"),
        F.col("l_returnflag").alias("run"),
    )
    pair = [F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")]
    runs = flagged.where("i <> j").groupBy(*pair, "run").agg(F.max("score").alias("score"))
    return _out(network.canonical_edges(runs), "i", "j", score=4)


@query(
    "arr_13_evalue_score",
    "SELECT l_orderkey, l_linenumber, round(-log10(l_discount * 1e-9 + 1e-300), 4) AS score FROM lineitem",
)
def evalue(t: Tables):
    score = scores.evalue_score(F.col("l_discount") * F.lit(1e-9))
    return t.table("lineitem").select("l_orderkey", "l_linenumber", F.round(score, 4).alias("score"))


# Headers of the large parts stand for the sequence file that filters the network.
_KEPT = "SELECT header FROM nodes WHERE seq_len > 10"


@query("join_1_fasta_node_filter", sql("nodes", f"SELECT node_id, header FROM nodes WHERE header IN ({_KEPT})"))
def node_filter(t: Tables):
    """Nodes named by a sequence file, by full header or first token."""
    listed = t.nodes.where("seq_len > 10").select("header")
    return network.nodes_named_in(t.nodes, listed).select("node_id", "header")


@query(
    "join_1_missing_headers",
    sql(
        "nodes",
        """SELECT DISTINCT split_part(source || ' ' || lang, ' ', 1) AS token FROM documents
           WHERE split_part(source || ' ' || lang, ' ', 1) NOT IN (SELECT split_part(header, ' ', 1) FROM nodes)""",
    ),
)
def missing_headers(t: Tables):
    """First tokens of a sequence file that the network lacks."""
    return network.missing_from_network(t.records.select("header"), t.nodes)


_INDUCED = """
    WITH kept AS (SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS new_id FROM nodes WHERE seq_len > 10)
    SELECT a.new_id AS i, b.new_id AS j, CAST(e.score AS DOUBLE) AS score
    FROM edges e JOIN kept a ON e.i = a.node_id JOIN kept b ON e.j = b.node_id"""


@query("join_2_induced_reindexed_edges", sql("nodes edges", _INDUCED))
def induced(t: Tables):
    """Edges between kept nodes on gap-free new ids."""
    kept = network.reindexed(t.nodes.where("seq_len > 10").select("node_id"))
    return _out(network.induced_edges(t.edges, kept), "i", "j", score=4)


@query(
    "join_3_edge_lengths",
    sql(
        "nodes edges",
        """SELECT i, j, a.seq_len AS len_i, b.seq_len AS len_j
           FROM edges JOIN nodes a ON i = a.node_id JOIN nodes b ON j = b.node_id""",
    ),
)
def edge_lengths(t: Tables):
    return network.with_lengths(t.edges, t.nodes).select("i", "j", "len_i", "len_j")


_MODES = {
    "alignment_length": "aln_len",
    "shorter_sequence": "least(len_i, len_j)",
    "longer_sequence": "greatest(len_i, len_j)",
    "average_sequence": "(len_i + len_j) / 2.0",
}
_WITH_LEN = """WITH lens AS (SELECT e.*, a.seq_len AS len_i, b.seq_len AS len_j
    FROM edges e JOIN nodes a ON e.i = a.node_id JOIN nodes b ON e.j = b.node_id)"""


def _normalization(mode: str, below: str):
    body = f"""{_WITH_LEN} SELECT i, j, round(CASE WHEN {below} > 0
        THEN CAST(score AS DOUBLE) / CAST({below} AS DOUBLE) ELSE 0 END, 6) AS score FROM lens"""

    @query(f"arr_12_normalized_{mode}", sql("nodes edges", body))
    def normalized(t: Tables):
        return _out(network.normalized_edges(t.scored_edges, t.nodes, mode), "i", "j", score=6)


for _mode, _below in _MODES.items():
    _normalization(_mode, _below)


@query(
    "pred_17_score_threshold",
    sql("edges", "SELECT i, j, CAST(score AS DOUBLE) AS score FROM edges WHERE score >= CAST(40.5 AS FLOAT)"),
)
def threshold(t: Tables):
    return _out(network.at_least(t.edges, 40.5), "i", "j", score=4)


_TOP = """
    WITH k AS (SELECT greatest(1, least(CAST(floor((SELECT count(*) FROM nodes) * ((SELECT count(*) FROM nodes) - 1) / 2.0
                 * 0.005) AS BIGINT), (SELECT count(*) FROM edges))) AS k),
    cut AS (SELECT min(score) AS cut FROM (SELECT score, row_number() OVER (ORDER BY score DESC) AS rn FROM edges), k WHERE rn <= k)
    SELECT i, j, CAST(score AS DOUBLE) AS score FROM edges, cut WHERE score >= cut"""


@query("win_1_top_percent_edges", sql("nodes edges", _TOP))
def top_percent(t: Tables):
    """Top 0.5 percent of all possible edges, ties included."""
    return _out(network.top_percent(t.edges, t.table("part").count(), 0.5), "i", "j", score=4)


_KNN = """SELECT i, j, CAST(score AS DOUBLE) AS score FROM (
      SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, i, j) AS ri,
                row_number() OVER (PARTITION BY j ORDER BY score DESC, i, j) AS rj FROM edges)
    WHERE ri <= 5 OR rj <= 5"""


@query("win_2_nearest_edges", sql("edges", _KNN))
def nearest(t: Tables):
    """Five best edges per source and per target."""
    return _out(network.nearest_edges(t.edges, 5), "i", "j", score=4)


@query(
    "gr_8_degrees",
    sql(
        "edges",
        """SELECT node_id, count(*) AS degree
           FROM (SELECT i AS node_id FROM edges UNION ALL SELECT j FROM edges) GROUP BY node_id""",
    ),
)
def degrees(t: Tables):
    return network.degrees(t.edges)


_BOTH = "(SELECT i AS node_id, j AS other FROM edges UNION ALL SELECT j, i FROM edges)"


@query(
    "join_19_neighbours",
    sql(
        "nodes edges",
        f"""SELECT DISTINCT other AS node_id FROM {_BOTH}
            WHERE node_id IN (SELECT node_id FROM nodes WHERE kind = 'PROMO' AND length > 45)
              AND other NOT IN (SELECT node_id FROM nodes WHERE kind = 'PROMO' AND length > 45)""",
    ),
)
def neighbours(t: Tables):
    """Nodes next to a selection."""
    return network.neighbours(t.edges, t.nodes.where("kind = 'PROMO' AND length > 45"))


@query(
    "join_20_cluster_subgraph",
    sql(
        "nodes edges",
        """SELECT i, j, CAST(score AS DOUBLE) AS score FROM edges
           WHERE i IN (SELECT node_id FROM nodes WHERE cluster = 7) AND j IN (SELECT node_id FROM nodes WHERE cluster = 7)""",
    ),
)
def cluster_subgraph(t: Tables):
    return _out(network.edges_within(t.edges, t.nodes.where("cluster = 7")), "i", "j", score=4)


@query(
    "join_4_extracted_network",
    sql(
        "nodes hits",
        """WITH kept AS (SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS new_id FROM nodes WHERE kind = 'LARGE')
           SELECT a.new_id AS i, b.new_id AS j, CAST(score AS DOUBLE) AS score, aln_len
           FROM hits JOIN kept a ON i = a.node_id JOIN kept b ON j = b.node_id""",
    ),
)
def extracted(t: Tables):
    """Sub-network by exact header; directions, repeats and other columns stay."""
    chosen = t.nodes.where("kind = 'LARGE'").select("header")
    kept = network.reindexed(t.nodes.join(chosen, "header", "left_semi").select("node_id"))
    return _out(network.induced_edges(t.hits, kept), "i", "j", "aln_len", score=4)


@query(
    "pred_18_visible_edges",
    sql(
        "nodes edges",
        """SELECT i, j, CAST(score AS DOUBLE) AS score FROM edges WHERE score >= 45
           AND i IN (SELECT node_id FROM nodes WHERE visible) AND j IN (SELECT node_id FROM nodes WHERE visible)""",
    ),
)
def visible(t: Tables):
    return _out(network.visible_edges(t.edges, t.nodes, 45.0), "i", "j", score=4)


@query(
    "gr_7_isolated_nodes",
    sql(
        "nodes edges",
        f"""WITH active AS (SELECT i, j FROM edges WHERE score >= 50
              AND i IN (SELECT node_id FROM nodes WHERE visible) AND j IN (SELECT node_id FROM nodes WHERE visible))
            SELECT node_id FROM nodes WHERE visible
              AND node_id NOT IN (SELECT i FROM active UNION ALL SELECT j FROM active)""",
    ),
)
def isolated(t: Tables):
    """Visible nodes without an active edge."""
    active = network.visible_edges(t.edges, t.nodes, 50.0)
    return network.isolated(t.nodes.where("visible"), active).select("node_id")


@query(
    "agg_17_network_statistics",
    sql(
        "nodes edges",
        """SELECT (SELECT count(*) FROM nodes) AS nodes,
                  (SELECT count(*) * (count(*) - 1) // 2 FROM nodes) AS possible_edges, count(*) AS edges,
                  CAST(min(score) AS DOUBLE) AS min_score, CAST(max(score) AS DOUBLE) AS max_score,
                  round(avg(score), 6) AS mean_score FROM edges""",
    ),
)
def statistics(t: Tables):
    stats = network.score_statistics(t.edges, t.nodes)
    return stats.withColumn("mean_score", F.round("mean_score", 6))


_SWEEP = """
    WITH marks AS (SELECT CAST(s AS DOUBLE) AS threshold
                   FROM (SELECT unnest(range(CAST(floor(min(score)) AS BIGINT), CAST(ceil(max(score)) AS BIGINT) + 1)) AS s FROM edges))
    SELECT threshold, (SELECT count(*) FROM edges WHERE score >= threshold) AS edges,
           round((SELECT count(*) FROM edges WHERE score >= threshold) * 100.0
                 / (SELECT count(*) * (count(*) - 1) / 2 FROM nodes), 6) AS percent
    FROM marks"""


@query("agg_18_threshold_sweep", sql("nodes edges", _SWEEP))
def sweep(t: Tables):
    """Edges at or above every whole threshold."""
    low, high = t.edges.agg(F.min("score"), F.max("score")).first()
    n = t.table("part").count()
    swept = network.threshold_sweep(t.edges, n * (n - 1) // 2, network.sweep_thresholds(low, high, evalue=True))
    return swept.withColumn("percent", F.round("percent", 6))


def _histogram_sql(needs: str, values: str, bins: int) -> str:
    return sql(
        needs,
        f"""WITH v AS ({values}), r AS (SELECT min(v) AS lo, max(v) AS hi FROM v),
        b AS (SELECT CAST(least(floor((v - lo) / (hi - lo) * {bins}), {bins - 1}) AS INTEGER) AS bin, count(*) AS n FROM v, r GROUP BY 1),
        g AS (SELECT CAST(unnest(range({bins})) AS INTEGER) AS bin)
        SELECT g.bin, round(lo + g.bin * ((hi - lo) / {bins}), 6) AS low,
               round(lo + (g.bin + 1) * ((hi - lo) / {bins}), 6) AS high, coalesce(n, 0) AS count
        FROM g LEFT JOIN b ON g.bin = b.bin, r""",
    )


def _rounded_bins(df):
    return df.withColumns({"low": F.round("low", 6), "high": F.round("high", 6)})


@query("agg_19_score_histogram", _histogram_sql("edges", "SELECT CAST(score AS DOUBLE) AS v FROM edges", 100))
def score_histogram(t: Tables):
    return _rounded_bins(network.histogram(t.edges, F.col("score"), 100))


@query(
    "src_23_edge_violations",
    sql(
        "hits",
        """WITH p AS (SELECT i, j, count(*) AS n, count(*) FILTER (score IS NULL OR isnan(score) OR isinf(score)) AS bad FROM hits GROUP BY i, j)
           SELECT CAST(sum(n) AS BIGINT) AS edges, CAST(sum(bad) AS BIGINT) AS not_finite,
                  CAST(sum(n - 1) AS BIGINT) AS duplicates, count(*) FILTER (i >= j) AS not_ordered,
                  count(*) FILTER (least(i, j) < 0 OR greatest(i, j) >= 1500) AS out_of_range FROM p""",
    ),
)
def violations(t: Tables):
    """Storage checks of a raw edge table against 1500 declared nodes."""
    return network.edge_violations(t.hits, 1500)


@query(
    "src_13_completeness",
    sql(
        "nodes edges",
        """SELECT count(*) AS edges, (SELECT count(*) * (count(*) - 1) // 2 FROM nodes) AS possible_edges,
                  CASE WHEN count(*) = (SELECT count(*) * (count(*) - 1) // 2 FROM nodes) THEN 'complete' ELSE 'incomplete' END AS state
           FROM edges""",
    ),
)
def complete(t: Tables):
    possible = F.shiftright(t.n_nodes * (t.n_nodes - 1), 1)
    counted = t.edges.agg(F.count(F.lit(1)).alias("edges")).withColumn("possible_edges", possible)
    return counted.withColumn(
        "state", F.when(F.col("edges") == F.col("possible_edges"), "complete").otherwise("incomplete")
    )


@query(
    "arr_16_pair_index",
    sql(
        "nodes edges",
        """SELECT i, j, n * i - (i * (i + 1)) // 2 + j - i - 1 AS pair
           FROM edges, (SELECT count(*) AS n FROM nodes)""",
    ),
)
def pair_index(t: Tables):
    return t.edges.select("i", "j", scores.pair_index(F.col("i"), F.col("j"), t.n_nodes).alias("pair"))


@query(
    "arr_14_score_distance",
    sql(
        "edges",
        """SELECT i, j, round(least(greatest(0.0, m - CAST(score AS DOUBLE)), m + 0.1), 4) AS distance
           FROM edges, (SELECT CAST(max(score) AS DOUBLE) AS m FROM edges)""",
    ),
)
def distance(t: Tables):
    highest = t.edges.agg(F.max("score").cast("double")).scalar()
    return t.edges.select(
        "i", "j", F.round(scores.score_distance(F.col("score").cast("double"), highest), 4).alias("distance")
    )


@query(
    "join_25_equivalent_results",
    sql(
        "edges nodes",
        """SELECT count(*) FILTER (a.i IS NULL OR b.i IS NULL) AS unmatched,
                  count(*) FILTER (a.aln_len <> b.aln_len) AS length_differences,
                  count(*) FILTER (abs(a.score - b.score) / greatest(1, a.aln_len) > 0.001) AS score_drifts
           FROM edges a FULL JOIN (SELECT i, j, CAST(score + 0.002 AS FLOAT) AS score, aln_len FROM edges) b
             ON a.i = b.i AND a.j = b.j""",
    ),
)
def equivalent(t: Tables):
    """Two runs of one scoring job: same pairs, same lengths, drift within tolerance."""
    from simloom.operators.search import result_differences

    shifted = t.scored_edges.withColumn("score", (F.col("score") + 0.002).cast("float"))
    return result_differences(t.scored_edges, shifted, ["i", "j"])
