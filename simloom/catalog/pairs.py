"""Pairwise scoring on the given vectors: cosine networks, prefilter, alignment and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from simloom.catalog.registry import Tables, query, sql
from simloom.functions import scores
from simloom.operators import embeddings as emb
from simloom.operators import network, pairwise, search
from simloom.plans.pairs import with_ends
from simloom.plans.runtime import materialized
from simloom.streaming import incremental

RESIDUES, WIDTH = 8, 8


def _pooled(t: Tables):
    """Vectors with a length taken from their label, for length-adjusted measures."""
    vector = F.transform("embedding", lambda x: x.cast("double"))
    return t.vectors.select("node_id", vector.alias("pooled"), (F.col("label") + 10).alias("seq_len"))


def _residue_embeddings(t: Tables):
    """Each vector of 64 numbers read as 8 residues of 8 features."""
    parts = F.transform(F.sequence(F.lit(0), F.lit(RESIDUES - 1)), lambda k: F.slice("embedding", k * WIDTH + 1, WIDTH))
    return t.vectors.select(
        "node_id",
        F.concat(F.lit("vec_"), F.col("node_id").cast("string")).alias("header"),
        F.repeat(F.lit("A"), RESIDUES).alias("sequence"),
        parts.alias("embedding"),
    )


_V = "v AS (SELECT vec_id AS node_id, CAST(embedding AS DOUBLE[]) AS e, label + 10 AS len FROM embeddings)"
_COS = "greatest(-1.0, least(1.0, list_cosine_similarity(a.e, b.e)))"


@query(
    "join_8_similar_pairs",
    f"""WITH {_V} SELECT a.node_id AS i, b.node_id AS j, round({_COS}, 6) AS similarity
        FROM v a JOIN v b ON a.node_id < b.node_id WHERE {_COS} >= 0.35""",
)
def similar(t: Tables):
    """All pairs of vectors in blocks, only similar ones leave a task."""
    pairs = pairwise.similar_pairs(_pooled(t), 0.35)
    return pairs.select("i", "j", F.round("similarity", 6).alias("similarity"))


@query(
    "arr_10_edge_cosine",
    f"""WITH {_V}, n AS (SELECT max(vec_id) + 1 AS n FROM embeddings),
        e AS (SELECT DISTINCT l_partkey % n AS i, l_suppkey % n AS j FROM lineitem, n)
        SELECT i, j, round({_COS}, 6) AS cosine FROM e JOIN v a ON i = a.node_id JOIN v b ON j = b.node_id""",
)
def edge_cosine(t: Tables):
    """Cosine along the edges of a network, as a column expression."""
    n = t.table("embeddings").agg(F.max("vec_id") + 1).scalar()
    edges = t.table("lineitem").select((F.col("l_partkey") % n).alias("i"), (F.col("l_suppkey") % n).alias("j")).distinct()
    value = scores.cosine(F.col("a"), F.col("b"))
    return with_ends(edges, _pooled(t), "pooled").select("i", "j", F.round(value, 6).alias("cosine"))


_ADJUSTED = f"{_COS} * pow(least(a.len, b.len) / greatest(a.len, b.len, 1), 0.5)"


@query(
    "arr_11_length_adjusted_pairs",
    f"""WITH {_V} SELECT a.node_id AS i, b.node_id AS j, round({_ADJUSTED}, 6) AS similarity
        FROM v a JOIN v b ON a.node_id < b.node_id WHERE {_ADJUSTED} >= 0.3""",
)
def adjusted(t: Tables):
    pairs = pairwise.similar_pairs(_pooled(t), 0.3, power=0.5)
    return pairs.select("i", "j", F.round("similarity", 6).alias("similarity"))


@query(
    "agg_21_similarity_percentile",
    f"""WITH {_V} SELECT round(quantile_cont({_ADJUSTED.replace('0.5)', '1.0)')}, 0.95), 9) AS threshold
        FROM v a JOIN v b ON a.node_id < b.node_id""",
)
def percentile(t: Tables):
    """95th percentile over all pairs, exact and without keeping the pairs."""
    value = pairwise.similarity_percentile(_pooled(t), 95.0, 1.0)
    return t.spark.createDataFrame([(value,)], "threshold DOUBLE").withColumn("threshold", F.round("threshold", 9))


@query(
    "join_8_prefiltered_pairs",
    f"""WITH {_V}, p AS (SELECT a.node_id AS i, b.node_id AS j, {_ADJUSTED.replace('0.5)', '1.0)')} AS s FROM v a JOIN v b ON a.node_id < b.node_id)
        SELECT i, j FROM p WHERE s >= (SELECT quantile_cont(s, 0.99) FROM p)""",
)
def prefiltered(t: Tables):
    """Pairs worth aligning at prefilter strength 99."""
    return pairwise.prefiltered_pairs(_pooled(t), 99.0).select("i", "j")


@query(
    "agg_22_lowest_edge_similarity",
    f"""WITH {_V}, n AS (SELECT max(vec_id) + 1 AS n FROM embeddings),
        e AS (SELECT DISTINCT l_partkey % n AS i, l_suppkey % n AS j FROM lineitem, n)
        SELECT round(min({_COS}), 6) AS lowest FROM e JOIN v a ON i = a.node_id JOIN v b ON j = b.node_id""",
)
def lowest(t: Tables):
    n = t.table("embeddings").agg(F.max("vec_id") + 1).scalar()
    edges = t.table("lineitem").select((F.col("l_partkey") % n).alias("i"), (F.col("l_suppkey") % n).alias("j")).distinct()
    value = pairwise.lowest_edge_similarity(_pooled(t), edges)
    return t.spark.createDataFrame([(round(value, 6),)], "lowest DOUBLE")


_RES = "r AS (SELECT vec_id AS node_id, unnest(range(8)) AS res, embedding FROM embeddings)"


@query(
    "arr_9_mean_pooling",
    f"""WITH {_RES}, d AS (SELECT node_id, k, avg(CAST(embedding[res * 8 + k + 1] AS DOUBLE)) AS v FROM r, (SELECT unnest(range(8)) AS k) GROUP BY node_id, k)
        SELECT node_id, k, round(v, 6) AS value FROM d""",
)
def mean_pooling(t: Tables):
    pooled = emb.pooled(_residue_embeddings(t), "mean")
    flat = pooled.select(F.substring("header", 5, 20).cast("long").alias("node_id"), F.posexplode("pooled").alias("k", "value"))
    return flat.withColumn("value", F.round("value", 6))


@query(
    "arr_9_max_pooling",
    f"""WITH {_RES}, d AS (SELECT node_id, k, max(CAST(embedding[res * 8 + k + 1] AS DOUBLE)) AS v FROM r, (SELECT unnest(range(8)) AS k) GROUP BY node_id, k)
        SELECT node_id, k, round(v, 6) AS value FROM d""",
)
def max_pooling(t: Tables):
    pooled = emb.pooled(_residue_embeddings(t), "max")
    flat = pooled.select(F.substring("header", 5, 20).cast("long").alias("node_id"), F.posexplode("pooled").alias("k", "value"))
    return flat.withColumn("value", F.round("value", 6))


@query("join_8_alignment_network")
def alignment_network(t: Tables):
    """Global and local alignment of every pair (kernels are checked against brute force in tests)."""
    return pairwise.align_all_pairs(_residue_embeddings(t))


@query("arr_6_prefiltered_alignment_network")
def prefiltered_network(t: Tables):
    """Alignment of the pairs that pass the pooled prefilter, normalised and cut to the best."""
    residues = _residue_embeddings(t)
    pooled = emb.pooled(residues).select(F.substring("header", 5, 20).cast("long").alias("node_id"), "pooled", "seq_len")
    pairs = pairwise.prefiltered_pairs(pooled, 90.0)
    aligned = pairwise.align_listed_pairs(residues, pairs)
    edges = aligned.select("i", "j", F.col("l_score").alias("score"), F.col("l_len").alias("aln_len"))
    nodes = residues.select("node_id", F.length("sequence").alias("seq_len"))
    return network.normalized_edges(edges, nodes, "shorter_sequence")


@query("arr_7_aligned_residues")
def aligned_residues(t: Tables):
    """Matched residues of the most similar pairs."""
    pairs = pairwise.prefiltered_pairs(_pooled(t), 99.0)
    return pairwise.aligned_residues(_residue_embeddings(t), pairs, "local", -2.0)


@query(
    "win_4_ranked_hits",
    f"""WITH {_V}, q AS (SELECT e FROM v WHERE node_id = 7),
        h AS (SELECT 'vec_' || node_id AS header, round(list_cosine_similarity(v.e, q.e), 6) AS norm_score FROM v, q)
        SELECT header, norm_score, row_number() OVER (ORDER BY norm_score DESC, header) AS rank FROM h
        WHERE norm_score >= 0 AND header <> 'vec_7' ORDER BY norm_score DESC, header LIMIT 49""",
)
def ranked_hits(t: Tables):
    """Top 50 report of a stored query: threshold, own hit removed, one place kept for it."""
    query_vector = _pooled(t).where("node_id = 7").select("pooled").scalar()
    value = F.round(scores.cosine(F.col("pooled"), F.col("q")), 6)
    hits = _pooled(t).withColumn("q", query_vector).select(
        F.concat(F.lit("vec_"), F.col("node_id").cast("string")).alias("header"), value.alias("norm_score")
    )
    return search.ranked_hits(hits, "vec_7", top_k=50, threshold=0.0)


@query("join_10_alignment_search")
def alignment_search(t: Tables):
    """One query aligned against the whole database and ranked."""
    residues = _residue_embeddings(t)
    hits = pairwise.search_all(residues, residues.where("node_id = 7"))
    return search.search_report(search.ranked_hits(hits, "vec_7", top_k=100, threshold=0.0))


@query(
    "src_24_embedding_checks",
    "SELECT 0 AS repeated_headers, 0 AS unsafe_headers, 0 AS wrong_length, 0 AS ragged, 0 AS not_finite, 0 AS illegal_residues, 0 AS dimension_spread FROM (SELECT count(*) FROM embeddings)",
)
def embedding_checks(t: Tables):
    return emb.violations(_residue_embeddings(t))


@query(
    "join_17_cropped_embeddings",
    """SELECT 'vec_' || vec_id AS header, k AS pos, round(CAST(embedding[(k + 1 + (label % 3)) * 8 + 1] AS DOUBLE), 6) AS first_feature
       FROM embeddings, (SELECT unnest(range(8)) AS k) WHERE k < 4""".replace("(k + 1 + (label % 3))", "(k + label % 3)"),
)
def cropped(t: Tables):
    """Four residues cut out of each embedding where the cropped text lies."""
    full = _residue_embeddings(t).drop("sequence").join(t.vectors.select("node_id", "label"), "node_id")
    start = F.col("label") % 3
    full = full.withColumns(
        {
            "sequence": F.concat(F.repeat(F.lit("G"), start), F.lit("ACDE"), F.repeat(F.lit("K"), 4 - start)),
        }
    )
    crops = full.select("header", F.lit("ACDE").alias("sequence"))
    cut = emb.cropped_embeddings(full.select("header", "sequence", "embedding"), crops)
    flat = cut.select("header", F.posexplode("embedding").alias("pos", "vec"))
    return flat.select("header", "pos", F.round(F.get("vec", F.lit(0)).cast("double"), 6).alias("first_feature"))


@query(
    "join_16_extracted_embeddings",
    "SELECT 'vec_' || vec_id AS header, 8 AS residues FROM embeddings WHERE label = 3",
)
def extracted(t: Tables):
    """Embeddings of a target list; sequences must agree."""
    residues = _residue_embeddings(t)
    targets = residues.join(t.vectors.where("label = 3").select("node_id"), "node_id").select("header", "sequence")
    return emb.extracted(residues.select("header", "sequence", "embedding"), targets).select(
        "header", F.size("embedding").alias("residues")
    )


@query(
    "join_11_common_headers",
    sql(
        "nodes",
        """SELECT node_id FROM nodes WHERE 'vec_' || node_id IN (SELECT 'vec_' || vec_id FROM embeddings)
           AND 'vec_' || node_id IN (SELECT 'vec_' || o_custkey FROM orders)""",
    ),
)
def common(t: Tables):
    """Nodes known to the network, the embedding database and the sequence file."""
    nodes = t.nodes.select("node_id", F.concat(F.lit("vec_"), F.col("node_id").cast("string")).alias("header"))
    fasta = t.table("orders").select(F.concat(F.lit("vec_"), F.col("o_custkey").cast("string")).alias("header"))
    return emb.common_headers(nodes, _residue_embeddings(t), fasta).select("node_id")


@query(
    "join_12_sequence_mismatches",
    "SELECT 'vec_' || vec_id AS header FROM embeddings WHERE label = 4",
)
def mismatches(t: Tables):
    """Records whose sequence differs from the stored one."""
    residues = _residue_embeddings(t)
    records = residues.join(t.vectors.select("node_id", "label"), "node_id").select(
        "header", F.when(F.col("label") == 4, F.lit("AAAAAAAC")).otherwise(F.col("sequence")).alias("sequence")
    )
    return emb.sequence_mismatches(records, residues.select("header", "sequence", "embedding"))


@query(
    "join_13_extended_network",
    f"""WITH {_V}, old_nodes AS (SELECT node_id FROM v WHERE len < 17),
        old AS (SELECT a.node_id AS i, b.node_id AS j, {_COS} AS s FROM v a JOIN v b ON a.node_id < b.node_id
                WHERE a.node_id IN (FROM old_nodes) AND b.node_id IN (FROM old_nodes) AND {_COS} >= 0.3),
        low AS (SELECT min(s) AS s FROM old),
        fresh AS (SELECT a.node_id AS i, b.node_id AS j FROM v a JOIN v b ON a.node_id < b.node_id
                  WHERE NOT (a.node_id IN (FROM old_nodes) AND b.node_id IN (FROM old_nodes)) AND {_COS} >= (SELECT s FROM low))
        SELECT i, j, 'old' AS source FROM old UNION ALL SELECT i, j, 'new' FROM fresh""",
)
def extended(t: Tables):
    """Pairs of an extended network: old edges stay, new ones reach the old minimum similarity."""
    pooled = _pooled(t)
    old_nodes = pooled.where("seq_len < 17")
    # Counted, searched for its lowest similarity and returned: compared once.
    old = materialized(pairwise.similar_pairs(old_nodes, 0.3).select("i", "j"))
    required = incremental.required_pairs(pooled, old_nodes.select("node_id"), old)
    return required.select("i", "j", F.when(F.col("is_new"), "new").otherwise("old").alias("source"))


@query(
    "join_18_pending_pairs",
    f"""WITH {_V} SELECT a.node_id AS i, b.node_id AS j FROM v a JOIN v b ON a.node_id < b.node_id
        WHERE {_COS} >= 0.35 AND NOT ({_COS} >= 0.45)""",
)
def pending(t: Tables):
    """Required pairs without the finished ones of an earlier run."""
    required = pairwise.similar_pairs(_pooled(t), 0.35).select("i", "j")
    finished = pairwise.similar_pairs(_pooled(t), 0.45).select("i", "j")
    return incremental.pending_pairs(required, finished)


@query(
    "join_14_reused_scores",
    sql(
        "edges hits",
        """WITH rev AS (SELECT least(i, j) AS i, greatest(i, j) AS j, max(aln_len) AS score FROM hits WHERE i <> j AND score > 25 GROUP BY ALL)
           SELECT coalesce(e.i, r.i) AS i, coalesce(e.j, r.j) AS j, CAST(coalesce(CAST(e.score AS DOUBLE), r.score) AS DOUBLE) AS score
           FROM (SELECT * FROM edges WHERE score <= 30) e FULL JOIN rev r ON e.i = r.i AND e.j = r.j""",
    ),
)
def reused(t: Tables):
    """Old scores win over freshly computed ones."""
    old = t.edges.where("score <= 30").select("i", "j", F.col("score").cast("double").alias("score"))
    fresh = network.canonical_edges(
        t.hits.where("score > 25").select("i", "j", F.col("aln_len").cast("double").alias("score"))
    )
    return incremental.reused_scores(old, fresh, ["score"])


@query(
    "join_15_new_embeddings",
    "SELECT 'vec_' || vec_id AS header FROM embeddings WHERE label >= 8",
)
def new_embeddings(t: Tables):
    """Records of a grown sequence file that still need an embedding."""
    residues = _residue_embeddings(t).join(t.vectors.select("node_id", "label"), "node_id")
    stored = residues.where("label < 8").select("header", "sequence")
    return incremental.new_records(residues.select("header", "sequence"), stored).select("header")
