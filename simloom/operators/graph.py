"""Graph operators: components, Jaccard filter, clustering and cluster numbering.

Every iteration writes its small state to the shared folder (:func:`materialized`) and goes on
from there, so plans stay short and a lost executor costs one round at most. Aggregations are
combined before the shuffle, and joins against a hub's edges are split by adaptive execution.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simloom.functions import communities
from simloom.operators.network import degrees, edges_within, endpoints
from simloom.plans.numbering import dense_index, id_bucket
from simloom.plans.runtime import materialized, materialized_with, shuffles_removed

NOISE = -1
# Products of a squaring that are shuffled at once.
PRODUCTS = 1 << 28
# Links of a network, or of a level, that one task takes: its arrays hold some hundred bytes for each.
IN_ONE_TASK = 1 << 22


# -- components --------------------------------------------------------------------------------


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node_id, component)``, where the component is its lowest node id.

    Large-star and small-star rounds: each links neighbours to the lowest id around them, which
    needs a number of rounds logarithmic in the component size and never collects a component.
    """
    links = materialized(
        edges.where("i <> j").select(F.greatest("i", "j").alias("u"), F.least("i", "j").alias("v")).distinct()
    )
    state = None
    while True:
        both = links.select(
            F.inline(F.array(F.struct(F.col("u"), F.col("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
        )
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        base = large.groupBy("u").agg(F.min("v").alias("m"))
        rooted = large.join(base, "u").select(
            F.inline(
                F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
            )
        )
        links, checksum = materialized_with(
            rooted.where("u <> v").distinct(),
            rows=F.count(F.lit(1)),
            roots=F.sum("v"),
            content=F.bit_xor(F.xxhash64("u", "v")),
        )
        if checksum == state:
            break
        state = checksum
    root = links.select(F.col("u").alias("node_id"), F.col("v").alias("component"))
    return nodes.select("node_id").join(root, "node_id", "left").select(
        "node_id", F.coalesce("component", "node_id").alias("component")
    )


# -- Jaccard -----------------------------------------------------------------------------------


def common_neighbours(edges: DataFrame) -> DataFrame:
    """``(i, j, common)`` for adjacent pairs with at least one common neighbour.

    Edges point from the lower to the higher degree, so that no node has more than about
    ``sqrt(2 E)`` outgoing ones. Wedges are formed only over those, which finds every triangle
    once without ever pairing up the neighbours of a hub.
    """
    plain = _plain(edges)
    return _common_neighbours(plain, materialized(degrees(plain)))


def _plain(edges: DataFrame) -> DataFrame:
    """Distinct undirected pairs, written once as they are read several times."""
    pairs = edges.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
    return materialized(pairs.where("i <> j").distinct())


def _common_neighbours(plain: DataFrame, degree: DataFrame) -> DataFrame:
    ranked = plain.join(degree.withColumnRenamed("node_id", "i").withColumnRenamed("degree", "di"), "i").join(
        degree.withColumnRenamed("node_id", "j").withColumnRenamed("degree", "dj"), "j"
    )
    forward = F.struct("di", "i") < F.struct("dj", "j")
    end = lambda i, j, di, dj: F.struct(F.when(forward, dj).otherwise(di).alias("degree"), F.when(forward, j).otherwise(i).alias("b"))
    directed = ranked.select(F.when(forward, F.col("i")).otherwise(F.col("j")).alias("a"), end(*map(F.col, ("i", "j", "di", "dj"))).alias("to"))
    # The ends of a node in rising order of degree: of two of them that are linked, the first one has the second among its own.
    out = materialized(directed.groupBy("a").agg(F.sort_array(F.collect_list("to")).alias("to")).select("a", F.col("to.b").alias("ends")))
    # The wedges of an edge travel as one list, to the one place where all that could close them is known.
    following = out.select("a", "ends", F.posexplode("ends").alias("at", "b")).where(F.col("at") < F.size("ends") - 1)
    wedges = following.select("a", "b", F.slice("ends", F.col("at") + 2, F.size("ends")).alias("rest"))
    closed = wedges.join(out.withColumnsRenamed({"a": "b", "ends": "own"}), "b")
    closed = closed.select("a", "b", F.explode(F.array_intersect("rest", "own")).alias("c"))
    sides = F.array(*[F.struct(F.least(x, y).alias("i"), F.greatest(x, y).alias("j")) for x, y in ("ab", "ac", "bc")])
    return closed.select(F.inline(sides)).groupBy("i", "j").agg(F.count(F.lit(1)).alias("common"))


def with_jaccard(edges: DataFrame) -> DataFrame:
    """Distinct edges with the Jaccard index of their endpoints' neighbour sets."""
    plain = _plain(edges)
    degree = materialized(degrees(plain))
    return _jaccard(plain.join(_common_neighbours(plain, degree), ["i", "j"], "left"), degree)


def _jaccard(counted: DataFrame, degree: DataFrame) -> DataFrame:
    counted = counted.join(degree.withColumnsRenamed({"node_id": "i", "degree": "di"}), "i").join(
        degree.withColumnsRenamed({"node_id": "j", "degree": "dj"}), "j"
    )
    common = F.coalesce("common", F.lit(0))
    return counted.select("i", "j", (common / (F.col("di") + F.col("dj") - common)).alias("jaccard"))


def jaccard_edges(edges: DataFrame, threshold: float) -> DataFrame:
    """:func:`with_jaccard` from a threshold on; above zero only edges of triangles can reach it."""
    if threshold <= 0:
        return with_jaccard(edges).where(F.col("jaccard") >= threshold)
    plain = _plain(edges)
    degree = materialized(degrees(plain))
    return _jaccard(_common_neighbours(plain, degree), degree).where(F.col("jaccard") >= threshold)


# -- numbering ---------------------------------------------------------------------------------


def numbered_clusters(members: DataFrame, min_size: int = 1) -> DataFrame:
    """``(node_id, cluster)`` with ids 1..K by falling size, then lowest member.

    ``members`` is ``(node_id, label)``; label -1 and clusters below ``min_size`` become noise.
    """
    sizes = (
        members.where(F.col("label") != NOISE)
        .groupBy("label")
        .agg(F.count(F.lit(1)).alias("size"), F.min("node_id").alias("lowest"))
        .where(F.col("size") >= min_size)
    )
    ids = dense_index(
        sizes, "cluster", [-F.col("size"), id_bucket("lowest")], [F.col("lowest")], start=1
    ).select("label", "cluster")
    return members.join(ids, "label", "left").select(
        "node_id", F.coalesce(F.col("cluster").cast("int"), F.lit(NOISE)).alias("cluster")
    )


def cluster_sizes(nodes: DataFrame) -> DataFrame:
    """Size and share of every cluster, noise included even if empty."""
    noise = nodes.sparkSession.createDataFrame([(NOISE, 0)], "cluster INT, n BIGINT")
    counted = nodes.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).unionByName(noise)
    total = nodes.agg(F.count(F.lit(1))).scalar()
    return counted.groupBy("cluster").agg(F.sum("n").alias("nodes")).withColumn(
        "percent", F.col("nodes") * 100.0 / total
    )


# -- clustering modes --------------------------------------------------------------------------


def jaccard_labels(nodes: DataFrame, edges: DataFrame, threshold: float) -> DataFrame:
    """``(node_id, label)``: components of the Jaccard-filtered network."""
    kept = jaccard_edges(edges, threshold)
    return connected_components(nodes, kept).withColumnRenamed("component", "label")


def _symmetric(edges: DataFrame) -> DataFrame:
    sides = F.array(
        F.struct(F.col("i"), F.col("j"), F.col("score").cast("double").alias("w")),
        F.struct(F.col("j").alias("i"), F.col("i").alias("j"), F.col("score").cast("double").alias("w")),
    )
    return edges.select(F.inline(sides)).where("i <> j")


def mcl_labels(
    nodes: DataFrame,
    edges: DataFrame,
    inflation: float,
    pruning: float = 0.001,
    max_rounds: int = 100,
) -> DataFrame:
    """``(node_id, label)`` by Markov clustering of the weighted network.

    The transition matrix stays in long form ``(i, j, p)`` with columns ``j`` summing to one.
    Squaring joins entries ``(i, k)`` with ``(k, j)``; their products are shuffled once, for so many columns at a time that there are about
    ``PRODUCTS`` of them, and their files go before the next columns come. Pruning, a part of the algorithm, drops entries below
    ``pruning`` but for the largest of a column and so leaves at most ``1 / pruning`` of them, which bounds every
    later join; 0 switches it off. A matrix that still changes after ``max_rounds`` raises.
    """
    loops = nodes.select(F.col("node_id").alias("i"), F.col("node_id").alias("j"), F.lit(1.0).alias("p"))
    matrix = _normalized(_symmetric(edges).groupBy("i", "j").agg(F.sum("w").alias("p")).unionByName(loops))
    matrix, totals = materialized_with(matrix, entries=F.count(F.lit(1)))
    entries = totals["entries"]
    for _ in range(max_rounds):
        # No more products than pairs of entries: those of a small matrix are not counted.
        parts, following, entries = 1 if entries**2 <= PRODUCTS else _column_parts(matrix), None, 0
        for part in range(parts):
            columns = matrix if parts == 1 else matrix.where(F.pmod(F.xxhash64("j"), F.lit(parts)) == part)
            done, totals = materialized_with(_expanded_columns(matrix, columns, inflation, pruning), entries=F.count(F.lit(1)))
            following, entries = done if following is None else following.unionByName(done), entries + totals["entries"]
        gap = F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("before", F.lit(0.0)))
        with shuffles_removed(matrix.sparkSession):
            settled = (
                following.join(matrix.withColumnRenamed("p", "before"), ["i", "j"], "full")
                .where(gap > 1e-8 + 1e-5 * F.abs(F.coalesce("before", F.lit(0.0))))
                .isEmpty()
            )
        matrix = following
        if settled:
            break
    else:
        raise RuntimeError(f"the matrix still changes after {max_rounds} rounds")
    # Rows with a positive diagonal attract; rows with the same members are one cluster.
    attractors = matrix.where("i = j AND p > 0").select("i")
    rows = matrix.where("p > 0").join(attractors, "i", "left_semi")
    same = rows.groupBy("i").agg(
        F.min("j").alias("lowest"), F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("j")).alias("set")
    )
    labelled = rows.join(same, "i").groupBy(F.col("j").alias("node_id")).agg(
        F.max(F.struct("lowest", "size", "set")).alias("key")
    )
    label = F.xxhash64("key.lowest", "key.size", "key.set")
    label = F.when(label == NOISE, F.lit(0)).otherwise(label)
    return labelled.select("node_id", label.alias("label"))


def _column_parts(matrix: DataFrame) -> int:
    """Into how many parts the columns are dealt, so that squaring one makes about ``PRODUCTS`` products."""
    left, right = (matrix.groupBy(F.col(x).alias("k")).agg(F.count(F.lit(1)).alias(f"n_{x}")) for x in "ji")
    with shuffles_removed(matrix.sparkSession):
        products = left.join(right, "k").agg(F.sum(F.col("n_j") * F.col("n_i"))).first()[0]
    return max(1, -(-(products or 0) // PRODUCTS))


def _expanded_columns(matrix: DataFrame, columns: DataFrame, inflation: float, pruning: float) -> DataFrame:
    """The given columns of the squared, inflated and pruned matrix."""
    right, column = columns.select(F.col("i").alias("k"), "j", F.col("p").alias("q")), Window.partitionBy("j")
    products = matrix.withColumnRenamed("j", "k").join(right, "k").select("i", "j", (F.col("p") * F.col("q")).alias("p"))
    # Dealt once, by column: entries are summed, scaled and pruned where their column is.
    squared = products.repartition("j").groupBy("i", "j").agg(F.pow(F.sum("p"), F.lit(inflation)).alias("p"))
    inflated = squared.withColumn("p", F.col("p") / F.sum("p").over(column))
    kept = inflated.withColumn("top", F.max("p").over(column)).where((F.col("p") >= pruning) | (F.col("p") == F.col("top")))
    return kept.select("i", "j", "p")


def _normalized(matrix: DataFrame) -> DataFrame:
    totals = matrix.groupBy("j").agg(F.sum("p").alias("total"))
    return matrix.join(totals, "j").select("i", "j", (F.col("p") / F.col("total")).alias("p"))


def leiden_labels(
    nodes: DataFrame,
    edges: DataFrame,
    resolution: float = 1.0,
    seed: int = 42,
    max_rounds: int = 4,
    max_settling: int = 1000,
) -> DataFrame:
    """``(node_id, label)`` by modularity optimisation in the Leiden scheme; nodes without edges are noise.

    On every level nodes move to better communities for ``max_rounds`` rounds, each community is refined from single
    nodes, and the refined parts become the nodes of the next level, which begins with the communities found so far. When
    parts no longer merge, the nodes themselves move until none gains, and communities that fell apart are split into their
    connected parts; both are repeated until neither changes anything. So every community is connected and no node
    gains by a move. Moves that do not settle in ``max_settling`` rounds raise.

    A network of at most ``IN_ONE_TASK`` links goes through all these rounds in one task, and so do the upper levels of a larger one.
    """
    links, size = _measured(
        edges.where("i <> j")
        .groupBy(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
        .agg(F.sum(F.col("score").cast("double")).alias("w"))
    )
    if size <= IN_ONE_TASK:
        labels = _of_one_task(links, lambda level, _: communities.communities(level, resolution, seed, max_rounds, max_settling, MOVING))
        return _with_noise(nodes, materialized(labels))
    linked = materialized(endpoints(links).select("node_id").distinct())
    count_ = linked.count()
    members, level, start = linked.withColumn("part", F.col("node_id")), links, None
    while True:
        if size <= IN_ONE_TASK:
            upper = _of_one_task(level, lambda level, start: communities.optimised(level, resolution, seed, max_rounds, MOVING, start), start)
            start = materialized(upper)
            break
        moved = _local_moves(level, resolution, seed, max_rounds, 0, start)
        if moved is None:
            break
        parts = materialized(_refined(level, moved, resolution, seed))
        found, fewer = parts.count(), parts.select("part").distinct().count()
        start = materialized(parts.groupBy("part").agg(F.min("label").alias("label")).withColumnRenamed("part", "node_id"))
        finer = parts.select(F.col("node_id").alias("part"), F.col("part").alias("__part"))
        members = materialized(members.join(finer, "part").select("node_id", F.col("__part").alias("part")))
        if fewer == found:
            break
        a = parts.select(F.col("node_id").alias("i"), F.col("part").alias("__i"))
        b = parts.select(F.col("node_id").alias("j"), F.col("part").alias("__j"))
        # A self loop keeps the weight inside a part for the next level.
        level, size = _measured(
            level.join(a, "i").join(b, "j")
            .groupBy(F.least("__i", "__j").alias("i"), F.greatest("__i", "__j").alias("j"))
            .agg(F.sum("w").alias("w"))
        )
    labels = members.withColumn("label", F.col("part"))
    if start is not None:
        labels = members.join(start.withColumnRenamed("node_id", "part"), "part")
    labels = materialized(labels.select("node_id", "label"))
    while count_:
        settled = _local_moves(links, resolution, seed, max_rounds, max_settling, labels)
        if settled is None:
            break
        a, b = (settled.select(F.col("node_id").alias(x), F.col("label").alias(f"__{x}")) for x in ("i", "j"))
        inside = links.join(a, "i").join(b, "j").where("__i = __j")
        labels = materialized(connected_components(linked, inside).withColumnRenamed("component", "label"))
        if labels.select("label").distinct().count() == settled.select("label").distinct().count():
            break
    return _with_noise(nodes, labels)


def _with_noise(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    return nodes.select("node_id").join(labels, "node_id", "left").select(
        "node_id", F.coalesce("label", F.lit(NOISE)).alias("label")
    )


def _measured(level: DataFrame) -> tuple[DataFrame, float]:
    """A level, written, with the number of its links; infinite if a weight is no number, as arrays do not treat that like columns."""
    w = F.col("w")
    odd = w.isNull() | F.isnan(w) | (F.abs(w) == float("inf"))
    written, totals = materialized_with(level, links=F.count(F.lit(1)), odd=F.count_if(odd))
    return written, float("inf") if totals["odd"] else totals["links"]


def _of_one_task(level: DataFrame, labels_of: Callable, start: DataFrame | None = None) -> DataFrame:
    """``(node_id, label)`` of a level that one task takes, by a function of its arrays and of the labels to start from."""
    kind = level.schema["i"].dataType.simpleString()
    rows = level.select(F.lit(0).alias("kind"), F.col("i").cast("long"), F.col("j").cast("long"), "w")
    if start is not None:
        begun = start.select(F.lit(1).alias("kind"), F.col("node_id").cast("long").alias("i"), F.col("label").cast("long").alias("j"), F.lit(0.0).alias("w"))
        rows = rows.unionByName(begun)

    def run(batches):
        parts = [[batch.column(x).to_numpy(zero_copy_only=False) for x in ("kind", "i", "j", "w")] for batch in batches]
        if not parts:
            return
        of, i, j, w = (np.concatenate(x) for x in zip(*parts))
        parts.clear()
        links, begun = of == 0, of == 1
        found = communities.Level.of(i[links], j[links], w[links])
        labels = labels_of(found, j[begun][np.argsort(i[begun])] if begun.any() else None)
        yield pa.RecordBatch.from_pydict({"node_id": found.ids, "label": labels})

    found = rows.repartition(1).mapInArrow(run, "node_id BIGINT, label BIGINT")
    return found.select(F.col("node_id").cast(kind), F.col("label").cast(kind))


# The share of nodes that may move at once; neighbours that wait keep others from chasing each other.
MOVING = 0.7


def _both_ways(level: DataFrame) -> DataFrame:
    ways = F.array(
        F.struct(F.col("i").alias("node_id"), F.col("j").alias("other"), F.col("w")),
        F.struct(F.col("j").alias("node_id"), F.col("i").alias("other"), F.col("w")),
    )
    return level.select(F.inline(ways))


def _local_moves(
    level: DataFrame, resolution: float, seed: int, max_rounds: int, max_settling: int = 1000, start: DataFrame | None = None
) -> DataFrame | None:
    """Communities ``(node_id, label)`` of one level, from those of ``start`` or from single nodes; None if there is no weight or no merge.

    In a round a hashed share of the nodes that gain moves to the best neighbouring community. Only nodes are looked at
    whose neighbourhood changed, or that wait; once none of them gains, all are looked at again for what other
    communities' weights have changed. A round after which modularity is lower is taken back and repeated with half the share, so
    modularity rises until no node gains. With ``max_settling`` 0 it ends after ``max_rounds`` rounds wherever it stands.
    """
    both = _both_ways(level)
    strength = materialized(both.groupBy("node_id").agg(F.sum("w").alias("k")))
    nodes, total = strength.agg(F.count(F.lit(1)), F.sum("k")).first()
    if not total:
        return None
    # The strength travels with every edge, so no round has to look it up again.
    outer = materialized(both.where("node_id <> other").join(strength, "node_id"))
    begun = strength.withColumn("label", F.col("node_id")) if start is None else strength.join(start, "node_id")
    # Draws follow from the ones before, so that all rounds have the same compiled plan.
    state, active = begun.withColumns({"inside": F.lit(0.0), "draw": F.xxhash64("node_id", F.lit(seed))}), None
    share, best_so_far, kept = MOVING, None, None
    for turn in range(max_rounds + max_settling):
        found, totals = materialized_with(
            _choices(outer, state, active, resolution, total), wants=F.count_if("wants"), moves=F.count_if("may_move"), quality=F.sum("quality")
        )
        if best_so_far is not None and totals["quality"] < best_so_far - 1e-12 * total:
            share /= 2
        else:
            kept, best_so_far = found, totals["quality"]
            share = min(MOVING, 1.5 * share)
            if not totals["wants"]:
                if active is None:
                    break
                state, active = kept.select("node_id", "k", F.col("home").alias("label"), "inside", "draw"), None
                continue
        drawn = F.pmod("draw", F.lit(1 << 20)) < int(share * (1 << 20))
        decided = kept.withColumn("moved", F.col("may_move") & drawn)
        label = F.when(F.col("moved"), F.col("target")).otherwise(F.col("home"))
        state = decided.select("node_id", "k", label.alias("label"), "inside", "draw")
        moved = decided.where("moved").select(F.col("node_id").alias("other"))
        near = outer.join(moved, "other", "left_semi").select("node_id")
        active = near.unionByName(decided.where("wants").select("node_id")).distinct()
    else:
        if max_settling:
            raise RuntimeError(f"nodes still gain by moves after {max_rounds} and {max_settling} rounds")
    labels = kept.select("node_id", F.col("home").alias("label"))
    merged = start is not None or labels.select("label").distinct().count() < nodes
    return labels if merged else None


def _choices(outer: DataFrame, state: DataFrame, active: DataFrame | None, resolution: float, total: float) -> DataFrame:
    """For every node its community (``home``), the best one for it (``target``) and whether it gains (``wants``); nodes that are not active stay.

    ``quality`` sums up to the weight inside communities less what is expected there. Two single nodes never swap: only the one with the higher
    label may move.
    """
    sizes = state.groupBy("label").agg(F.sum("k").alias("mass"), F.count(F.lit(1)).alias("n"))
    looked_at = state if active is None else state.join(active, "node_id", "left_semi")
    edges = outer if active is None else outer.join(active, "node_id", "left_semi")
    near = edges.join(state.select(F.col("node_id").alias("other"), "label"), "other")
    near = near.select("node_id", "label", "k", "w", F.lit(False).alias("stays"))
    own = looked_at.select("node_id", "label", "k", F.lit(0.0).alias("w"), F.lit(True).alias("stays"))
    options = near.unionByName(own).groupBy("node_id", "label").agg(
        F.max("k").alias("k"), F.sum("w").alias("weight"), F.max("stays").alias("stays")
    )
    mass = F.col("mass") - F.when(F.col("stays"), F.col("k")).otherwise(F.lit(0.0))
    gain = F.col("weight") - F.lit(resolution) * F.col("k") * mass / F.lit(total)
    best = options.join(sizes, "label").withColumn("gain", gain).groupBy("node_id").agg(
        F.max("k").alias("k"),
        F.max(F.struct("gain", (-F.col("label")).alias("minus"), "n")).alias("best"),
        F.max(F.when(F.col("stays"), F.struct("gain", "label", "n", "weight"))).alias("here"),
    )
    # Above the rounding of sums that are at most ``k``, so that no node moves to and fro between equals.
    better = F.col("best.gain") > F.col("here.gain") + 1e-9 * F.greatest(F.lit(1.0), F.col("k"))
    swap = (F.col("best.n") == 1) & (F.col("here.n") == 1) & (-F.col("best.minus") > F.col("here.label"))
    chosen = best.select(
        "node_id", (-F.col("best.minus")).alias("target"), better.alias("wants"), (better & ~swap).alias("may_move"), F.col("here.weight").alias("weight"),
        (F.col("best.gain") - F.col("here.gain")).alias("gain"),
    )
    whole = state.join(sizes.select("label", "mass"), "label").join(chosen, "node_id", "left")
    inside = F.coalesce("weight", "inside")
    return whole.select(
        "node_id", "k", F.col("label").alias("home"), inside.alias("inside"), F.coalesce("target", "label").alias("target"),
        F.coalesce("wants", F.lit(False)).alias("wants"), F.coalesce("may_move", F.lit(False)).alias("may_move"),
        (inside - F.lit(resolution) * F.col("k") * F.col("mass") / F.lit(total)).alias("quality"), F.coalesce("gain", F.lit(0.0)).alias("gain"),
        F.xxhash64("node_id", "draw").alias("draw"),
    )


def move_gains(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """``(node_id, gain)`` of every linked node: what its best move to a neighbouring community adds to the weight inside communities beyond expectation; 0 if it is best where it is."""
    both = _both_ways(edges.where("i <> j").select("i", "j", F.col("score").cast("double").alias("w")))
    strength = materialized(both.groupBy("node_id").agg(F.sum("w").alias("k")))
    total = strength.agg(F.sum("k")).first()[0]
    state = strength.join(labels, "node_id").withColumns({"inside": F.lit(0.0), "draw": F.lit(0).cast("long")})
    return _choices(both.join(strength, "node_id"), state, None, resolution, total or 1.0).select("node_id", "gain")


def split_communities(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``(label, parts)`` of communities that are not connected, and the number of their parts."""
    members = labels.where(F.col("label") != NOISE)
    a, b = (members.select(F.col("node_id").alias(x), F.col("label").alias(f"__{x}")) for x in ("i", "j"))
    inside = edges.join(a, "i").join(b, "j").where("__i = __j").select("i", "j")
    parts = members.join(connected_components(members.select("node_id"), inside), "node_id")
    return parts.groupBy("label").agg(F.count_distinct("component").alias("parts")).where("parts > 1")


def _refined(level: DataFrame, labels: DataFrame, resolution: float, seed: int, rounds: int = 4) -> DataFrame:
    """``(node_id, label, part)``: connected parts of each community, put together from single nodes.

    In each round a coin decides for every part whether it stays or its node may move. Only single nodes move, to a part of their own
    community that stays, is linked to them and adds to modularity; so parts are connected.
    """
    both = _both_ways(level)
    strength = both.groupBy("node_id").agg(F.sum("w").alias("k"))
    total = strength.agg(F.sum("k")).first()[0]
    state = materialized(strength.join(labels, "node_id").withColumn("part", F.col("node_id")))
    side = lambda name: labels.select(F.col("node_id").alias(name), F.col("label").alias(f"__{name}"))
    within = both.where("node_id <> other").join(side("node_id"), "node_id").join(side("other"), "other")
    within = materialized(within.where("__node_id = __other").select("node_id", "other", "w"))
    for turn in range(rounds):
        stays = F.pmod(F.xxhash64("part", F.lit(seed + turn)), F.lit(2)) == 0
        parts = state.groupBy("part").agg(F.sum("k").alias("mass"), F.count(F.lit(1)).alias("n")).withColumn("stays", stays)
        free = state.join(parts.where("n = 1 AND NOT stays").select("part"), "part", "left_semi").select("node_id", "k")
        near = within.join(free, "node_id").join(state.select(F.col("node_id").alias("other"), "part"), "other")
        options = near.groupBy("node_id", "part").agg(F.max("k").alias("k"), F.sum("w").alias("w")).join(parts.where("stays"), "part")
        gain = F.col("w") - F.lit(resolution) * F.col("k") * F.col("mass") / F.lit(total)
        best = options.withColumn("gain", gain).where("gain > 0").groupBy("node_id").agg(F.max(F.struct("gain", (-F.col("part")).alias("minus"))).alias("best"))
        target = best.select("node_id", (-F.col("best.minus")).alias("__part"))
        state = materialized(state.join(target, "node_id", "left").select("node_id", "k", "label", F.coalesce("__part", "part").alias("part")))
    return state.select("node_id", "label", "part")


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row ``(modularity)`` of a labelling ``(node_id, label)`` of the weighted network."""
    both = _symmetric(edges)
    a = labels.select(F.col("node_id").alias("i"), F.col("label").alias("a"))
    b = labels.select(F.col("node_id").alias("j"), F.col("label").alias("b"))
    inside = both.join(a, "i").join(b, "j").agg(
        F.sum("w").alias("total"), F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0)).alias("inside")
    )
    masses = both.join(a, "i").groupBy("a").agg(F.sum("w").alias("mass")).agg(F.sum(F.col("mass") ** 2)).scalar()
    return inside.select(
        (F.col("inside") / F.col("total") - F.lit(resolution) * masses / (F.col("total") ** 2)).alias("modularity")
    )


def clusters(
    nodes: DataFrame, edges: DataFrame, mode: str = "leiden", parameter: float = 1.0, min_size: int = 10
) -> DataFrame:
    """``(node_id, cluster)`` by one of the modes ``leiden``, ``mcl`` and ``jaccard``."""
    return numbered_clusters(_labels(nodes, edges, mode, parameter), min_size)


def _labels(nodes: DataFrame, edges: DataFrame, mode: str, parameter: float) -> DataFrame:
    run = {"jaccard": jaccard_labels, "mcl": mcl_labels, "leiden": leiden_labels}[mode]
    return run(nodes, edges, parameter)


def subclusters(
    nodes: DataFrame, edges: DataFrame, number: int, mode: str, parameter: float, min_size: int
) -> DataFrame:
    """Nodes with groups ``subcluster_<number>_<k>`` from clustering one cluster again.

    Groups of an earlier run on the same cluster go first. Sub-clusters keep the order of their
    lowest member; they are not sorted by size.
    """
    from simloom.operators.metadata import without_subclusters

    inside = nodes.where(F.col("cluster") == number).select("node_id")
    labels = _labels(inside, edges_within(edges, inside), mode, parameter)
    sizes = (
        labels.where(F.col("label") != NOISE)
        .groupBy("label")
        .agg(F.count(F.lit(1)).alias("size"), F.min("node_id").alias("lowest"))
        .where(F.col("size") >= min_size)
    )
    ids = dense_index(sizes, "k", [id_bucket("lowest")], [F.col("lowest")], start=1)
    named = labels.join(ids, "label").select(
        "node_id", F.concat(F.lit(f"subcluster_{number}_"), F.col("k").cast("string")).alias("__group")
    )
    cleaned = without_subclusters(nodes, number)
    added: Column = F.array_sort(F.array_distinct(F.array_append("groups", F.col("__group"))))
    return cleaned.join(named, "node_id", "left").withColumn(
        "groups", F.when(F.col("__group").isNotNull(), added).otherwise(F.col("groups"))
    ).drop("__group")
