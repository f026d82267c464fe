import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from simloom.functions import communities
from simloom.operators import graph, layout, metadata, network


def frames(spark, n, pairs, scores=None):
    nodes = spark.range(n).select(F.col("id").alias("node_id"))
    rows = [(a, b, float(scores[k]) if scores is not None else 1.0) for k, (a, b) in enumerate(pairs)]
    return nodes, spark.createDataFrame(rows, "i BIGINT, j BIGINT, score DOUBLE")


def random_pairs(seed, n, share):
    rng = np.random.default_rng(seed)
    return [p for p in itertools.combinations(range(n), 2) if rng.random() < share]


def union_find(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in range(n)}


@pytest.mark.parametrize("pairs", [random_pairs(1, 60, 0.02), [(k, k + 1) for k in range(25)], [(0, k) for k in range(1, 30)]])
def test_components(spark, pairs):
    nodes, edges = frames(spark, 60, pairs)
    got = {r["node_id"]: r["component"] for r in graph.connected_components(nodes, edges).collect()}
    assert got == union_find(60, pairs)


def test_jaccard_counts_every_triangle_once(spark):
    pairs = random_pairs(2, 30, 0.25) + [(0, k) for k in range(20, 30)]
    nodes, edges = frames(spark, 30, pairs)
    near = {k: set() for k in range(30)}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    got = {(r["i"], r["j"]): r["jaccard"] for r in graph.with_jaccard(edges).collect()}
    assert set(got) == {(a, b) for a, b in pairs}
    for (a, b), value in got.items():
        assert value == pytest.approx(len(near[a] & near[b]) / len(near[a] | near[b]))


def test_wedges_travel_as_lists(spark):
    pairs = random_pairs(4, 40, 0.3) + [(50, k) for k in range(40)]
    nodes, edges = frames(spark, 51, pairs)
    every = {(r["i"], r["j"]): r["jaccard"] for r in graph.with_jaccard(edges).collect()}
    got = {(r["i"], r["j"]): r["jaccard"] for r in graph.jaccard_edges(edges, 0.1).collect()}
    assert got == {k: v for k, v in every.items() if v >= 0.1} and 0 < len(got) < len(every)
    plan = graph.common_neighbours(edges)._jdf.queryExecution().executedPlan().toString()
    assert "array_intersect" in plan and "LeftSemi" not in plan


@pytest.mark.parametrize(
    "labels, expected",
    [
        ([9, 9, 9, 4, 4, -1, 7, 7, 7, 7, 2], [2, 2, 2, 3, 3, -1, 1, 1, 1, 1, 4]),
        ([8, 8, 3, 3, -1, 5, 5], [1, 1, 2, 2, -1, 3, 3]),
    ],
)
def test_cluster_numbers(spark, labels, expected):
    members = spark.createDataFrame(list(enumerate(labels)), "node_id BIGINT, label BIGINT")
    got = {r["node_id"]: r["cluster"] for r in graph.numbered_clusters(members).collect()}
    assert [got[k] for k in range(len(labels))] == expected


def dense_mcl(n, pairs, scores, inflation):
    m = np.eye(n)
    for (a, b), s in zip(pairs, scores):
        m[a, b] = m[b, a] = s
    m = m / m.sum(0)
    for _ in range(100):
        before = m
        m = (m @ m) ** inflation
        m = m / m.sum(0)
        m = np.where((m >= 0.001) | (m == m.max(0)), m, 0)
        if np.allclose(m, before):
            break
    return {frozenset(np.flatnonzero(m[k] > 0).tolist()) for k in range(n) if m[k, k] > 0}


def test_markov_clusters(spark):
    pairs = [(a, b) for group in ((0, 5), (5, 9), (9, 12)) for a, b in itertools.combinations(range(*group), 2)] + [(4, 5), (8, 9)]
    scores = [1.0] * (len(pairs) - 2) + [0.3, 0.2]
    nodes, edges = frames(spark, 13, pairs, scores)
    labels = graph.mcl_labels(nodes, edges, 2.0).collect()
    groups = {}
    for row in labels:
        groups.setdefault(row["label"], set()).add(row["node_id"])
    assert {frozenset(g) for g in groups.values()} == dense_mcl(13, pairs, scores, 2.0)


def test_markov_products_are_dealt_once(spark, monkeypatch):
    plans = []

    def kept(df, written=graph.materialized):
        plans.append(df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0])
        return written(df)

    monkeypatch.setattr(graph, "materialized", kept)
    nodes, edges = frames(spark, 12, random_pairs(5, 12, 0.4))
    graph.mcl_labels(nodes, edges, 2.0)
    squares = [p for p in plans if "Window" in p]
    assert squares and all(p.count("Exchange hashpartitioning(j") == 1 and "hashpartitioning(i" not in p for p in squares)


def test_markov_columns_in_parts_give_the_same_clusters(spark, monkeypatch):
    nodes, edges = frames(spark, 14, random_pairs(5, 12, 0.4), [1.0 + k % 4 for k in range(66)])
    whole = sorted(map(tuple, graph.mcl_labels(nodes, edges, 2.0).collect()))
    parts = []

    def counted(matrix, found=graph._column_parts):
        parts.append(found(matrix))
        return parts[-1]

    monkeypatch.setattr(graph, "PRODUCTS", 250)
    monkeypatch.setattr(graph, "_column_parts", counted)
    assert sorted(map(tuple, graph.mcl_labels(nodes, edges, 2.0).collect())) == whole
    assert parts[0] > 1


def test_leiden_invariants(spark):
    cliques = [range(0, 6), range(6, 12), range(12, 17)]
    pairs = [p for c in cliques for p in itertools.combinations(c, 2)] + [(5, 6), (11, 12)]
    nodes, edges = frames(spark, 19, pairs)
    labels = graph.leiden_labels(nodes, edges)
    got = {r["node_id"]: r["label"] for r in labels.collect()}
    assert got[17] == got[18] == -1  # no edges, always noise
    assert len({got[k] for k in range(17)}) == 3
    assert all(len({got[k] for k in c}) == 1 for c in cliques)
    found = graph.modularity(edges, labels).first()[0]
    plain = graph.modularity(edges, nodes.select("node_id", F.lit(0).alias("label"))).first()[0]
    assert found > plain + 0.5
    assert {r["cluster"] for r in graph.numbered_clusters(labels, 6).collect()} == {1, 2, -1}


def test_leiden_level_ends_when_no_node_gains(spark):
    pairs = random_pairs(8, 40, 0.2)
    level = spark.createDataFrame([(i, j, 1.0) for i, j in pairs], "i BIGINT, j BIGINT, w DOUBLE")
    label = {r.node_id: r.label for r in graph._local_moves(level, 1.0, 42, 2).collect()}
    near = {v: [b if a == v else a for a, b in pairs if v in (a, b)] for v in label}
    total = 2 * len(pairs)
    for v, others in near.items():
        mass = lambda c: sum(len(near[u]) for u in label if u != v and label[u] == c)  # noqa: E731, B023
        gain = {c: sum(label[u] == c for u in others) - len(others) * mass(c) / total for c in {label[v], *(label[u] for u in others)}}
        assert max(gain.values()) <= gain[label[v]] + 1e-6
    assert len(set(label.values())) < len(label)


def test_leiden_communities_are_connected_and_stable(spark):
    """On a random network with weights: no community falls apart, no node gains by a move, and refined parts are connected."""
    pairs = random_pairs(12, 50, 0.15)
    scores = [1.0 + (a * 7 + b * 3) % 5 for a, b in pairs]
    nodes, edges = frames(spark, 52, pairs, scores)
    labels = graph.leiden_labels(nodes, edges)
    assert graph.split_communities(edges, labels).isEmpty()
    assert graph.move_gains(edges, labels).where("gain > 1e-6").isEmpty()
    level = edges.select("i", "j", F.col("score").cast("double").alias("w"))
    one = nodes.select("node_id", F.lit(0).cast("long").alias("label"))
    parts = graph._refined(level, one, 1.0, 3)
    assert graph.split_communities(edges, parts.select("node_id", F.col("part").alias("label"))).isEmpty()
    assert 1 < parts.select("part").distinct().count() < 50


def test_hashes_are_those_of_spark(spark):
    ids = [0, 1, -5, 7, 1 << 40, -(1 << 62)]
    df = spark.createDataFrame([(x,) for x in ids], "id BIGINT").withColumn("one", F.xxhash64("id", F.lit(42)))
    want = [tuple(r)[1:] for r in df.withColumn("two", F.xxhash64("id", "one")).collect()]
    first = communities.hashed_int(42, communities.hashed(np.array(ids)))
    second = communities.hashed(first.view(np.int64), communities.hashed(np.array(ids)))
    assert list(zip(first.view(np.int64).tolist(), second.view(np.int64).tolist())) == want


def test_leiden_in_one_task_is_that_of_the_joins(spark, monkeypatch):
    pairs = random_pairs(21, 36, 0.12)
    nodes, edges = frames(spark, 38, pairs, [1.0 + (a * 5 + b) % 4 for a, b in pairs])
    jobs, found = [], []
    moves = graph._local_moves
    monkeypatch.setattr(graph, "_local_moves", lambda *given: jobs.append(1) or moves(*given))
    for most in (graph.IN_ONE_TASK, len(pairs) - 1, 0):
        monkeypatch.setattr(graph, "IN_ONE_TASK", most)
        found.append((sorted(map(tuple, graph.leiden_labels(nodes, edges).collect())), len(jobs)))
    assert found[0][0] == found[1][0] == found[2][0]
    assert 0 == found[0][1] < found[1][1]


def test_subclusters_replace_older_groups(spark):
    pairs = list(itertools.combinations(range(4), 2)) + list(itertools.combinations(range(4, 9), 2)) + [(3, 4)]
    nodes, edges = frames(spark, 10, pairs)
    nodes = nodes.select("node_id", F.lit(1).alias("cluster"), F.array(F.lit("kept"), F.lit("subcluster_1_9")).alias("groups"))
    got = {r["node_id"]: set(r["groups"]) for r in graph.subclusters(nodes, edges, 1, "jaccard", 0.4, 2).collect()}
    assert got[0] == {"kept", "subcluster_1_1"} and got[8] == {"kept", "subcluster_1_2"} and got[9] == {"kept"}


def test_extraction_keeps_order_and_columns(spark):
    nodes = spark.createDataFrame([(0, "A"), (1, "B"), (2, "C")], "node_id BIGINT, header STRING")
    edges = spark.createDataFrame(
        [(0, 1, 1.0, 31), (0, 2, 2.0, 32), (1, 2, 3.0, 33), (2, 0, 4.0, 34)], "i BIGINT, j BIGINT, l_score DOUBLE, g_len INT"
    )
    kept = network.reindexed(nodes.where("header IN ('A', 'C')").select("node_id"))
    got = sorted(tuple(r) for r in network.induced_edges(edges, kept).collect())
    assert got == [(0, 1, 2.0, 32), (1, 0, 4.0, 34)]


def test_top_percent_keeps_ties(spark):
    scores = [5, 4, 4, 4, 3, 2, 1]
    nodes, edges = frames(spark, 10, random_pairs(3, 10, 1.0)[:7], scores)
    assert network.top_percent(edges, 10, 100 * 2 / 45).count() == 4
    assert network.top_percent(edges, 10, 0.0).count() == 1
    assert network.top_percent(edges, 10, 100.0).count() == 7


def test_sweep_thresholds():
    assert network.sweep_thresholds(98.2, 112.5, evalue=True) == [98.0, 99.0, 100.0, 105.0, 110.0, 115.0]
    assert network.sweep_thresholds(2.5, 4.0, evalue=True) == [2.0, 3.0, 4.0]
    assert len(network.sweep_thresholds(0.05, 0.3, evalue=False)) == 4


def test_group_names():
    assert metadata.checked_group_name(" Hot_Set ") == "hot_set"
    for bad in ("noise", "cluster_3", "subcluster_1_2", "a b", ""):
        with pytest.raises(ValueError):
            metadata.checked_group_name(bad)


def test_spectral_start_matches_dense_eigenvectors(spark):
    pairs = [(a, b) for a, b in itertools.combinations(range(12), 2) if b - a in (1, 5)]
    nodes, edges = frames(spark, 15, pairs, [1.0 + (k % 3) for k in range(len(pairs))])
    components = graph.connected_components(nodes, edges)
    got = {r["node_id"]: r for r in layout.spectral_positions(edges, components, tolerance=1e-5).collect()}
    w = np.zeros((12, 12))
    for k, (a, b) in enumerate(pairs):
        w[a, b] = w[b, a] = 1.0 + (k % 3)
    d = w.sum(0)
    _, vectors = np.linalg.eigh(np.eye(12) - w / np.sqrt(np.outer(d, d)))
    span = vectors[:, 1:3]
    for axis in "xy":
        v = np.array([got[k][axis] for k in range(12)])
        v = v - v.mean()
        basis = np.column_stack([span, np.ones(12)])
        fitted = basis @ np.linalg.lstsq(basis, v, rcond=None)[0]
        assert np.linalg.norm(v - fitted) < 0.05 * np.linalg.norm(v)
    box = np.sqrt(12) * 2.5 + 5
    assert max(abs(got[k]["x"]) for k in range(12)) <= 0.4 * box + 1e-6
