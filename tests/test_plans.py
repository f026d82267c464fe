import numpy as np
import pytest
from pyspark.sql import functions as F

from simloom.operators import network
from simloom.plans import pairs
from simloom.plans.numbering import dense_index, id_bucket, running_total
from simloom.plans.ranking import kth_largest, linear_percentile


def test_dense_index_over_many_buckets(spark):
    ids = np.random.default_rng(3).choice(5000, 900, replace=False).tolist()
    df = spark.createDataFrame([(int(i),) for i in ids], "id BIGINT")
    got = dense_index(df, "place", [id_bucket("id", 4)], [F.col("id")]).collect()
    assert {r["id"]: r["place"] for r in got} == {v: k for k, v in enumerate(sorted(ids))}


def test_running_total_within_one_hot_group(spark):
    rows = [("hot", i, i % 5) for i in range(400)] + [("cold", i, 1) for i in range(7)]
    df = spark.createDataFrame(rows, "g STRING, id BIGINT, w BIGINT")
    got = running_total(df, "t", F.col("w"), [id_bucket("id", 3)], [F.col("id")], within=["g"], inclusive=False)
    expected, total = {}, {"hot": 0, "cold": 0}
    for g, i, w in rows:
        expected[g, i] = total[g]
        total[g] += w
    assert {(r["g"], r["id"]): r["t"] for r in got.collect()} == expected


@pytest.mark.parametrize("seed", [0, 1])
def test_order_statistics(spark, monkeypatch, seed):
    from simloom.plans import ranking

    monkeypatch.setattr(ranking, "FINISH_ROWS", 20)
    monkeypatch.setattr(ranking, "BUCKETS", 8)
    rng = np.random.default_rng(seed)
    values = np.concatenate([rng.normal(size=300), np.full(150, 0.25), rng.normal(size=50) * 1e6])
    df = spark.createDataFrame([(float(v),) for v in values], "v DOUBLE")
    ordered = np.sort(values)[::-1]
    for k in (1, 40, 137, 299, 500):
        assert kth_largest(df, "v", k) == ordered[k - 1]
    assert linear_percentile(df, "v", 33.3) == pytest.approx(np.percentile(values, 33.3), rel=1e-12)
    with pytest.raises(ValueError):
        kth_largest(df, "v", 501)


def test_hub_is_limited_before_the_shuffle(spark):
    edges = spark.range(100).select(F.lit(0).alias("i"), (F.col("id") + 1).alias("j"), F.rand(1).alias("score"))
    plan = network.nearest_edges(edges, 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    from simloom.sources import store

    nodes = spark.range(10).select(F.col("id").alias("node_id"), F.lit("h").alias("header"), F.lit(5).alias("seq_len"))
    edges = spark.range(9).select(
        F.col("id").alias("i"), (F.col("id") + 1).alias("j"),
        *[F.lit(1).cast("float").alias(c) for c in ("l_score", "g_score")],
        *[F.lit(3).alias(c) for c in ("l_len", "g_len")],
    )
    store.write_network(str(tmp_path / "net"), nodes, edges, "model")
    scores = store.network_scores(store.read_network(spark, str(tmp_path / "net")), "local")
    plan = network.at_least(scores, 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "g_score" not in plan.split("ReadSchema")[1]
    assert "GreaterThanOrEqual(l_score" in plan


def test_intermediate_tables_go_to_the_named_folder(spark):
    import os

    from simloom.plans.runtime import materialized, scratch_folder

    folder = spark.conf.get("spark.checkpoint.dir")
    assert scratch_folder(spark) == folder
    before = len(os.listdir(folder))
    assert materialized(spark.range(5)).count() == 5
    assert len(os.listdir(folder)) == before + 1


@pytest.mark.parametrize("tasks", [1, 3, 10, 200])
def test_tiles_hold_every_pair_of_blocks_once(spark, tasks):
    rows = spark.range(43).select(F.col("id").alias("node_id")).withColumn("place", F.col("node_id"))
    found = pairs.block_pairs(rows, "place", ["node_id"], 4)
    tiled, count = found.tiled(tasks)
    p = found.grid(tasks)[0]
    assert count == p * (p + 1) // 2 and tiled.count() == 11 * p  # a block travels to p tiles

    def every(tile):
        for given in tile:
            a, b = pairs.upper_triangle(given["bi"], given["bj"], len(given["a_node_id"]), len(given["b_node_id"]))
            yield {"i": given["a_node_id"][a], "j": given["b_node_id"][b]}

    got = [tuple(r) for r in pairs.map_tiles(found, every, "i BIGINT, j BIGINT", tasks).collect()]
    assert sorted(got) == [(i, j) for i in range(43) for j in range(i + 1, 43)]


@pytest.mark.parametrize("tasks", [1, 5, 64])
def test_tiles_of_two_tables(spark, tasks):
    def numbered(low, high):
        return spark.range(low, high).select(F.col("id").alias("node_id"), (F.col("id") - low).alias("place"))

    found = pairs.bipartite_pairs(numbered(0, 9), numbered(100, 131), "place", ["node_id"], 4)
    p, q = found.grid(tasks)
    tiled, count = found.tiled(tasks)
    assert count == p * q and tiled.count() == 3 * q + 8 * p
    both = lambda given: {"i": given["a_node_id"].repeat(len(given["b_node_id"])), "j": np.tile(given["b_node_id"], len(given["a_node_id"]))}
    got = [tuple(r) for r in pairs.map_block_pairs(found, both, "i BIGINT, j BIGINT").collect()]
    assert sorted(got) == [(i, j) for i in range(9) for j in range(100, 131)]
    nothing = pairs.bipartite_pairs(numbered(0, 0), numbered(5, 8), "place", ["node_id"], 4)
    assert pairs.map_block_pairs(nothing, both, "i BIGINT, j BIGINT").collect() == []
