"""Start positions ``(node_id, x, y)`` of a network: a grid, or eigenvectors of its Laplacian."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simloom.functions.noise import hashed_normal
from simloom.plans.numbering import dense_index, dense_index_by_id, id_bucket
from simloom.plans.runtime import materialized, materialized_with


def box_limit(n_nodes: Column | int, scale: float = 1.0) -> Column:
    n = F.lit(n_nodes) if isinstance(n_nodes, int) else n_nodes
    return (F.sqrt(n) * 2.5 + 5.0) * scale


def grid_positions(nodes: DataFrame, scale: float = 1.0) -> DataFrame:
    """Nodes on a square grid over half the layout box, row by row in node order."""
    total = nodes.agg(F.count(F.lit(1))).scalar()
    placed = dense_index_by_id(nodes, "__place", "node_id").withColumns(
        {"__side": F.ceil(F.sqrt(total)).cast("long"), "__box": box_limit(total, scale)}
    )
    step = F.when(F.col("__side") > 1, F.col("__box") / F.nullif(F.col("__side") - 1, F.lit(0))).otherwise(0.0)
    return placed.withColumns(
        {
            "x": -F.col("__box") * 0.5 + (F.col("__place") % F.col("__side")) * step,
            "y": -F.col("__box") * 0.5 + F.floor(F.col("__place") / F.col("__side")) * step,
        }
    ).drop("__place", "__side", "__box")


def with_places(state: DataFrame) -> DataFrame:
    """Add the place of every node within its component and the component size."""
    sizes = state.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    placed = dense_index(state, "place", [id_bucket("node_id")], [F.col("node_id")], within=["component"])
    return placed.join(sizes, "component")


def spectral_positions(edges: DataFrame, components: DataFrame, tolerance: float = 1e-3, seed: int = 42) -> DataFrame:
    """Start positions ``(node_id, component, x, y)`` from eigenvectors of the network.

    The second and third eigenvector of the normalised Laplacian of every component come from
    subspace iteration on half of ``I + D^-1/2 W D^-1/2``: one edge join per round, with sums per
    component, until no coordinate moves by more than ``tolerance`` in a round. They are scaled to 80% of half the
    box; components below four nodes get a grid.
    """
    weight = F.col("score").cast("double")
    both = materialized(
        edges.select(
            F.inline(
                F.array(
                    F.struct(F.col("i").alias("node_id"), F.col("j").alias("other"), weight.alias("w")),
                    F.struct(F.col("j").alias("node_id"), F.col("i").alias("other"), weight.alias("w")),
                )
            )
        )
    )
    degree = both.groupBy("node_id").agg(F.sum("w").alias("d"))
    scaled = with_places(components).join(degree, "node_id", "left").withColumn("root", F.sqrt(F.coalesce("d", F.lit(0.0))))
    state = scaled.select(
        "node_id", "component", "place", "size", "root",
        hashed_normal(seed, F.lit("u"), "node_id").alias("u"), hashed_normal(seed, F.lit("v"), "node_id").alias("v"),
    )
    state = materialized(_orthogonal(state))
    residual = float("inf")
    while residual > tolerance:
        spread_out = both.join(
            state.select(F.col("node_id").alias("other"), *[(F.col(c) / F.nullif("root", F.lit(0.0))).alias(c) for c in "uv"]),
            "other",
        )
        sums = spread_out.groupBy("node_id").agg(*[F.sum(F.col("w") * F.col(c)).alias(f"s{c}") for c in "uv"])
        before = [F.col(c).alias(f"old_{c}") for c in "uv"]
        stepped = state.select("*", *before).join(sums, "node_id", "left").withColumns(
            {
                c: 0.5 * (F.col(c) + F.coalesce(F.col(f"s{c}") / F.nullif("root", F.lit(0.0)), F.lit(0.0)))
                for c in "uv"
            }
        )
        moved = F.greatest(*[F.abs(F.col(c) - F.col(f"old_{c}")) for c in "uv"])
        state, seen = materialized_with(_orthogonal(stepped.drop("su", "sv")), residual=F.max(moved))
        residual, state = seen["residual"] or 0.0, state.drop("old_u", "old_v")
    box = box_limit(F.col("size"))
    ranges = state.groupBy("component").agg(*[f(c).alias(f"{n}{c}") for c in "uv" for n, f in (("lo", F.min), ("hi", F.max))])
    side = F.ceil(F.sqrt("size"))
    step = box / F.nullif(side - 1, F.lit(0))

    def scale(c: str, grid: Column) -> Column:
        share = (F.col(c) - F.col(f"lo{c}")) / (F.col(f"hi{c}") - F.col(f"lo{c}") + 1e-9)
        return F.when(F.col("size") < 4, -box * 0.5 + F.coalesce(grid * step, F.lit(0.0))).otherwise((share - 0.5) * box * 0.8)

    return state.join(ranges, "component").select(
        "node_id", "component",
        scale("u", F.col("place") % side).alias("x"),
        scale("v", F.floor(F.col("place") / side)).alias("y"),
    )


def _orthogonal(state: DataFrame) -> DataFrame:
    """Per component: remove the trivial direction from u and v, u from v, and normalise both."""

    def without(df: DataFrame, target: str, base: str) -> DataFrame:
        shares = df.groupBy("component").agg(
            (F.sum(F.col(target) * F.col(base)) / F.nullif(F.sum(F.col(base) * F.col(base)), F.lit(0.0))).alias("share")
        )
        return df.join(shares, "component").withColumn(
            target, F.col(target) - F.coalesce("share", F.lit(0.0)) * F.col(base)
        ).drop("share")

    for target, base in (("u", "root"), ("v", "root"), ("v", "u")):
        state = without(state, target, base)
    norms = state.groupBy("component").agg(*[F.sqrt(F.sum(F.col(c) ** 2)).alias(f"n{c}") for c in "uv"])
    return state.join(norms, "component").withColumns(
        {c: F.coalesce(F.col(c) / F.nullif(f"n{c}", F.lit(0.0)), F.lit(0.0)) for c in "uv"}
    ).drop("nu", "nv")
