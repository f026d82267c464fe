import itertools

import pytest
from pyspark.sql import functions as F

from simloom.operators.selection import (
    SelectionContext,
    SelectionContextError,
    SelectionExpressionError,
    boolean_column,
    select_nodes,
)


@pytest.fixture(scope="module")
def context(spark):
    nodes = spark.createDataFrame(
        [
            (0, "Alpha|1ABC_A WP_000001.1", 1, ["alpha"], 100.0, "E. coli"),
            (1, "beta AAA12345.1", 2, [], None, ""),
            (2, "gamma [x]", -1, ["omega"], 300.0, None),
        ],
        "node_id BIGINT, header STRING, cluster INT, groups ARRAY<STRING>, Length DOUBLE, Organism STRING",
    )
    rows = spark.createDataFrame([(0, 10), (2, 12)], "node_id BIGINT, row_id BIGINT")
    cells = spark.createDataFrame([(10, 0, "K"), (12, 0, "R"), (10, 1, "A")], "row_id BIGINT, col INT, aa STRING")
    labels = spark.createDataFrame([(0, "10.1"), (1, "-1")], "col INT, label STRING")
    files = {
        "exact.txt": spark.createDataFrame([("BETA AAA12345.1",)], "header STRING"),
        "acc.txt": spark.createDataFrame([("found wp_000001.1 here",), ("none",)], "header STRING"),
        "pdb.txt": spark.createDataFrame([("1abc_B",)], "header STRING"),
    }
    return SelectionContext(nodes, ["Length", "Organism"], rows, cells, labels, files)


CASES = {
    '"ALPHA"': {0}, '"[bg]*a* *"': {1, 2}, '"gamma [[]x]"': {2},
    "@exact.txt@": {1}, "@[NCBI]acc.txt@": {0}, "@[PDB]pdb.txt@": {0},
    "#cluster_1#": {0}, "#noise#": {2}, "#ALPHA#": {0},
    "K10.1": {0}, "!K10.1": {2}, "_(-1)": {2}, "A(-1)": {0}, "K10.1 | !K10.1": {0, 2},
    "K10.1 | #cluster_2#": {0, 1}, "K10.1 ^ #cluster_2#": {0},
    "{Length>150}": {2}, "!{Length>150}": {0, 1}, "{Length!=100}": {1, 2}, "{length=50-150}": {0},
    "{Length=1--5}": set(), "{organism=COLI}": {0}, "{Organism!=coli}": {1, 2}, "{Organism=e*}": {0},
    "#cluster_1# | #cluster_2# ^ #cluster_2#": {0},
    '!("alpha" | #noise#)': {1},
}


@pytest.mark.parametrize("text", CASES)
def test_expressions(context, text):
    assert {r["node_id"] for r in select_nodes(context, text).collect()} == CASES[text]


@pytest.mark.parametrize(
    "text, error",
    [
        ("", SelectionExpressionError), ("#cluster_1# &", SelectionExpressionError), ("K-1", SelectionExpressionError),
        ("(#cluster_1#", SelectionExpressionError), ("__import__('os')", SelectionExpressionError),
        ("#cluster_9#", SelectionContextError), ("#nobody#", SelectionContextError), ("K99", SelectionContextError),
        ("{Weight>3}", SelectionContextError), ("@nofile@", SelectionContextError),
        ("{Length>abc}", SelectionExpressionError), ("{Organism>3}", SelectionExpressionError),
        ("{Length>}", SelectionExpressionError), ("{.x=1}", SelectionExpressionError),
    ],
)
def test_errors(context, text, error):
    with pytest.raises(error):
        select_nodes(context, text).collect()


def test_suggestions_are_bounded(spark):
    nodes = spark.range(30).select(F.col("id").alias("node_id"), F.lit("h").alias("header"), F.col("id").cast("int").alias("cluster"))
    with pytest.raises(SelectionContextError) as caught:
        select_nodes(SelectionContext(nodes), "#cluster_99#")
    assert str(caught.value).count("cluster_") == 11


def test_three_valued_tables(spark):
    values = [True, False, None]
    rows = list(itertools.product(values, values))
    df = spark.createDataFrame(rows, "a BOOLEAN, b BOOLEAN")
    atoms = {"x_": F.col("a"), "y_": F.col("b")}
    got = df.select("a", "b", *[boolean_column(t, atoms).alias(n) for n, t in (("and", "x_ & y_"), ("or", "x_ | y_"), ("xor", "x_ ^ y_"), ("not", "!x_"))])
    for row in got.collect():
        a, b = row["a"], row["b"]
        known = [v for v in (a, b) if v is not None]
        assert row["and"] == (False if False in known else (True if len(known) == 2 else None))
        assert row["or"] == (True if True in known else (False if len(known) == 2 else None))
        assert row["xor"] == (a != b if len(known) == 2 else None)
        assert row["not"] == (None if a is None else not a)


def test_spaces_in_values_are_optional(context):
    assert select_nodes(context, "{Organism=E. coli}").count() == 0
    from dataclasses import replace

    assert select_nodes(replace(context, strip_spaces=False), "{Organism=E. coli}").count() == 1
