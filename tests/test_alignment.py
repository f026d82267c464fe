
import numpy as np
import pytest
from pyspark.sql import functions as F

from simloom.operators import alignment, identity
from simloom.operators.selection import SelectionExpressionError

LETTERS = "ACDEFGHIKLMNPQRSTVWY"


def aligned_frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "row_id BIGINT, sequence STRING")


def brute_weights(texts, threshold):
    weights = []
    for a in texts:
        n = 0
        for b in texts:
            either = sum(x in LETTERS or y in LETTERS for x, y in zip(a, b))
            same = sum(x == y and x in LETTERS for x, y in zip(a, b))
            n += either > 0 and same >= threshold * either - 1e-12
        weights.append(1.0 / max(1, n))
    return weights


@pytest.mark.parametrize("rows", [5, 512])
@pytest.mark.parametrize("threshold, seed", [(0.9, 0), (0.6, 1), (0.35, 2), (1.0, 3)])
def test_identity_weights(spark, monkeypatch, threshold, seed, rows):
    monkeypatch.setattr(identity, "BLOCK_ROWS", rows)
    rng = np.random.default_rng(seed)
    base = rng.choice(list("ACD-X"), (6, 15))
    texts = []
    for k in range(60):
        row = base[k % 6].copy()
        hit = rng.random(15) < 0.15
        row[hit] = rng.choice(list("ACDE-"), hit.sum())
        texts.append("".join(row))
    texts += [texts[0]] * 4 + ["-" * 15, "X" * 15]
    got = {r["row_id"]: r["weight"] for r in identity.identity_weights(aligned_frame(spark, texts), threshold).collect()}
    assert [got[k] for k in range(len(texts))] == pytest.approx(brute_weights(texts, threshold))


def brute_specific(texts, members, low, high, weights):
    total = sum(weights)
    found = {}
    subsets = sorted({s for groups in members for s in groups})
    for col in range(len(texts[0])):
        for aa in sorted({t[col] for t in texts} - {"-"}):
            qualified = {}
            for subset in subsets:
                rows = [k for k, g in enumerate(members) if subset in g]
                share = sum(weights[k] for k in rows if texts[k][col] == aa) / sum(weights[k] for k in rows)
                if share >= low:
                    qualified[subset] = share
            union = {k for k, g in enumerate(members) if set(g) & set(qualified)}
            outside = [k for k in range(len(texts)) if k not in union]
            if not qualified or sum(weights[k] for k in outside) <= 1e-12:
                continue
            rate = sum(weights[k] for k in outside if texts[k][col] == aa) / (total - sum(weights[k] for k in union))
            if rate < high:
                found.update({(col, aa, s): (f, rate) for s, f in qualified.items()})
    return found


@pytest.mark.parametrize("weighted", [False, True])
def test_subset_specific_residues(spark, weighted):
    rng = np.random.default_rng(11)
    texts = ["".join(rng.choice(list("AAAK-"), 6)) for _ in range(40)]
    members = [[s for s in "xyz" if rng.random() < 0.3] for _ in texts]
    weights = rng.uniform(0.2, 1.0, len(texts)).tolist() if weighted else [1.0] * len(texts)
    frame = aligned_frame(spark, texts)
    groups = spark.createDataFrame([(k, s) for k, g in enumerate(members) for s in g], "row_id BIGINT, subset STRING")
    weight_frame = spark.createDataFrame(list(enumerate(weights)), "row_id BIGINT, weight DOUBLE") if weighted else None
    got = alignment.subset_specific_residues(
        alignment.alignment_cells(frame), frame.select("row_id"), groups, 0.5, 0.6, weight_frame
    )
    expected = brute_specific(texts, members, 0.5, 0.6, weights)
    result = {(r["col"], r["aa"], r["subset"]): (r["frequency"], r["outside_frequency"]) for r in got.collect()}
    assert set(result) == set(expected) and expected
    for key, value in expected.items():
        assert result[key] == pytest.approx(value)


def test_no_outside_rows_means_no_specific_residue(spark):
    frame = aligned_frame(spark, ["AK", "AK"])
    groups = spark.createDataFrame([(0, "all"), (1, "all")], "row_id BIGINT, subset STRING")
    found = alignment.subset_specific_residues(alignment.alignment_cells(frame), frame.select("row_id"), groups)
    assert found.count() == 0


def test_reference_labels_and_offset(spark):
    frame = aligned_frame(spark, ["--A-CD--", "AAAAAAAA"])
    cells = alignment.alignment_cells(frame)
    reference = spark.createDataFrame([(0,)], "row_id BIGINT")
    labels = alignment.reference_labels(cells, reference, 8)
    got = [r["label"] for r in labels.orderBy("col").collect()]
    assert got == ["0.1", "0.2", "1", "1.1", "2", "3", "3.1", "3.2"]
    columns = spark.createDataFrame([(0,), (2,), (4,)], "col INT")
    shifted = alignment.reference_labels(cells, reference, 8, columns, offset=-3).orderBy("col")
    assert [r["label"] for r in shifted.collect()] == ["-3.1", "-2", "-1"]


def test_consensus_ties_and_empty_columns(spark):
    frame = aligned_frame(spark, ["K-", "R-", "R-", "K-"])
    counts = alignment.residue_counts(alignment.alignment_cells(frame))
    columns = spark.createDataFrame([(0,), (1,)], "col INT")
    got = {r["col"]: tuple(r)[1:] for r in alignment.consensus(counts, F.lit(4), columns).collect()}
    assert got == {0: ("K", 0.5, 1.0), 1: ("-", 0.0, 0.0)}


def test_frequency_logic(spark):
    frame = aligned_frame(spark, ["KA-", "KC-", "R--", "RAG"])
    counts = alignment.residue_counts(alignment.alignment_cells(frame))
    labels = spark.createDataFrame([(0, "1"), (1, "2"), (2, "3"), (3, "4")], "col INT, label STRING")

    def found(logic):
        return {r["label"] for r in alignment.frequency_search(counts, F.lit(4), labels, logic).collect()}

    assert found("[K>=50%]") == {"1"}
    assert found("[gap>0.7]") == {"3", "4"}
    assert found("[(GAP>70) & !(G>0)]") == {"4"}
    assert found("[(A>=50%) ^ (K>=0.5)]") == {"1", "2"}
    for bad in ("[K>10% & R>5%]", "[(K>10%) &]", "[]"):
        with pytest.raises(SelectionExpressionError):
            found(bad)


def test_logo_heights(spark):
    texts = ["AK", "AR", "A-", "CX"]
    frame = aligned_frame(spark, texts)
    cells = alignment.alignment_cells(frame)
    got = {(r["col"], r["aa"]): r["height"] for r in alignment.logo_matrix(cells, frame.select("row_id")).collect()}
    correction = 19 / (2 * np.log(2) * 4)
    information = max(0.0, np.log2(20) - (-(0.75 * np.log2(0.75) + 0.25 * np.log2(0.25)) + correction))
    assert got[0, "A"] == pytest.approx(0.75 * information)
    assert got[1, "K"] == pytest.approx(0.5 * max(0.0, np.log2(20) - (1 + correction)) * 0.5)
    assert (1, "X") not in got


def test_last_node_of_a_shared_row_wins(spark):
    nodes = spark.createDataFrame(
        [(0, 1, ["a"]), (1, 2, ["b"]), (2, -1, [])], "node_id BIGINT, cluster INT, groups ARRAY<STRING>"
    )
    rows = spark.createDataFrame([(0, 5), (1, 5), (2, 6)], "node_id BIGINT, row_id BIGINT")
    assert [tuple(r) for r in alignment.cluster_memberships(nodes, rows).collect()] == [(5, "cluster_2")]
    assert [tuple(r) for r in alignment.group_memberships(nodes, rows).collect()] == [(5, "b")]


def test_text_round_trip(spark):
    texts = ["A-C", "---", "KKK"]
    frame = aligned_frame(spark, texts)
    back = alignment.aligned_text(frame.select("row_id"), alignment.alignment_cells(frame), 3)
    assert {r["row_id"]: r["sequence"] for r in back.collect()} == dict(enumerate(texts))


