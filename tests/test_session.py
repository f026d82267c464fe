import pytest
from pyspark.sql import functions as F

from simloom.operators import alignment, metadata
from simloom.operators.selection import SelectionExpressionError
from simloom.session import HISTORY, Session
from simloom.sources import sheets, store


@pytest.fixture()
def session(spark):
    nodes = spark.createDataFrame(
        [(k, f"n{k} {'ring' if k % 2 else 'rod'}", float(k * 10)) for k in range(6)], "node_id BIGINT, header STRING, Length DOUBLE"
    )
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 2.0), (3, 4, 3.0)], "i BIGINT, j BIGINT, score DOUBLE")
    texts = ["AKR", "AK-", "A-R", "CKR"]
    rows = spark.createDataFrame([(k, f"n{k} {'ring' if k % 2 else 'rod'}") for k in range(4)], "row_id BIGINT, header STRING")
    cells = alignment.alignment_cells(spark.createDataFrame(list(enumerate(texts)), "row_id BIGINT, sequence STRING"))
    return Session(nodes, edges, ["Length"], rows, cells, 3)


def ids(df):
    return {r["node_id"] for r in df.collect()}


def test_selecting_hiding_and_history(session):
    assert ids(session.select('"ring"')) == {1, 3, 5}
    assert ids(session.select("{Length>=30}", "filter")) == {3, 5}
    assert ids(session.select("$sele$ & {Length>40}", "subtract")) == {3}
    assert ids(session.invert()) == {0, 1, 2, 4, 5}
    session.hide("single")
    assert ids(session.nodes.where("visible")) == {0, 1, 2, 3, 4}
    assert 5 not in ids(session.selected)
    assert session.undo() and ids(session.nodes.where("visible")) == set(range(6))
    assert session.redo() and ids(session.nodes.where("visible")) == {0, 1, 2, 3, 4}
    assert not session.redo()
    for _ in range(HISTORY + 5):
        session.reset("order")
    assert len(session._past) == HISTORY


def test_failing_commands_change_nothing(session):
    before = session.nodes
    with pytest.raises(SelectionExpressionError):
        session.group(('"ring"', "good"), ("#missing#", "bad"))
    assert session.nodes is before


def test_groups_may_refer_to_earlier_pairs(session):
    session.group(('"ring"', "rings"), ("#rings# & {Length>20}", "long"))
    got = {r["name"]: r["nodes"] for r in metadata.group_counts(session.nodes).collect()}
    assert got == {"rings": 3, "long": 2}


def test_clusters_and_residues(session):
    sizes = {r["cluster"]: r["nodes"] for r in session.cluster("jaccard", 0.0, 2).collect()}
    assert sizes == {1: 3, 2: 2, -1: 1}
    report = {r["label"]: r["gap_percent"] for r in session.query("1-3").collect()}
    assert report == {"1": 0.0, "2": 25.0, "3": 25.0}
    subset = {r["label"]: r["gap_percent"] for r in session.query("2", '"rod"').collect()}
    assert subset == {"2": 50.0}
    assert [r["label"] for r in session.query("[C>20%]").collect()] == ["1"]
    session.set_reference("n2 rod")
    assert [r["label"] for r in session.labels.orderBy("col").collect()] == ["1", "1.1", "2"]
    session.set_offset(10)
    session.set_offset(5)
    assert [r["label"] for r in session.labels.orderBy("col").collect()] == ["6", "6.1", "7"]
    assert ids(session.select("_6.1")) == {2}
    assert session.logo('"rod"', identity=0.5).count() > 0
    assert session.label("clusters", 0.9, 0.5).count() >= 1


def test_scripts(session):
    done = session.run(["// comment", "", 'select "rod"', "hide free // trailing", "undo", "select invert"])
    assert done == 4 and ids(session.selected) == {1, 3, 5}
    with pytest.raises(ValueError):
        session.run(["launch rockets"])


def test_script_lines_with_quotes_and_lists(session, spark, tmp_path):
    (tmp_path / "mine.txt").write_text("n0 rod\nn1 ring\n")
    session.file_dir = str(tmp_path)
    assert session.run(['select "n0 rod"', 'select add "n1 ring" // and "more"']) == 2
    assert ids(session.selected) == {0, 1}
    session.run(['select "n0 rod" | "n1 ring"', "select filter $SELE$"])
    assert ids(session.selected) == {0, 1}
    session.run(["select @mine.txt@"])
    assert ids(session.selected) == {0, 1}
    session.run(['select "a // b"'])
    assert ids(session.selected) == set()
    session.run(['group "n0 rod" firsts'])
    assert session.nodes.where("array_contains(groups, 'firsts')").count() == 1


def test_metadata_commands(session, spark):
    sheet = spark.createDataFrame(
        [(0, "n0 rod", "5", "x"), (1, "n0 rod", "", "y"), (2, " n1 ring ", "bad", " "), (3, "nobody", "1", "z")],
        "ord BIGINT, header STRING, Length STRING, Note STRING",
    )
    report = session.upload(sheet, [("Length", "number"), ("Note", "text")]).first()
    assert tuple(report) == (2, 1)
    got = {r["node_id"]: (r["Length"], r["Note"]) for r in session.nodes.collect()}
    assert got[0] == (0.0, "y") and got[1] == (10.0, None)
    session.edit(1, "Length", "77")
    assert session.nodes.where("node_id = 1").first()["Length"] == 77.0
    with pytest.raises(ValueError):
        session.delete_properties("note", "ghost")
    session.delete_properties("NOTE")
    assert "Note" not in session.nodes.columns
    with pytest.raises(ValueError):
        session.delete_properties("all")


def test_sheet_files(session, spark, tmp_path):
    path = tmp_path / "sheet.csv"
    path.write_text(',Mass,Origin\n,num,words\nn0 rod,3.5,"a, b"\nn1 ring,,\n')
    sheet, columns = sheets.read_sheet(spark, str(path))
    assert columns == [("Mass", "number"), ("Origin", "text")]
    merged = metadata.merged_metadata(session.nodes, sheet, columns)
    assert merged.where("node_id = 0").first()["Origin"] == "a, b"
    out = str(tmp_path / "out")
    sheets.write_sheet(merged, ["Mass", "Origin"], out)
    again, columns = sheets.read_sheet(spark, out)
    assert columns == [("Mass", "number"), ("Origin", "text")] and again.count() == 1


def test_sheet_of_many_parts_comes_back_whole(session, spark, tmp_path):
    from pyspark.sql import functions as F

    rows = [(k, f"n{k}", float(k), f'line {k}\n"quoted", {k % 7}') for k in range(500)]
    nodes = spark.createDataFrame(rows, "node_id LONG, header STRING, Mass DOUBLE, Origin STRING").repartition(5)
    out = str(tmp_path / "many")
    sheets.write_sheet(nodes, ["Mass", "Origin"], out)
    again, columns = sheets.read_sheet(spark, out)
    assert columns == [("Mass", "number"), ("Origin", "text")]
    found = {r["header"]: (float(r["Mass"]), r["Origin"]) for r in again.collect()}
    assert found == {h: (m, o) for _, h, m, o in rows}
    assert again.select(F.count_distinct("ord")).first()[0] == 500
    spark.createDataFrame([("", "A"), ("", "text"), ("x", "1")], "a STRING, b STRING").repartition(3).write.csv(str(tmp_path / "loose"))
    with pytest.raises(ValueError):
        sheets.read_sheet(spark, str(tmp_path / "loose"))


def test_failed_rewrite_keeps_the_old_tables(session, spark, tmp_path):
    from pyspark.sql import functions as F

    folder = str(tmp_path / "net")
    edges = spark.createDataFrame([(0, 1, 5.0)], "i INT, j INT, score DOUBLE")
    nodes = session.nodes.select("node_id", "header")
    store.write_network(folder, nodes, edges, "blast")
    with pytest.raises(Exception, match="broken"):
        store.write_network(folder, nodes, edges.withColumn("score", F.expr("raise_error('broken')").cast("double")), "blast")
    assert store.read_network(spark, folder)["edges"].count() == 1
    store.write_network(folder, nodes, edges.unionByName(edges), "blast", note="second")
    assert store.read_network(spark, folder)["edges"].count() == 2
    assert store.read_network(spark, folder).manifest["note"] == "second"


def test_stores(session, spark, tmp_path):
    folder = str(tmp_path / "layout")
    positions = session.nodes.select("node_id", "header", F.lit(0.0).alias("x"), F.lit(1.0).alias("y"))
    fields = {"sequences": "AB", "network": "CD", "score": "local", "top_percent": 2.0, "threshold": None}
    store.write_layout(folder, positions, fields)
    assert store.read_layout(spark, folder, session.nodes).count() == 6
    assert store.matching_folders(spark, [folder, str(tmp_path / "none")], fields) == [folder]
    with pytest.raises(store.StoreError):
        store.read_layout(spark, folder, session.nodes.where("node_id < 3"))
    with pytest.raises(store.StoreError):
        store.write_network(str(tmp_path / "n"), session.nodes, session.edges, " ")
    assert store.next_version(["version_00", "Version_07", "other"]) == "version_08"
    assert store.settings_id({"b": 1, "a": None}) == store.settings_id({"b": 1}) != store.settings_id({"b": 2})
    assert store.settings_folder("esm/2", {"b": 1}).startswith("esm_2-")
    embeddings = spark.createDataFrame([("a", "AC", [[1.0, 0.1], [3e-6, 70000.0]])], "header STRING, sequence STRING, embedding ARRAY<ARRAY<FLOAT>>")
    store.write_embeddings(str(tmp_path / "e"), embeddings.limit(1), "m", "float32", complete=False)
    with pytest.raises(store.StoreError):
        store.read_embeddings(spark, str(tmp_path / "e"))


def test_half_precision(spark):
    import numpy as np

    values = [0.1, -3.14159, 1e-5, 6.1e-5, 1234.567, 0.0, 2049.0]
    df = spark.createDataFrame([([[float(np.float32(v)) for v in values]],)], "embedding ARRAY<ARRAY<FLOAT>>")
    got = df.select(store.half_precision(F.col("embedding"))).first()[0][0]
    assert got == [float(np.float16(np.float32(v))) for v in values]


def test_settings(tmp_path):
    from dataclasses import dataclass

    from simloom.sources.settings import load_settings

    @dataclass
    class Options:
        top: int = 3
        ratio: float = 0.5
        umap: bool = False
        name: str = ""

    path = tmp_path / "s.json"
    path.write_text('{"top": "7", "umap": "yes", "ratio": 2}')
    assert load_settings(Options, str(path)) == Options(7, 2.0, True, "")
    path.write_text('{"nope": 1}')
    with pytest.raises(ValueError):
        load_settings(Options, str(path))


def test_highlights(spark):
    path = spark.createDataFrame([(0, 2), (1, 3), (4, 9)], "row INT, col INT")
    assert sheets.mapped_highlights(path, "1, 1-2, 3, 5-9, x") == ["3", "3-4", "*", "10", "*"]
