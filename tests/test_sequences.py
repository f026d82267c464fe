import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from simloom.functions import headers, positions, residues
from simloom.operators import sanitize
from simloom.sources import fasta, hits, lists

QUICK = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
TEXT = st.text(alphabet=st.sampled_from("aA cK[]{}?*\"#%@$/\\_\t xéß-.>|1"), max_size=12)


def expected_header(text):
    text = text.translate(str.maketrans("[]{}", "()()"))
    text = re.sub(r'[?*"#%@$/\\]', "_", text)
    return re.sub("_+", "_", " ".join(text.split()).replace(" ", "_"))


def expected_sequence(text):
    letters = "ACDEFGHIKLMNPQRSTVWYBZJXUO"
    upper = text.upper()
    hits_ = [k for k, c in enumerate(upper) if c in letters]
    if not hits_:
        return ""
    return "".join(c if c in letters else "X" for c in upper[hits_[0] : hits_[-1] + 1])


@QUICK
@given(st.lists(TEXT, min_size=20, max_size=60))
def test_cleaning_matches_plain_python(spark, texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k INT, t STRING")
    got = df.select("k", headers.clean_header(F.col("t")).alias("h"), residues.clean_sequence(F.col("t")).alias("s"))
    for row in got.collect():
        assert row["h"] == expected_header(texts[row["k"]])
        assert row["s"] == expected_sequence(texts[row["k"]])


def test_aligned_cleaning_keeps_positions(spark):
    df = spark.createDataFrame([("a.c -k*ß",)], "s STRING")
    assert df.select(residues.clean_aligned(F.col("s"))).first()[0] == "A-C-KXX"


def brute_unique(rows):
    """Allocation by walking through the records in order."""
    groups = {}
    for header, order in sorted(rows, key=lambda r: r[1]):
        groups.setdefault(header, []).append(order)
    used, out = set(), {}
    for header, orders in groups.items():
        if len(orders) == 1:
            out[orders[0]] = header
            used.add(header)
            continue
        number, stem = 1, header if header.endswith("_") else header + "_"
        for order in orders:
            while stem + str(number) in groups or stem + str(number) in used:
                number += 1
            out[order] = stem + str(number)
            used.add(out[order])
            number += 1
    return out


@QUICK
@given(st.lists(st.sampled_from(["a", "a_", "a_1", "a_2", "a_4", "a_07", "b", "b_1_", "b_1_1", "b_1"]), min_size=5, max_size=40))
def test_unique_headers(spark, names):
    rows = [(name, k) for k, name in enumerate(names)]
    df = spark.createDataFrame(rows, "header STRING, first_ord BIGINT")
    got = {r["first_ord"]: r["new_header"] for r in sanitize.unique_headers(df).collect()}
    assert got == brute_unique(rows)
    assert len(set(got.values())) == len(got)


def test_sanitized_records_and_counters(spark):
    rows = [
        (0, "x y", "acd"), (1, "longer y", "ACD"), (2, "x y", "ACD"), (3, "p", "--k*k--"), (4, "p", "WW"), (5, "e", "..."),
    ]
    df = spark.createDataFrame(rows, "ord BIGINT, header STRING, sequence STRING")
    got = [(r["header"], r["sequence"]) for r in sanitize.sanitized_records(df).orderBy("ord").collect()]
    assert got == [("longer_y", "ACD"), ("p_1", "KXK"), ("p_2", "WW")]
    counters = sanitize.sanitize_counters(df).first().asDict()
    assert counters["exact_duplicates_removed"] == 1
    assert counters["different_headers_merged"] == 1
    assert counters["headers_renamed"] == 2
    assert counters["empty_sequences_removed"] == 1
    assert counters["final_records"] == 3


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_fasta_line_ends_and_headers(spark, tmp_path, end):
    """Any line end; a header keeps what follows its first ``>``, but for white space at the end."""
    path = tmp_path / "ends.fasta"
    lines = ["stray", ">one two \t", "AC", "", " DE ", "> spaced", "K", "  >indented", ">>double", "LL"]
    path.write_bytes(b"\xef\xbb\xbf" + end.join(lines).encode())
    records = fasta.read_fasta(spark, str(path)).orderBy("ord").collect()
    expected, current = [], None
    for line in "\n".join(lines).split("\n"):
        line = line.strip()
        if line.startswith(">"):
            current = [line[1:], ""]
            expected.append(current)
        elif current is not None:
            current[1] += line
    assert [[r["header"], r["sequence"]] for r in records] == expected


def test_failed_write_keeps_the_old_files(spark, tmp_path):
    out = str(tmp_path / "kept")
    fasta.write_fasta(spark.createDataFrame([(0, "a", "AC")], "ord BIGINT, header STRING, sequence STRING"), out)
    broken = spark.createDataFrame([(0, "b", "K")], "ord BIGINT, header STRING, sequence STRING")
    broken = broken.withColumn("sequence", F.when(F.col("ord") == 0, F.raise_error(F.lit("no"))).otherwise(F.col("sequence")))
    with pytest.raises(Exception):
        fasta.write_fasta(broken, out)
    assert [r["header"] for r in fasta.read_fasta(spark, out + "/*.txt").collect()] == ["a"]
    fasta.write_fasta(spark.createDataFrame([(0, "c", "K")], "ord BIGINT, header STRING, sequence STRING"), out)
    assert [r["header"] for r in fasta.read_fasta(spark, out + "/*.txt").collect()] == ["c"]


def test_fasta_round_trip(spark, tmp_path):
    path = tmp_path / "in.fasta"
    path.write_bytes(b"\xef\xbb\xbfjunk\n>one > x \r\nAC\r\n\r\n  DE \n>two\nK\n >three\nLL\n")
    records = fasta.read_fasta(spark, str(path)).orderBy("ord").collect()
    assert [tuple(r) for r in records] == [(0, "one > x", "ACDE"), (1, "two", "K"), (2, "three", "LL")]
    out = str(tmp_path / "out")
    fasta.write_fasta(fasta.read_fasta(spark, str(path)), out)
    again = fasta.read_fasta(spark, out + "/*.txt").collect()
    assert sorted(r["sequence"] for r in again) == ["ACDE", "K", "LL"]


@pytest.mark.parametrize(
    "rows, problem",
    [
        ([(0, "a", "AC"), (1, "a", "AC")], "duplicate"),
        ([(0, "a", "AC"), (1, "b", "ACD")], "length"),
        ([(0, "a", ""), (1, "b", "")], "without data"),
        ([(0, " ", "AC")], "empty"),
    ],
)
def test_unsafe_alignments_raise(spark, rows, problem):
    df = spark.createDataFrame(rows, "ord BIGINT, header STRING, sequence STRING")
    with pytest.raises(Exception, match=problem):
        fasta.checked_alignment(df).collect()


def test_positions():
    assert positions.reference_positions("[3-5, (-2), 4.2, +1]") == ["-2", "1", "3", "4", "4.2", "5"]
    for bad in ("5-3", "1.2-4", "4.0", "-3"):
        with pytest.raises(ValueError):
            positions.reference_positions(bad)
    assert positions.label_percentage("1%") == 1.0 and positions.label_percentage("40") == 0.4
    assert positions.identity_fraction("1%") == 0.01 and positions.identity_fraction(90) == 0.9
    with pytest.raises(ValueError):
        positions.identity_fraction(0)


def test_position_lists(spark):
    labels = ["-1", "0", "1", "10.1", "10.2", "11", "2", "10"]
    df = spark.createDataFrame([(label,) for label in labels], "label STRING")
    last = F.lit("11")

    def chosen(text):
        return {r[0] for r in df.where(positions.in_positions(F.col("label"), text, last)).collect()}

    assert chosen("2-(-1)") == {"-1", "0", "1", "2"}
    assert chosen("10.1-END") == {"10.1", "10.2", "11"}
    assert chosen("E, 10") == {"11", "10"}


def test_hit_table(spark):
    lines = [
        "# comment", "a b 1 2 3 4 5 6 7 8 1e-30 50", "b a 1 2 3 4 5 6 7 8 1e-40 50", "a a 1 2 3 4 5 6 7 8 0.0 9",
        "c d 1 2 3 4 5 6 7 8 oops 50", "d a 1 2 3 4 5 6 7 8 0 50",
    ]
    df = spark.createDataFrame(list(enumerate(lines)), "line BIGINT, value STRING")
    column = hits.evalue_column(df).first()[0]
    assert column == 10
    nodes, edges = hits.named_network(hits.parse_named_hits(df, column))
    assert {r["header"]: r["node_id"] for r in nodes.collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert sorted((r["i"], r["j"], round(r["score"], 3)) for r in edges.collect()) == [(0, 1, 40.0), (0, 3, 300.0)]


def test_header_lists(spark, tmp_path):
    (tmp_path / "few.txt").write_text("one\n\n two \n")
    (tmp_path / "seqs.fasta").write_text(">a b\nACD\n>c\nK\n")
    assert sorted(r[0] for r in lists.read_header_list(spark, str(tmp_path), "few").collect()) == ["one", "two"]
    assert sorted(r[0] for r in lists.read_header_list(spark, str(tmp_path), "seqs.fasta").collect()) == ["a b", "c"]
    twice = spark.createDataFrame([("a",), ("a",)], "header STRING")
    with pytest.raises(Exception, match="duplicate"):
        lists.checked_targets(twice).collect()


@QUICK
@given(st.text(alphabet="ab[]!?*-.x", min_size=1, max_size=7))
def test_wildcards_match_whole_texts(spark, pattern):
    import fnmatch

    texts = ["a", "ab", "xab", "a-b", "[a]", "b.x", "", "ba!", "aab\n", "abab"]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    got = {r[0] for r in df.where(headers.wildcard_match(F.col("t"), pattern)).collect()}
    assert got == {t for t in texts if fnmatch.fnmatchcase(t, pattern)}
