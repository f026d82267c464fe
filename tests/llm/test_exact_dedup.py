import hashlib
import random

from llm.helpers import awkward, rows_of
from simloom.llm.exact_dedup import LOWER, UPPER, exact_duplicates, identities, without_copies

COLUMNS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def expected(rows):
    norm = [(i, (t or "").translate(str.maketrans(UPPER, LOWER))) for i, t in rows]
    out = []
    for i, t in norm:
        same = [j for j, u in norm if u == t]
        keep = max((j for j in same if j is not None), default=None)
        out.append((i, keep, len(same), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=lambda row: tuple((v is not None, v) for v in row))


def test_matches_brute_force_with_small_blocks(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("aAbÉé") for _ in range(rnd.randint(0, 40))) for _ in range(60)]
    rows = [(k, rnd.choice(texts)) for k in range(150)] + [(500, "a" * 4 + "b" * 4), (501, "b" * 4 + "a" * 4), (502, "A" * 4 + "B" * 4)]
    found = exact_duplicates(awkward(spark, rows), block_bytes=4)
    assert rows_of(found, *COLUMNS) == expected(rows)


def test_null_empty_repeated_and_long(spark):
    long = "Word " * 30_000
    rows = [(1, None), (2, ""), (None, "x"), (None, None), (3, long), (4, long.upper()), (5, long + "."), (3, long)]
    assert rows_of(exact_duplicates(awkward(spark, rows)), *COLUMNS) == expected(rows)
    stay = without_copies(awkward(spark, rows))
    assert stay.columns == awkward(spark, rows).columns
    assert rows_of(stay.selectExpr("doc_id", "length(text) AS n"), "doc_id", "n") == [(None, 1), (2, 0), (4, 150_000), (5, 150_001)]


def test_level_and_name_identify_the_text(spark):
    rows = [(k, "ab" * k) for k in range(20)] + [(100 + k, "AB" * k) for k in range(20)]
    named = identities(awkward(spark, rows), block_bytes=3).collect()
    names = {}
    for row in named:
        names.setdefault((row["level"], row["name"]), set()).add(row["id"] % 100)
    assert len(names) == 20 and all(len(ids) == 1 for ids in names.values())


def test_empty_table(spark):
    assert exact_duplicates(awkward(spark, [])).collect() == []
    assert without_copies(awkward(spark, [])).collect() == []
