import random

import numpy as np
import pytest

from llm.helpers import awkward
from simloom.llm.near_dedup import aligned_similarity, labelled, near_duplicates, shingles_of, sketch, without_near_copies
from simloom.llm.words import hash_words


def marks(text):
    return shingles_of(hash_words([text])[0])


def plain_similarity(a, b):
    """Longest common subsequence of labelled shingles by the full table."""
    row = [0] * (len(b) + 1)
    for x in a.tolist():
        new = [0]
        for k, y in enumerate(b.tolist()):
            new.append(row[k] + 1 if x == y else max(new[-1], row[k + 1]))
        row = new
    return row[-1] / (len(a) + len(b) - row[-1])


def words(rnd, n):
    return ["w%d" % rnd.randrange(400) for _ in range(n)]


def edited(rnd, text, edits):
    out = list(text)
    for _ in range(edits):
        k = rnd.randrange(len(out))
        kind = rnd.randrange(3)
        if kind == 0:
            out[k] = "x%d" % rnd.randrange(10**6)
        elif kind == 1:
            del out[k]
        else:
            out.insert(k, "y%d" % rnd.randrange(10**6))
    return out


def brute_force(rows, threshold=0.8):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    own = [marks(t) for _, t in rows]
    for a in range(len(rows)):
        for b in range(a):
            same = len(own[a]) and len(own[b]) and plain_similarity(own[a], own[b]) >= threshold
            if same or (not len(own[a]) and (rows[a][1] or "") == (rows[b][1] or "")):
                parent[find(a)] = find(b)
    out = {}
    for k, (i, _) in enumerate(rows):
        out.setdefault(find(k), []).append(i)
    return sorted(sorted(ids) for ids in out.values())


def classes(found):
    out = {}
    for r in found:
        out.setdefault(r.class_id, []).append(r.doc_id)
        assert r.kept == (r.doc_id == r.class_id)
    for key, ids in out.items():
        assert key == min(ids)
    assert all(r.class_size == len(out[r.class_id]) for r in found)
    return sorted(sorted(ids) for ids in out.values())


def test_alignment_equals_the_full_table():
    rnd = random.Random(1)
    for _ in range(150):
        a = words(rnd, rnd.randint(5, 80))
        b = edited(rnd, a, rnd.randint(0, 4))
        if rnd.random() < 0.3:
            b = b[len(b) // 2 :] + b[: len(b) // 2]
        x, y = marks(" ".join(a)), marks(" ".join(b))
        found, wanted = aligned_similarity(x, y)[0], plain_similarity(x, y)
        assert found == pytest.approx(wanted) if wanted >= 0.8 else found < 0.8


def test_repeats_are_told_apart():
    x = np.array([5, 5, 7, 5], np.uint64)
    assert len(set(labelled(x).tolist())) == 4 and set(labelled(x[:2]).tolist()) < set(labelled(x).tolist())


def test_sketch_follows_order():
    a = labelled(np.arange(100, dtype=np.uint64))
    assert np.all(sketch(a) == sketch(a.copy())) and np.mean(sketch(a) == sketch(a[::-1].copy())) < 0.5


def test_classes_equal_brute_force(spark):
    rnd = random.Random(7)
    rows = []
    for _ in range(25):
        base = words(rnd, rnd.randint(30, 120))
        rows.append(base)
        for _ in range(rnd.randint(0, 6)):  # chains of copies of copies
            rows.append(edited(rnd, rows[-1], rnd.choice((0, 0, 1, 1, 2))))
    rows = [(k, " ".join(text)) for k, text in enumerate(rows)]
    rnd.shuffle(rows)
    assert classes(near_duplicates(awkward(spark, rows)).collect()) == brute_force(rows)


def test_short_empty_null_long_and_repeated(spark):
    long = " ".join("v%d" % (k * k % 9973) for k in range(9000))
    rows = [(1, None), (2, ""), (3, "!!"), (4, "??"), (5, "one two"), (6, "One, two!"), (7, "one two three"), (8, long), (9, long + " tail"), (10, "!!"), (11, long), (11, long)]
    assert classes(near_duplicates(awkward(spark, rows)).collect()) == [[1, 2], [3, 10], [4], [5, 6], [7], [8, 9, 11, 11]]
    assert near_duplicates(awkward(spark, [(None, "a b c d e f"), (None, "a b c d e f"), (3, "x")])).where("kept").count() == 3
    assert near_duplicates(awkward(spark, [])).collect() == []


def test_shared_passage_is_no_near_copy_and_a_hot_group_is_one_class(spark):
    rnd = random.Random(9)
    passage, base = words(rnd, 60), words(rnd, 100)
    rows = [(k, " ".join(words(rnd, 90) + passage)) for k in range(60)]
    rows += [(1000 + k, " ".join(edited(rnd, base, 1))) for k in range(150)]
    found = classes(near_duplicates(awkward(spark, rows)).collect())
    assert found == brute_force(rows) and len(found) == 61


def test_one_of_each_class_stays(spark):
    docs = awkward(spark, [(4, "a b c d e f g"), (2, "A b c d e f g!"), (7, "other words entirely here now")])
    kept = without_near_copies(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 7]


def test_null_and_repeated_ids_of_different_texts(spark):
    """A decision is one of a row, not of all rows that have its id."""
    rnd = random.Random(12)
    base, twin, clean, other, third = (words(rnd, 80) for _ in range(5))
    text = " ".join
    rows = [
        (1, text(base)), (None, text([*base, "tail"])), (None, text(clean)), (None, None),  # a null id that goes, two that stay
        (2, text(other)), (2, text([*base, "end"])),  # a repeated id: one text goes, one stays
        (3, text(twin)), (3, text([*twin, "more"])), (3, text(twin).replace(" ", ", ")),  # one class under one id: one text stays
        (None, text(third)), (None, text([*third, "last"])),  # a class of null ids only
        (9, text(clean[:40] + other[:40])), (9, text(clean[:40] + other[:40])),  # the same row twice
    ]
    found = near_duplicates(awkward(spark, rows)).collect()
    assert sorted((r.class_id or 0, r.class_size) for r in found if r.kept) == [(0, 1), (0, 1), (0, 2), (1, 3), (2, 1), (3, 3), (9, 2), (9, 2)]
    kept = [(r.doc_id, r.text) for r in without_near_copies(awkward(spark, rows)).collect()]
    assert {(1, text(base)), (None, text(clean)), (None, None), (2, text(other)), (9, text(clean[:40] + other[:40]))} <= set(kept)
    assert sorted(i or 0 for i, _ in kept) == [0, 0, 0, 1, 2, 3, 9]


def test_lower_thresholds_are_refused(spark):
    with pytest.raises(ValueError):
        near_duplicates(awkward(spark, []), threshold=0.5)
