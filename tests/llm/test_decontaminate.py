import random

import numpy as np

from llm.helpers import awkward, rows_of
from simloom.llm import decontaminate
from simloom.llm.decontaminate import REPEAT_RECALL, Items, anchor_words, best_match, edits_allowed, leaks, repeats_for, without_leaks
from simloom.llm.words import hash_words


def distance_to_best_stretch(item, text):
    row = [0] * (len(text) + 1)
    for k, x in enumerate(item):
        new = [k + 1]
        for j, y in enumerate(text):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row)


def words(rnd, n, size=600):
    return ["w%d" % rnd.randrange(size) for _ in range(n)]


def edited(rnd, text, edits):
    out = list(text)
    for k in sorted(rnd.sample(range(len(out)), edits), reverse=True):
        kind = rnd.randrange(3)
        if kind == 0:
            out[k] = "x%d" % rnd.randrange(10**6)
        elif kind == 1:
            del out[k]
        else:
            out.insert(k, "y%d" % rnd.randrange(10**6))
    return out


def hashed(items):
    return [hash_words([" ".join(w)])[0] for w in items]


def test_best_match_equals_the_full_table():
    rnd = random.Random(2)
    for _ in range(80):
        item, text = words(rnd, rnd.randint(1, 15), 8), words(rnd, rnd.randint(0, 40), 8)
        a, b = hash_words([" ".join(item)])[0], hash_words([" ".join(text)])[0]
        edits, start, end = best_match(a, b)
        assert edits == distance_to_best_stretch(item, text) and 0 <= start <= end <= len(text)
        assert distance_to_best_stretch(item, text[start:end]) == edits


def test_unchanged_run_exists():
    rnd = random.Random(3)
    for n in range(1, 70):
        e, size = edits_allowed(n, 0.8), anchor_words(n, 0.8)
        item = ["a%d" % k for k in range(n)]
        for _ in range(20):
            text = edited(rnd, item, e)
            grams = {tuple(item[k : k + size]) for k in range(n - size + 1)}
            assert any(tuple(text[k : k + size]) in grams for k in range(len(text) - size + 1))


def test_single_repeats_and_target_recall():
    """With the most edits allowed, a repeat finds an item as often as assumed, and all repeats reach the recall asked for."""
    rnd = random.Random(5)
    items = [words(rnd, rnd.randint(14, 59), 10**6) for _ in range(150)]
    own = Items(list(range(150)), hashed(items), 0.8, repeats_for(0.99))
    single, found, changed = [], 0, 0
    for k, item in enumerate(items):
        text = words(rnd, 50, 10**6) + edited(rnd, item, edits_allowed(len(item), 0.8)) + words(rnd, 50, 10**6)
        hashes = hash_words([" ".join(text)])[0]
        starts = own.begins(hashes).get(k, np.zeros(0, np.int64))
        limits = np.full(len(starts), len(hashes))
        single += [bool((own.signature(hashes, starts, limits, len(item), r) == own.signatures[k][r]).any()) for r in range(own.repeats)]
        if distance_to_best_stretch(item, text) <= edits_allowed(len(item), 0.8):
            changed += 1
            found += any(hit[0] == k for hit in own.search(hashes))
    assert np.mean(single) >= REPEAT_RECALL
    assert found >= 0.99 * changed and changed > 140


def test_clustered_edits_in_items_of_any_length():
    """The most edits allowed, of one kind, in the first part, the last part or all of the item: nothing is lost."""
    rnd = random.Random(11)
    for n in (16, 30, 59, 150, 400, 1000):
        item, e = ["a%d" % k for k in range(n)], edits_allowed(n, 0.8)
        own = Items([7], hashed([item]), 0.8, repeats_for(0.99))
        for kind in ("substitution", "deletion", "insertion"):
            for low, high in ((0, n // 2), (n // 2, n), (0, n)):
                for _ in range(3):
                    text = list(item)
                    for k in sorted(rnd.sample(range(low, high), e), reverse=True):
                        text[k : k + (kind != "insertion")] = [] if kind == "deletion" else ["x%d" % rnd.randrange(10**6)]
                    text = words(rnd, 20) + text + words(rnd, 20)
                    hits = own.search(hash_words([" ".join(text)])[0])
                    assert hits and hits[0][1] >= 0.8 - 1e-9, (n, kind, low, high)


def test_hits_are_real(spark):
    rnd = random.Random(6)
    items = [words(rnd, rnd.randint(3, 40)) for _ in range(30)]
    rows = []
    for k in range(120):
        text = words(rnd, rnd.randint(0, 80))
        for item in rnd.sample(items, rnd.randint(0, 2)):
            at = rnd.randint(0, len(text))
            text[at:at] = edited(rnd, item, rnd.randint(0, edits_allowed(len(item), 0.8)))
        rows.append((k, " ".join(text)))
    bench = spark.createDataFrame([(k, " ".join(w), "x") for k, w in enumerate(items)], "item_id long, text string, doc_id string")
    found = {r.doc_id: r for r in leaks(awkward(spark, rows), bench).collect()}
    missing = 0
    for k, text in rows:
        wanted = {i for i, item in enumerate(items) if distance_to_best_stretch(item, text.split()) <= edits_allowed(len(item), 0.8)}
        assert set(found[k].item_ids) <= wanted and found[k].contaminated == bool(found[k].item_ids)
        missing += len(wanted - set(found[k].item_ids))
    assert missing <= 1
    kept = without_leaks(awkward(spark, rows), bench)
    assert [r[0] for r in rows_of(kept, "doc_id")] == sorted(k for k in found if not found[k].contaminated)
    assert kept.columns == awkward(spark, rows).columns


def test_awkward_rows_and_blocks(spark, monkeypatch):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "..."), (None, "lone words here"), (5, "one two three four"), (5, "one two three four")], "item_id long, text string")
    rows = [(1, None), (2, ""), (None, "say lone words HERE now"), (4, "zero one, two. three four five " * 3000), (4, "x")]
    schema = ("doc_id", "contaminated", "item_ids")
    wanted = [(None, True, [None]), (1, False, []), (2, False, []), (4, False, []), (4, True, [5, 5])]
    assert rows_of(leaks(awkward(spark, rows), bench), *schema) == wanted
    assert leaks(awkward(spark, []), bench).collect() == []
    assert [r[1] for r in rows_of(leaks(awkward(spark, rows), bench.where("false")), *schema)] == [False] * 5
    assert without_leaks(awkward(spark, rows), bench.where("false")).count() == 5
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 5)
    split = rows_of(leaks(awkward(spark, rows), bench).where("contaminated"), *schema)
    assert split == [(None, True, [None]), (4, True, [5]), (4, True, [5])]


def test_recall_of_walks_against_all_windows():
    """With the most edits allowed, of one kind and in one part of the item, the walks find nearly all that looking at every window finds, whatever the item's length."""
    rnd = random.Random(21)
    for n, trials in ((16, 12), (40, 12), (120, 8), (300, 4), (800, 2)):
        e, wanted, found = edits_allowed(n, 0.8), 0, 0
        for kind in ("substitution", "deletion", "insertion"):
            for low, high in ((0, n // 2), (n // 2, n), (0, n)):
                for _ in range(trials):
                    item = words(rnd, n, 10**5)
                    text = list(item)
                    for k in sorted(rnd.sample(range(low, high), e), reverse=True):
                        text[k : k + (kind != "insertion")] = [] if kind == "deletion" else ["x%d" % rnd.randrange(10**6)]
                    own, text = Items([7], hashed([item]), 0.8, repeats_for(0.99)), hashed([words(rnd, 20) + text + words(rnd, 20)])[0]
                    exact, walked = own.search_exactly(text), own.search(text)
                    wanted += len(exact)
                    found += walked == exact
        assert wanted >= 9 * trials and found >= 0.95 * wanted, (n, found, wanted)


def test_items_that_share_an_opening_are_taken_in_parts(monkeypatch):
    rnd = random.Random(22)
    opening = ["o%d" % k for k in range(6)]
    items = hashed([opening + words(rnd, 20, 10**6) for _ in range(300)])
    texts = hashed([opening + words(rnd, 30, 10**6) for _ in range(40)]) + [items[7], np.concatenate([items[250], items[3]])]
    cuts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    own = Items(list(range(300)), items, 0.8, repeats_for(0.99))
    whole = own.search_all(np.concatenate(texts), cuts)
    assert {k: [hit[0] for hit in hits] for k, hits in whole.items()} == {40: [7], 41: [3, 250]}
    largest = []
    original = Items._anchored
    monkeypatch.setattr(Items, "_anchored", lambda self, words, cuts, low, high: largest.append((len(cuts) - 1) * (high - low)) or original(self, words, cuts, low, high))
    monkeypatch.setattr(decontaminate, "CHUNK_PAIRS", 500)
    assert own.search_all(np.concatenate(texts), cuts) == whole and max(largest) <= 300
