import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from llm.helpers import awkward, rows_of
from simloom.llm.spelling import keys_of, neighbour_keys, observed_words, reduce_words, spelling_groups, variants

RESULT = ["word", "form", "root", "n", "n_near", "form_n"]
SCHEMA = "word string, n long"


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def brute_groups(counts, ratio=10):
    others = {w: [v for v in counts if near(w, v)] for w in counts}
    form = {}
    for w, found in others.items():
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(others[w]), counts[form[w]] if form[w] else None))
    return sorted(out)


def brute_words(rows, least=2):
    found = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= least}


def random_words(seed, n, letters="abcdé"):
    rnd = random.Random(seed)
    words = {}
    while len(words) < n:
        word = "".join(rnd.choice(letters) for _ in range(rnd.randint(7, 9)))
        for variant in {word, word[:3] + rnd.choice(letters) + word[4:], word[:5] + word[6:], word[:2] + rnd.choice(letters) + word[2:]}:
            if len(variant) >= 7:
                words[variant] = rnd.choice([2, 3, 20, 31, 200, 310, 4000])
    return words


@pytest.mark.parametrize("seed,symbols", [(1, 8), (2, 2), (3, 26)])
def test_groups_against_all_pairs(spark, seed, symbols):
    counts = random_words(seed, 300)
    found = spelling_groups(spark.createDataFrame(list(counts.items()), SCHEMA), symbols=symbols)
    assert rows_of(found, *RESULT) == [tuple(r) for r in brute_groups(counts)] and found.columns == RESULT


def test_forms_lead_to_the_root(spark):
    chain = ["aaaaaaaa" + "bcdefgh"[:k] for k in range(6)]
    counts = {w: 2 * 10**k for k, w in enumerate(chain)}
    found = {r.word: r for r in spelling_groups(spark.createDataFrame(list(counts.items()), SCHEMA)).collect()}
    assert [found[w].form for w in chain] == [*chain[1:], None] and {r.root for r in found.values()} == {chain[-1]}


def test_neighbourhood_is_full():
    """The keys of a word are those of all strings of symbols at most one edit away."""
    (_, reduced), = reduce_words(["abcab"], 3)
    row, symbols = reduced[0].tolist(), (1, 2, 3)
    strings = {tuple(row)}
    for k in range(6):
        strings.update(tuple(row[:k] + [s] + row[k:]) for s in symbols)
        if k < 5:
            strings.add(tuple(row[:k] + row[k + 1 :]))
            strings.update(tuple(row[:k] + [s] + row[k + 1 :]) for s in symbols)
    expected = {int(keys_of(np.array([s], np.uint64))[0]) for s in strings}
    assert set(neighbour_keys(reduced, 3)[0].tolist()) == expected


def test_words_of_texts(spark):
    rnd = random.Random(8)
    words = ["Straßenbahn", "strassenbahn", "Éclairage", "éclairage", "naïveté", "ABCDEFGH", "abcdefgh", "short", "ab×cdefg", "Ünterwegs", "x" * 300]
    rows = [(k if k % 7 else None, " ".join(rnd.choice(words) + rnd.choice(["", ".", "1", "_", "ő"]) for _ in range(80))) for k in range(60)]
    rows += [(5, None), (6, ""), (7, "Garnele Garnele " * 20_000), (7, "Garnele Garnele " * 20_000), (None, "é" * 70_000)]
    docs = awkward(spark, rows)
    counts = brute_words(rows, 1)
    assert dict(rows_of(observed_words(docs), "word", "n")) == counts
    assert rows_of(variants(docs), *RESULT) == [tuple(r) for r in brute_groups(brute_words(rows))]


def test_empty_tables_and_lonely_words(spark):
    assert spelling_groups(spark.createDataFrame([], SCHEMA)).collect() == []
    assert variants(awkward(spark, [(1, None), (None, "")])).collect() == []
    assert rows_of(variants(awkward(spark, [(1, "Lonely!")] * 3), min_count=1), *RESULT) in ([("lonely", None, "lonely", 3, 0, None)], [])
    twins = spark.createDataFrame([("tiebreaka", 1), ("tiebreakb", 50), ("tiebreakc", 50)], SCHEMA)
    assert rows_of(spelling_groups(twins), "word", "form", "n_near")[0] == ("tiebreaka", "tiebreakb", 2)
