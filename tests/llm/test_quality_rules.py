import math
import random
import re
import zlib
from collections import Counter

from llm.helpers import awkward, rows_of
from simloom.llm import quality_rules
from simloom.llm.quality_rules import BASE, base_counts, judge

WORDS = ["the", "of", "and", "river", "stone", "cloud", "paper", "green", "mill", "house", "walked", "over", "été"]


def brute_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    seen, covered = Counter(windows), set()
    for k, window in enumerate(windows):
        if seen[window] > 1:
            covered.update(range(k, k + 5))
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def brute(rows, good):
    """Scores and decisions from plain counters."""
    texts = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]

    def grams(words):
        codes = [zlib.crc32(w.encode()) % 65536 for w in words]
        return codes + [(a * 1_000_003 + b) % 65536 for a, b in zip(codes, codes[1:])]

    odd = lambda i: zlib.crc32(str(i).encode()) % 2
    raw, trusted = Counter(), Counter()
    for i, words in texts:
        raw.update(grams(words))
        if i in good and not odd(i):
            trusted.update(grams(words))
    r_all, t_all = sum(raw.values()), sum(trusted.values())
    ratio = {b: round(math.log(((trusted[b] + 0.5) / (t_all + 32768)) / ((n + 0.5) / (r_all + 32768))) * 4096) if t_all else 0 for b, n in raw.items()}
    out = []
    for (i, words), (_, text) in zip(texts, rows):
        found = [ratio[b] for b in grams(words)]
        out.append((i, *brute_base(text), math.floor(sum(found) / len(found)) if found else None))
    aside = sorted(x[7] for x in out if x[0] in good and odd(x[0]) and not x[6])
    least = [s for s in aside if sum(a < s for a in aside) <= 0.01 * len(aside)]
    cut = max(least) if least else -(1 << 62)
    return [(*x[:7], not x[6] and x[7] >= cut, None if x[7] is None else x[7] / 4096) for x in out]


def corpus():
    rnd = random.Random(5)
    rows = []
    for k in range(160):
        words = [rnd.choice(WORDS) for _ in range(rnd.randint(1, 90))]
        if k % 8 == 3:
            words = [w.upper() + "!!" for w in words]
        if k % 8 == 5:
            words = words[:7] * rnd.randint(1, 5) + words
        text = "".join(w + rnd.choice([" ", " ", " ", "\n", "\t \n"]) for w in words)
        rows.append((k, text + ("\n" + text if k % 16 == 7 else "")))
    return rows, {k for k in range(160) if k % 8 not in (3, 5) and k % 3}


def test_against_counters(spark):
    rows, good = corpus()
    labels = spark.createDataFrame([(k, int(k in good)) for k in range(160)], "doc_id long, quality int")
    found = rows_of(judge(awkward(spark, rows), labels), "doc_id", *BASE, "kept", "score")
    assert found == sorted(brute(rows, good))
    assert {k for k, *_, kept, _ in found if kept} >= {k for k in good if not brute_base(dict(rows)[k])[5]} - {0}.union(
        {x[0] for x in found if not x[7]}
    ) and not any(kept for k, *_, kept, _ in found if k % 8 == 3)


def test_base_counts_of_awkward_texts(spark):
    window = "a b c d e"
    texts = [None, "", " \t\n\v\f\r", "a", "a b c d e", f"{window} {window}", f"{window} x {window}", "a " * 40, "x\n\nx\n \nx \n", "  |  <>#", "é𝔘 é𝔘",
             "a b c d e f g a b c d e f h b c d e f", "w " * 60_000, "\na\r\nb"]
    found = rows_of(base_counts(awkward(spark, list(enumerate(texts)))), "doc_id", *BASE)
    assert found == [(k, *brute_base(text)) for k, text in enumerate(texts)]


def test_null_and_repeated_ids_and_no_labels(spark):
    text = " ".join(WORDS)
    rows = [(None, text), (None, None), (3, text), (3, text), (3, "short")]
    labels = spark.createDataFrame([(None, 1), (3, None), (3, 0)], "doc_id long, quality int")
    found = rows_of(judge(awkward(spark, rows), labels), "doc_id", "n_words", "base_failed", "kept", "score")
    n = len(WORDS)
    assert found == [(None, 0, True, False, None), (None, n, False, True, 0.0), (3, 1, True, False, 0.0), (3, n, False, True, 0.0), (3, n, False, True, 0.0)]
    assert judge(awkward(spark, []), labels).collect() == []


def test_gram_counts_are_few_rows(spark):
    rows, good = corpus()
    read = quality_rules._read(awkward(spark, rows), "doc_id", "text")
    labels = spark.createDataFrame([(k, 1) for k in good], "doc_id long, quality int")
    assert quality_rules.log_ratios(read, labels).count() <= 1 << quality_rules.BITS
