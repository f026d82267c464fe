import random
from collections import Counter

import numpy as np
import pytest

from llm.helpers import awkward, rows_of
from simloom.llm import alignment
from simloom.llm.alignment import PerfectHash, align, aligner, count_pairs
from simloom.llm.shared import map_rows

RESULT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


@pytest.fixture(scope="module")
def files():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(rows, files):
    """Whole texts by both libraries, all pairs of tokens by their ends."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(files[0]), sentencepiece.SentencePieceProcessor(model_file=files[1])
    a.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(x): x for x in printable} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in printable)}
    names = {k: entry for entry, k in a.get_vocab().items()}

    def ends(tokens):
        at, out = 0, []
        for token in tokens:
            at += len(token)
            out.append(at)
        return out

    found, counts = [], Counter()
    for i, text in rows:
        links, groups, ids = [], [], ([], [])
        if text:
            ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            tokens = [bytes(back[c] for c in names[k]) for k in ids[0]], [
                bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in ids[1]
            ]
            if any(b"".join(x) != (" " + text).encode() for x in tokens):
                ids = [], []
            else:
                at = {e: k for k, e in enumerate(ends(tokens[0]))}, {e: k for k, e in enumerate(ends(tokens[1]))}
                last = [0, 0]
                for e in sorted(set(at[0]) & set(at[1])):
                    stop = at[0][e] + 1, at[1][e] + 1
                    groups.append("|".join(",".join(map(str, ids[k][last[k] : stop[k]])) for k in (0, 1)))
                    links.append((ids[0][at[0][e]], ids[1][at[1][e]]))
                    last = stop
        counts.update(links)
        found.append((i, len(ids[0]), len(ids[1]), links, ";".join(groups)))
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [
        (i, n_a, n_b, len(links), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), groups)
        for i, n_a, n_b, links, groups in found
    ]


TEXTS = [
    None, "", " ", "  ", "\n", "\n\n", " \n", "a", " a", "a ", "a\n\n\nb", "a \n b", "a\n \n\n", "tabs\tand more \t\n\nx", "▁ blank mark", "<s> x </s> <|endoftext|>",
    "don't we'll 've", "naïve café Straße", "日本語のテキスト", "emoji 👩‍👩‍👧 𝔘", "é combining", "\u0000 nul", "x" * 5000, "1234567 12 3.14", "(a)[b]{c}!!??", "　wide line",
    "a\r\nb", "The quick brown fox. The quick brown fox.", "​zero", "ﬁ ligature ½", "мир и война", "a" + " " * 700 + "b", "don’t “quote”",
]


def test_against_both_libraries(spark, files):
    rnd = random.Random(3)
    words = ["the", "thintion", "éauxnai", "don't", "Straße", "42", "!!", "\n", "\n\n", "  ", "  ", "х", "<s>", "thnd,", "***", "naïve"]
    rows = list(enumerate(TEXTS)) + [(100 + k, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 200)))) for k in range(60)]
    rows += [(None, "twice"), (None, "twice"), (7, "the other text of seven")]
    docs = awkward(spark, rows).repartition(5)
    found = align(docs, *files, count_pairs(docs, *files))
    key = lambda r: (r[0] is not None, r[0] or 0, r[7])
    assert sorted(rows_of(found, *RESULT), key=key) == sorted(brute(rows, files), key=key)


def test_words_together_equal_the_whole_text(files, monkeypatch):
    """Words aligned in runs of any size, each once, give what aligning the whole text gives."""
    rnd = random.Random(4)
    text = " " + "".join(rnd.choice(["river", "stone", "été", "42,", "don't"]) + rnd.choice([" ", "\n", "  ", "\n\n"]) for _ in range(3000))
    own = aligner(*files)
    whole = own.align([text])
    for run in (1, 40, 1 << 16):
        monkeypatch.setattr(alignment, "RUN", run)
        words = alignment.Words(own)
        (numbers,) = words.numbers([text[1:]])
        groups = [group for part in words.new for group in part.groups(own)]
        pairs = np.concatenate([part.pairs() for part in words.new])
        assert ";".join(groups[k] for k in numbers) == whole.groups(own)[0]
        assert set(pairs.tolist()) == set(whole.pairs().tolist()) and words.count == len(set(numbers.tolist()))


def test_few_words_at_hand_give_the_same_counts(spark, files, monkeypatch):
    rnd = random.Random(9)
    rows = [(k, " ".join(rnd.choice(["river", "stone", "cloud", "mill", "green"]) + rnd.choice("abcdef") for _ in range(30))) for k in range(40)]
    docs = awkward(spark, rows)
    monkeypatch.setattr(alignment, "KNOWN", 3)
    monkeypatch.setattr(alignment, "map_rows", lambda *given, **more: map_rows(*given, rows=4))
    assert rows_of(align(docs, *files, count_pairs(docs, *files)), *RESULT) == sorted(brute(rows, files))


def test_pairs_not_counted_before(spark, files):
    counts = count_pairs(awkward(spark, [(1, "river stone")]), *files)
    (row,) = align(awkward(spark, [(2, "cloud stone")]), *files, counts).collect()
    assert row.n_links == 2 and row.n_best == 1 and row.count_sum == 1
    nothing = count_pairs(awkward(spark, []), *files)
    (row,) = align(awkward(spark, [(2, "cloud")]), *files, nothing).collect()
    assert nothing.hashed.size == 0 and (row.n_best, row.count_sum) == (0, 0)
    assert align(awkward(spark, []), *files, counts).collect() == []


def test_perfect_hash_is_minimal_and_knows_its_keys():
    rnd = np.random.default_rng(6)
    keys = np.unique(rnd.integers(0, 1 << 40, 50_000))
    table = PerfectHash(np.concatenate([keys, keys]))
    assert table.size == len(keys) and sorted(table.places(keys).tolist()) == list(range(len(keys)))
    other = np.setdiff1d(rnd.integers(0, 1 << 40, 50_000), keys)
    assert (table.places(other) == -1).all()
    assert PerfectHash(np.zeros(0, np.int64)).places(other[:3]).tolist() == [-1, -1, -1]


def test_counts_are_summed_as_a_tree(spark, files, monkeypatch):
    monkeypatch.setattr(alignment, "FAN", 2)
    monkeypatch.setattr(alignment, "SLICE", 3)
    local = spark.createDataFrame([(k % 11, k) for k in range(1000)], "pair long, n long").repartition(9)
    hashed = PerfectHash(np.arange(11))
    found = alignment._dense(local, hashed)
    assert found[hashed.places(np.arange(11))].tolist() == [sum(range(r, 1000, 11)) for r in range(11)]


def test_pairs_are_bounded_by_the_vocabularies(files):
    own = aligner(*files)
    assert own.most_pairs() < 600_000
    for pair in own.align([" thintion"]).pairs().tolist():
        x, y = own.bytes_a[pair >> alignment.SHIFT], own.bytes_b[pair & ((1 << alignment.SHIFT) - 1)]
        assert x.endswith(y) or y.endswith(x)
