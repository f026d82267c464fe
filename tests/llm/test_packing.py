import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from llm.helpers import awkward
from simloom.llm.packing import Rooms, pack, plan


def one_by_one(lengths, window):
    """Best-fit decreasing, a piece at a time: the room used of every window in the order of opening."""
    rooms = []
    for length in sorted(lengths, reverse=True):
        fitting = [room for room in rooms if room >= length]
        if fitting:
            k = rooms.index(min(fitting))
            rooms[k] -= length
        else:
            rooms.append(window - length)
    return sorted(rooms)


def placed(histogram, window):
    used = defaultdict(list)
    for length, low, high, first, each, base in plan(histogram, window):
        for k in range(high - low):
            used[first + k // each].append((base + k % each * length, length))
    return used


def test_plan_equals_best_fit_piece_by_piece():
    rnd = random.Random(1)
    for window in (7, 16, 50):
        for _ in range(60):
            lengths = [rnd.randint(1, window) for _ in range(rnd.randint(0, 120))]
            histogram = {n: lengths.count(n) for n in set(lengths)}
            used = placed(histogram, window)
            for pieces in used.values():
                at = 0
                for offset, length in sorted(pieces):
                    assert offset == at
                    at += length
                assert at <= window
            assert sorted(window - sum(n for _, n in pieces) for pieces in used.values()) == one_by_one(lengths, window)
            assert sorted(n for pieces in used.values() for _, n in pieces) == sorted(lengths)
            assert sorted(used) == list(range(len(used)))


def test_plan_size_does_not_follow_the_counts():
    small = plan({n: 3 for n in range(1, 257)}, 256)
    large = plan({n: 3_000_000 + n for n in range(1, 257)}, 256)
    assert len(large) <= 4 * 256 and len(small) <= 4 * 256


def test_tree_finds_tightest_room():
    rooms = Rooms(20)
    for room in (3, 9, 20):
        rooms.add(room, 0, 1)
    assert [rooms.tightest(n) for n in (1, 3, 4, 9, 10, 20)] == [3, 3, 9, 9, 20, 20]
    rooms.take(20)
    assert rooms.tightest(10) is None


def test_every_id_lies_in_one_piece(spark, words_file):
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice(["the", "Über", "it's", "42", "<|endoftext|>", "..."]) for _ in range(rnd.randint(0, 90))) for _ in range(60)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(60, None), (61, ""), (None, "null id"), (63, texts[0])]
    tokenizer = Tokenizer.from_file(words_file)
    ids = {k: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for k, t in rows}
    found = pack(awkward(spark, rows), words_file, window=32).collect()
    parts, windows = defaultdict(list), defaultdict(list)
    for r in found:
        piece = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert zlib.crc32(piece) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        parts[r.doc_id].append((r.start, r.length))
        windows[r.sequence_id].append((r.offset, r.length))
    for pieces, total in [(parts[k], len(ids[k])) for k in ids] + [(w, None) for w in windows.values()]:
        at = 0
        for start, length in sorted(pieces):
            assert start == at
            at += length
        assert at == total if total else at <= 32


def test_empty_table(spark, words_file):
    assert pack(awkward(spark, []), words_file).collect() == []
