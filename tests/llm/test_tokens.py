import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from llm.helpers import awkward
from simloom.llm import token_files, tokens
from simloom.llm.prefix_counts import PrefixCounter, longest_within, prefix_counts, tokens_at
from simloom.llm.shared import new_folder, open_store
from simloom.llm.tokens import RUN, WordEncoder

SPECIAL = ["<|endoftext|> a<|startoftext|>b", "it's DON'T we'll", "x" * 500, "é", "a\x1cb\x85c", "", "<s> <0x0A>▁a", "ẞß K Å"]


def texts(alphabet, n=1500, seed=5):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


MIXED = "aAbBzZ éÉßÅĶ́\n\t\r .,'!?<|>_-019中İςΣ ﬁ"
COMMON = "aAbBzZ éÉßÅ\n\t\r .,'!?<|>_-019sSmMtT–’×÷"


def test_words_equal_the_library(words_file):
    tokenizer, own = Tokenizer.from_file(words_file), WordEncoder(words_file)
    for batch in (texts(MIXED), texts(COMMON), SPECIAL):
        wanted = [np.array(x.ids, "<u4").tobytes() for x in tokenizer.encode_batch(batch, add_special_tokens=False)]
        assert own.encode(batch) == wanted == own.encode(batch)
    assert own.encode([None]) == [b""]


def test_known_words_are_not_cut_again(words_file, monkeypatch):
    own, cut = WordEncoder(words_file), []

    class Counting:
        def findall(self, text):
            cut.append(text)
            return RUN.findall(text)

    monkeypatch.setattr(tokens, "RUN", Counting())
    batch = ["It's 2019, they'll say: don't!", "say it's  2019,\n(don't)", "x" * 500 + " y-" * 3]
    first = own.encode(batch)
    assert cut and own.encode(batch[:2]) == first[:2]
    before = len(cut)
    assert own.encode(batch) == first and len(cut) == before
    assert max(map(len, own.runs)) <= tokens.LONG_RUN


def test_prefix_counts_equal_the_library(pieces_file):
    import sentencepiece

    model, own = sentencepiece.SentencePieceProcessor(model_file=pieces_file), PrefixCounter(pieces_file)
    for text in texts(MIXED, 150) + SPECIAL:
        total, changes = own.count(text)
        assert total == len(model.encode(text)) and len(changes) == len(text)
        counts = [len(model.encode(text[:k])) for k in range(len(text) + 1)]
        assert [tokens_at(changes, k) for k in range(len(text) + 1)] == counts
        for budget in (0, 1, 5):
            assert longest_within(changes, budget) == max(k for k, n in enumerate(counts) if n <= budget)


def test_prefix_counts_of_a_table(spark, pieces_file):
    rows = [(1, None), (2, ""), (None, "é a"), (3, "word " * 20_000), (3, "word " * 20_000)]
    found = sorted(prefix_counts(awkward(spark, rows), pieces_file).collect(), key=lambda r: (r.n_bytes, str(r.doc_id)))
    assert [(r.doc_id, r.n_bytes, r.n_chars, len(r.changes)) for r in found] == [
        (1, 0, 0, 0), (2, 0, 0, 0), (None, 4, 3, 3), (3, 100_000, 100_000, 100_000), (3, 100_000, 100_000, 100_000)]
    assert found[3].n_tokens == tokens_at(found[3].changes, 100_000) == 20_001
    assert prefix_counts(awkward(spark, []), pieces_file).collect() == []


def test_token_files_round_trip(spark, words_file):
    rows = [(7, "the end"), (3, None), (5, ""), (None, "no id"), (9, "word " * 5000), (7, "the end"), (8, "Ünder ß")]
    folder = new_folder(spark, "tokens-test")
    manifest = token_files.write_tokens(awkward(spark, rows), folder, words_file, file_bytes=40)
    assert manifest.count() > 1
    found = token_files.read_entries(manifest, folder).collect()
    tokenizer = Tokenizer.from_file(words_file)
    start, wanted = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        wanted.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, found), key=lambda r: r[1]) == wanted
    store, root = open_store(folder)
    for row in manifest.collect():
        with store.open_input_file(f"{root}/{row.file}") as opened:
            tokens = token_files.TokenFile(opened)
            if 8 in tokens.doc_ids:
                assert tokens.document(8).tolist() == [*tokenizer.encode("Ünder ß", add_special_tokens=False).ids, 1]
                with pytest.raises(KeyError):
                    tokens.document(4)


def test_damage_is_noticed(spark, words_file):
    folder = new_folder(spark, "tokens-test")
    name = token_files.write_tokens(awkward(spark, [(1, "some text here")]), folder, words_file).first().file
    store, root = open_store(folder)
    with store.open_input_file(f"{root}/{name}") as opened:
        data = bytearray(opened.read())
    data[-10] ^= 1  # the checksum of the last frame
    with store.open_output_stream(f"{root}/{name}", compression=None) as out:
        out.write(bytes(data))
    with store.open_input_file(f"{root}/{name}") as opened, pytest.raises(ValueError):
        token_files.TokenFile(opened).document(1)


def test_no_documents(spark, words_file):
    assert token_files.token_entries(awkward(spark, []), words_file).collect() == []
