import pytest


@pytest.fixture(scope="session")
def words_file():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="session")
def pieces_file():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
