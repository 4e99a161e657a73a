"""The encoder's cache: whatever its size, ids are the library's, and rare words give way."""

import random

import numpy as np
import pytest

VOCABULARIES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


def texts():
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdeéüñß'0129 \t.,-ABÀ") for _ in range(rnd.randrange(1, 9)))
    return [" ".join(word() for _ in range(rnd.randrange(60))) for _ in range(120)] + ["", " ", "naïve <|endoftext|> b", "漢字 and more", "a" * 3000]


@pytest.mark.parametrize("vocabulary", VOCABULARIES)
@pytest.mark.parametrize("cache_words", [1, 10, 100_000])
def test_ids_equal_the_library(vocabulary, cache_words):
    import public_tokenizers
    from tokenizers import Tokenizer

    from tidemark.llm.bpe import Encoder

    path = public_tokenizers.path(vocabulary)
    library, own = Tokenizer.from_file(path), Encoder(path, added_tokens=True, cache_words=cache_words)
    asked = texts()
    for at in range(0, len(asked), 16):
        part = asked[at : at + 16]
        got = [np.frombuffer(ids, "<u4").tolist() for ids in own.encode(part)]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in part]
    assert len(own.old) + len(own.young) > 0
    if cache_words == 10:
        largest = max(len({w for t in asked[at : at + 16] for w in own._split(t) or []}) for at in range(0, len(asked), 16))
        assert len(own.young) <= max(5, largest) and len(own.old) <= max(5, largest)


def test_planes_of_either_width():
    from tidemark.llm.wavelet import Shard, build

    for top in (1, 2, 65_535, 65_536, 200_000):
        ids = np.random.default_rng(top).integers(0, top + 1, 5000)
        ids[0] = top
        shard = Shard(build(ids, np.array([4]), np.array([0, len(ids)])))
        assert (shard.all_ids() == ids).all() and shard.all_ids().dtype == np.uint32
        assert (shard.access(np.arange(0, 5000, 7)) == ids[::7]).all()
        assert shard.occurrences(int(ids[9])) == np.flatnonzero(ids == ids[9]).tolist()
