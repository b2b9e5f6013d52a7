"""Words without a space take time in proportion to their length, and are encoded as the library does."""

import random
import time

import numpy as np
import pytest

from silvergrain.llm import pieces, registry

PATH = registry.vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def ids(text):
    return np.frombuffer(pieces.model(PATH).encode_batch([text])[0], "<i4").tolist()


@pytest.mark.parametrize("alphabet", ["abcdefghijklmnopqrstuvwxyz", "etaoin", "a", "ab", "漢字かな交じり文", "é▁ ", " ", "01", "-=*", "𝄞a\t"])
@pytest.mark.parametrize("n", [1023, 1025, 5000])
def test_long_words_equal_the_library(library, alphabet, n):
    rng = random.Random(n)
    word = "".join(rng.choice(alphabet) for _ in range(n))
    text = f"so {word} it {word}x goes"
    assert ids(text) == library.encode(text)
    assert not any(len(w) > pieces.REMEMBERED_CHARS for w in pieces.model(PATH).known)


def test_400_000_letters():
    rng = random.Random(1)
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(400_000))
    start = time.monotonic()
    ids(word)
    assert time.monotonic() - start < 6
