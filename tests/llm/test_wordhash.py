import random

import numpy as np

from larder.llm import wordhash


def test_words_are_hashed_whole_whatever_the_pieces(monkeypatch):
    rng = random.Random(3)
    for _ in range(200):
        text = bytes(rng.choice(b"ab \n\t\x0b") for _ in range(rng.randrange(150)))
        whole = wordhash.word_hashes(text)
        monkeypatch.setattr(wordhash, "PIECE", rng.randrange(1, 9))
        pieces = wordhash.word_hashes(text)
        monkeypatch.undo()
        words = text.split()
        assert whole.tolist() == pieces.tolist()
        assert len(set(zip(words, whole.tolist()))) == len(set(words)) and len(whole) == len(words)


def test_folding_changes_ascii_letters_only():
    plain, folded = (wordhash.word_hashes("Ab É ab é".encode(), v).tolist() for v in (wordhash.EXACT, wordhash.FOLDED))
    assert plain[0] != plain[2] and folded[0] == folded[2] and folded[1] != folded[3]


def test_short_texts_are_one_shingle():
    assert len(wordhash.shingle_set(b"")) == 0
    assert len(wordhash.shingle_set(b"one two")) == 1
    assert wordhash.shingle_set(b"one two").tolist() != wordhash.shingle_set(b"two one").tolist()
    assert len(wordhash.shingle_set(b"a b c d e f")) == 2


def test_sliding_min():
    x = np.array([5, 3, 4, 9, 1, 7], np.uint64)
    for width in range(1, 7):
        assert wordhash.sliding_min(x, width).tolist() == [min(x[i : i + width].tolist()) for i in range(len(x) - width + 1)]
