"""Word hashes against plain splitting, at block sizes that cut texts and words."""

import random

import pyarrow as pa
import pytest

from pixelloom.llm import words


def _check(texts, kind=pa.string()):
    column = pa.array(["cut away", *texts], kind).slice(1)
    hashes, cuts = words.words_of(column)
    assert len(cuts) == len(texts) + 1 and cuts[-1] == len(hashes)
    of, back = {}, {}
    for i, text in enumerate(texts):
        plain = (text or "").encode().lower().split()
        found = hashes[cuts[i] : cuts[i + 1]].tolist()
        assert len(plain) == len(found)
        for h, w in zip(found, plain, strict=True):
            assert of.setdefault(h, w) == w and back.setdefault(w, h) == h


@pytest.mark.parametrize("block", [4, 16, 64, words.BLOCK])
def test_against_split(monkeypatch, block):
    monkeypatch.setattr(words, "BLOCK", block)
    monkeypatch.setattr(words, "_UP", words._UP[:block])
    monkeypatch.setattr(words, "_DOWN", words._DOWN[:block])
    r = random.Random(block)
    for _ in range(100):
        _check([None if r.random() < 0.1 else "".join(r.choice("abAB é\t\n \x0b ") for _ in range(r.choice([0, 1, 5, 40, 300]))) for _ in range(r.randint(0, 12))])
    _check(["x" * 1000 + " y " + "z" * 3000, "z" * 3000 + "q", "", None, "Z" * 3000], pa.large_string())


def test_long_texts():
    _check(["word " * 300_000 + "x" * 700_000 + " end", "x" * 700_000, "", "word"])
