"""Cached token ids against the tokenizer."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tablegauge.llm import packing, tokens
from tablegauge.llm.queries import tokenizer_path

from .corpora import documents

MARKS = [
    *"aAbSTd'’.,!?%<|>1 9éÉ̸́̀ΣİſK \t\n\x0b\x1c\x85 中😀", "<|endoftext|>", "<|startoftext|>", "'s", "'RE", "<|", "|>",
    "zz" * 70, "q" * 300, "é" * 200, "|" * 400,
]


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def check(cached, whole, texts):
    ids, at = cached(pa.array(texts, pa.string()))
    assert len(at) == len(texts) + 1 and at[-1] == len(ids)
    for text, begin, end in zip(texts, at[:-1], at[1:]):
        assert ids[begin:end].tolist() == whole.encode(text or "", add_special_tokens=False).ids, repr(text)


def odd_texts(n):
    rng = random.Random(1)
    return ["".join(rng.choices(MARKS, k=rng.randrange(30))) for _ in range(n)]


def test_ids_are_the_tokenizers(whole):
    cached = tokens.TokenIds(tokenizer_path())
    texts = odd_texts(4000) + [r[1] for r in documents()]
    check(cached, whole, texts)
    check(cached, whole, texts[::-1])  # from the cache


def test_small_slices_and_a_full_cache(whole, monkeypatch):
    monkeypatch.setattr(tokens, "SEGMENT", 700)
    monkeypatch.setattr(tokens, "CACHED_WORDS", 50)
    monkeypatch.setattr(tokens, "_POWERS", [])
    cached = tokens.TokenIds(tokenizer_path())
    for _ in range(3):
        check(cached, whole, odd_texts(200) + [r[1] for r in documents(n=30)])
    assert len(cached.keys) < 400


def test_words_of_one_key_are_told_apart(whole, monkeypatch):
    monkeypatch.setattr(tokens, "mixed", lambda x: x & np.uint64(3) if x.flags.writeable and _first() else x)
    calls = iter(range(10**9))

    def _first():
        return next(calls) % 2 == 0  # the keys collide, the checks do not

    cached = tokens.TokenIds(tokenizer_path())
    for _ in range(2):
        check(cached, whole, [r[1] for r in documents(n=20)])


def test_nothing():
    cached = tokens.TokenIds(tokenizer_path())
    for texts in ([], [None], ["", " \n"]):
        ids, at = cached(pa.array(texts, pa.string()))
        assert len(ids) == 0 and at.tolist() == [0] * (len(texts) + 1)


def test_a_worker_keeps_little_memory(monkeypatch):
    """A worker outlives its task, so what packing leaves there burdens the stages that come after it."""
    met = []

    def tokenizer(column):
        met.append(sum(len(t) for t in column.to_pylist()))
        return np.empty(0, np.uint32), np.zeros(len(column) + 1, np.int64)

    monkeypatch.setattr(packing, "token_ids", lambda path: tokenizer)
    texts = pa.RecordBatch.from_pydict({"id": list(range(40)), "text": ["word " * 20_000] * 40})
    assert sum(len(b) for b in packing._pieces_of("", 2048, False)(iter([texts]))) == 40
    assert sum(met) == 40 * 100_000 and max(met) <= 1 << 19
    assert sum(x.nbytes for up_and_down in tokens._powers() for x in up_and_down) < 20 << 20
