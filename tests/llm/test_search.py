"""Ranked search against scores computed one by one."""

import collections
import math
import random
import re

import pyarrow as pa
import pytest

from tablegauge.llm import search

from .corpora import WORDS, documents, empty, frame

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def by_hand(rows, items, top):
    docs = [(r[0], collections.Counter(terms(r[1]))) for r in rows]
    df = collections.Counter(t for _, c in docs for t in c)
    filled, length = sum(bool(c) for _, c in docs), sum(c.total() for _, c in docs)
    out = []
    for item, text in items:
        found = []
        for doc, c in docs:
            m = 100 - 75 + (75 * c.total() * filled) // length
            score = sum(
                math.floor(1000 * math.log((2 * filled + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in terms(text)
            )
            if score > 0:
                found.append((-score, doc is None, doc))
        found.sort(key=lambda f: (f[0], f[1], f[2] or 0))
        out += [(item, n, doc, -score) for n, (score, _, doc) in enumerate(found[:top], 1)]
    return collections.Counter(out)


def odd_rows():
    rng = random.Random(3)
    marks = [*" .,-_'\x00\x7f@[`{/:|\t\nÉé中 ’", "kadra", "KADRA", "lofel", "9", "x1"]
    rows = [(2000 + i, "".join(rng.choices(marks, k=rng.randrange(40))), None, None, 0, "", "", 0) for i in range(150)]
    return documents() + rows


ITEMS = [
    (1, "kadra lofel kadra"), (2, "Kadra-LOFEL, é 中!"), (2, "x1 9 9 kadrax"), (None, " ".join(WORDS)), (4, None), (5, "--"),
    (6, "nothing of this"), (7, "one"), (8, "kadra lofel kadra"),
]


@pytest.mark.parametrize("segment, cells, item_bytes", [(search.SEGMENT, search.CELLS, search.ITEM_BYTES), (40, 60, 30)])
def test_ranked(spark, monkeypatch, segment, cells, item_bytes):
    monkeypatch.setattr(search, "SEGMENT", segment)
    monkeypatch.setattr(search, "CELLS", cells)
    rows = odd_rows()
    items = spark.createDataFrame([(*i, "x", 3) for i in ITEMS], "item_id int, text string, source string, rank int")
    for top in (3, 10):
        found = search.ranked(frame(spark, rows), items, top=top, item_bytes=item_bytes)
        assert found.columns == ["item_id", "rank", "doc_id", "score"]
        assert collections.Counter(map(tuple, found.collect())) == by_hand(rows, ITEMS, top)


def test_scan_in_segments(monkeypatch):
    texts = [r[1] for r in odd_rows()]
    asked = search.Asked([(0, " ".join(WORDS)), (1, "é 中 9")])
    whole = search.scan(pa.array(texts), asked.automaton(), len(asked.terms))
    monkeypatch.setattr(search, "SEGMENT", 100)
    parts = search.scan(pa.array(texts), asked.automaton(), len(asked.terms))
    for a, b in zip(whole, parts):
        assert a.tolist() == b.tolist()
    n, doc, term, times = whole
    assert n.tolist() == [len(terms(t)) for t in texts]
    found = {(d, asked.terms[t].decode()): c for d, t, c in zip(doc.tolist(), term.tolist(), times.tolist())}
    wanted = {t.decode() for t in asked.terms}
    assert found == {(d, t): c for d, text in enumerate(texts) for t, c in collections.Counter(terms(text)).items() if t in wanted}


def test_best_keeps_ties_by_id():
    import numpy as np

    feed, merge, least = search._best(2, 2)
    for ids in (7, 3, 9, 5):
        feed(np.array([0]), np.array([10]), np.array([0]), np.array([ids]))
    item, score, missing, ids = merge()
    assert ids.tolist() == [3, 5] and least.tolist() == [10, 0]
    feed(np.array([0, 1]), np.array([11, 1]), np.array([0, 1]), np.array([1, 0]))
    item, score, missing, ids = merge()
    assert list(zip(item.tolist(), score.tolist(), missing.tolist(), ids.tolist())) == [(0, 11, 0, 1), (0, 10, 0, 3), (1, 1, 1, 0)]


def test_nothing(spark):
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    assert search.ranked(empty(spark), items).collect() == []
    assert search.ranked(frame(spark, documents(n=10)), items.limit(0)).collect() == []
    blank = frame(spark, [(1, None, None, None, 0, "", "", 0), (2, " -- ", None, None, 0, "", "", 0)])
    assert search.ranked(blank, items).collect() == []
