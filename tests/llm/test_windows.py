"""Bounded-space packing: an exact round trip, and placement against a plain version."""

import collections
import random
import zlib

import numpy as np
import pytest

from tablegauge.llm import windows
from tablegauge.llm.queries import tokenizer_path

from .corpora import documents, empty, frame


def by_hand(sizes, capacity, most):
    """Contents of all windows, in the order in which they leave."""
    open_windows, out, number = [], [], 0
    for doc, size in enumerate(sizes):
        start = 0
        while start < size:
            left = size - start
            fits = [w for w in open_windows if capacity - w[1] >= left]
            if fits:
                w = min(fits, key=lambda w: (capacity - w[1], w[0]))
            elif left >= capacity or len(open_windows) < most:
                w = [number, 0, []]
                number += 1
                open_windows.append(w)
            else:
                w = min(open_windows, key=lambda w: (capacity - w[1], w[0]))
            take = min(left, capacity - w[1])
            w[2].append((doc, start, take))
            w[1] += take
            start += take
            if w[1] == capacity:
                open_windows.remove(w)
                out.append((w[0], w[2]))
    return out, sorted((w[0], w[2]) for w in open_windows)


@pytest.mark.parametrize("capacity, most", [(8, 1), (16, 3), (50, 7)])
def test_placement(capacity, most):
    rng = random.Random(capacity)
    sizes = [rng.randint(1, 2 * capacity) if rng.random() < 0.2 else rng.randint(1, capacity) for _ in range(400)]
    w, left = windows.Windows(capacity, most), []
    for doc, size in enumerate(sizes):
        for number, pieces in w.add(doc, size, 0, np.arange(size, dtype=np.uint32)):
            left.append((number, [(d, s, len(ids)) for d, _, s, ids in pieces]))
            assert all(ids.tolist() == list(range(s, s + len(ids))) for _, _, s, ids in pieces)
        assert len(w.gaps) <= most and len(w.held) == len(w.gaps)
    rest = sorted((number, [(d, s, len(ids)) for d, _, s, ids in pieces]) for number, pieces in w.rest())
    assert (left, rest) == by_hand(sizes, capacity, most)


def test_cut():
    ids = np.arange(100, dtype=np.uint32)
    pieces = [(0, 30, 0, ids[:30]), (1, 70, 5, ids[30:61])]
    runs = list(windows._cut(pieces, [32, 16, 8, 4, 1]))
    assert [sum(len(p[3]) for p in r) for r in runs] == [32, 16, 8, 4, 1]
    assert [x for r in runs for p in r for x in p[3].tolist()] == list(range(61))
    assert runs[0][1][:3] == (1, 70, 5) and runs[1][0][:3] == (1, 70, 7)


@pytest.mark.parametrize("parts, most, merged", [(1, 64, 64), (9, 3, 2), (30, 64, 4)])
def test_round_trip(spark, monkeypatch, parts, most, merged):
    from tokenizers import Tokenizer

    monkeypatch.setattr(windows, "MERGED", merged)
    monkeypatch.setattr(windows, "ROWS", 7)
    rows = documents()
    tokenizer = Tokenizer.from_file(tokenizer_path())
    docs = frame(spark, rows).repartition(parts)
    found = windows.packed_windows(docs, tokenizer_path(), most_open=most, with_ids=True).collect()
    wanted = collections.Counter((r[0], tuple([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1])) for r in rows)

    # Repeated ids: pieces of one document have its tokens; every id lies in one piece.
    spans = collections.Counter()
    for r in found:
        data = np.frombuffer(r.ids, "<u4")
        assert len(data) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        spans.update((r.doc_id, r.doc_tokens, r.start + k, int(x)) for k, x in enumerate(data))
    every = collections.Counter()
    for (doc, ids), n in wanted.items():
        for k, x in enumerate(ids):
            every[(doc, len(ids), k, x)] += n
    assert spans == every

    sequences = collections.defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    total = 0
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end == 2048 or end < 2048 and end & (end - 1) == 0
        total += end
    assert len(sequences) <= total // 2048 + 11


def test_nothing(spark):
    assert windows.packed_windows(empty(spark), tokenizer_path()).collect() == []
    found = windows.packed_windows(frame(spark, [(None, None, None, None, None, None, None, None)]), tokenizer_path()).collect()
    assert [(r.doc_id, r.start, r.length, r.doc_tokens, r.offset) for r in found] == [(None, 0, 1, 1, 0)]
