"""Mixing, packing and the pipeline."""

import collections
import os
import random
import re
import zlib

import numpy as np
import pytest

from tablegauge.llm import mixing, packing
from tablegauge.llm.queries import tokenizer_path

from .corpora import documents, empty, frame


def targets_by_hand(rows):
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1.0 + n % 3 for n, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in fixed]
        each = (total - sum(fixed.values())) / (sum(weight[s] for s in rest) or 1)
        over = [s for s in rest if weight[s] * each > 3 * sizes[s]]
        if not over:
            return sizes, {**fixed, **{s: weight[s] * each for s in rest}}
        fixed |= {s: 3.0 * sizes[s] for s in over}


def test_mixing(spark):
    rows = documents(n=200)
    sizes, targets = targets_by_hand(rows)
    found = mixing.mixed_copies(frame(spark, rows)).collect()
    again = mixing.mixed_copies(frame(spark, rows).repartition(3)).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(found, key=key) == sorted(again, key=key) and len(found) == len(rows)
    taken = collections.Counter()
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
        assert r.taken == r.copies * r.size and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    # One document is larger than the rest of its source: whether it is taken decides there.
    huge = {r.source: r.size for r in found if r.size > 5000}
    for s in targets:
        assert abs(taken[s] - targets[s]) <= max(150, huge.get(s, 0) / 2), s
    copied = mixing.mix_sources(frame(spark, rows))
    assert copied.columns == frame(spark, rows).columns and copied.count() == sum(r.copies for r in found)


def test_mixing_of_sources_with_few_documents(spark):
    """Where nearly every document is large beside its source, the words still come near the target."""
    rng, rows = random.Random(12), []
    for n in range(12):
        lengths = [rng.randint(10, 900) for _ in range(49)] + [3700]
        rows += [(100 * n + i, "w " * k, None, f"s{n:02}", 1, "", "", 1) for i, k in enumerate(lengths)]
    found = mixing.mixed_copies(frame(spark, rows)).collect()
    taken = collections.Counter()
    for r in found:
        taken[r.source] += r.taken
    for source, target in {(r.source, r.target) for r in found}:
        assert abs(taken[source] - target) <= 0.005 * target, source


def test_mixing_keeps_expectations(spark):
    """Over many documents of one size, as many copies as the target asks for, in every block."""
    rows = [(i, "a b c", None, "x" if i % 3 else "y", 1, "", "", 1) for i in range(900)]
    found = mixing.mixed_copies(frame(spark, rows), block=8).collect()
    for source in "xy":
        mine = [r for r in found if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 3


def test_mixing_empty(spark):
    assert mixing.mixed_copies(empty(spark)).collect() == []
    none = frame(spark, [(1, None, None, None, None, None, None, None), (2, "", None, "a", 0, "", "", 0)])
    assert {(r.size, r.taken, r.target) for r in mixing.mixed_copies(none).collect()} == {(0, 0, 0.0)}


def sum_of_squares_by_hand(sizes, capacity):
    gaps, out = [], []
    for s in sizes:
        def squares(change):
            n = collections.Counter(g for g in gaps if 0 < g < capacity)
            for g, d in change:
                if 0 < g < capacity:
                    n[g] += d
            return sum(v * v for v in n.values())

        options = [(squares([(g, -1), (g - s, 1)]), g) for g in sorted({g for g in gaps if g >= s})]
        new = squares([(capacity - s, 1)])
        if options and min(options)[0] <= new:
            g = min(options)[1]
            gaps[len(gaps) - 1 - gaps[::-1].index(g)] -= s
        else:
            gaps.append(capacity - s)
        out.append(sorted(gaps))
    return out


def test_sum_of_squares_rule():
    rng = random.Random(4)
    for capacity in (5, 12, 30):
        sizes = [rng.randint(1, capacity) for _ in range(60)]
        bins, places = packing.sum_of_squares(np.array(sizes), capacity)
        fill, out = collections.Counter(), []
        for s, b, p in zip(sizes, bins.tolist(), places.tolist()):
            assert fill[b] == p
            fill[b] += s
            out.append(sorted(capacity - f for f in fill.values()))
        assert out == sum_of_squares_by_hand(sizes, capacity)


@pytest.mark.parametrize("group", [20, packing.GROUP])
def test_packing(spark, group):
    from tokenizers import Tokenizer

    rows = documents()
    tokenizer = Tokenizer.from_file(tokenizer_path())
    found = packing.packed_sequences(frame(spark, rows), tokenizer_path(), group=group, with_ids=True).collect()
    wanted = collections.Counter()
    for r in rows:
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = np.array(ids[k : k + 2048], "<u4").tobytes()
            wanted[(r[0], k // 2048, k, len(part) // 4, zlib.crc32(part), part)] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in found) == wanted
    sequences = collections.defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 2048
    total = sum(r.length for r in found)
    assert len(sequences) <= -(-total // 2048) * (1.02 if group > 1000 else 1.2) + 2
    assert packing.packed_sequences(empty(spark), tokenizer_path()).collect() == []


def test_packing_stops_where_nothing_fits_together(spark):
    """Pieces that cannot share a sequence: no group grows, and no more than one further round is tried."""
    text = " ".join(["word"] * 1100)
    rows = [(i, text, None, None, 0, "", "", 0) for i in range(300)]
    docs = frame(spark, rows).select("doc_id", "text")
    tasks = []
    pack = packing._pack

    def counted(capacity):
        tasks.append(capacity)
        return pack(capacity)

    packing._pack = counted
    try:
        found = packing.packed_sequences(docs, tokenizer_path(), group=20).collect()
    finally:
        packing._pack = pack
    assert len({r.sequence_id for r in found}) == len(found) == 300 and len(tasks) == 2


SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the tables are not here")
def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF_DIR)
        counts.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
        if name == "near dedup":
            texts = [r.text for r in docs.collect()]
            assert len(texts) == len({re.sub(r"[\x20\x09-\x0D]+", " ", t) for t in texts}) and counts[-1] < counts[0]
    assert {(r.doc_id) for r in docs.collect()} == {r.doc_id for r in before.collect()}
    packed = corpus_pipeline.run(spark, SF_DIR).count()
    assert packed == counts[-1]
