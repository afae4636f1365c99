"""Exact and near duplicates, vectors and components against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from tablegauge.errors import TableGaugeError
from tablegauge.llm import embeddings, exactdup, graph, neardup
from tablegauge.llm.shared import Work

from .corpora import documents, empty, frame


def union(parents, a, b):
    def root(x):
        while parents[x] != x:
            x = parents[x]
        return x

    a, b = root(a), root(b)
    parents[max(a, b)] = min(a, b)
    return root


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near_by_hand(rows):
    sets = [(r[0], shingles(r[1])) for r in rows if r[0] is not None]
    parents = {i: i for i, _ in sets}
    for n, (i, s) in enumerate(sets):
        for j, t in sets[:n]:
            if i != j and s and t and 100 * len(s & t) >= 75 * len(s | t):
                union(parents, i, j)

    def root(x):
        while parents[x] != x:
            x = parents[x]
        return x

    return {i: root(i) for i in parents}


@pytest.mark.parametrize("fan_in", [2, 16])
def test_exact_duplicates(spark, fan_in):
    rows = documents()
    found = exactdup.exact_duplicates(frame(spark, rows), fan_in=fan_in).collect()
    groups = collections.defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")].append(r[0])
    wanted = collections.Counter()
    for text, ids in groups.items():
        low = min((i for i in ids if i is not None), default=None)
        for n, i in enumerate(sorted(ids, key=lambda x: (x is None, x))):
            wanted[(i, low, len(ids), n == 0, hashlib.sha256(text.encode()).hexdigest())] += 1
    assert collections.Counter(map(tuple, found)) == wanted
    kept = exactdup.without_exact_duplicates(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns and kept.count() == len(groups)


def test_near_duplicates(spark):
    rows = documents()
    wanted = near_by_hand(rows)
    found = neardup.near_duplicates(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    size = collections.Counter((r[0], len(shingles(r[1]))) for r in rows)
    assert collections.Counter((x.doc_id, x.n_shingles) for x in found) == size
    for x in found:
        if x.doc_id is not None:
            assert (x.component_id, x.kept) == (wanted[x.doc_id], x.doc_id == wanted[x.doc_id])
    kept = neardup.without_near_duplicates(frame(spark, rows))
    assert {r.doc_id for r in kept.collect()} - {None} == {i for i, c in wanted.items() if i == c}


def test_a_large_family_of_near_copies(spark):
    rng = random.Random(3)
    text = " ".join(f"w{rng.randrange(9000)}" for _ in range(200))
    family = [text + " " + " ".join(f"v{rng.randrange(9000)}" for _ in range(6)) for _ in range(300)]
    common = " ".join(f"p{k}" for k in range(60))
    quoting = [common + " " + " ".join(f"q{rng.randrange(9000)}" for _ in range(50)) for _ in range(300)]
    rows = [(i, t, "en", "a", 1, "", "", 1) for i, t in enumerate(family + quoting)]
    found = {x.doc_id: x.component_id for x in neardup.near_duplicates(frame(spark, rows)).collect()}
    assert all(found[i] == 0 for i in range(300)) and all(found[i] == i for i in range(300, 600))


@pytest.mark.parametrize("tile", [neardup.TILE, 1 << 10])
def test_a_family_around_the_threshold(spark, monkeypatch, tile):
    monkeypatch.setattr(neardup, "TILE", tile)
    rng = random.Random(11)
    text = " ".join(f"w{rng.randrange(9000)}" for _ in range(160))
    rows = []
    for i in range(150):
        tail = " ".join(f"v{rng.randrange(9000)}" for _ in range(rng.randrange(14, 40)))
        rows.append((i * 7 % 1009, f"{text} {tail}", "en", "a", 1, "", "", 1))
    rows += [(rows[k][0], rows[k + 40][1], "en", "a", 1, "", "", 1) for k in range(3)]  # ids with two texts
    wanted = near_by_hand(rows)
    assert 3 < len(set(wanted.values())) < 150
    assert {x.doc_id: x.component_id for x in neardup.near_duplicates(frame(spark, rows)).collect()} == wanted


def test_empty_tables(spark):
    assert exactdup.exact_duplicates(empty(spark)).collect() == []
    assert neardup.near_duplicates(empty(spark)).collect() == []
    assert neardup.without_near_duplicates(empty(spark)).collect() == []
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert embeddings.near_vectors(none).collect() == []


def test_components_of_a_long_chain(spark):
    order = list(range(60))
    random.Random(5).shuffle(order)
    links = spark.createDataFrame([(order[i], order[i + 1]) for i in range(59)] + [(100, 101), (7, 7)], "a bigint, b bigint")
    found = dict(graph.components(links, Work(spark)).collect())
    assert found == {**dict.fromkeys(range(60), 0), 100: 100, 101: 100}


def test_near_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(500, 16))
    family = base[0] + 0.02 * rng.normal(size=(80, 16))
    chain = [np.array([np.cos(t), np.sin(t)] + [0.0] * 14) for t in np.arange(6) * 0.3]
    vectors = [v.tolist() for v in np.concatenate([base, family, base[:30] * 3.0, base[40:60], chain])]
    rows = [(i * 3 % 2003, v) for i, v in enumerate(vectors)]
    rows += [(5000, None), (5001, []), (5002, [0.0] * 16), (5003, [float("nan")] * 16), (5004, [None] * 16), (5005, [1.0, 2.0]),
             (5006, [float("inf")] + [1.0] * 15), (5007, [2.0, 4.0]), (None, vectors[0])]
    found = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    good = [(i, np.array(v) / np.linalg.norm(v)) for i, v in rows[: len(vectors)]]
    unit = np.stack([u for _, u in good])
    close = unit @ unit.T >= 0.95
    ids = np.array([i for i, _ in good])
    label = ids.copy()
    for _ in range(20):
        label = np.array([label[c].min() for c in close])
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in found}
    assert len(found) == len(rows)
    for n, i in enumerate(ids):
        assert got[i] == (close[n].sum() - 1, label[n], bool(label[n] == i))
    assert got[5005] == (1, 5005, True) and got[5007] == (1, 5005, False)
    assert all(got[i] == (0, i, True) for i in (5000, 5001, 5002, 5003, 5004, 5006))


def test_near_vectors_finds_isolated_pairs(spark):
    """Links that are rare are found, not only those of large families."""
    rng = np.random.default_rng(12)
    base = rng.normal(size=(12_000, 24))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    away = rng.normal(size=(400, 24))
    away -= (away * base[:400]).sum(axis=1, keepdims=True) * base[:400]
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    family = base[500] + 0.01 * rng.normal(size=(3000, 24))
    vectors = np.concatenate([base, 0.9503 * base[:400] + np.sqrt(1 - 0.9503**2) * away, family])
    rows = list(enumerate(vectors.tolist()))
    found = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(4)).collect()
    got = {r.vec_id: r.component_id for r in found}
    assert sum(got[12_000 + i] == i for i in range(400)) >= 396


def test_near_vectors_raises_without_recall(spark, monkeypatch):
    for name, value in (("AUDIT", 64), ("MOST", 64), ("NEIGHBOURS", 1000)):
        monkeypatch.setattr(embeddings, name, value, raising=False)
    monkeypatch.setattr(embeddings, "_nearest", lambda proposals, neighbours: proposals.limit(0))
    rng = np.random.default_rng(3)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(300, 16)).tolist())]
    with pytest.raises(TableGaugeError):
        embeddings.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))


def test_recall_counts_nodes_not_pairs(spark):
    label = spark.createDataFrame([(i, 0) for i in range(100)], "node bigint, component bigint")
    pairs = [(0, i) for i in range(1, 100)] + [(200, 201)]
    assert embeddings.recall(spark.createDataFrame(pairs, "a bigint, b bigint"), label) == 0.5
    assert embeddings.tables_for(23) > 4 * embeddings.tables_for(9)
