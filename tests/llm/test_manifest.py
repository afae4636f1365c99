"""The Merkle manifest against trees built by hand."""

import collections
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablegauge.llm import manifest

from .corpora import documents, empty, frame


def places_by_hand(levels):
    """Node (depth, index) -> place, by storing the top tree and then each bottom tree."""
    out = []

    def lay(depth, index, levels):
        if levels == 1:
            out.append((depth, index))
            return
        upper = levels // 2
        lay(depth, index, upper)
        for k in range(1 << upper):
            lay(depth + upper, (index << upper) + k, levels - upper)

    lay(0, 0, levels)
    return {node: place for place, node in enumerate(out)}


@pytest.mark.parametrize("levels", range(1, 12))
def test_layout(levels):
    layout, places = manifest.VebLayout(levels), places_by_hand(levels)
    assert layout.size == len(places)
    for depth in range(levels):
        index = np.arange(1 << depth)
        assert layout.address(depth, index).tolist() == [places[depth, i] for i in index.tolist()]


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def value(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def tree(nodes):
    """The root, and per leaf the siblings (None where there is none) with their side."""
    steps, under = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        for i, leaves in enumerate(under):
            beside = nodes[i ^ 1] if i ^ 1 < len(nodes) else None
            for leaf in leaves:
                steps[leaf].append((beside, bool(i & 1)))
        nodes = [h(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        under = [sum(under[i : i + 2], []) for i in range(0, len(under), 2)]
    return nodes[0], steps


def by_hand(rows):
    kinds = collections.defaultdict(list)
    for r in rows:
        leaf = h(*[value(x) for x in (r[0], r[3], r[2], r[4], r[1])])
        kinds[r[2]].append((r[0] is not None, r[0] or 0, leaf))
    order = sorted(kinds, key=lambda k: (k is not None, (k or "").encode()))
    trees = [tree([leaf for *_, leaf in sorted(kinds[k])]) for k in order]
    root, tops = tree([subroot for subroot, _ in trees])
    out = collections.Counter()
    for k, (subroot, steps), top in zip(order, trees, tops):
        for (known, doc, leaf), own in zip(sorted(kinds[k]), steps):
            out[(doc if known else None, k, leaf, subroot, root, tuple(own + top))] += 1
    return out


@pytest.mark.parametrize("height", [1, 3, manifest.HEIGHT])
def test_manifest(spark, height):
    langs = ["en", None, "", "é", "fr", "en", "en", "en"]
    rows = [(*r[:2], langs[i % 8] if i > 3 else "lone" if i == 0 else "de", *r[3:]) for i, r in enumerate(documents())]
    rows += rows[20:30]
    made = manifest.merkle_manifest(frame(spark, rows), height=height, carry=["kept"])
    made = made.withColumn("up", manifest.folded(F.col("leaf"), F.col("steps"))).collect()
    found = collections.Counter(
        (r.doc_id, r.lang, r.leaf, r.subroot, r.root, tuple((s.sibling, s.left) for s in r.steps)) for r in made
    )
    assert found == by_hand(rows) and all(r.up == r.root for r in made)
    assert {r.kept for r in made} == {r[5] for r in rows}


def test_small_manifests(spark):
    assert manifest.merkle_manifest(empty(spark)).collect() == []
    one = [(None, None, None, None, None, None, None, None)]
    (r,) = manifest.merkle_manifest(frame(spark, one)).collect()
    assert r.leaf == r.subroot == r.root == h("-----") and r.steps == []


def test_a_change_shows(spark):
    rows = [r for r in documents(n=20) if r[4] is not None]
    before = {r.doc_id: r for r in manifest.merkle_manifest(frame(spark, rows)).collect()}
    after = [(*r[:4], r[4] + (i == 5), *r[5:]) for i, r in enumerate(rows)]
    after = {r.doc_id: r for r in manifest.merkle_manifest(frame(spark, after)).collect()}
    assert {d for d in before if before[d].leaf != after[d].leaf} == {rows[5][0]}
    assert before[rows[5][0]].root != after[rows[5][0]].root
