"""Document quality: ordinal cumulative-link regression over hashed features of the text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bytes_of, mixed, parts_of, ship_package, word_hashes

BUCKETS = 1 << 15
SAMPLE = 4_000
STEPS = 150
RATE = 0.3
PENALTY = 1e-5
SCALE = 20.0
CUT = 0.5

# What a byte looks like: lower case, upper case, digit, blank, line break; other marks stay themselves.
_KIND = np.arange(256, dtype=np.int64)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 1
_KIND[[32, 9, 11, 12]], _KIND[[10, 13]] = 4, 5


def hashed_features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, value) of the features of all texts; a bucket may come several times.

    Three views share the buckets: words; the shape of the text (three neighbouring kinds of
    characters, runs taken together); and tenths of words that repeat the one before, and of words
    that are new in the text. The first two are shares, so the length of a text does not weigh.
    """
    texts = len(at) - 1
    words, first = word_hashes(data, at)
    counts = np.diff(first)
    of_word = np.repeat(np.arange(texts), counts)
    rows, buckets, values = [], [], []

    def add(row, key, value):
        rows.append(row)
        buckets.append((key % np.uint64(BUCKETS)).astype(np.int64))
        values.append(value)

    add(of_word, words, SCALE / counts[of_word])

    kinds = _KIND[data]
    of_byte = np.repeat(np.arange(texts), np.diff(at))
    change = np.ones(len(data), bool)
    change[1:] = (kinds[1:] != kinds[:-1]) | (of_byte[1:] != of_byte[:-1])
    kinds, of_run = kinds[change], of_byte[change]
    if len(kinds) > 2:
        inside = of_run[2:] == of_run[:-2]
        shape = ((kinds[:-2] << 16) + (kinds[1:-1] << 8) + kinds[2:])[inside]
        row = of_run[2:][inside]
        add(row, mixed(shape.astype(np.uint64) + np.uint64(1)), SCALE / np.bincount(row, minlength=texts)[row])

    known = counts > 0
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (of_word[1:] == of_word[:-1])
    repeated = np.bincount(of_word[same], minlength=texts) / np.maximum(counts, 1)
    distinct = np.zeros(texts)
    order = np.lexsort((words, of_word))
    if len(order):
        w, d = words[order], of_word[order]
        new = np.ones(len(w), bool)
        new[1:] = (w[1:] != w[:-1]) | (d[1:] != d[:-1])
        distinct = np.bincount(d[new], minlength=texts) / np.maximum(counts, 1)
    # How many new words to expect depends on the length.
    length = np.minimum(np.log2(np.maximum(counts, 1)), 15).astype(np.int64)
    for tag, key in (
        (11, np.floor(repeated * 10).astype(np.int64)), (12, np.floor(distinct * 10).astype(np.int64) * 16 + length // 3),
        (13, (~known).astype(np.int64)),
    ):
        add(np.arange(texts), mixed((key + (tag << 32)).astype(np.uint64)), np.ones(texts))
    return np.concatenate(rows), np.concatenate(buckets), np.concatenate(values)


class OrdinalModel:
    """P(grade <= k) = logistic(threshold[k] - weights . features), thresholds in order."""

    def __init__(self, grades: list[int], thresholds: np.ndarray, weights: np.ndarray):
        self.grades, self.thresholds, self.weights = grades, thresholds, weights

    @classmethod
    def fit(cls, rows, buckets, values, ratings: np.ndarray) -> OrdinalModel:
        """Maximum likelihood by Adam; one grade only: that grade for every text."""
        grades = sorted(set(ratings.tolist()))
        if len(grades) < 2:
            return cls(grades or [0], np.empty(0), np.zeros(BUCKETS))
        y = np.searchsorted(grades, ratings)
        n, k = len(y), len(grades)
        share = np.clip(np.cumsum(np.bincount(y, minlength=k))[:-1] / n, 1e-3, 1 - 1e-3)
        theta = np.log(share / (1 - share))
        # The first threshold and the logarithms of the steps to the next ones.
        free = np.concatenate([theta[:1], np.log(np.maximum(np.diff(theta), 1e-3))])
        w = np.zeros(BUCKETS)
        moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(free), np.zeros_like(free)]
        for step in range(1, STEPS + 1):
            theta = free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))])
            score = np.bincount(rows, values * w[buckets], minlength=n)
            below = _logistic(np.concatenate([theta, [np.inf]])[y] - score)
            under = _logistic(np.concatenate([[-np.inf], theta])[y] - score)
            p = np.maximum(below - under, 1e-12)
            slope_below, slope_under = below * (1 - below) / p, under * (1 - under) / p
            g_score = (slope_below - slope_under) / n
            g_w = np.bincount(buckets, values * g_score[rows], minlength=BUCKETS) + PENALTY * w
            g_theta = np.zeros(k - 1)
            np.add.at(g_theta, y[y < k - 1], -slope_below[y < k - 1] / n)
            np.add.at(g_theta, y[y > 0] - 1, slope_under[y > 0] / n)
            tail = np.cumsum(g_theta[::-1])[::-1]
            g_free = np.concatenate([tail[:1], tail[1:] * np.exp(free[1:])])
            for x, g, a, b in ((w, g_w, 0, 1), (free, g_free, 2, 3)):
                moments[a] = 0.9 * moments[a] + 0.1 * g
                moments[b] = 0.99 * moments[b] + 0.01 * g * g
                x -= RATE * (moments[a] / (1 - 0.9**step)) / (np.sqrt(moments[b] / (1 - 0.99**step)) + 1e-8)
        theta = free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))])
        return cls(grades, theta, w)

    def judge(self, rows, buckets, values, texts: int) -> tuple[np.ndarray, np.ndarray]:
        """Per text the expected grade and the probability of the upper half of the grades."""
        score = np.bincount(rows, values * self.weights[buckets], minlength=texts)
        at_most = _logistic(self.thresholds[None, :] - score[:, None])
        edges = np.concatenate([np.zeros((texts, 1)), at_most, np.ones((texts, 1))], axis=1)
        share = np.diff(edges, axis=1)
        return share @ np.array(self.grades, dtype=float), share[:, (len(self.grades) + 1) // 2 :].sum(axis=1) if len(self.grades) > 1 else np.ones(texts)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in parts_of(whole, "text", 1 << 19):
            rows, buckets, values = hashed_features(*bytes_of(batch.column("text")))
            key = rows * BUCKETS + buckets
            key, place = np.unique(key, return_inverse=True)
            values = np.bincount(place, values).astype(np.float32)
            ends = np.searchsorted(key, np.arange(len(batch) + 1) * BUCKETS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column("rating"),
                pa.ListArray.from_arrays(pa.array(ends), pa.array((key % BUCKETS).astype(np.int32))),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(values)),
            ], names=["rating", "buckets", "values"])


def fit_quality(
    docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", rating_col: str = "quality",
    sample: int = SAMPLE,
) -> OrdinalModel:
    """Learn from at most ``sample`` rated documents, those with the smallest hashes of their ids.

    Null ratings do not count; a document rated several times counts once per rating. The features
    of the sample are made on the executors; its size bounds what the driver reads.
    """
    ship_package(docs.sparkSession)
    rated = ratings.select(F.col(id_col).alias("id"), F.col(rating_col).cast("bigint").alias("rating")).dropna()
    rated = rated.orderBy(F.xxhash64("id"), "id", "rating").limit(sample)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(rated), "id")
    texts = texts.orderBy(F.xxhash64("id"), "id", "rating").limit(sample).select("text", "rating")
    found = texts.mapInArrow(_sample_features, "rating bigint, buckets array<int>, values array<float>").toArrow()
    sizes = np.array([len(x) for x in found["buckets"]], dtype=np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    flat = [np.concatenate([np.asarray(c.flatten()) for c in found[n].chunks] or [np.empty(0)]) for n in ("buckets", "values")]
    return OrdinalModel.fit(rows, flat[0].astype(np.int64), flat[1].astype(float), np.asarray(found["rating"], dtype=np.int64))


def quality_scores(
    docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT, keep_columns: bool = False,
) -> DataFrame:
    """Per row of ``docs``: its id, expected_grade, upper_probability and kept.

    kept: the probability of the upper half of the grades is at least ``cut``. A null text is
    judged as an empty one; ids play no part and may repeat or be null. With ``keep_columns`` the
    result is instead the kept rows of ``docs``, all columns as they are.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)  # BUCKETS weights
    place = docs.columns.index(text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            named = whole.rename_columns([f"c{i}" for i in range(whole.num_columns)])  # names may clash
            for batch in parts_of(named, f"c{place if keep_columns else 1}", 1 << 19):
                text = batch.column(place if keep_columns else 1)
                grade, upper = shared.value.judge(*hashed_features(*bytes_of(text)), len(batch))
                if keep_columns:
                    yield batch.filter(pa.array(upper >= cut)).rename_columns(whole.schema.names)
                else:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0), pa.array(grade), pa.array(upper), pa.array(upper >= cut)],
                        names=[id_col, "expected_grade", "upper_probability", "kept"],
                    )

    if keep_columns:
        return docs.mapInArrow(score, docs.schema)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, expected_grade double, upper_probability double, kept boolean"
    return docs.select(id_col, text_col).mapInArrow(score, schema)
