"""Language of a text: a byte convolutional network over fixed-length windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bytes_of, drawn, parts_of, ship_package

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
SAMPLE = 1_500
LEAST = 8  # documents of every language, however many there are
WINDOWS_PER_LANGUAGE = 1_200
STEPS = 300
BATCH = 64
RATE = 0.02
NONE = "und"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[97:123] = _IS_LETTER[128:] = True


def windows(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows, WINDOW) lower-cased bytes that cover every text, and each window's text.

    A text's windows overlap by the widest filter less one, so each n-gram is in one of them; the
    last is filled up with zeros.
    """
    step = WINDOW - max(WIDTHS) + 1
    sizes = np.diff(at)
    number = np.where(sizes > 0, np.maximum(1, -(-(sizes - max(WIDTHS) + 1) // step)), 0)
    of_text = np.repeat(np.arange(len(sizes)), number)
    place = np.arange(len(of_text)) - np.repeat(np.cumsum(number) - number, number)
    begin = at[:-1][of_text] + place * step
    end = np.minimum(begin + WINDOW, at[1:][of_text])
    spots = begin[:, None] + np.arange(WINDOW)[None]
    inside = spots < end[:, None]
    rows = np.where(inside, _LOWER[data[np.minimum(spots, len(data) - 1)]], 0) if len(spots) else np.empty((0, WINDOW), np.uint8)
    return rows.astype(np.uint8), of_text


class ByteNet:
    """Filters of several widths over bytes, the maximum of each over the window, softmax.

    ``tables[w][k]`` holds what each byte adds to the filters of width w at place k; a convolution
    over one-hot bytes is a sum of looked-up rows.
    """

    def __init__(self, languages: list[str], tables: list[np.ndarray], out: np.ndarray, bias: np.ndarray):
        self.languages, self.tables, self.out, self.bias = languages, tables, out, bias

    def pooled(self, rows: np.ndarray, with_places: bool = False):
        maxima, places = [], []
        for width, table in zip(WIDTHS, self.tables):
            n = WINDOW - width + 1
            h = table[0][rows[:, :n]]
            for k in range(1, width):
                h += table[k][rows[:, k : k + n]]
            if with_places:
                places.append(h.argmax(axis=1))
            maxima.append(np.maximum(h.max(axis=1), 0.0))
        return np.concatenate(maxima, axis=1), places

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        out = np.empty((len(rows), len(self.languages)), np.float32)
        for i in range(0, len(rows), 128):  # stays in the processor's cache
            h, _ = self.pooled(rows[i : i + 128])
            z = h @ self.out + self.bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out[i : i + 128] = z / z.sum(axis=1, keepdims=True)
        return out

    @classmethod
    def train(cls, rows: np.ndarray, targets: np.ndarray, languages: list[str]) -> ByteNet:
        random = np.random.default_rng(11)
        classes = len(languages)
        tables = [random.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        out = random.normal(0, 0.1, (FILTERS * len(WIDTHS), classes)).astype(np.float32)
        net = cls(languages, tables, out, np.zeros(classes, np.float32))
        params = [*tables, net.out, net.bias]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        for step in range(1, STEPS + 1 if classes > 1 else 1):
            pick = random.integers(0, len(rows), BATCH)
            x, y = rows[pick], targets[pick]
            h, places = net.pooled(x, with_places=True)
            z = h @ net.out + net.bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            g = z / z.sum(axis=1, keepdims=True)
            g[np.arange(BATCH), y] -= 1
            g /= BATCH
            grads = [np.zeros_like(t) for t in tables]
            g_h = (g @ net.out.T) * (h > 0)
            each = np.arange(BATCH)[:, None]
            for i, width in enumerate(WIDTHS):
                part = g_h[:, i * FILTERS : (i + 1) * FILTERS]
                for k in range(width):
                    seen = x[each, places[i] + k]  # the byte at place k under each filter's maximum
                    np.add.at(grads[i][k], (seen, np.arange(FILTERS)[None]), part)
            grads += [h.T @ g + 1e-4 * net.out, g.sum(axis=0)]
            for p, d, (a, b) in zip(params, grads, moments):
                a += 0.1 * (d - a)
                b += 0.01 * (d * d - b)
                p -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)
        return net


def fit_language(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE,
) -> ByteNet:
    """Learn from about ``sample`` documents with a language, as many of each as there are, but not fewer than
    ``LEAST`` of any, so that every language is learned: those with the smallest id hashes; and of them at
    most ``WINDOWS_PER_LANGUAGE`` windows a language."""
    named = docs.where(F.col(text_col) != "").withColumnRenamed(lang_col, "lang")
    kinds = named.where(F.col("lang").isNotNull()).select("lang").distinct().count()
    each = max(LEAST, -(-sample // max(kinds, 1)))
    found = drawn(named, id_col, text_col, each, "lang", kinds).orderBy(F.xxhash64("id"), "id", "lang").select("text", "lang").toArrow()
    langs = np.array(found["lang"].to_pylist(), dtype=object)
    languages = sorted(set(langs.tolist())) or [NONE]
    if not len(langs):
        return ByteNet.train(np.zeros((1, WINDOW), np.uint8), np.zeros(1, np.int64), languages)
    rows, of_text = windows(*bytes_of(pa.concat_arrays(found["text"].chunks)))
    target = np.searchsorted(languages, langs)[of_text]
    random = np.random.default_rng(3)
    keep = np.concatenate([
        random.choice(np.flatnonzero(target == k), WINDOWS_PER_LANGUAGE) for k in range(len(languages)) if (target == k).any()
    ])
    return ByteNet.train(rows[keep], target[keep], languages)


def languages_of(docs: DataFrame, model: ByteNet, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: its id, lang_pred and score.

    The probabilities of a text are the mean over all its windows, weighted by their letters. A text
    that is null or has no letter is ``und`` with score 0. Ids and other columns play no part.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)  # a few hundred kB whatever the corpus

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*shared.value.languages, NONE], dtype=object)
        for whole in batches:
            for batch in parts_of(whole, "text", 1 << 20):
                n = len(batch)
                rows, of_text = windows(*bytes_of(batch.column("text")))
                p = shared.value.probabilities(rows)
                weight = _IS_LETTER[rows].sum(axis=1) + 1e-3
                mean = np.stack([np.bincount(of_text, weight * p[:, k], minlength=n) for k in range(p.shape[1])], axis=1)
                mean /= np.maximum(np.bincount(of_text, weight, minlength=n), 1e-9)[:, None]
                best = mean.argmax(axis=1)
                score = np.clip(mean[np.arange(n), best], 0.0, 1.0)
                some = np.asarray(batch.column("lettered").to_numpy(zero_copy_only=False), dtype=bool)
                yield pa.RecordBatch.from_arrays([
                    batch.column("id"), pa.array(names[np.where(some, best, -1)], pa.string()), pa.array(np.where(some, score, 0.0)),
                ], names=[id_col, "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    lettered = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("lettered")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), lettered)
    return texts.mapInArrow(predict, f"`{id_col}` {kind}, lang_pred string, score double")
