"""Toxic spans: a linear-chain conditional random field over the words of a text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bytes_of, mixed, parts_of, ship_package

BUCKETS = 1 << 18
SAMPLE = 800  # labelled documents of either label
MIN_DOCUMENTS = 5
MIN_LIFT = 10.0
BY_CHANCE = 0.01
CUT = 0.7
CONTEXT = 6
EPOCHS = 60
TOXIC_STRETCHES, CLEAN_STRETCHES = 2_000, 8_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[97:123] = _IS_LETTER[65:91] = _IS_LETTER[128:] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        steps = [np.full(max(n + (n >> 3), 1 << 20), b, np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
        for x in steps:
            x[0] = 1
        _POWERS[:] = [np.cumprod(x) for x in steps]
    return _POWERS[0], _POWERS[1]


def letter_words(data: np.ndarray, at: np.ndarray):
    """(begin, end) bytes of all runs of letters, hashes of the whole run, its first and its last
    three bytes in lower case, and where each text's words begin."""
    inside = _IS_LETTER[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    some = at[1:] > at[:-1]
    first[at[:-1][some]] = inside[at[:-1][some]]
    last[at[1:][some] - 1] = inside[at[1:][some] - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])

    def key(b, e, tag):
        return mixed((sums[e] - sums[b]) * down[b] + np.uint64(tag))

    hashes = key(begin, end, 1), key(begin, np.minimum(begin + 3, end), 2), key(np.maximum(end - 3, begin), end, 3)
    return begin, end, hashes, np.searchsorted(begin, at)


class ToxicModel:
    """Two states per word, clean and toxic. Weights are those of toxic against clean."""

    def __init__(self, weights: np.ndarray, bias: float, transitions: np.ndarray, scale=(1.0, 0.0)):
        self.weights, self.bias, self.transitions, self.scale = weights, bias, transitions, scale

    def documents(self, p: np.ndarray, of_text: np.ndarray, texts: int) -> np.ndarray:
        """Per text a score from the marginals of its words: logistic in the logarithm of the summed
        evidence. Squares keep thousands of clean words from counting like a toxic one."""
        evidence = np.bincount(of_text, -np.log1p(-np.minimum(p * p, 1 - 1e-9)), minlength=texts)
        a, b = self.scale
        return 1.0 / (1.0 + np.exp(-np.clip(a * np.log(evidence + 1e-6) + b, -30, 30)))

    @staticmethod
    def features(hashes, first: np.ndarray) -> np.ndarray:
        """(words, 5) buckets: the word, its beginning and end, the words before and after it."""
        word, head, tail = hashes
        n = len(word)
        before, after = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        before[1:], after[:-1] = word[:-1], word[1:]
        starts = first[:-1][first[1:] > first[:-1]]
        ends = first[1:][first[1:] > first[:-1]] - 1
        before[starts], after[ends] = 0, 0
        columns = [word, head, tail, mixed(before + np.uint64(5)), mixed(after + np.uint64(6))]
        return np.stack([(c & np.uint64(BUCKETS - 1)).astype(np.int32) for c in columns], axis=1)

    def marginals(self, hashes, first: np.ndarray) -> np.ndarray:
        """Per word the probability of the toxic state given its whole text."""
        buckets = self.features(hashes, first)
        score = self.weights[buckets].sum(axis=1) + self.bias
        starts = first[:-1][first[1:] > first[:-1]]
        ends = first[1:][first[1:] > first[:-1]] - 1
        return chain_marginals(score, self.transitions, starts, ends)


def _products(m: np.ndarray, block: int = 64) -> np.ndarray:
    """All products m[0], m[0] m[1], ... of 2 x 2 matrices, each scaled to a sum of one.

    Blocks advance side by side; the products of whole blocks are found the same way.
    """
    n = len(m)
    if n <= block:
        out = m.copy()
        for t in range(1, n):
            x = out[t - 1] @ m[t]
            out[t] = x / x.sum()
        return out
    blocks = -(-n // block)
    padded = np.empty((blocks * block, 2, 2))
    padded[:n], padded[n:] = m, np.eye(2)
    # Step by step over the place in the block, all blocks at once: four planes, one per entry.
    a = np.ascontiguousarray(padded.reshape(blocks, block, 4).transpose(1, 2, 0))
    for t in range(1, block):
        p, q = a[t - 1], a[t]
        x = np.stack([
            p[0] * q[0] + p[1] * q[2], p[0] * q[1] + p[1] * q[3], p[2] * q[0] + p[3] * q[2], p[2] * q[1] + p[3] * q[3],
        ])
        a[t] = x / x.sum(axis=0)
    whole = a[-1].T.reshape(blocks, 2, 2)
    before = np.empty((blocks, 2, 2))
    before[0] = np.eye(2)
    before[1:] = _products(whole, block)[:-1]
    b = before.reshape(blocks, 4).T
    out = np.empty_like(a)
    out[:, 0] = b[0] * a[:, 0] + b[1] * a[:, 2]
    out[:, 1] = b[0] * a[:, 1] + b[1] * a[:, 3]
    out[:, 2] = b[2] * a[:, 0] + b[3] * a[:, 2]
    out[:, 3] = b[2] * a[:, 1] + b[3] * a[:, 3]
    out /= out.sum(axis=1, keepdims=True)
    return out.transpose(2, 0, 1).reshape(blocks * block, 2, 2)[:n]


def chain_marginals(score: np.ndarray, transitions: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Forward-backward over many chains on end; chains begin at ``starts`` and end at ``ends``."""
    if not len(score):
        return np.empty(0)
    p = 1.0 / (1.0 + np.exp(-np.clip(score, -30, 30)))
    emit = np.stack([1 - p, p], axis=1)
    step = np.exp(transitions)
    forward = step[None] * emit[:, None, :]
    forward[starts] = emit[starts][:, None, :]  # whatever came before is forgotten
    ahead = _products(forward)[:, 0, :]
    backward = np.empty((len(score), 2, 2))
    backward[:-1] = step[None] * emit[1:, None, :]
    backward[ends] = 1.0
    # Suffix products are prefix products of the transposed matrices, read from the end.
    behind = _products(backward[::-1].transpose(0, 2, 1))[::-1].transpose(0, 2, 1).sum(axis=2)
    both = ahead * behind
    return both[:, 1] / both.sum(axis=1)


def train_toxic(texts: list[bytes], labels: np.ndarray, clean_per_toxic: float | None = None) -> ToxicModel:
    """Learn from labelled texts.

    Words are labelled first: a word of a toxic text is toxic if it is in ``MIN_LIFT`` times as
    large a share of the toxic texts as of the clean ones, in ``MIN_DOCUMENTS`` of them, and this by
    the likelihood ratio happens by chance to fewer than ``BY_CHANCE`` words in all; all others are
    clean. Near copies, recognised by their smallest hash of three words, count once.
    Then the chain is trained by gradient descent on stretches: toxic words with their context, and
    stretches of clean texts. At last the score of a document is fitted to the labels, clean texts
    weighted so that there are ``clean_per_toxic`` as many of them, as in the whole table of labels.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    _, _, hashes, first = letter_words(data, at)
    word = hashes[0]
    of_text = np.repeat(np.arange(len(texts)), np.diff(first))
    if not len(word):
        return ToxicModel(np.zeros(BUCKETS), -10.0, np.zeros((2, 2)))
    three = mixed(word + np.roll(word, -1) * np.uint64(3) + np.roll(word, -2) * np.uint64(5))
    kin = np.zeros(len(texts), np.uint64)
    full = first[1:] > first[:-1]
    kin[full] = np.minimum.reduceat(three, first[:-1][full])
    _, kin = np.unique(np.stack([kin, labels.astype(np.uint64)], axis=1), axis=0, return_inverse=True)
    kin = kin.ravel()
    kin_label = np.zeros(kin.max() + 1, np.int64)
    kin_label[kin] = labels
    # A word counts once in a kin.
    _, once = np.unique(mixed(word + kin[of_text].astype(np.uint64) * np.uint64(_BASE)), return_index=True)
    names, place = np.unique(word[once], return_inverse=True)
    toxic_text = kin_label[kin[of_text[once]]] == 1
    n_toxic, n_clean = max(int((kin_label == 1).sum()), 1), max(int((kin_label != 1).sum()), 1)
    in_toxic = np.bincount(place, toxic_text, minlength=len(names))
    in_clean = np.bincount(place, ~toxic_text, minlength=len(names))
    lift = ((in_toxic + 0.5) / n_toxic) / ((in_clean + 0.5) / n_clean)
    # How unlikely the split is by chance, with as many words to choose from.
    both = in_toxic + in_clean
    chance = [np.maximum(both * n / (n_toxic + n_clean), 1e-9) for n in (n_toxic, n_clean)]
    ratio = sum(x * np.log(np.maximum(x, 1e-9) / e) for x, e in zip((in_toxic, in_clean), chance))
    offending = names[(in_toxic >= MIN_DOCUMENTS) & (lift >= MIN_LIFT) & (ratio >= np.log(len(names) / BY_CHANCE))]
    tag = (np.isin(word, offending) & (labels[of_text] == 1)).astype(np.int8)

    buckets = ToxicModel.features(hashes, first)
    random = np.random.default_rng(7)
    toxic = np.flatnonzero(tag)
    clean = np.flatnonzero(labels[of_text] != 1)
    toxic = random.permutation(toxic)[:TOXIC_STRETCHES]
    clean = random.permutation(clean)[:CLEAN_STRETCHES]
    centres = np.concatenate([toxic, clean])
    if not len(toxic):
        return ToxicModel(np.zeros(BUCKETS), -10.0, np.zeros((2, 2)))
    length = 2 * CONTEXT + 1
    span = centres[:, None] + np.arange(-CONTEXT, CONTEXT + 1)[None]
    inside = (span >= first[of_text[centres]][:, None]) & (span < first[of_text[centres] + 1][:, None])
    span = np.clip(span, 0, len(word) - 1)
    x, y = buckets[span], tag[span].astype(float)
    w, bias, trans = np.zeros(BUCKETS), -4.0, np.zeros((2, 2))
    past_w, past_b, past_t = np.full(BUCKETS, 1e-6), 1e-8, np.full((2, 2), 1e-8)
    for _ in range(EPOCHS):
        score = np.where(inside, w[x].sum(axis=2) + bias, 0.0)
        marginal, joint = _stretch_marginals(score, trans, inside)
        g = np.where(inside, marginal - y, 0.0) / len(centres)
        g_w = np.bincount(x.ravel(), np.repeat(g.ravel(), x.shape[2]), minlength=BUCKETS) + 1e-6 * w
        seen = np.zeros((2, 2))
        linked = inside[:, 1:] & inside[:, :-1]
        for i in (0, 1):
            for j in (0, 1):
                seen[i, j] = ((y[:, :-1] == i) & (y[:, 1:] == j) & linked).sum()
        g_t = (joint - seen) / (len(centres) * length) + 1e-3 * trans
        past_w += g_w * g_w
        past_b += g.sum() ** 2
        past_t += g_t * g_t
        w -= 0.5 * g_w / np.sqrt(past_w)
        bias -= 0.5 * g.sum() / np.sqrt(past_b)
        trans -= 0.1 * g_t / np.sqrt(past_t)
    model = ToxicModel(w, float(bias), trans)
    here = max(int((labels != 1).sum()), 1) / max(int((labels == 1).sum()), 1)
    weights = np.where(labels == 1, 1.0, (clean_per_toxic or here) / here)
    model.scale = _fitted_scale(model, hashes, first, of_text, labels, weights)
    return model


def _fitted_scale(model: ToxicModel, hashes, first, of_text, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """The logistic scale of document scores, by Newton's method in short steps."""
    evidence = np.zeros(len(labels))
    cuts = np.unique(np.searchsorted(first, np.arange(0, len(of_text) + 100_000, 100_000)))  # some texts at a time
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        b = min(b, len(labels))
        part = slice(first[a], first[b])
        p = model.marginals([h[part] for h in hashes], first[a : b + 1] - first[a])
        evidence += np.bincount(of_text[part], -np.log1p(-np.minimum(p * p, 1 - 1e-9)), minlength=len(labels))
    x = np.log(evidence + 1e-6)
    mean, spread = x.mean(), x.std() + 1e-6
    x = np.stack([(x - mean) / spread, np.ones_like(x)], axis=1)
    theta = np.zeros(2)
    for _ in range(100):
        s = 1.0 / (1.0 + np.exp(-(x @ theta)))
        hessian = (x * (weights * s * (1 - s))[:, None]).T @ x + 0.1 * np.eye(2)
        move = np.linalg.solve(hessian, x.T @ (weights * (s - labels)) + 0.1 * theta)
        theta = theta - move * min(1.0, 0.5 / (np.abs(move).max() + 1e-12))
    a = float(max(theta[0], 0.05)) / float(spread)
    return a, float(theta[1]) - a * float(mean)


def _stretch_marginals(score, transitions, inside):
    """Marginals of stretches of one length, and expected numbers of transitions."""
    n, length = score.shape
    p = 1.0 / (1.0 + np.exp(-np.clip(score, -30, 30)))
    emit = np.stack([1 - p, p], axis=2)
    step = np.exp(transitions)
    ahead, behind = np.empty_like(emit), np.ones_like(emit)
    ahead[:, 0] = emit[:, 0]
    for t in range(1, length):
        x = (ahead[:, t - 1] @ step) * emit[:, t]
        x = np.where((inside[:, t] & inside[:, t - 1])[:, None], x, emit[:, t])
        ahead[:, t] = x / x.sum(axis=1, keepdims=True)
    for t in range(length - 2, -1, -1):
        x = (behind[:, t + 1] * emit[:, t + 1]) @ step.T
        x = np.where((inside[:, t] & inside[:, t + 1])[:, None], x, 1.0)
        behind[:, t] = x / x.sum(axis=1, keepdims=True)
    both = ahead * behind
    marginal = both[:, :, 1] / both.sum(axis=2)
    linked = inside[:, 1:] & inside[:, :-1]
    pair = ahead[:, :-1, :, None] * step * (emit * behind)[:, 1:, None, :]
    pair /= pair.sum(axis=(2, 3), keepdims=True)
    return marginal, (pair * linked[:, :, None, None]).sum(axis=(0, 1))


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE,
) -> ToxicModel:
    """Learn from at most ``sample`` documents of either label, those with the smallest id hashes."""
    marked = labels.select(F.col(id_col).alias("id"), (F.col(label_col) > 0).cast("int").alias("toxic")).dropna()
    clean, toxic = marked.agg(F.count(F.when(F.col("toxic") == 0, 1)), F.count(F.when(F.col("toxic") == 1, 1))).first()
    by_hash = [F.xxhash64("id"), F.col("id"), F.col("toxic")]
    marked = marked.where("toxic = 1").orderBy(*by_hash).limit(sample).unionAll(marked.where("toxic = 0").orderBy(*by_hash).limit(sample))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).dropna().join(F.broadcast(marked), "id")
    found = texts.orderBy(*by_hash).limit(2 * sample).select("text", "toxic").toArrow()
    raw = [t.encode() for t in found["text"].to_pylist()]
    return train_toxic(raw, np.asarray(found["toxic"], dtype=np.int64), clean / toxic if clean and toxic else None)


def toxic_spans(
    docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT,
) -> DataFrame:
    """Per row of ``docs``: its id, score, predicted and spans (start, end, probability).

    The score rises with the expected number of toxic words, as fitted to the labels. Spans are words with a marginal of one half or more; their offsets count code points,
    the end is exclusive. A null or empty text, or one without letters, has the lowest score and no spans.
    Ids play no part and may repeat or be null; other columns are not looked at.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)  # BUCKETS weights

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts_of(whole, "text", 1 << 20):
                data, at = bytes_of(batch.column("text"))
                begin, end, hashes, first = letter_words(data, at)
                p = shared.value.marginals(hashes, first) if len(begin) else np.empty(0)
                of_text = np.repeat(np.arange(len(batch)), np.diff(first))
                found = np.flatnonzero(p >= 0.5)
                # Continuation bytes do not count as code points.
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                base = points[at[of_text[found]]]
                spans = pa.StructArray.from_arrays([
                    pa.array(points[begin[found]] - base), pa.array(points[end[found]] - base), pa.array(p[found]),
                ], names=["start", "end", "probability"])
                edges = np.searchsorted(found, first).astype(np.int32)
                total = shared.value.documents(p, of_text, len(batch))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(total), pa.array((total >= cut).astype(np.int32)),
                     pa.ListArray.from_arrays(pa.array(edges), spans)],
                    names=[id_col, "score", "predicted", "spans"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, score double, predicted int, spans array<struct<start: bigint, end: bigint, probability: double>>"
    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(score, schema)
