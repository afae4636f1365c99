"""Personal data: rules for four kinds, and a character BiLSTM with CRF transitions that adds to them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drawn, parts_of, ship_package

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 1_500
WINDOW, STRIDE = 96, 48
HIDDEN = 16
STEPS, BATCH, RATE = 120, 64, 0.02
TAGS = 1 + 2 * len(KINDS)  # outside; first and further characters of each kind

# Where a run of first characters has no such rest, no part of the run has one either: it is passed
# over as a match without the group, so long runs are read once.
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)?")
_IP = re.compile(r"[0-9]++(\.[0-9]++\.[0-9]++\.[0-9]++)?")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_EMAIL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-@")
# Each kind of personal data holds one of these characters.
_TELLING = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) that the rules find, leftmost and without overlaps within a kind."""
    spans = []
    at = text.find("@")
    while at >= 0:  # an email lies in a run of the characters it may have
        a, b = at, at
        while a > 0 and text[a - 1] in _EMAIL_CHARS:
            a -= 1
        while b < len(text) and text[b] in _EMAIL_CHARS:
            b += 1
        spans += [(0, a + m.start(), a + m.end()) for m in _EMAIL.finditer(text[a:b]) if m[1]]
        at = text.find("@", b)
    for m in _IP.finditer(text):
        if m[1] and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            spans.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = _digits(m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            spans.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m.group())) <= 15:
            spans.append((3, m.start(), m.end()))
    return spans


def plausible(kind: int, text: str) -> bool:
    """What an added span has to have at least: the parts of its kind, however they are written."""
    digits = _digits(text)
    if kind == 0:
        name, at, host = text.partition("@")
        return bool(at and name.strip() and "." in host.strip(". "))
    if kind == 1:
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and all(int(p) <= 255 for p in parts if len(p) < 5) and all(len(p) < 4 for p in parts)
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    return "+" in text and 9 <= len(digits) <= 15


def _classes() -> np.ndarray:
    table = np.full(128, 1, np.uint8)
    table[48:58], table[65:91], table[97:123] = 2, 3, 4
    for n, c in enumerate("@.-+() _%/:\n", start=5):
        table[ord(c)] = n
    return table


_CLASS = _classes()
CLASSES = 18  # 0 is beyond the text, 17 a character that is not ASCII


def char_classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, _CLASS[np.minimum(points, 127)], 17).astype(np.uint8)


def telling_windows(text: str) -> list[int]:
    """Where windows begin that hold a digit or an at sign; their middles tile the text."""
    edge = (WINDOW - STRIDE) // 2
    found: list[int] = []
    for m in _TELLING.finditer(text):
        low = -((WINDOW - edge - 1 - m.start()) // STRIDE)
        for k in range(max(low, 0), (m.start() + edge) // STRIDE + 1):
            if not found or k > found[-1]:
                found.append(k)
    return [k * STRIDE - edge for k in found]


def cut_windows(classes: np.ndarray, begins: list[int], length: int = WINDOW) -> np.ndarray:
    spots = np.array(begins, np.int64)[:, None] + np.arange(length)[None]
    inside = (spots >= 0) & (spots < len(classes))
    return np.where(inside, classes[np.clip(spots, 0, len(classes) - 1)], 0)


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-x))


class Lstm:
    """One direction. ``table`` holds what each class of character adds to the gates."""

    def __init__(self, random):
        self.table = random.normal(0, 0.3, (CLASSES, 4 * HIDDEN)).astype(np.float32)
        self.table[:, HIDDEN : 2 * HIDDEN] += 1.0
        self.inner = random.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)).astype(np.float32)

    def run(self, x: np.ndarray, keep: bool = False):
        """States (length, rows, HIDDEN) for x (rows, length); with ``keep`` also what training needs."""
        n, length = x.shape
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out, kept = np.empty((length, n, HIDDEN), np.float32), []
        for t in range(length):
            z = self.table[x[:, t]] + h @ self.inner
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            if keep:
                kept.append((h, c, gates, g))
            c = f * c + i * g
            h = o * np.tanh(c)
            out[t] = h
            if keep:
                kept[-1] += (c,)
        return out, kept

    def gradients(self, x, kept, d_out):
        d_table, d_inner = np.zeros_like(self.table), np.zeros_like(self.inner)
        d_h, d_c = np.zeros_like(d_out[0]), np.zeros_like(d_out[0])
        for t in range(len(kept) - 1, -1, -1):
            h, c, gates, g, c_now = kept[t]
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            d_h = d_h + d_out[t]
            th = np.tanh(c_now)
            d_c = d_c + d_h * o * (1 - th * th)
            d_z = np.concatenate([
                d_c * g * i * (1 - i), d_c * c * f * (1 - f), d_h * th * o * (1 - o), d_c * i * (1 - g * g),
            ], axis=1)
            np.add.at(d_table, x[:, t], d_z)
            d_inner += h.T @ d_z
            d_h, d_c = d_z @ self.inner.T, d_c * f
        return d_table, d_inner


class PiiModel:
    def __init__(self):
        random = np.random.default_rng(5)
        self.ahead, self.behind = Lstm(random), Lstm(random)
        self.out = random.normal(0, 0.1, (2 * HIDDEN, TAGS)).astype(np.float32)
        self.bias = np.zeros(TAGS, np.float32)
        self.bias[0] = 1.0
        self.transitions = np.zeros((TAGS, TAGS), np.float32)
        # A further character follows only the first or a further one of its kind.
        self.allowed = np.ones((TAGS, TAGS), bool)
        for k in range(len(KINDS)):
            self.allowed[:, 2 + 2 * k] = False
            self.allowed[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = True

    def emissions(self, x: np.ndarray, keep: bool = False):
        a, kept_a = self.ahead.run(x, keep)
        b, kept_b = self.behind.run(x[:, ::-1], keep)
        states = np.concatenate([a, b[::-1]], axis=2)
        return states @ self.out + self.bias, states, kept_a, kept_b

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The likeliest tags (rows, length) under emissions and transitions."""
        scores, *_ = self.emissions(x)
        step = np.where(self.allowed, self.transitions, -1e4).astype(np.float32)
        best = scores[0].copy()
        best[:, 2::2] = -1e4
        back = np.empty((len(scores), len(x), TAGS), np.int8)
        for t in range(1, len(scores)):
            ways = best[:, :, None] + step[None]
            back[t] = ways.argmax(axis=1)
            best = ways.max(axis=1) + scores[t]
        tags = np.empty(x.shape, np.int8)
        tags[:, -1] = best.argmax(axis=1)
        rows = np.arange(len(x))
        for t in range(len(scores) - 1, 0, -1):
            tags[:, t - 1] = back[t, rows, tags[:, t]]
        return tags

    def train(self, x: np.ndarray, y: np.ndarray) -> None:
        """Maximum likelihood of whole tag sequences by Adam."""
        random = np.random.default_rng(9)
        params = [self.ahead.table, self.ahead.inner, self.behind.table, self.behind.inner, self.out, self.bias, self.transitions]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        for step in range(1, STEPS + 1):
            pick = random.integers(0, len(x), BATCH)
            rows, tags = x[pick], y[pick]
            scores, states, kept_a, kept_b = self.emissions(rows, keep=True)
            marginal, joint = self._marginals(scores)
            d = marginal.astype(np.float32)
            d[np.arange(d.shape[0])[:, None], np.arange(BATCH)[None], tags.T] -= 1
            d /= BATCH
            seen = np.zeros((TAGS, TAGS))
            np.add.at(seen, (tags[:, :-1], tags[:, 1:]), 1)
            d_states = d @ self.out.T
            d_out = np.einsum("tnh,tnk->hk", states, d)
            grads = [
                *self.ahead.gradients(rows, kept_a, d_states[:, :, :HIDDEN]),
                *self.behind.gradients(rows[:, ::-1], kept_b, d_states[::-1, :, HIDDEN:]),
                d_out, d.sum(axis=(0, 1)), ((joint - seen) / BATCH).astype(np.float32),
            ]
            size = np.sqrt(sum(float((g * g).sum()) for g in grads))
            for p, g, (a, b) in zip(params, grads, moments):
                g = g * min(1.0, 5.0 / (size + 1e-9))
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)

    def _marginals(self, scores):
        step = np.where(self.allowed, np.exp(self.transitions.astype(float)), 0.0)
        emit = np.exp(scores - scores.max(axis=2, keepdims=True)).astype(float) + 1e-12
        length = len(emit)
        ahead, behind = np.empty_like(emit), np.ones_like(emit)
        ahead[0] = emit[0]
        ahead[0][:, 2::2] = 1e-12
        for t in range(1, length):
            a = (ahead[t - 1] @ step) * emit[t]
            ahead[t] = a / a.sum(axis=1, keepdims=True)
        for t in range(length - 2, -1, -1):
            b = (behind[t + 1] * emit[t + 1]) @ step.T
            behind[t] = b / b.sum(axis=1, keepdims=True)
        both = ahead * behind
        marginal = both / both.sum(axis=2, keepdims=True)
        pair = ahead[:-1, :, :, None] * step * (emit * behind)[1:, :, None, :]
        pair /= pair.sum(axis=(2, 3), keepdims=True)
        return marginal, pair.sum(axis=(0, 1))


def _tags_of(length: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    tags = np.zeros(length, np.int64)
    # Longer spans first; a shorter one of another kind inside stays out.
    for kind, a, b in sorted(spans, key=lambda s: s[1] - s[2]):
        if not tags[a:b].any():
            tags[a], tags[a + 1 : b] = 1 + 2 * kind, 2 + 2 * kind
    return tags


def train_pii(texts: list[str]) -> PiiModel:
    """Learn from the spans that the rules label in the texts, and windows that only look alike."""
    model, x, y = PiiModel(), [], []
    random = np.random.default_rng(2)
    for text in texts:
        begins = telling_windows(text)
        if len(begins) > 24:
            begins = sorted(random.choice(begins, 24, replace=False).tolist())
        if begins:
            tags = _tags_of(len(text), base_spans(text))
            rows, marks = cut_windows(char_classes(text), begins), cut_windows(tags, begins)
            marks[:, 0] = np.where(marks[:, 0] % 2 == 0, np.maximum(marks[:, 0] - 1, 0), marks[:, 0])
            x.append(rows)
            y.append(marks)
    if x:
        x, y = np.concatenate(x), np.concatenate(y)
        # Each kind, and windows without any, come up about as often.
        kind = np.array([(r[r > 0][0] + 1) // 2 if (r > 0).any() else 0 for r in y])
        some = [np.flatnonzero(kind == k) for k in range(len(KINDS) + 1)]
        pick = np.concatenate([random.choice(s, 400) for s in some if len(s)])
        model.train(x[pick], y[pick])
    return model


def fit_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> PiiModel:
    """Learn from at most ``sample`` texts with a digit or an at sign, by the smallest id hashes."""
    texts = drawn(docs.where(F.col(text_col).rlike("[0-9@]")), id_col, text_col, sample)
    found = texts.orderBy(F.xxhash64("id"), "id").select("text").toArrow()
    return train_pii(found["text"].to_pylist())


def added_spans(model: PiiModel, texts: list[str], base: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """Spans the model finds beside the base ones.

    The tags of the windows' middles, which tile a text, are put on end, and spans are read from
    that sequence, however long they are. Where a span leaves the windows looked at, the next window
    is looked at as well. Spans that overlap a base span, or lack the parts of their kind, do not count.
    """
    edge = (WINDOW - STRIDE) // 2
    wanted = [(n, (begin + edge) // STRIDE) for n, text in enumerate(texts) for begin in telling_windows(text)]
    classes = {n: char_classes(texts[n]) for n in {n for n, _ in wanted}}
    looked, middles = set(wanted), {}
    while wanted:
        further = set()
        for i in range(0, len(wanted), 4096):
            part = wanted[i : i + 4096]
            tags = model.decode(np.concatenate([
                cut_windows(classes[n], [k * STRIDE - edge for _, k in own]) for n, own in groupby(part, itemgetter(0))
            ]))
            middle = tags[:, edge : edge + STRIDE]
            for r in np.flatnonzero(middle.any(axis=1)).tolist():
                n, k = part[r]
                middles[n, k] = middle[r]
                if k > 0 and _goes_on(middle[r, 0]):
                    further.add((n, k - 1))
                if (k + 1) * STRIDE < len(texts[n]) and _goes_on(tags[r, edge + STRIDE]):
                    further.add((n, k + 1))
        wanted = sorted(further - looked)
        looked |= further
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    order = sorted(middles)
    ruled = {n: np.zeros(len(texts[n]), bool) for n in {n for n, _ in order}}
    for n, by_rule in ruled.items():
        for _, a, b in base[n]:
            by_rule[a:b] = True
    # Windows of a text that follow each other differ from their place by the same number.
    for (n, _), run in groupby(range(len(order)), lambda i: (order[i][0], order[i][1] - i)):
        run = [order[i] for i in run]
        start = run[0][1] * STRIDE
        for kind, a, b in _spans_of(np.concatenate([middles[x] for x in run])):
            a, b = start + a, min(start + b, len(texts[n]))
            if a < b and not ruled[n][a:b].any() and plausible(kind, texts[n][a:b]):
                out[n].append((kind, a, b))
    return out


def _goes_on(tag: int) -> bool:
    """Whether the character is a further one of a span."""
    return tag > 0 and tag % 2 == 0


def _spans_of(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, start, end) of a sequence of tags; a further character of another kind starts a span."""
    kinds = (tags + 1) // 2
    before = np.concatenate([[0], kinds[:-1]])
    cuts = np.flatnonzero((tags % 2 == 1) | (kinds != before)).tolist()
    return [(int(kinds[a]) - 1, a, b) for a, b in zip(cuts, [*cuts[1:], len(tags)]) if kinds[a] > 0]


def personal_data(docs: DataFrame, model: PiiModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: its id and spans (kind, start, end, by_rule), by kind as in KINDS, then start.

    Offsets count code points, the end is exclusive. The rules' spans are always there; the model
    adds to them. The model looks at every window of the whole text that holds a digit or an at
    sign, without which none of the kinds exists. A null text counts as empty: no spans. Ids play
    no part and may repeat or be null; other columns are not looked at.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)  # a few thousand weights

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts_of(whole, "text"):
                texts = batch.column("text").fill_null("").to_pylist()
                base = [base_spans(t) if _TELLING.search(t) else [] for t in texts]
                added = added_spans(shared.value, texts, base)
                spans = []
                for b, a in zip(base, added):
                    every = sorted([(*s, True) for s in b] + [(*s, False) for s in a])
                    spans.append([{"kind": KINDS[k], "start": s, "end": e, "by_rule": r} for k, s, e, r in every])
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("by_rule", pa.bool_())]))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(spans, kind)], names=[id_col, "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, spans array<struct<kind: string, start: bigint, end: bigint, by_rule: boolean>>"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(find, schema)
