"""The trained operators: held-out accuracy, and the parts of them that have exact answers."""

import itertools
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tablegauge.llm import language, lmscore, pii, quality, toxicity
from tablegauge.llm.shared import bytes_of, drawn, word_hashes

from .corpora import SCHEMA, documents, empty, frame, words

AWKWARD = [(9001, None, None, None, None, None, None, None), (9002, "", None, None, 0, "", "", 0), (9003, "12 34 !!", None, "a", 1, "", "", 0)]


def labelled(spark, make, n=300):
    """(documents, labels) where make(rng, label) writes a text."""
    rng = random.Random(8)
    marks = [rng.randrange(2) for _ in range(n)]
    rows = [(i, make(rng, m), None, "s", 1, "x", "y", 1) for i, m in enumerate(marks)]
    return frame(spark, rows + AWKWARD + rows[:3]), spark.createDataFrame(list(enumerate(marks)) + [(5, None)], "doc_id bigint, label int")


def accuracy(found, labels, column, least):
    marks = {r.doc_id: r.label for r in labels.collect() if r.label is not None}
    held = [r for r in found if r.doc_id in marks and r.doc_id % 5 == 0]
    assert np.mean([marks[r.doc_id] == int(r[column]) for r in held]) >= least


def test_quality(spark):
    def make(rng, good):
        w = words(rng, rng.randint(5, 80))
        return " ".join(w) + "." if good else " ".join(x + rng.choice(["###", "%%%"]) for x in w)

    docs, labels = labelled(spark, make)
    model = quality.fit_quality(docs, labels.where("doc_id % 5 <> 0"), rating_col="label")
    found = quality.quality_scores(docs, model).collect()
    assert len(found) == docs.count()
    accuracy(found, labels, "kept", 0.95)
    rows = quality.quality_scores(docs, model, keep_columns=True)
    assert rows.columns == docs.columns and rows.count() == sum(r.kept for r in found)
    assert quality.quality_scores(empty(spark), model).collect() == []


def test_ordinal_grades_are_in_order():
    rng = np.random.default_rng(1)
    n = 600
    strength = rng.normal(size=n)
    grade = np.digitize(strength + 0.2 * rng.normal(size=n), [-0.7, 0.1, 0.9])
    model = quality.OrdinalModel.fit(np.arange(n), np.zeros(n, np.int64), strength, grade)
    assert (np.diff(model.thresholds) > 0).all() and model.grades == [0, 1, 2, 3]
    expected, upper = model.judge(np.arange(n), np.zeros(n, np.int64), strength, n)
    assert np.abs(expected - grade).mean() < 0.4 and ((upper >= 0.5) == (grade >= 2)).mean() > 0.85


def test_quality_without_labels(spark):
    docs = frame(spark, documents(n=8))
    model = quality.fit_quality(docs, spark.createDataFrame([], "doc_id bigint, quality int"))
    assert all(r.kept for r in quality.quality_scores(docs, model).collect())


def test_language(spark):
    alphabet = {"xx": "abcde", "yy": "vwxyz", "zz": "éèüöa"}
    rng = random.Random(2)

    def text(lang):
        return " ".join("".join(rng.choice(alphabet[lang]) for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(3, 400)))

    rows = [(i, text(lang), lang, "s", 1, "", "", 1) for i, lang in enumerate(itertools.islice(itertools.cycle(alphabet), 150))]
    docs = frame(spark, rows + AWKWARD)
    model = language.fit_language(docs.where("doc_id % 5 <> 0"))
    found = {r.doc_id: r for r in language.languages_of(docs, model).collect()}
    assert np.mean([found[r[0]].lang_pred == r[2] for r in rows if r[0] % 5 == 0]) > 0.95
    assert all(0 <= r.score <= 1 for r in found.values())
    assert {found[i].lang_pred for i in (9001, 9002, 9003)} == {"und"}
    assert language.languages_of(empty(spark), model).collect() == []


def test_rare_languages_are_learned(spark):
    """Ten documents of a language among thousands: it is a class of the net, and they are found."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["the", "that", "thing", "with", "ing"]) + rng.choice("aeo") for _ in range(40)), "en") for i in range(3000)]
    rows += [(5000 + i, " ".join(rng.choice(["quux", "zyx", "wyqu", "xuz"]) + rng.choice("uxy") for _ in range(40)), "la") for i in range(10)]
    docs = spark.createDataFrame(rows + rows[:3], "doc_id bigint, text string, lang string").repartition(4)
    model = language.fit_language(docs, sample=200)
    assert model.languages == ["en", "la"]
    found = language.languages_of(docs, model).collect()
    assert all(r.lang_pred == ("la" if r.doc_id >= 5000 else "en") for r in found)


def test_drawn_texts(spark):
    rows = [(i % 500, f"text {i % 500}", "a" if i % 500 < 480 else "b") for i in range(900)] + [(None, "x", "a"), (1000, None, "a"), (1001, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    every = drawn(docs, "doc_id", "text", 30).collect()
    assert len(every) == len({r.id for r in every}) == 30 and all(r.text == f"text {r.id}" for r in every)
    by = Counter(r.lang for r in drawn(docs, "doc_id", "text", 25, "lang", 2).collect())
    assert by == {"a": 25, "b": 20}


def test_many_rare_toxic_words():
    """Thirty toxic words, each in one toxic text of thirty: none is missed for being rare."""
    rng = random.Random(6)
    plain = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in ("ran", "sol", "tim", "nud")]
    toxic = [f"zog{a}{b}" for a in "aeiou" for b in "bdfgkl"]
    texts, labels = [], []
    for i in range(1600):
        words = [rng.choice(plain) for _ in range(30)]
        if i % 2:
            words.insert(rng.randrange(30), toxic[i // 2 % 30])
        texts.append(" ".join(words).encode())
        labels.append(i % 2)
    model = toxicity.train_toxic(texts, np.array(labels))
    assert np.any(model.weights != 0)


def test_windows_cover_every_byte():
    import pyarrow as pa

    texts = ["", "a" * 5, "b" * 256, "c" * 257, "d" * 5000]
    rows, of_text = language.windows(*bytes_of(pa.array(texts)))
    step = language.WINDOW - max(language.WIDTHS) + 1
    for n, t in enumerate(texts):
        mine = rows[of_text == n]
        assert len(t) <= (len(mine) - 1) * step + language.WINDOW if t else len(mine) == 0
        assert (mine > 0).sum() >= len(t)


def test_toxicity(spark):
    def make(rng, bad):
        w = words(rng, rng.randint(30, 90))
        for _ in range(3 * bad):
            w[rng.randrange(len(w))] = rng.choice(["Grumblo!", "snarf", "blech,"])
        return " ".join(w)

    docs, labels = labelled(spark, make)
    model = toxicity.fit_toxicity(docs, labels.where("doc_id % 5 <> 0"), label_col="label")
    found = toxicity.toxic_spans(docs, model).collect()
    accuracy(found, labels, "predicted", 0.95)
    texts = {r.doc_id: r.text for r in docs.collect()}
    spans = {texts[r.doc_id][s.start : s.end].lower() for r in found for s in r.spans}
    assert {"grumblo", "snarf", "blech"} <= spans
    assert all(r.predicted == 0 and r.spans == [] for r in found if r.doc_id > 9000)
    assert toxicity.toxic_spans(empty(spark), model).collect() == []


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 700])
def test_chain_marginals(n):
    rng = np.random.default_rng(n)
    score, trans = rng.normal(size=n) * 3, rng.normal(size=(2, 2))
    starts = np.unique(np.concatenate([[0], rng.integers(0, n, n // 20)]))
    ends = np.concatenate([starts[1:] - 1, [n - 1]])
    emit = np.exp(np.stack([np.zeros(n), score], axis=1))
    wanted = []
    for a, b in zip(starts, ends):
        ahead, behind = [emit[a]], [np.ones(2)]
        for t in range(a + 1, b + 1):
            ahead.append((ahead[-1] @ np.exp(trans)) * emit[t])
            ahead[-1] /= ahead[-1].sum()
        for t in range(b, a, -1):
            behind.append(np.exp(trans) @ (emit[t] * behind[-1]))
            behind[-1] /= behind[-1].sum()
        both = np.array(ahead) * np.array(behind[::-1])
        wanted += (both[:, 1] / both.sum(axis=1)).tolist()
    assert np.allclose(toxicity.chain_marginals(score, trans, starts, ends), wanted)


PERSONAL = "Call +1 (706) 555-3138 or ann.lee@mail.example.org, host 10.0.255.1, card 4111 1111 1111 1111."


def test_base_spans():
    found = {(pii.KINDS[k], PERSONAL[a:b]) for k, a, b in pii.base_spans(PERSONAL)}
    assert found == {("email", "ann.lee@mail.example.org"), ("ip", "10.0.255.1"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (706) 555-3138")}
    assert pii.base_spans("a@b 1.2.3 256.1.1.1 4111 1111 1111 1112 +12 é@x.y @.. 1.2.3.4.5") == [(1, 54, 61)]
    assert pii.base_spans("a@b.c@d.e") == [(0, 0, 5)]


def spans_by_hand(text):
    """The four kinds by plain patterns over the whole text."""
    digits = lambda t: [int(c) for c in t if c in "0123456789"]

    def checked(numbers):
        return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(numbers))) % 10 == 0

    kinds = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t: all(int(p) <= 255 for p in t.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda t: 13 <= len(digits(t)) <= 19 and checked(digits(t))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: 9 <= len(digits(t)) <= 15),
    ]
    return [(k, *m.span()) for k, (rule, good) in enumerate(kinds) for m in re.finditer(rule, text) if good(m.group())]


def test_base_spans_agree_with_plain_patterns():
    rng, found = random.Random(4), Counter()
    for alphabet in ("a1.@", "a.@@-% é", "012.", "12. ", "0123456789 -", "+(1 2)-.3", "+1a@.4 -\n"):
        for _ in range(1500):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
            assert pii.base_spans(text) == spans_by_hand(text), text
            found.update(k for k, *_ in spans_by_hand(text))
    assert min(found[k] for k in range(4)) > 50


def test_base_spans_of_long_runs_take_linear_time():
    n = 300_000
    started = time.perf_counter()
    for text in ("@" + "a" * n, "a" * n + "@", "a@" * n, "a@b" * n, "7" * n, "1." * n, "1 " * n, "+" * n, "+1" * n, "+1" + "." * n, "a." * n + "@b"):
        assert [s for s in pii.base_spans(text) if s[0] != 1] == []
    assert pii.base_spans("x" * n + "@y." + "z" * n) == [(0, 0, 2 * n + 3)]
    assert time.perf_counter() - started < 30


def test_personal_data(spark):
    rng = random.Random(6)
    rows = []
    for i in range(150):
        w = words(rng, rng.randint(5, 60))
        extra = [f"{rng.choice(w)}@{rng.choice(w)}.org", f"{i}.{i}.1.9", "+49 (30) 1234-" + str(1000 + i), "4111 1111 1111 1111", "year 1999"]
        w.insert(rng.randrange(len(w)), rng.choice(extra))
        rows.append((i, "é" * (i % 3) + " ".join(w), None, "s", 1, "", "", 1))
    docs = frame(spark, rows + AWKWARD)
    model = pii.fit_pii(docs)
    found = {r.doc_id: r.spans for r in pii.personal_data(docs, model).collect()}
    for i, text, *_ in rows:
        base = [(pii.KINDS[k], a, b) for k, a, b in sorted(pii.base_spans(text))]
        assert [(s.kind, s.start, s.end) for s in found[i] if s.by_rule] == base
    assert found[9001] == found[9002] == []
    # Without the rules the net finds most of what they find: it has learnt the kinds.
    texts = [r[1] for r in rows]
    base = [pii.base_spans(t) for t in texts]
    alone = pii.added_spans(model, texts, [[] for _ in texts])
    hits = sum(any(k == m and a < d and c < b for m, c, d in mine) for b_, mine in zip(base, alone) for k, a, b in b_)
    assert hits >= 0.6 * sum(map(len, base))
    assert pii.personal_data(empty(spark), model).collect() == []


class Spelled:
    """Tags every run of characters between spaces as an email, as far as a window shows it."""

    def decode(self, x):
        inside = (x > 0) & (x != pii.char_classes(" ")[0])
        before = np.concatenate([np.zeros((len(x), 1), bool), inside[:, :-1]], axis=1)
        return np.where(inside, np.where(before, 2, 1), 0).astype(np.int8)


@pytest.mark.parametrize("email", ["ann.of.some.long.name@mail.example.org", "a" * 150 + "@" + "b" * 190 + ".org"])
def test_added_spans_anywhere_and_of_any_length(email):
    for offset in range(100):
        for after in ("", " then"):
            assert pii.added_spans(Spelled(), ["", " " * offset + email + after], [[], []]) == [[], [(0, offset, offset + len(email))]]


def test_language_model_scores(spark):
    rng = random.Random(7)
    target = spark.createDataFrame([(" ".join(words(rng, 40)),) for _ in range(20)] + [(None,)], "text string")
    strange = [" ".join("q" + w for w in words(rng, 40)) for _ in range(40)]
    like = [" ".join(words(rng, 40)) for _ in range(40)]
    rows = [(i, t, None, "s", 1, "", "", 1) for i, t in enumerate(like + strange)]
    docs = frame(spark, rows + AWKWARD)
    model = lmscore.fit_difference(target, docs)
    found = {r.doc_id: r for r in lmscore.difference_scores(docs, model).collect()}
    assert max(found[i].score for i in range(40)) < min(found[i].score for i in range(40, 80))
    assert found[9001].n_tokens == 0 and found[9001].score is None and found[9003].n_tokens == 3
    # Both models are distributions: over the vocabulary and one unknown word they sum to one.
    vocabulary = model.vocabulary
    some = np.concatenate([np.stack([np.full(len(vocabulary) + 1, vocabulary[3]), np.append(vocabulary, np.uint64(1))], axis=1).ravel()]).astype(np.uint64)
    losses = model.losses(some, np.arange(0, len(some) + 1, 2))[:, 1::2]
    assert (np.exp(-losses).sum(axis=1) < 1.05).all()
    assert lmscore.difference_scores(empty(spark), model).collect() == []
    lmscore.fit_difference(empty(spark).select("text"), empty(spark))


def test_language_model_keeps_rare_passages(spark, monkeypatch):
    """However large the background, what the target holds counts, and so does what the background has twice."""
    rng = random.Random(3)
    passage = "zyx wvu tsr qpo nml kji"
    target = spark.createDataFrame([(passage,)], "text string")
    rows = [(i, " ".join(words(rng, 1500)), None, "s", 1, "", "", 1) for i in range(300)]
    rows += [(1000, passage, None, "s", 1, "", "", 1), (1001, " ".join(passage.split()[::-1]), None, "s", 1, "", "", 1)]
    rows += [(1002 + i, "only twice", None, "s", 1, "", "", 1) for i in range(2)] + [(1004, "only once", None, "s", 1, "", "", 1)]
    docs = frame(spark, rows)
    monkeypatch.setattr(lmscore, "BLOCK", 1 << 18)
    model = lmscore.fit_difference(target, docs)
    known = lmscore._word_keys(word_hashes(*bytes_of(pa.array([passage + " only twice once"])))[0])
    assert np.isin(known, model.vocabulary).tolist() == [True] * 8 + [False]
    scores = lmscore.difference_scores(docs, model).collect()
    assert sorted(r.doc_id for r in scores) == sorted(r[0] for r in rows)
    found = {r.doc_id: r for r in scores}
    # The order of the words tells the passage from the same words: pairs count although they are rare.
    assert found[1000].target_loss < found[1001].target_loss and found[1000].score < min(r.score for i, r in found.items() if i != 1000)
    # The scores are those of counts in plain Python.
    texts = [passage, *[r[1] for r in rows]]
    split = [t.split() for t in texts]
    ones = [Counter(split[0]), Counter(w for t in split[1:] for w in t)]
    twos = [Counter(zip(split[0], split[0][1:])), Counter(p for t in split[1:] for p in zip(t, t[1:]))]
    total = [sum(c.values()) for c in ones]
    kept = {w for w in ones[1] if ones[0][w] or ones[1][w] >= 2}
    for doc_id, text in [(1000, split[0]), (1001, split[0][::-1]), (1004, ["only", "once"]), (0, split[1])]:
        for side, name in enumerate(("target_loss", "background_loss")):
            scale = total[0] / total[side]
            unknown = total[side] - sum(ones[side][w] for w in kept)
            loss = 0.0
            for n, w in enumerate(text):
                share = ((ones[side][w] if w in kept else unknown) * scale + 0.5) / (total[0] + 0.5 * (len(kept) + 1))
                pair = (text[n - 1], w) if n else None
                counts = pair and (twos[0][pair] or twos[1][pair] >= 2)
                seen = twos[side][pair] * scale if counts else 0.0
                context = ones[side][pair[0]] * scale if pair and pair[0] in kept else 0.0
                loss -= np.log((seen + 20 * share) / (context + 20))
            assert np.isclose(found[doc_id][name], loss / len(text))
