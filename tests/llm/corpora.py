"""Small tables for the corpus operators: the ordinary and the awkward."""

import random

WORDS = [a + b for a in ("ka", "lo", "mi", "nu", "pe", "ro", "su", "ti") for b in ("dra", "fel", "gon", "hib", "jat", "vem")]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, component_id string, row int"


def words(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def changed(rng, text, edits):
    out = text.split(" ")
    for _ in range(edits):
        out[rng.randrange(len(out))] = rng.choice(WORDS) + "x"
    return " ".join(out)


def documents(seed=1, n=120):
    """Texts of many lengths with copies, near copies, a passage many share, nulls and repeated rows."""
    rng = random.Random(seed)
    texts = [" ".join(words(rng, rng.randint(1, 150))) for _ in range(n)]
    passage = " ".join(words(rng, 60))
    for _ in range(n // 4):
        texts.append(changed(rng, rng.choice(texts[:n]), rng.randint(0, 6)))
        texts.append(passage + " " + " ".join(words(rng, rng.randint(0, 60))))
    texts += ["", "  \t ", None, None, "one", "One", "three words here", "THREE  words\nhere", " ".join(words(rng, 9000)), "é ü ß 中"]
    texts += [texts[5]] * 20 + [texts[5].replace(" ", " \n ", 3)] * 3
    rng.shuffle(texts)
    sources = ["b", "a", None, "", "é", "b", "b"]
    rows = [
        (i * 7 % 1009, t, "en", sources[rng.randrange(len(sources))], len(t or ""), "k", "c", 3) for i, t in enumerate(texts)
    ]
    return rows + rows[:4] + [(None, "nobody knows this one at all", None, "a", 3, None, None, None)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
