"""Ranked lexical search by scanning texts with one automaton of all terms that are asked for."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Work, bytes_of, parts_of

TOP = 10
ITEM_BYTES = 8 << 20  # text of the items that one automaton serves
SEGMENT = 4 << 20  # bytes of text scanned at a time
CELLS = 1 << 21  # scores held at a time
FIRST_MERGE = 512  # groups of tasks whose best documents are merged first

# What a byte of UTF-8 is in a term: itself, letters lower-cased; everything else is a space.
_TERM = np.full(256, 32, np.uint8)
for _kept in (range(48, 58), range(97, 123), range(128, 256)):
    _TERM[list(_kept)] = list(_kept)
_TERM[65:91] = range(97, 123)
_AUTOMATA: dict[int, object] = {}


def terms_of(text: str | None) -> list[bytes]:
    return _TERM[np.frombuffer((text or "").encode(), np.uint8)].tobytes().split()


class Asked:
    """The distinct terms of some items, and in which items each is how often."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.items = [number for number, _ in items]
        numbers: dict[bytes, int] = {}
        rows = []
        for at, (_, text) in enumerate(items):
            rows += [(numbers.setdefault(t, len(numbers)), at, n) for t, n in Counter(terms_of(text)).items()]
        rows.sort()
        term, self.item, self.times = (np.array(c, np.int64) for c in zip(*rows)) if rows else (np.empty(0, np.int64),) * 3
        self.terms = list(numbers)
        self.begin = np.searchsorted(term, np.arange(len(numbers) + 1))

    def automaton(self):
        import ahocorasick

        made = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for n, term in enumerate(self.terms):
            # The spaces guard the boundaries: a term within a longer one does not match.
            made.add_word(f" {term.decode('latin-1')} ", n)
        made.make_automaton()
        return made


def _automaton(shared):
    """The automaton of a broadcast, built once per process."""
    if shared.id not in _AUTOMATA:
        _AUTOMATA.clear()
        _AUTOMATA[shared.id] = shared.asked.value.automaton()
    return _AUTOMATA[shared.id]


class Shared:
    """What the tasks get: the broadcast items and a number that tells them from earlier ones."""

    made = 0

    def __init__(self, spark, asked: Asked):
        Shared.made += 1
        self.id = hash((spark.sparkContext.applicationId, Shared.made))
        self.asked = spark.sparkContext.broadcast(asked)


def scan(texts: pa.Array, automaton, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms per text; then, sorted, which text has which of the asked terms how often."""
    raw, at = bytes_of(texts)
    # A space before and behind every text; all boundaries are spaces now.
    data = np.insert(_TERM[raw], at, 32)
    edges = at + np.arange(len(at))
    spaces = data == 32
    begins = np.append(0, np.cumsum(spaces[:-1] & ~spaces[1:]))
    n = np.diff(begins[edges])
    found = []
    if terms:
        text = data.tobytes().decode("latin-1")
        start = 0
        while start < len(text) - 1:
            stop = text.find(" ", min(start + SEGMENT, len(text) - 1))
            hits = np.fromiter(chain.from_iterable(automaton.iter(text, start, stop + 1)), np.int64).reshape(-1, 2)
            doc = np.searchsorted(edges, hits[:, 0]) - 1
            found.append(np.unique(doc * terms + hits[:, 1], return_counts=True))
            start = stop
    if len(found) > 1:
        keys, which = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
        times = np.zeros(len(keys), np.int64)
        np.add.at(times, which, np.concatenate([c for _, c in found]))
    else:
        keys, times = found[0] if found else (np.empty(0, np.int64),) * 2
    return n, keys // max(terms, 1), keys % max(terms, 1), times


def _counted(shared: Shared):
    """Per term the documents that hold it; documents with terms at -1, terms in all at -2."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, terms = _automaton(shared), len(shared.asked.value.terms)
        holding, filled, length = np.zeros(terms, np.int64), 0, 0
        for whole in batches:
            for batch in parts_of(whole, "text"):
                n, _, term, _ = scan(batch.column("text"), automaton, terms)
                holding += np.bincount(term, minlength=terms)
                filled, length = filled + int((n > 0).sum()), length + int(n.sum())
        term = np.flatnonzero(holding)
        if filled:
            columns = [np.append(term, [-1, -2]), np.append(holding[term], [filled, length])]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["term", "times"])

    return count


def _best(items: int, top: int):
    """Keeps the best documents of every item: (item, score, no id, id), fed in any order."""
    kept = [np.empty(0, np.int64)] * 4
    waiting: list[list[np.ndarray]] = []
    least = np.zeros(items, np.int64)  # scores from here on may count

    def feed(item: np.ndarray, score: np.ndarray, missing: np.ndarray, ids: np.ndarray) -> None:
        waiting.append([item, score, missing, ids])
        if sum(len(w[0]) for w in waiting) >= max(CELLS // 4, items * top):
            merge()

    def merge() -> list[np.ndarray]:
        nonlocal kept
        if waiting:
            item, score, missing, ids = (np.concatenate(c) for c in zip(kept, *waiting))
            order = np.lexsort((ids, missing, -score, item))
            item = item[order]
            first = np.searchsorted(item, item)  # where the item's rows begin
            nth = np.arange(len(item)) - first
            keep = order[nth < top]
            kept = [c[keep] for c in (np.concatenate(c) for c in zip(kept, *waiting))]
            waiting.clear()
            last = nth == top - 1
            least[item[last]] = score[order][last]
        return kept

    return feed, merge, least


def _ranked(shared: Shared, weights: np.ndarray, filled: int, length: int, top: int):
    """The best documents of a partition for every item."""

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, asked = _automaton(shared), shared.asked.value
        terms, items = len(asked.terms), len(asked.items)
        feed, merge, least = _best(items, top)
        reach = np.diff(asked.begin)
        for whole in batches:
            for batch in parts_of(whole, "text"):
                n, doc, term, times = scan(batch.column("text"), automaton, terms)
                ids = batch.column("id")
                missing = np.asarray(ids.is_null()).astype(np.int64)
                ids = np.asarray(ids.fill_null(0))
                m = 25 + (75 * n * filled) // length if length else n
                worth = weights[term] * ((1_000_000_000 * times) // (1000 * times + 8 * m[doc]))
                # As many texts at a time as keep the scores, and the terms' items, within bounds.
                work = np.append(0, np.cumsum(np.bincount(doc, reach[term], len(n)) + items))
                start = 0
                while start < len(n):
                    stop = max(start + 1, int(np.searchsorted(work, work[start] + CELLS, side="right")) - 1)
                    a, b = np.searchsorted(doc, (start, stop))
                    spread = reach[term[a:b]]
                    ends = np.cumsum(spread)
                    at = np.repeat(asked.begin[term[a:b]] - (ends - spread), spread) + np.arange(ends[-1] if b > a else 0)
                    scores = np.zeros((stop - start) * items, np.int64)
                    cell = np.repeat(doc[a:b] - start, spread) * items + asked.item[at]
                    np.add.at(scores, cell, np.repeat(worth[a:b], spread) * asked.times[at])
                    scores = scores.reshape(-1, items)
                    row, item = np.nonzero((scores > 0) & (scores >= least))
                    if len(row):
                        feed(item, scores[row, item], missing[start + row], ids[start + row])
                    start = stop
        item, score, missing, ids = merge()
        if len(item):
            yield pa.RecordBatch.from_arrays([
                pa.array(np.array(asked.items, np.int64)[item]), pa.array(ids, pa.int64(), mask=missing.astype(bool)), pa.array(score),
            ], names=["number", "id", "score"])

    return rank


def _first(df: DataFrame, top: int, *keys: str) -> DataFrame:
    nth = f"row_number() over (partition by {', '.join(keys)} order by score desc, id asc nulls last) as rank"
    return df.selectExpr("*", nth).where(f"rank <= {top}")


def ranked(
    docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """(item, rank, id, score): the ``top`` documents with the highest score above 0 for every item.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased. A
    document's score is the sum over the item's terms, repeats included, of the term's weight (rarer
    terms weigh more) times its frequency, damped by itself and by the document's length. Equal scores
    come by ascending id (integers; a null id last). Every row of ``items`` is an item of its own, also
    one with a repeated or null id; every row of ``docs`` is a document. Null and empty texts have no
    terms. Other columns are not looked at. Without documents or terms there is no row.

    Items go to the tasks in groups of about ``item_bytes`` of text, so what is broadcast is bounded
    (but for one longer item); each group has its automaton and scans the whole texts twice: once for the
    counts of documents per term, once for the scores. A task keeps ``top`` documents per item.
    """
    spark = docs.sparkSession
    work = Work(spark)
    asked = items.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text"))
    asked = work.write(asked.withColumn("number", F.monotonically_increasing_id()), "items")
    groups = max(1, -(-(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // item_bytes))
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))

    found = None
    for group in range(groups):
        own = asked.where(F.pmod(F.xxhash64("number"), F.lit(groups)) == group).orderBy("number").select("number", "text")
        wanted = Asked([tuple(r) for r in own.collect()])
        if not wanted.terms:
            continue
        shared = Shared(spark, wanted)
        counted = texts.mapInArrow(_counted(shared), "term bigint, times bigint")
        times = {r["term"]: r["times"] for r in counted.groupBy("term").agg(F.sum("times").alias("times")).collect()}
        filled, length = times.get(-1, 0), times.get(-2, 0)
        weights = [
            math.floor(1000 * math.log((2 * filled + 2) / (2 * times.get(t, 0) + 1)))
            for t in range(len(wanted.terms))
        ]
        best = texts.mapInArrow(_ranked(shared, np.array(weights, np.int64), filled, length, top), "number bigint, id bigint, score bigint")
        found = best if found is None else found.unionAll(best)
    if found is None:
        return asked.where("false").selectExpr(
            f"item as `{item_col}`", "cast(null as int) as rank", f"cast(null as bigint) as `{id_col}`", "cast(null as bigint) as score",
        )
    salted = found.withColumn("salt", F.spark_partition_id() % FIRST_MERGE)
    merged = _first(_first(salted, top, "number", "salt").drop("rank"), top, "number")
    return merged.join(asked.select("number", F.col("item").alias(item_col)), "number").select(
        item_col, "rank", F.col("id").alias(id_col), "score",
    )
