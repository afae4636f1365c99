"""Cross-entropy difference of two bigram models that share a vocabulary."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shared import Work, bytes_of, mixed, parts_of, word_hashes

# A word or pair counts if the target has it or the background has it twice, however large both are.
LEAST_BACKGROUND = 2
PRIOR = 20.0  # words' worth of the unigram model in each bigram distribution
ADDED = 0.5
HELD = 4_000_000  # keys a task adds up before they leave it
BLOCK = 8 << 20  # bytes of text that look up their n-grams together
BUCKET_BITS = 10  # ranges of keys, at least
BUCKET_BYTES = 16 << 20  # of the corpus's text for each range of keys, beyond those
TOTAL = 0  # the key under which all words are counted


# A key has 55 bits of a hash and a bit that tells pairs from words. Its last byte is zero, which packs to nothing.
PAIR = np.uint64(1 << 8)
HASH = ~np.uint64((1 << 9) - 1)


def _word_keys(hashes: np.ndarray) -> np.ndarray:
    """Keys of words, above TOTAL."""
    return np.maximum(hashes & HASH, np.uint64(1 << 9))


def _pair_keys(words: np.ndarray) -> np.ndarray:
    """Keys of (word before, word), for all words but the first."""
    return mixed(words[:-1] * np.uint64(0xD1342543DE82EF95) + words[1:]) & HASH | PAIR


def _follows(number: int, first: np.ndarray) -> np.ndarray:
    """Whether each word has a word before it in its text."""
    follows = np.ones(number, bool)
    follows[first[:-1][first[1:] > first[:-1]]] = False
    return follows


def _gram_keys(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    words = _word_keys(hashes)
    return np.concatenate([words, _pair_keys(words)[_follows(len(words), first)[1:]]])


def _distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted; np.unique hashes first, which takes several times as long."""
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def _pack(x: np.ndarray) -> bytes:
    """Numbers of eight bytes, compressed: their first bytes first, so that small ones leave runs of zeros."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(x).to_bytes(8, "little") + (pa.compress(planes, "zstd", asbytes=True) if planes else b"")


def _unpack(data: bytes, kind=np.int64) -> np.ndarray:
    size = 8 * int.from_bytes(data[:8], "little")
    planes = pa.decompress(memoryview(data)[8:], size, "zstd", asbytes=True) if size else b""
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view(kind).ravel()


def _pack_rows(batch: pa.RecordBatch) -> bytes:
    """A batch as a compressed Arrow stream."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack_rows(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def _pack_keys(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, np.uint64))


def _in_buckets(keys: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """The ranges of keys, which are sorted, that have any."""
    buckets = keys >> np.uint64(64 - bits)
    starts = np.flatnonzero(np.diff(buckets, prepend=buckets[:1] + np.uint64(1)))
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)]):
        yield int(buckets[a]), slice(a, b)


def _gram_counts(bits: int, side: int):
    """(bucket, side, keys, n) of a task's texts, added up before they leave it."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, words = [], 0, 0

        def flush():
            key, n = np.unique(np.concatenate(held), return_counts=True)
            key, n = np.append(np.uint64(TOTAL), key), np.append(words, n).astype(np.int64)
            rows = [(k, _pack_keys(key[s]), _pack(n[s])) for k, s in _in_buckets(key, bits)]
            bucket, keys, numbers = zip(*rows)
            return pa.RecordBatch.from_arrays(
                [pa.array(bucket, pa.int64()), pa.array([side] * len(rows), pa.int32()), pa.array(keys, pa.binary()), pa.array(numbers, pa.binary())],
                names=["bucket", "side", "keys", "n"],
            )

        for whole in batches:
            for batch in parts_of(whole, "text"):
                hashes, first = word_hashes(*bytes_of(batch.column("text")))
                held.append(_gram_keys(hashes, first))
                size, words = size + len(held[-1]), words + len(hashes)
                if size >= HELD:
                    yield flush()
                    held, size, words = [], 0, 0
        if size:
            yield flush()

    return counts


_GRAMS = "bucket bigint, keys binary, target binary, background binary, words bigint, known_target bigint, known_background bigint, " \
    "total_target bigint, total_background bigint"


def _added_up(group: pa.Table) -> pa.Table:
    """The counts of a range of keys over all tasks, those that count."""
    sides = group.column("side").to_pylist()
    keys = [_unpack_keys(x) for x in group.column("keys").to_pylist()]
    every, place = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.zeros((2, len(every)), np.int64)
    start = 0
    for side, mine, number in zip(sides, keys, group.column("n").to_pylist()):
        n[side, place[start : start + len(mine)]] += _unpack(number)  # a task's keys are distinct
        start += len(mine)
    total = n[:, every == TOTAL].sum(axis=1)
    keep = ((n[0] > 0) | (n[1] >= LEAST_BACKGROUND)) & (every != TOTAL)
    every, n = every[keep], n[:, keep]
    word = every & PAIR == 0
    known = n[:, word].sum(axis=1)
    row = [group.column("bucket")[0].as_py(), _pack_keys(every), _pack(n[0]), _pack(n[1]), int(word.sum()), *known.tolist(), *total.tolist()]
    kinds = [pa.int64(), *[pa.binary()] * 3, *[pa.int64()] * 5]
    names = [c.split()[0] for c in _GRAMS.split(", ")]
    return pa.table({name: pa.array([x], kind) for name, x, kind in zip(names, row, kinds)})


_ANSWERS = "block bigint, bucket bigint, target binary, background binary"


def _answered(grams: pa.Table, asked: pa.Table) -> pa.Table:
    """The counts of the keys that blocks ask for, in their order; 0 for those that do not count."""
    known, counts = np.empty(0, np.uint64), np.zeros((2, 0), np.int64)
    if grams.num_rows:
        known = _unpack_keys(grams.column("keys")[0].as_py())
        counts = np.stack([_unpack(grams.column(c)[0].as_py()) for c in ("target", "background")])
    found: list[list[bytes]] = [[], []]
    for data in asked.column("keys").to_pylist():
        keys = _unpack_keys(data)
        n = np.zeros((2, len(keys)), np.int64)
        if len(known):
            place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            n = np.where(known[place] == keys, counts[:, place], 0)
        for side in (0, 1):
            found[side].append(_pack(n[side]))
    return pa.table({
        "block": asked.column("block"), "bucket": asked.column("bucket"),
        "target": pa.array(found[0], pa.binary()), "background": pa.array(found[1], pa.binary()),
    })


def _counts_of(answers: pa.Table, size: int) -> np.ndarray:
    """(2, keys) counts in the order of a block's sorted keys, from the answers of all ranges."""
    if not size:
        return np.zeros((2, 0))
    answers = answers.sort_by("bucket")
    return np.stack([
        np.concatenate([_unpack(x) for x in answers.column(c).to_pylist()]) for c in ("target", "background")
    ]).astype(float)


@dataclass(frozen=True)
class Smoothing:
    """What the losses need beside the counts: three numbers of either corpus, and the vocabulary's size."""

    total: tuple[float, float]
    unknown: tuple[float, float]
    words: int

    def losses(self, hashes: np.ndarray, first: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """(2, words) negative log probabilities; grams: the sorted keys of these words and pairs; (2, grams) counts."""
        if not len(hashes):
            return np.zeros((2, 0))
        words, follows = _word_keys(hashes), _follows(len(hashes), first)
        total = np.array(self.total)[:, None]
        scale = np.where(total > 0, total[:1] / np.maximum(total, 1), 1.0)  # the background at the target's size
        mine = counts[:, np.searchsorted(grams, words)]
        known = mine.any(axis=0)
        unigrams = np.where(known, mine, np.array(self.unknown)[:, None]) * scale
        share = (unigrams + ADDED) / (total * scale + ADDED * (self.words + 1))
        # A text's first word has no word before it, and no pair with an unknown word counts: the unigram model alone.
        seen, context = np.zeros_like(unigrams), np.zeros_like(unigrams)
        at = np.flatnonzero(follows)
        seen[:, at] = counts[:, np.searchsorted(grams, _pair_keys(words)[at - 1])] * scale
        context[:, at] = np.where(known[at - 1], unigrams[:, at - 1], 0.0)
        return -np.log((seen + PRIOR * share) / (np.maximum(context, seen) + PRIOR))


class DifferenceModel:
    """Losses of words given the word before under the target and the background model.

    The counts stay in a written table with a row per range of keys; what grows with the corpora
    never comes to the driver, but for ``vocabulary``.
    """

    def __init__(self, grams: DataFrame, bits: int, smoothing: Smoothing):
        self.grams, self.bits, self.smoothing = grams, bits, smoothing

    @property
    def vocabulary(self) -> np.ndarray:
        """The sorted keys of all known words, for small corpora."""
        keys = [_unpack_keys(r.keys) for r in self.grams.select("keys").collect()]
        keys = np.concatenate([np.empty(0, np.uint64), *keys])
        return np.sort(keys[keys & PAIR == 0])

    def answers(self, asked: DataFrame) -> DataFrame:
        """The counts of the keys asked for (block, bucket, keys): (block, bucket, target, background)."""
        mine = self.grams.select("bucket", "keys", "target", "background")
        return mine.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(_answered, _ANSWERS)

    def losses(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        """(2, words) negative log probabilities of a few texts' hashed words under target and background."""
        keys = _distinct(_gram_keys(words, first))
        rows = [(0, k, bytearray(_pack_keys(keys[s]))) for k, s in _in_buckets(keys, self.bits)]
        asked = self.grams.sparkSession.createDataFrame(rows, "block bigint, bucket bigint, keys binary")
        return self.smoothing.losses(words, first, keys, _counts_of(self.answers(asked).toArrow(), len(keys)))


def fit_difference(target: DataFrame, background: DataFrame, text_col: str = "text") -> DifferenceModel:
    """Count words and pairs over all of both corpora.

    Each task adds up its n-grams before they travel, as packed ranges of keys; each range is added
    up over the tasks by itself and written. There are more ranges where there is more text.
    """
    work = Work(background.sparkSession)
    sides = [docs.select(F.col(text_col).alias("text")) for docs in (target, background)]
    size = sum(x.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] for x in sides)
    bits = max(BUCKET_BITS, int(np.ceil(np.log2(max(size, 1) / BUCKET_BYTES))))
    counts = [x.mapInArrow(_gram_counts(bits, n), "bucket bigint, side int, keys binary, n binary") for n, x in enumerate(sides)]
    grams = work.write(counts[0].unionAll(counts[1]).groupBy("bucket").applyInArrow(_added_up, _GRAMS), "grams")
    names = ("words", "known_target", "known_background", "total_target", "total_background")
    words, known_t, known_b, total_t, total_b = grams.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in names]).first()
    return DifferenceModel(grams, bits, Smoothing((total_t, total_b), (total_t - known_t, total_b - known_b), words))


def _cut_blocks(bits: int):
    """The texts, packed, with a block number, and for each block the n-grams it holds, in ranges of keys."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, held = TaskContext.get().partitionId() << 32, 0, []

        def rows(buckets: list, data: list[bytes], asks: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                pa.array([block] * len(data), pa.int64()), pa.array(buckets, pa.int64()), pa.array(data, pa.binary()),
                pa.array([asks] * len(data)),
            ], names=["block", "bucket", "data", "asks"])

        def asked() -> pa.RecordBatch:
            keys = _distinct(np.concatenate(held))
            ranges = list(_in_buckets(keys, bits))
            return rows([k for k, _ in ranges], [_pack_keys(keys[s]) for _, s in ranges], True)

        part = 0
        for whole in batches:
            for batch in parts_of(whole, "text"):
                hashes, first = word_hashes(*bytes_of(batch.column("text")))
                held.append(_distinct(_gram_keys(hashes, first)))
                part += 1
                yield rows([part], [_pack_rows(batch)], False)
                size += pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0
                if size >= BLOCK:
                    yield asked()
                    block, size, held = block + 1, 0, []
        if held:
            yield asked()

    return cut


def difference_scores(docs: DataFrame, model: DifferenceModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: its id, n_tokens, target_loss, background_loss and score.

    The losses are means over all words of the text; score is target less background, so low means
    like the target. A null text or one without words has 0 tokens and null losses and score.

    Texts are cut into blocks, each block looks up its distinct words and pairs in the model's
    table by ranges of keys, and the counts found come back to the block's texts.
    """
    work = Work(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    id_type = to_arrow_type(docs.schema[id_col].dataType)
    cut = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        _cut_blocks(model.bits), "block bigint, bucket bigint, data binary, asks boolean")
    blocks = work.write(cut, "blocks", "asks")
    texts = blocks.where("NOT asks").select("block", "bucket", "data")
    asked = blocks.where("asks").select("block", "bucket", F.col("data").alias("keys"))
    answers = work.write(model.answers(asked), "answers")
    work.drop("blocks/asks=true")
    smoothing = model.smoothing

    def score(mine: pa.Table, answers: pa.Table) -> pa.Table:
        packed = mine.sort_by("bucket").column("data")
        ids, found = [], []
        for data in packed.to_pylist():
            batch = _unpack_rows(data)
            ids.append(batch.column("id"))
            found.append(word_hashes(*bytes_of(batch.column("text"))))
        hashes = np.concatenate([np.empty(0, np.uint64), *[h for h, _ in found]])
        number = np.concatenate([np.empty(0, np.int64), *[np.diff(f) for _, f in found]])
        first = np.append(0, np.cumsum(number))
        grams = _distinct(_gram_keys(hashes, first))
        each = smoothing.losses(hashes, first, grams, _counts_of(answers, len(grams)))
        of_text = np.repeat(np.arange(len(number)), number)
        mean = [np.bincount(of_text, x, minlength=len(number)) / np.maximum(number, 1) for x in each]
        none = number == 0
        return pa.table({
            id_col: pa.chunked_array(ids, id_type), "n_tokens": pa.array(number.astype(np.int64)), "target_loss": pa.array(mean[0], mask=none),
            "background_loss": pa.array(mean[1], mask=none), "score": pa.array(mean[0] - mean[1], mask=none),
        })

    schema = f"`{id_col}` {kind}, n_tokens bigint, target_loss double, background_loss double, score double"
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, schema)
