"""Bounded-space online packing: a fixed number of open windows per partition."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Work, parts_of
from .tokens import token_ids

CAPACITY = 2048
OPEN = 64  # windows open at a time in a partition
MERGED = 64  # partitions, then groups of them, whose leftovers one task merges
END = 1
ROWS = 1 << 14  # pieces that leave a task together

_PART_BITS, _NUMBER_BITS = 24, 34
_NAMES = ["id", "start", "length", "ids_crc32", "doc_tokens", "number", "offset", "open", "ids"]
_TYPES = [*[pa.int64()] * 6, pa.bool_(), pa.binary()]

# A piece: (document, its tokens, the piece's place in it, the piece's ids).
Piece = tuple[int, int, int, np.ndarray]


class Windows:
    """At most ``most`` open windows of ``capacity`` ids.

    A piece goes where the least room stays. Where none has room for it and no further window may
    open, the fullest is filled up with the head of the piece and leaves; the rest goes on.
    """

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.gaps: list[tuple[int, int]] = []  # room and number of the open windows, sorted
        self.held: dict[int, list[Piece]] = {}
        self.made = 0

    def _put(self, at: int | None, piece: Piece) -> Iterator[tuple[int, list[Piece]]]:
        if at is None:
            gap, number = self.capacity, self.made
            self.held[number] = []
            self.made += 1
        else:
            gap, number = self.gaps.pop(at)
        self.held[number].append(piece)
        gap -= len(piece[3])
        if gap:
            insort(self.gaps, (gap, number))
        else:
            yield number, self.held.pop(number)

    def add(self, doc: int, tokens: int, start: int, ids: np.ndarray) -> Iterator[tuple[int, list[Piece]]]:
        """Place ids; yields the windows that are full now."""
        while len(ids):
            at = bisect_left(self.gaps, (len(ids), -1))
            if at < len(self.gaps):
                take = len(ids)
            elif len(ids) >= self.capacity or len(self.gaps) < self.most:
                at, take = None, min(len(ids), self.capacity)
            else:
                at, take = 0, self.gaps[0][0]
            yield from self._put(at, (doc, tokens, start, ids[:take].copy()))
            start, ids = start + take, ids[take:]

    def rest(self) -> Iterator[tuple[int, list[Piece]]]:
        """The windows that are open still, the fullest first."""
        for _, number in self.gaps:
            yield number, self.held[number]


def _rows(number: int, pieces: list[Piece], is_open: bool, with_ids: bool) -> Iterator[tuple]:
    offset = 0
    for doc, tokens, start, ids in pieces:
        data = ids.astype("<u4").tobytes()
        kept = data if is_open or with_ids else None
        yield doc, start, len(ids), zlib.crc32(data), tokens, number, offset, is_open, kept
        offset += len(ids)


def _placed(path: str, capacity: int, most: int, with_ids: bool):
    """Pieces of the windows that leave a partition, and with their ids those of its open windows."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, windows = token_ids(path), Windows(capacity, most)
        first = TaskContext.get().partitionId() << _NUMBER_BITS
        keys: dict[int, object] = {}  # documents with a piece in an open window
        rows: list[tuple] = []

        def batch_of(id_type: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*rows))
            columns[0] = [keys[doc] for doc in columns[0]]
            rows.clear()
            held = {doc for pieces in windows.held.values() for doc, *_ in pieces}
            for doc in [d for d in keys if d not in held and d != seen]:
                del keys[doc]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [id_type, *_TYPES])], names=_NAMES)

        seen, id_type = 0, pa.int64()
        for whole in batches:
            id_type = whole.schema.field("id").type
            for batch in parts_of(whole, "text", 2 << 20):
                ids, at = tokenizer(batch.column("text"))
                for key, begin, end in zip(batch.column("id").to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                    seen += 1
                    keys[seen] = key
                    text = np.append(ids[begin:end], np.uint32(END))
                    for number, pieces in windows.add(seen, len(text), 0, text):
                        rows.extend(_rows(first + number, pieces, False, with_ids))
                        if len(rows) >= ROWS:
                            yield batch_of(id_type)
        for number, pieces in windows.rest():
            rows.extend(_rows(first + number, pieces, True, with_ids))
        if rows:
            yield batch_of(id_type)

    return place


def _cut(pieces: list[Piece], lengths: list[int]) -> Iterator[list[Piece]]:
    """The ids of the pieces in runs of the given lengths."""
    left = pieces[::-1]
    for length in lengths:
        run = []
        while length:
            doc, tokens, start, ids = left.pop()
            run.append((doc, tokens, start, ids[:length]))
            if len(ids) > length:
                left.append((doc, tokens, start + length, ids[length:]))
            length -= len(run[-1][3])
        yield run


def _merged(capacity: int, last: bool, with_ids: bool):
    """Pour the open windows of a group into one another; at most one stays open.

    In the last group, what is left is cut into sequences whose lengths are powers of two.
    """

    def merge(group: pa.Table) -> pa.Table:
        group = group.sort_by([("number", "ascending"), ("offset", "ascending")]).combine_chunks()
        windows, rows = Windows(capacity, 1), []
        for doc, (tokens, start, data) in enumerate(zip(*[group[c].to_pylist() for c in ("doc_tokens", "start", "ids")])):
            for number, pieces in windows.add(doc, tokens, start, np.frombuffer(data, "<u4")):
                rows.extend(_rows(number, pieces, False, with_ids))
        for number, pieces in windows.rest():
            left = sum(len(ids) for *_, ids in pieces)
            lengths = [1 << bit for bit in reversed(range(left.bit_length())) if left >> bit & 1] if last else [left]
            for n, run in enumerate(_cut(pieces, lengths)):
                rows.extend(_rows(number + n, run, not last, with_ids))
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), *_TYPES])]
        columns[0] = group["id"].combine_chunks().take(columns[0])
        number = _NAMES.index("number")
        first = (group["number"][0].as_py() >> _NUMBER_BITS) // MERGED << _NUMBER_BITS
        columns[number] = pc.add(columns[number], first)
        return pa.table(columns, names=_NAMES)

    return merge


def packed_windows(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
    capacity: int = CAPACITY, most_open: int = OPEN, with_ids: bool = False,
) -> DataFrame:
    """Per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for.

    A document is its token ids and a closing id 1; a null or empty text is that one id. Every task
    packs its documents as they come, into at most ``most_open`` open windows: into the one where the
    least room stays, and where none has room, the fullest takes the head of the document and leaves.
    Whole windows of a long document leave at once. What is open at the end, 64 windows a partition at
    most, is poured together per 64 partitions, in rounds, until one window is left, which is cut into
    powers of two. So every sequence is full, or of a power of two. Memory is bounded by the open
    windows and one batch of texts. Ties, repeated rows, null ids and the order of rows change nothing
    but which piece goes where; other columns are not looked at; an empty table gives an empty result.
    """
    work = Work(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = (
        f"id {id_type}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, number bigint, offset bigint, "
        "open boolean, ids binary"
    )
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    placed = work.write(texts.mapInArrow(_placed(tokenizer_path, capacity, most_open, with_ids), schema), "placed")

    parts, level = [placed], 0
    while True:
        left = parts[-1].where("open").withColumn("part", F.shiftright("number", _NUMBER_BITS))
        most = left.agg(F.max("part")).first()[0]
        if most is None:
            break
        level += 1
        merged = left.groupBy(F.expr(f"part div {MERGED}").alias("group")).applyInArrow(
            _merged(capacity, most < MERGED, with_ids), schema,
        )
        parts.append(work.write(merged, f"merged{level}"))
    out = None
    for n, part in enumerate(parts):
        part = part.where("not open").select(
            F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens",
            (F.lit(n).cast("bigint") * F.lit(1 << _PART_BITS + _NUMBER_BITS) + F.col("number")).alias("sequence_id"),
            "offset", *(["ids"] if with_ids else []),
        )
        out = part if out is None else out.unionAll(part)
    return out
