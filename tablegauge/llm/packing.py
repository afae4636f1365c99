"""Packing tokenised documents into sequences by the sum-of-squares rule."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Work, parts_of
from .tokens import token_ids

CAPACITY = 2048
GROUP = 16_384
# Sequences with more room than this after packing are opened again and packed together.
ROOM = 64
LEAST_SAVED = 0.005  # share of its sequences that a further round must save
END = 0

def _pieces_of(path: str, capacity: int, with_ids: bool):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = token_ids(path)
        for whole in batches:
            for batch in parts_of(whole, "text", 1 << 19):
                ids, at = tokenizer(batch.column("text"))
                row, piece, start, length, crc, tokens = [], [], [], [], [], []
                for n, (begin, end) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                    data = np.append(ids[begin:end], np.uint32(END)).astype("<u4")
                    for k in range(0, len(data), capacity):
                        part = data[k : k + capacity].tobytes()
                        row.append(n)
                        piece.append(k // capacity)
                        start.append(k)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            tokens.append(part)
                columns = [batch.column("id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                           pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(tokens, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return pieces


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the place in it of every item, which come in the order given.

    An item goes where the squared numbers of open bins per residual gap sum up to least: from gap h
    to h - size the sum changes by 2 (n[h - size] - n[h] + 1); full bins and bins not begun do not
    count. Of equal changes the smallest gap wins.
    """
    counts = np.zeros(capacity + 1, dtype=np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, places = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    made = 0
    for i, size in enumerate(sizes.tolist()):
        # change[j]: the bin's gap is size + j now and j afterwards.
        here = counts[size:capacity]
        change = 2 * (counts[: capacity - size] - here + 1)
        if len(change):
            change[0] = 1 - 2 * here[0]
            change[here == 0] = np.iinfo(np.int64).max
            best = int(change.argmin())
            least = int(change[best])
        else:
            best, least = 0, np.iinfo(np.int64).max
        rest = capacity - size
        new = 2 * int(counts[rest]) + 1 if rest else 0
        if least <= new and least != np.iinfo(np.int64).max:
            gap = size + best
            b = open_bins[gap].pop()
            counts[gap] -= 1
        else:
            gap, b = capacity, made
            made += 1
        bins[i], places[i] = b, capacity - gap
        if gap > size:
            counts[gap - size] += 1
            open_bins[gap - size].append(b)
    return bins, places


def _pack(capacity: int):
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "row"], ascending=[False, True], kind="stable")
        bins, places = sum_of_squares(group["length"].to_numpy(), capacity)
        filled = np.bincount(bins, weights=group["length"].to_numpy()).astype(np.int64)
        return pd.DataFrame({
            "row": group["row"], "length": group["length"], "number": bins, "offset": places, "room": capacity - filled[bins],
            "group": group["group"],
        })

    return pack


def packed_sequences(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
    capacity: int = CAPACITY, group: int = GROUP, with_ids: bool = False,
) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset, and ids if asked for.

    A document is its token ids and a closing id 0; a null or empty text is that one id. Only longer
    ones are cut, into pieces of ``capacity``; the last may be shorter. Whole pieces are sequences of
    their own. The others are dealt by a hash of their row into groups of about ``group`` pieces,
    and each group is packed by the sum-of-squares rule, largest first. Sequences that are left with
    much room are opened and packed together in further rounds, in ever fewer groups of the same size,
    until a round saves none. The order of rows, ties and repeated rows change nothing but which piece goes where. Other columns are not
    looked at; an empty table gives an empty result.
    """
    work = Work(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    pieces = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        _pieces_of(tokenizer_path, capacity, with_ids), schema,
    ).withColumn("row", F.monotonically_increasing_id())
    pieces = work.write(pieces, "pieces")  # row numbers stay when a task runs again

    small = pieces.where(F.col("length") < capacity).select("row", "length")
    packed, level, left, before = None, 0, small.count(), None
    while left:
        groups = -(-left // group)
        packs = small.withColumn("group", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(groups)).cast("int"))
        out = packs.groupBy("group").applyInPandas(
            _pack(capacity), "row bigint, length bigint, number bigint, offset bigint, room bigint, group int",
        )
        out = work.write(out, f"packed{level}")
        roomy = F.col("room") > ROOM
        first = F.col("offset") == 0
        sequences, reopened, left = out.agg(F.count_if(first), F.count_if(first & roomy), F.count_if(roomy)).first()
        # One group left, or opening sequences again saves none: nothing more fits together.
        last = groups == 1 or before is not None and sequences > (1 - LEAST_SAVED) * before
        done = out if last else out.where(~roomy)
        done = done.select("row", "offset", F.lit(level).alias("level"), F.col("group").alias("within"), "number")
        packed = done if packed is None else packed.unionAll(done)
        if last:
            break
        small, before = out.where(roomy).select("row", "length"), reopened
        level += 1
    # The first piece in a sequence gives it its number.
    if packed is None:
        packed = small.select("row", F.lit(0).cast("bigint").alias("offset"), F.lit(0).alias("level"),
                              F.lit(0).alias("within"), F.lit(0).cast("bigint").alias("number"))
    groups_bits = 24
    sequence = (
        F.shiftleft(F.col("level").cast("bigint") + 1, 58) + F.shiftleft(F.col("within").cast("bigint"), groups_bits) + F.col("number")
    )
    return pieces.join(packed, "row", "left").select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []),
        F.when(F.col("length") < capacity, sequence).otherwise(F.col("row")).alias("sequence_id"),
        F.coalesce("offset", F.lit(0).cast("bigint")).alias("offset"),
    )
