"""Near duplicates: MinHash signatures, an inverted join of their coordinates, exact confirmation."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import components
from .shared import Work, bytes_of, fresh, mixed, parts_of, word_hashes

SHINGLE = 5
COORDINATES = 128
# A pair at 0.75 agrees in 96 of 128 coordinates on average, in fewer than 76 with a probability of
# about 3 in 100,000; a pair at 0.8 with one of 2 in a hundred million.
MATCHES = 76
NUMERATOR, DENOMINATOR = 75, 100
BLOCK = 256
# Shingles of either side whose sets one task holds at a time.
TILE = 1 << 18

_RANDOM = np.random.default_rng(20_240_501)
_STEPS = _RANDOM.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ORDERS = _RANDOM.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its word shingles.

    Fewer words than a shingle has: the whole sequence is the one shingle; no words: none.
    """
    words, first = word_hashes(data, at)
    if not len(words):
        return [np.empty(0, np.uint64)] * (len(at) - 1)
    padded = np.concatenate([words, np.zeros(SHINGLE - 1, np.uint64)])
    rolled = sum(padded[j : j + len(words)] * _STEPS[j] for j in range(SHINGLE))
    rolled = mixed(rolled)
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= SHINGLE:
            sets.append(np.unique(rolled[a : b - SHINGLE + 1]))
        elif b > a:
            short = (words[a:b] * _STEPS[: b - a]).sum(dtype=np.uint64)
            sets.append(mixed(np.array([short + np.uint64(b - a)])))
        else:
            sets.append(np.empty(0, np.uint64))
    return sets


def _signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(texts, COORDINATES) coordinates and (texts, 2) digests of non-empty sets."""
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    every = np.concatenate(sets)
    out = np.empty((COORDINATES, len(sets)), np.uint32)
    for k in range(COORDINATES):
        out[k] = np.minimum.reduceat(every * _ORDERS[k], starts) >> np.uint64(32)
    digests = np.stack([
        np.add.reduceat(mixed(every + np.uint64(1)), starts), np.bitwise_xor.reduceat(mixed(every ^ _ORDERS[0]), starts),
    ], axis=1)
    return out.T.view(np.int32), digests.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in parts_of(whole, "text", 1 << 19):
            sets = shingle_sets(*bytes_of(batch.column("text")))
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            full = np.flatnonzero(sizes)
            signature = np.zeros((len(sets), COORDINATES), np.int32)
            digests = np.zeros((len(sets), 2), np.int64)
            if len(full):
                signature[full], digests[full] = _signatures([sets[i] for i in full])
            flat = pa.array(signature.ravel())
            offsets = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * COORDINATES)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sizes), pa.array(digests[:, 0]), pa.array(digests[:, 1]),
                 pa.ListArray.from_arrays(offsets, flat)],
                names=["id", "n_shingles", "d1", "d2", "signature"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in parts_of(whole, "text", 1 << 19):
            sets = shingle_sets(*bytes_of(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "shingles"],
            )


def _enough_matches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pairs in batches:
        if len(pairs):
            same = np.stack(pairs.a_signature.to_numpy()) == np.stack(pairs.b_signature.to_numpy())
            yield pairs.loc[same.sum(axis=1) >= MATCHES, ["a", "b"]]


def _members(lists: pa.Array) -> tuple:
    """The members of all lists on end, where each list begins, and what is compared of them."""
    every = lists.flatten()
    ends = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths(), dtype=np.int64))])
    prefix = np.stack([np.asarray(every.field(x), dtype=np.int64) for x in ("low", "high")], axis=1)
    return (
        ends, every.field("node"), every.field("part").to_numpy(zero_copy_only=False),
        np.asarray(every.field("n_shingles"), dtype=np.int64), np.asarray(every.field("signature").flatten()).reshape(-1, COORDINATES),
        np.unpackbits(prefix.view(np.uint8), axis=1, bitorder="little").astype(bool),
    )


def _close_in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of different parts, one of block p and one of block q, with enough matches.

    Two classes that meet in several lists are paired in that of their lowest common coordinate. The
    pairs of two blocks come as one row, or as several where the sets of their members are large.
    """
    for batch in batches:
        p_ends, p_node, p_part, p_n, p_sign, p_prefix = _members(batch.column("p"))
        q_ends, q_node, q_part, q_n, q_sign, q_prefix = _members(batch.column("q"))
        coordinates, alone = np.asarray(batch.column("key")) >> 32, batch.column("alone").to_pylist()
        one, two = [], []
        for r in range(len(batch)):
            p, q = slice(p_ends[r], p_ends[r + 1]), slice(q_ends[r], q_ends[r + 1])
            x, y = p_n[p][:, None], q_n[q][None]
            fits = (p_part[p][:, None] != q_part[q][None]) & (DENOMINATOR * x >= NUMERATOR * y) & (DENOMINATOR * y >= NUMERATOR * x)
            i, j = np.nonzero(np.triu(fits, 1) if alone[r] else fits)
            close = [np.empty((2, 0), np.int64)]
            for k in range(0, len(i), 1 << 14):
                a, b = i[k : k + (1 << 14)] + p.start, j[k : k + (1 << 14)] + q.start
                same = p_sign[a] == q_sign[b]
                enough = same.sum(axis=1) >= MATCHES
                a, b, same = a[enough], b[enough], same[enough]
                before = slice(0, coordinates[r])
                first = ~(same[:, before] & p_prefix[a, before] & q_prefix[b, before]).any(axis=1)
                close.append(np.stack([a[first], b[first]]))
            a, b = np.concatenate(close, axis=1)
            if len(a):
                tile = np.stack([(np.cumsum(p_n[p]) // TILE)[a - p.start], (np.cumsum(q_n[q]) // TILE)[b - q.start]])
                order = np.lexsort(tile)
                tile = tile[:, order]
                cuts = np.flatnonzero((tile[:, 1:] != tile[:, :-1]).any(axis=0)) + 1
                one += np.split(a[order], cuts)
                two += np.split(b[order], cuts)
        if one:
            offsets = pa.array(np.cumsum([0, *map(len, one)]).astype(np.int32))
            a, b = (pa.ListArray.from_arrays(offsets, x.take(pa.array(np.concatenate(y)))) for x, y in ((p_node, one), (q_node, two)))
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"])


def _links_in_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the pairs of each row, similar ones that connect all that are similar, directly or not."""
    for batch in batches:
        id_type = batch.column("a").type.value_type
        one, two = [], []
        for firsts, seconds, members in zip(batch.column("a"), batch.column("b"), batch.column("members")):
            members = members.values
            sets = defaultdict(list)
            for node, shingles in zip(members.field("node").to_pylist(), members.field("shingles")):
                sets[node].append(np.frombuffer(shingles.as_buffer(), np.uint64))
            lead = {node: node for node in sets}
            for a, b in zip(firsts.as_py(), seconds.as_py()):
                x, y = _leader(lead, a), _leader(lead, b)
                if x != y and any(_alike(s, t) for s in sets[a] for t in sets[b]):
                    lead[y] = x
                    one.append(a)
                    two.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(one, id_type), pa.array(two, id_type)], names=["a", "b"])


def _leader(lead: dict, node):
    while lead[node] != node:
        lead[node] = node = lead[lead[node]]
    return node


def _links_across_parts(lists: DataFrame, signatures: DataFrame, sets: DataFrame, work: Work, id_type: str) -> DataFrame:
    """Links (a, b) between members of a list (key, node, d1, part, n_shingles) in different parts.

    Of links that would close a circle among the members of two blocks some are left out.
    """
    sizes = lists.groupBy("key", "part").agg(F.count("*").alias("size"))
    pools = sizes.groupBy("key").agg(
        F.count("*").alias("parts"), F.sum(F.when(F.col("size") < BLOCK, F.col("size")).otherwise(0)).alias("pool"),
    ).where("parts > 1")
    own = F.when(F.col("size") >= BLOCK, F.col("part"))
    among = F.when(F.col("size") >= BLOCK, F.col("size")).otherwise(F.col("pool"))
    members = lists.join(sizes, ["key", "part"]).join(pools, "key").select(
        "key", "node", "d1", "part", "n_shingles", own.alias("own"), F.pmod(F.xxhash64("node"), F.ceil(among / BLOCK)).alias("number"),
    )
    blocks = members.join(signatures, ["node", "d1"]).groupBy("key", "own", "number").agg(
        F.collect_list(F.struct("node", "part", "n_shingles", "low", "high", "signature")).alias("members"),
    ).withColumn("number", F.struct(F.col("own").isNotNull().alias("pure"), "own", "number"))
    blocks = work.write(blocks.drop("own"), "blocks")
    # Blocks of one large part hold no pair; a block of small parts is compared with itself as well.
    alone = blocks.where("NOT number.pure").select("key", F.col("members").alias("p"), F.col("members").alias("q"), F.lit(True).alias("alone"))
    p, q = (blocks.select("key", F.col("number").alias(f"{x}_number"), F.col("members").alias(x)) for x in "pq")
    apart = p.join(q, "key").where(
        "p_number < q_number AND NOT (p_number.pure AND q_number.pure AND p_number.own = q_number.own)",
    ).select("key", "p", "q", F.lit(False).alias("alone"))
    tiles = alone.unionAll(apart).mapInArrow(_close_in_blocks, f"a array<{id_type}>, b array<{id_type}>")
    tiles = work.write(tiles.select(F.monotonically_increasing_id().alias("tile"), "a", "b"), "tiles")
    # Each set travels once per tile, not once per pair.
    needed = tiles.select("tile", F.explode(F.array_distinct(F.concat("a", "b"))).alias("node"))
    filled = needed.join(sets, "node").groupBy("tile").agg(F.collect_list(F.struct("node", "shingles")).alias("members"))
    return tiles.join(filled, "tile").select("a", "b", "members").mapInArrow(_links_in_tiles, f"a {id_type}, b {id_type}")


def _alike(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return DENOMINATOR * both >= NUMERATOR * (len(x) + len(y) - both)


def _similar(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pairs in batches:
        keep = [
            _alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(pairs.a_shingles, pairs.b_shingles)
        ]
        yield pairs.loc[np.array(keep, dtype=bool), ["a", "b"]]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: its id, n_shingles, component_id and kept.

    A document's set holds the distinct shingles of five lower-cased (A-Z) words. Documents with
    100 * intersection >= 75 * union are linked; component_id is the smallest id that links reach,
    kept says that it is the row's own. Null and empty texts have no shingles and no links. Rows
    with the same id are the same document, linked with what any of their texts is linked with. A
    null id counts for no link but its text's copies. An empty table gives an empty result.

    1. Documents with the same set are one class; its smallest id stands for it from here on.
    2. Each class is posted under its 128 (coordinate, value) pairs. Values only one class has are
       dropped, and with them most of the table: 76 must agree.
    3. Of m remaining postings ordered from rare to frequent, two classes that agree in 76 share one
       of their first m - 75 (the prefix), so a passage that everybody quotes is not looked up.
    4. In each posting list all members are compared with the smallest one: as many pairs as
       postings. Links found this way put a group of copies into one component.
    5. What is left are pairs of a list in different components. Lists are cut into blocks, large
       components into blocks of their own, and blocks are compared with each other unless they are
       of one component; only pairs with enough matches leave a comparison, together with the other
       pairs of their blocks, so that each full set is looked up once for all of them.
    Compared means: equal signature coordinates are counted, pairs with 76 or more are confirmed on
    the full sets.
    """
    work = Work(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    signed = work.write(rows.mapInArrow(
        _sign, f"id {id_type}, n_shingles bigint, d1 bigint, d2 bigint, signature array<int>",
    ), "signed")
    classes = work.write(
        signed.where("n_shingles > 0 AND id IS NOT NULL").groupBy("n_shingles", "d1", "d2").agg(
            F.min("id").alias("node"), F.max("signature").alias("signature")), "classes",
    )

    postings = classes.select("node", "d1", "n_shingles", F.posexplode("signature").alias("at", "value")).select(
        "node", "d1", "n_shingles",
        F.shiftleft(F.col("at").cast("bigint"), 32).bitwiseOR(F.col("value").cast("bigint").bitwiseAND(0xFFFFFFFF)).alias("key"),
    )
    shared = postings.groupBy("key").agg(F.count("*").alias("often")).where("often > 1")
    postings = postings.join(shared.hint("shuffle_hash"), "key")
    of_node = Window.partitionBy("node", "d1")
    postings = postings.select(
        "node", "d1", "key", "n_shingles", F.count("*").over(of_node).alias("m"), F.row_number().over(of_node.orderBy("often", "key")).alias("place"),
    ).where(f"m >= {MATCHES} AND place <= m - {MATCHES - 1}").select("node", "d1", "key", "n_shingles")
    postings = work.write(postings, "prefixes")

    signatures = classes.select("node", "signature")
    # The coordinates of a class's prefix, as 128 bits.
    bit = "bit_or(if(shiftright(key, 38) = {}, shiftleft(1L, int(shiftright(key, 32) & 63)), 0L))"
    prefixes = postings.groupBy("node", "d1").agg(F.expr(bit.format(0)).alias("low"), F.expr(bit.format(1)).alias("high"))
    prefixed = classes.select("node", "d1", "signature").join(prefixes, ["node", "d1"])
    active = postings.select("node").distinct()
    sets = rows.join(active, rows.id == active.node, "left_semi").mapInArrow(_sets, f"node {id_type}, shingles binary")
    sets = work.write(sets, "sets")

    pair = f"a {id_type}, b {id_type}"

    def matched(pairs: DataFrame) -> DataFrame:
        """Of the pairs (a, b), those with enough matches."""
        sign = {x: signatures.toDF(x, f"{x}_signature") for x in "ab"}
        return pairs.join(sign["a"], "a").join(sign["b"], "b").mapInPandas(_enough_matches, pair).distinct()

    def confirmed(close: DataFrame) -> DataFrame:
        """Of the pairs (a, b), those whose sets are similar."""
        full = {x: sets.toDF(x, f"{x}_shingles") for x in "ab"}
        return close.join(full["a"], "a").join(full["b"], "b").mapInPandas(_similar, pair).distinct()

    lowest = postings.groupBy("key").agg(F.min("node").alias("a"))
    stars = postings.join(lowest, "key").where("a <> node").select("a", F.col("node").alias("b")).distinct()
    links = work.write(confirmed(matched(stars)), "links-to-lowest")

    label = components(links, work, "first")
    lists = postings.join(label, "node", "left").select(
        "key", "node", "d1", F.coalesce("component", "node").alias("part"), "n_shingles")
    links = links.unionAll(_links_across_parts(lists, prefixed, sets, work, id_type))
    label = components(work.write(links, "links"), work, "all")

    known = classes.join(label, "node", "left").select(
        "n_shingles", "d1", "d2", F.coalesce("component", "node").alias("component"),
    )
    # A row's class may hold only ids that are null; rows of an id with several texts go by the id.
    own = label.select(F.col("node").alias("id"), F.col("component").alias("by_id"))
    return signed.drop("signature").join(known, ["n_shingles", "d1", "d2"], "left").join(own, "id", "left").select(
        F.col("id").alias(id_col), "n_shingles",
        F.coalesce("by_id", "component", "id").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`near_duplicates` keeps, with all their columns.

    Of a group the document with the smallest id stays; rows with a null id stay unless their text
    has a class with an id.
    """
    other = fresh(docs, "dropped_id")
    found = near_duplicates(docs, id_col, text_col)
    dropped = found.where(F.col(id_col).isNotNull() & ~F.col("kept")).select(F.col(id_col).alias(other)).distinct()
    return docs.join(dropped, docs[id_col] == dropped[other], "left_anti")
