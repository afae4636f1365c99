"""Near duplicates among vectors: a neighbour graph refined by NN-descent, links above a cosine."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import TableGaugeError
from .graph import components
from .shared import Work

COSINE = 0.95
NEIGHBOURS = 10
SEEDED = 0.998  # chance that two vectors at the threshold are on the same side of all planes of some table
BUCKET = 128
BLOCK = 256
MEETING = 64  # neighbours that meet at one node in one task at most
QUIET = 0.01  # a round that changes a smaller share of the lists is the last
AUDIT = 256  # nodes drawn at first, and nodes planted
ENOUGH = 64  # linked nodes to be among those drawn
MOST = 4096  # nodes drawn, each of which is compared with every node
RECALL = 0.99
SLACK = 1e-5  # of single precision; pairs this near the threshold are looked at in double

_EDGE = "node bigint, other bigint, cosine float"


def _unit_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, dim, digest, unit): null where a vector cannot link."""
    for batch in batches:
        dims, digests, units = [], [], []
        for v in batch.column("embedding"):
            raw = v.as_py()
            unit = None
            if raw and all(x is not None for x in raw):
                x = np.array(raw, dtype=np.float64) + 0.0  # -0.0 is 0.0
                largest = np.abs(x).max()
                if np.isfinite(x).all() and largest > 0:
                    scaled = x / largest  # very large or small components do not overflow
                    unit = scaled / np.sqrt((scaled * scaled).sum())
            dims.append(None if unit is None else len(unit))
            digests.append(None if unit is None else hashlib.blake2b(x.tobytes(), digest_size=16).digest())
            units.append(None if unit is None else unit.tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(dims, pa.int32()), pa.array(digests, pa.binary()), pa.array(units, pa.binary())],
            names=["id", "dim", "digest", "unit"],
        )


def tables_for(bits: int) -> int:
    """How many tables of ``bits`` planes it takes for a pair at the threshold to meet in one."""
    together = (1 - np.arccos(COSINE) / np.pi) ** bits
    return max(1, int(np.ceil(np.log(1 - SEEDED) / np.log(1 - together))))


def _codes(bits: int, tables: int, seed: int):
    """Which side of ``bits`` random planes a vector is on, for each of several tables."""

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[int, np.ndarray] = {}
        for nodes in batches:
            for dim, part in nodes.groupby("dim"):
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, dim]).normal(size=(dim, tables * bits))
                units = np.stack([np.frombuffer(u, np.float32) for u in part.single])
                sides = (units @ planes[dim] > 0).reshape(len(part), tables, bits)
                codes = sides @ (1 << np.arange(bits, dtype=np.int64))
                yield pd.DataFrame({
                    "node": np.repeat(part.node.to_numpy(), tables), "dim": np.int32(dim),
                    "number": np.tile(np.arange(tables, dtype=np.int32), len(part)), "code": codes.ravel(),
                })

    return code


def _meet(keep: int):
    """For each row, the vectors that meet there are compared; each proposes its nearest ones."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("met")
            members = lists.flatten()
            nodes = np.asarray(members.field("node"), dtype=np.int64)
            ends = np.cumsum(np.asarray(lists.value_lengths(), dtype=np.int64))
            singles = members.field("single")
            a, b, c = [], [], []
            start = 0
            for end in ends.tolist():
                ids = nodes[start:end]
                units = np.stack([np.frombuffer(x.as_buffer(), np.float32) for x in singles[start:end]]) if end - start > 1 else None
                start = end
                if units is None:
                    continue
                cosines = units @ units.T
                cosines[ids[:, None] == ids[None]] = -2.0
                k = min(keep, len(ids) - 1)
                near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
                value = np.take_along_axis(cosines, near, axis=1)
                good = value > -2.0
                a.append(np.repeat(ids, k).reshape(-1, k)[good])
                b.append(ids[near][good])
                c.append(value[good])
            if a:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in (a, b, c)], names=["node", "other", "cosine"],
                )

    return meet


def _met(members: DataFrame, vectors: DataFrame, keys: list[str], keep: int) -> DataFrame:
    """Proposals (node, other, cosine) of the members (keys, node) that meet under the same keys."""
    rows = members.join(vectors, "node")
    return rows.groupBy(*keys).agg(F.collect_list(F.struct("node", "single")).alias("met")).select("met").mapInArrow(_meet(keep), _EDGE)


def _nearest(proposals: DataFrame, neighbours: int) -> DataFrame:
    """The nearest ones of each node; proposals of a node are bounded by the meetings it was in."""
    best = proposals.groupBy("node", "other").agg(F.max("cosine").alias("cosine"))
    lists = best.groupBy("node").agg(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("far"), "other"))).alias("near"))
    return lists.select("node", F.explode(F.slice("near", 1, neighbours)).alias("e")).select(
        "node", F.col("e.other").alias("other"), (-F.col("e.far")).alias("cosine"),
    )


def _descended(graph: DataFrame, vectors: DataFrame, neighbours: int, work: Work, name: str) -> DataFrame:
    """One round: all that list a node or are listed by it meet there, itself included."""
    met = graph.select(F.col("node").alias("at"), F.col("other").alias("node")).unionAll(
        graph.select(F.col("other").alias("at"), "node")).unionAll(graph.select(F.col("node").alias("at"), "node")).distinct()
    # A node that very many list is met in groups.
    size = met.groupBy("at").agg(F.count("*").alias("n")).where(F.col("n") > MEETING)
    met = met.join(size, "at", "left").withColumn(
        "part", F.pmod(F.xxhash64("node", "at"), F.ceil(F.coalesce("n", F.lit(1)) / MEETING)),
    ).select("at", "part", "node")
    found = _met(met, vectors, ["at", "part"], max(4, neighbours // 2))
    return work.write(_nearest(graph.unionAll(found), neighbours), name)


def _in_double(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pairs in batches:
        cosines = [float(np.frombuffer(x) @ np.frombuffer(y)) for x, y in zip(pairs.a_unit, pairs.b_unit)]
        yield pairs.loc[np.array(cosines, dtype=float) >= COSINE, ["a", "b"]]


def _links_of_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How many vectors of block q each vector of block p is linked with, itself left out."""
    for pairs in batches:
        for r in pairs.itertuples():
            x, y = (np.stack([np.frombuffer(u) for u in units]) for units in (r.p_unit, r.q_unit))
            close = x @ y.T >= COSINE
            close[np.asarray(r.p_node)[:, None] == np.asarray(r.q_node)[None]] = False
            yield pd.DataFrame({"node": r.p_node, "n": close @ np.asarray(r.q_copies, dtype=np.int64)})


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per row of ``vectors``: its id, n_links, component_id and kept.

    Vectors with a cosine of 0.95 or more, in double precision, are linked. n_links counts the other
    vectors linked directly, component_id is the smallest id that links reach, kept says that it is
    the row's own. Vectors that are null, empty, zero, or hold a null or non-finite component link
    with nothing, nor do rows with a null id, nor vectors of different lengths. Repeated rows are
    vectors of their own that link with each other. Other columns are not looked at; an empty table
    gives an empty result.

    1. Equal vectors are one node, named by the smallest id.
    2. The first neighbour lists come from tables of random planes: vectors on the same side of all
       planes meet in blocks of a bounded size. More vectors take more planes a table, and more
       tables, so that the chance to meet does not fall.
    3. NN-descent: in each round a node's neighbours, and those whose neighbour it is, meet at the
       node, are compared with each other and propose themselves to each other's lists, until a
       round changes few of them.
    4. Pairs of the lists above the threshold are links. A list that is full of links is saturated:
       there may be more than it holds. So the lists of whole components are enlarged to all their
       members, compared in blocks, which makes n_links exact within a component.
    5. Recall is audited in two ways. Nodes are drawn, and all their links found by comparing them
       with every node, until enough of them have links; and partners are planted that have a cosine
       just above the threshold with one node. Either mean over nodes of the share of links found
       has to be 0.99. Below, lists are doubled, more tables added, and the lists descend again;
       when lists as long as the table do not suffice, it is an error. If all nodes are drawn, what
       the audit finds is all there is.
    """
    work = Work(vectors.sparkSession)
    element = vectors.schema[vector_col].dataType.elementType
    kind = T.ArrayType(element) if isinstance(element, (T.FloatType, T.DoubleType)) else T.ArrayType(T.DoubleType())
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast(kind).alias("embedding"))
    units = work.write(rows.mapInArrow(_unit_vectors, "id bigint, dim int, digest binary, unit binary"), "units")
    nodes = units.where("unit IS NOT NULL AND id IS NOT NULL").groupBy("digest", "dim").agg(
        F.min("id").alias("node"), F.count("*").alias("copies"), F.max("unit").alias("unit"),
    )

    def in_single(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            part["single"] = [np.frombuffer(u).astype(np.float32).tobytes() for u in part.unit]
            yield part

    # Rows that share an id but not the vector: each vector is a node, the id of a node is not
    # unique then. Their numbers are, and stay, as the table is written.
    nodes = work.write(nodes.mapInPandas(
        in_single, "digest binary, dim int, node bigint, copies bigint, unit binary, single binary",
    ).withColumnRenamed("node", "id").withColumn("node", F.monotonically_increasing_id()), "nodes")
    total = nodes.count()
    bits = max(1, int(np.ceil(np.log2(max(total, 2) / BUCKET)))) if total > BUCKET else 1
    truth, planted, complete = _audit(nodes, total, work)
    search = work.write(nodes.select("node", "dim", "unit", "single").unionAll(planted.drop("at")), "search")
    single = search.select("node", "single")

    def seeded(seed: int, neighbours: int) -> DataFrame:
        codes = work.write(search.select("node", "dim", "single").mapInPandas(
            _codes(bits, tables_for(bits), seed), "node bigint, dim int, number int, code bigint"), f"codes{seed}")
        size = codes.groupBy("dim", "number", "code").agg(F.count("*").alias("n"))
        members = codes.join(size, ["dim", "number", "code"]).withColumn(
            "part", F.pmod(F.xxhash64("node", "number"), F.ceil(F.col("n") / BLOCK)))
        return _met(members.drop("n"), single, ["dim", "number", "code", "part"], neighbours)

    neighbours, graph, links, step = NEIGHBOURS, None, None, 0
    while True:
        start = seeded(step, neighbours)
        graph, k = work.write(_nearest(start if graph is None else graph.unionAll(start), neighbours), f"graph{step}-0"), 0
        while True:
            k += 1
            before, graph = graph, _descended(graph, single, neighbours, work, f"graph{step}-{k}")
            changed = graph.join(before.select("node", "other"), ["node", "other"], "left_anti").count()
            if changed <= QUIET * max(total * neighbours, 1):
                break
        pairs = graph.where(F.col("cosine") >= COSINE - SLACK).select(
            F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"), "cosine",
        ).groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
        unsure = pairs.where(F.col("cosine") < COSINE + SLACK).select("a", "b")
        full = {x: search.select(F.col("node").alias(x), F.col("unit").alias(f"{x}_unit")) for x in "ab"}
        checked = unsure.join(full["a"], "a").join(full["b"], "b").mapInPandas(_in_double, "a bigint, b bigint")
        links = pairs.where(F.col("cosine") >= COSINE + SLACK).select("a", "b").unionAll(checked)
        links = work.write(links, f"links{step}")
        # What is planted links itself, and must not link others.
        real = links.where("a >= 0")
        if complete or min(
            recall(truth, components(real, work, f"component{step}")),
            recall(planted.select(F.col("node").alias("a"), F.col("at").alias("b")), components(links, work, f"planted{step}")),
        ) >= RECALL:
            break
        if neighbours >= total:
            raise TableGaugeError(f"near_vectors: lists of {neighbours} neighbours do not hold {RECALL:.0%} of the links")
        neighbours, step = 2 * neighbours, step + 1
    links = real
    # What the audit found counts as well.
    label = components(links.unionAll(truth.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct(), work, "components")

    member = nodes.join(label, "node")
    block = F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / BLOCK)).alias("block")
    sizes = label.groupBy("component").agg(F.count("*").alias("members"))
    blocks = member.join(sizes, "component").select("component", block, "node", "copies", "unit").groupBy("component", "block").agg(
        F.collect_list(F.struct("node", "copies", "unit")).alias("m"),
    ).select("component", "m.node", "m.copies", "m.unit")
    blocks = work.write(blocks, "blocks")
    p, q = (blocks.select("component", *[F.col(c).alias(f"{x}_{c}") for c in ("node", "copies", "unit")]) for x in "pq")
    counts = p.join(q, "component").drop("component", "p_copies").mapInPandas(_links_of_blocks, "node bigint, n bigint")
    counts = counts.groupBy("node").agg(F.sum("n").alias("n"))
    lowest = member.groupBy("component").agg(F.min("id").alias("lowest"))
    named = member.join(lowest, "component").join(counts, "node", "left").select("digest", "dim", "lowest", "n")

    known = units.join(nodes.select("digest", "dim", F.col("id").alias("first"), "copies"), ["digest", "dim"], "left").join(
        named, ["digest", "dim"], "left")
    linked = F.col("unit").isNotNull() & F.col("id").isNotNull()
    return known.select(
        F.col("id").alias(id_col),
        F.when(linked, F.coalesce("n", F.lit(0)) + F.col("copies") - 1).otherwise(0).cast("bigint").alias("n_links"),
        F.when(linked, F.coalesce("lowest", "first")).otherwise(F.col("id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))


def recall(truth: DataFrame, label: DataFrame) -> float:
    """Mean over the nodes ``a`` of the share of their links (a, b) that join one component; 1 without links."""
    mine = {x: label.select(F.col("node").alias(x), F.col("component").alias(f"{x}_component")) for x in "ab"}
    together = truth.join(mine["a"], "a", "left").join(mine["b"], "b", "left")
    found = F.coalesce(F.col("a_component") == F.col("b_component"), F.lit(False)).cast("double")
    share = together.groupBy("a").agg(F.avg(found).alias("share")).agg(F.avg("share")).first()[0]
    return 1.0 if share is None else share


def _audit(nodes: DataFrame, total: int, work: Work) -> tuple[DataFrame, DataFrame, bool]:
    """The links (a, b) of the nodes drawn, planted (node, dim, unit, single, at), and whether all nodes are drawn."""
    drawn, truth = 0, None
    while True:
        size = min(max(2 * drawn, AUDIT), total, MOST)
        order = nodes.select("node", "dim", "unit", F.xxhash64("digest").alias("at")).orderBy("at", "node").limit(size)
        sample = order.toPandas()
        part = work.write(_all_links_of(nodes, sample.iloc[drawn:]), f"audited{drawn}")
        truth, drawn = part if truth is None else truth.unionAll(part), size
        if drawn >= min(total, MOST) or truth.select("a").distinct().count() >= ENOUGH:
            break
    planted, random, cosine = [], np.random.default_rng(11), COSINE + 10 * SLACK
    for row in sample.iloc[:AUDIT].itertuples() if drawn < total else ():
        if row.dim > 1:
            unit = np.frombuffer(row.unit)
            away = random.normal(size=row.dim)
            away -= (away @ unit) * unit
            near = cosine * unit + np.sqrt(1 - cosine**2) * away / np.sqrt(away @ away)
            planted.append((-1 - len(planted), int(row.dim), bytearray(near.tobytes()), bytearray(near.astype(np.float32).tobytes()), int(row.node)))
    partners = nodes.sparkSession.createDataFrame(planted, "node bigint, dim int, unit binary, single binary, at bigint")
    return truth, partners, drawn >= total


def _all_links_of(nodes: DataFrame, sample: pd.DataFrame) -> DataFrame:
    """All links (a, b) of the sampled nodes a, which are at most MOST, against every node."""
    queries = {
        int(dim): (part.node.to_numpy(), np.stack([np.frombuffer(u) for u in part.unit])) for dim, part in sample.groupby("dim")
    }
    shared = nodes.sparkSession.sparkContext.broadcast(queries)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for every in batches:
            for dim, part in every.groupby("dim"):
                if int(dim) in shared.value:
                    ids, units = shared.value[int(dim)]
                    for at in range(0, len(part), 1024):
                        mine = part.node.to_numpy()[at : at + 1024]
                        i, j = np.nonzero(np.stack([np.frombuffer(u) for u in part.unit[at : at + 1024]]) @ units.T >= COSINE)
                        a, b = ids[j], mine[i]
                        keep = a != b
                        yield pd.DataFrame({"a": a[keep], "b": b[keep]})

    return nodes.select("node", "dim", "unit").mapInPandas(compare, "a bigint, b bigint")
