"""Mixing sources to target weights by pivotal dependent rounding, DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import WORD, Work, fresh

WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
BLOCK = 128
EDGE = 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _ranked(names: DataFrame, work: Work) -> DataFrame:
    """The sources numbered from 0 by code point, null last, without one task for all of them."""
    name = F.col("source")
    ordered = names.repartitionByRange(name.asc_nulls_last()).sortWithinPartitions(name.asc_nulls_last())
    ordered = work.write(ordered.withColumn("part", F.spark_partition_id()), "sources")
    within = Window.partitionBy("part").orderBy(name.asc_nulls_last())
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ordered.groupBy("part").agg(F.count("*").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"),  # a row per partition
    )
    return ordered.join(starts, "part").select(
        "source", "source_size", "units", (F.col("start") + F.row_number().over(within) - 1).alias("place"),
    )


def source_targets(sizes: DataFrame, work: Work, weights=WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, units) with the target words of each source.

    The targets share the total in proportion to the weights, which repeat in the order of the
    sources. A target stops at ``most`` times the source's size; the excess goes to the others by
    weight until none is above. Each round reads one row of sums.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sources = work.write(_ranked(sizes, work).withColumn("weight", weight), "weighted")
    limit = F.col("source_size") * float(most)
    total = float(sources.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        full = limit <= F.col("weight") * level
        spent, open_weight = sources.agg(
            F.sum(F.when(full, limit).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))),
        ).first()
        if not open_weight:
            break
        above = (total - spent) / open_weight
        if above <= level:
            break
        level = above
    return sources.withColumn("target", F.least(limit, F.col("weight") * level)).drop("weight", "place")


def _rounded_block(units: Column) -> Column:
    """Fold the units of one block: pair each with the one that is still fractional.

    A pair moves mass along its sizes, so that the expected words of the block and each unit's
    expected copies stay as they are, until one of the two is integral. The other goes on. The units
    come from large to small: then a small one is left at the end, and little is lost by rounding it.
    """
    def draw(held: Column, unit: Column) -> Column:
        return (F.abs(F.xxhash64(held["hash"], unit["hash"], F.lit(17))) % (1 << 30)) / float(1 << 30)

    def outcome(unit: Column, p: Column, whole: Column) -> Column:
        return F.struct(unit["id"].alias("id"), F.when(whole, (p > 0.5).cast("int")).alias("copy"))

    def moved(unit: Column, p: Column) -> Column:
        return F.struct(
            (-unit["size"]).alias("first"), unit["hash"].alias("hash"), unit["id"].alias("id"), unit["size"].alias("size"),
            p.alias("p"),
        )

    def let(value: Column, body) -> Column:
        return F.transform(F.array(value), body)[0]

    def pair(state: Column, unit: Column) -> Column:
        held = state["held"]
        # Mass is counted in words: up moves it from the unit to the held one, down the other way.
        limits = F.struct(
            F.least((1 - held["p"]) * held["size"], unit["p"] * unit["size"]).alias("up"),
            F.least(held["p"] * held["size"], (1 - unit["p"]) * unit["size"]).alias("down"),
        )
        gain = let(limits, lambda m: F.when(draw(held, unit) * (m["up"] + m["down"]) < m["down"], m["up"]).otherwise(-m["down"]))
        after = let(gain, lambda g: F.struct(
            (held["p"] + g / held["size"]).alias("held"), (unit["p"] - g / unit["size"]).alias("unit"),
        ))
        return F.when(held.isNull(), F.struct(unit.alias("held"), state["done"].alias("done"))).otherwise(
            let(after, lambda p: settled(state, unit, p))
        )

    def settled(state: Column, unit: Column, p: Column) -> Column:
        held = state["held"]
        held_whole = (p["held"] < EDGE) | (p["held"] > 1 - EDGE)
        unit_whole = (p["unit"] < EDGE) | (p["unit"] > 1 - EDGE)
        done = F.concat(
            state["done"],
            F.filter(F.array(outcome(held, p["held"], held_whole), outcome(unit, p["unit"], unit_whole)),
                     lambda x: x["copy"].isNotNull()),
        )
        goes_on = F.when(held_whole & unit_whole, F.lit(None)).when(held_whole, moved(unit, p["unit"])).otherwise(moved(held, p["held"]))
        return F.struct(goes_on.alias("held"), done.alias("done"))

    unit_type = "struct<first:double,hash:bigint,id:bigint,size:double,p:double>"
    start = F.struct(
        F.lit(None).cast(unit_type).alias("held"),
        F.array().cast("array<struct<id:bigint,copy:int>>").alias("done"),
    )
    return F.aggregate(units, start, pair)


def _near_integers(share: Column) -> Column:
    """A hair off an integer is that integer."""
    return F.when(F.abs(share - F.round(share)) < EDGE, F.round(share)).otherwise(share)


def _rounded(units: DataFrame, most_units: int, block: int, work: Work, name: str) -> DataFrame:
    """(hash, copy) of units whose share has a fraction: a reduction tree over blocks of them."""
    open_units = units.withColumn("p", F.col("share") - F.floor("share")).where("p > 0 AND size > 0").select(
        "group", "none", "units", "hash",
        F.struct((-F.col("size")).alias("first"), "hash", F.col("hash").alias("id"), "size", "p").alias("unit"),
    )
    decided, level = [], 0
    while True:
        blocks = F.ceil(F.col("units") / F.lit(float(block) ** (level + 1)))
        number = F.pmod(F.xxhash64("hash", F.lit(level)), F.greatest(blocks, F.lit(1)))
        folded = open_units.groupBy("group", "none", "units", number.alias("number")).agg(
            F.array_sort(F.collect_list("unit")).alias("block"),
        ).select("group", "none", "units", _rounded_block(F.col("block")).alias("state"))
        folded = work.write(folded, f"{name}{level}")
        decided.append(folded.select(F.explode("state.done").alias("d")).select("d.id", "d.copy"))
        open_units = folded.where("state.held IS NOT NULL").select(
            "group", "none", "units", F.col("state.held.hash").alias("hash"), F.col("state.held").alias("unit"),
        )
        level += 1
        if most_units <= block**level:
            break
    decided.append(open_units.select(F.col("unit.id").alias("id"), (F.col("unit.p") >= 0.5).cast("int").alias("copy")))
    copies = decided[0]
    for more in decided[1:]:
        copies = copies.unionAll(more)
    return copies.withColumnRenamed("id", "hash")


def _exchanged(units: DataFrame, copies: DataFrame, passes: int = 3) -> DataFrame:
    """(hash, copy) after the words that a group misses are made up for by turning decisions round.

    From the largest unit to the smallest, each one's rounding is turned where that brings the
    group's words nearer to its share. A group has fewer than a block of units.
    """
    unit = F.struct((-F.col("size")).alias("first"), "hash", "size", "copy")
    groups = units.join(copies, "hash").groupBy("group", "none").agg(
        F.sum(F.col("size") * (F.col("share") - F.floor("share") - F.col("copy"))).alias("miss"),
        F.array_sort(F.collect_list(unit)).alias("block"),
    )
    block = dict(groups.dtypes)["block"]

    def turned(state: Column, unit: Column) -> Column:
        gain = F.when(unit["copy"] == 1, -unit["size"]).otherwise(unit["size"])
        nearer = F.abs(state["miss"] - gain) < F.abs(state["miss"]) - EDGE
        copy = F.when(nearer, 1 - unit["copy"]).otherwise(unit["copy"])
        return F.struct(
            F.when(nearer, state["miss"] - gain).otherwise(state["miss"]).alias("miss"),
            F.concat(state["done"], F.array(F.struct(unit["first"], unit["hash"], unit["size"], copy.alias("copy")))).alias("done"),
        )

    for _ in range(passes):
        start = F.struct(F.col("miss").cast("double").alias("miss"), F.array().cast(block).alias("done"))
        groups = groups.select("group", "none", F.aggregate("block", start, turned).alias("state")).select(
            "group", "none", "state.miss", F.col("state.done").alias("block"),
        )
    return groups.select(F.explode("block").alias("u")).select("u.hash", "u.copy")


def mixed_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights=WEIGHTS, most: int = MOST_COPIES, block: int = BLOCK,
) -> DataFrame:
    """Per row of ``docs``: id, source, size, source_size, target, copies and taken words.

    A source's target divided by its size is the number of copies each of its documents should have.
    The whole part is taken; the fractions are rounded by pivotal sampling: blocks of about
    ``block`` documents resolve pairs, each block leaves one fractional document, and those meet in
    the next level until one is left in a source, which is rounded to the nearer side. Documents that
    are large beside their source (fewer than ``block``) are rounded first; from the largest to the
    smallest, one is turned round where that brings their words nearer to their share, and what they
    still miss is spread over the fractions of the others. So the words taken differ from the target
    by half a small document, where a source has enough small ones.

    Draws come from hashes of the ids: reruns agree. Rows that share id and source count as one
    document. Documents without words, or a null text, are taken 0 words and copied as their whole
    part says. A null source is a source of its own, the last one. No source, however large, is ever
    in one task: blocks are dealt out by hash.
    """
    work = Work(docs.sparkSession)
    rows = work.write(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
    ), "rows")
    grouped = rows.groupBy("id", "source").agg(F.sum("size").alias("size"))
    sizes = grouped.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("units"),
    )
    targets = work.write(source_targets(sizes, work, weights, most), "targets")

    same_source = F.col("u.source").eqNullSafe(F.col("t.source"))
    share = F.when(F.col("t.source_size") > 0, F.col("t.target") / F.col("t.source_size")).otherwise(0.0)
    units = work.write(grouped.alias("u").join(targets.alias("t"), same_source).select(
        "u.id", "u.source", "t.units", F.col("u.size").cast("double").alias("size"), _near_integers(share).alias("share"),
        # The hash of (id, source) names a document while it is rounded.
        F.xxhash64("u.id", "u.source").alias("hash"),
        F.xxhash64("u.source").alias("group"), F.col("u.source").isNull().alias("none"),
        (F.col("u.size") * block > F.col("t.source_size")).alias("large"),
    ), "units")

    # Fewer than ``block`` documents of a source are larger than its size divided by ``block``.
    large = units.where("large")
    large_copies = _rounded(large.withColumn("units", F.lit(1)), 1, block, work, "large")
    large_copies = work.write(_exchanged(large, large_copies), "large-copies")
    owed = large.join(large_copies, "hash").groupBy("group", "none").agg(
        F.sum(F.col("size") * (F.col("share") - F.floor("share") - F.col("copy"))).alias("owed"),
    )
    rest = units.where("NOT large").groupBy("group", "none").agg(F.sum("size").alias("rest"))
    owed = work.write(rest.join(owed, ["group", "none"]).select(
        "group", "none", F.when(F.col("rest") > 0, F.col("owed") / F.col("rest")).otherwise(0.0).alias("shift"),
    ), "owed")
    shifted = F.least(F.lit(float(most)), F.greatest(F.lit(0.0), F.col("share") + F.coalesce("shift", F.lit(0.0))))
    small = work.write(
        units.where("NOT large").join(owed, ["group", "none"], "left").withColumn("share", _near_integers(shifted)), "small",
    )
    most_units = targets.agg(F.max("units")).first()[0] or 0
    small_copies = _rounded(small, most_units, block, work, "small")
    units = large.select(*small.columns[:-1], F.lit(0.0).alias("shift")).unionByName(small)
    copies = large_copies.unionAll(small_copies).groupBy("hash").agg(F.max("copy").alias("copy"))
    per_unit = units.join(copies, "hash", "left").select(
        "id", "source", (F.floor("share") + F.coalesce("copy", F.lit(0))).cast("int").alias("copies"),
    )
    same_unit = F.col("r.id").eqNullSafe(F.col("c.id")) & F.col("r.source").eqNullSafe(F.col("c.source"))
    return (
        rows.alias("r").join(per_unit.alias("c"), same_unit)
        .join(targets.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")))
        .select(
            F.col("r.id").alias(id_col), F.col("r.source").alias(source_col), "r.size", "t.source_size", "t.target",
            "c.copies", (F.col("c.copies") * F.col("r.size")).alias("taken"),
        )
    )


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs``, each as often as :func:`mixed_copies` says."""
    i, s, n = fresh(docs, "mix_id"), fresh(docs, "mix_source"), fresh(docs, "mix_copies")
    copies = mixed_copies(docs, id_col, text_col, source_col, **options).select(
        F.col(id_col).alias(i), F.col(source_col).alias(s), F.col("copies").alias(n),
    ).where(F.col(n) > 0).dropDuplicates([i, s])
    same = docs[id_col].eqNullSafe(copies[i]) & docs[source_col].eqNullSafe(copies[s])
    return docs.join(copies, same).withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns)
