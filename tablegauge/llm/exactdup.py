"""Exact duplicates: a tree of merges over sorted runs of digests, DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WHITE, Work, fresh

FAN_IN = 16


def normalised(text: Column) -> Column:
    """The text with each run of ASCII white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def merged_runs(runs: DataFrame, partitions: int, fan_in: int = FAN_IN) -> DataFrame:
    """One row per text from sorted runs of (run, sha, length, check, first, copies).

    In each round ``fan_in`` neighbouring runs exchange their rows and become one: run r joins run
    r // fan_in. Within a merged run the rows of a text meet, and the smallest identifier is kept
    once digest, length and a second, independent hash all agree. Spark deals a merged run out by
    text, so no task ever holds a whole run, and combines rows of a text before they travel: a text
    that fills a third of the table leaves each task as one row.
    """
    while True:
        runs = runs.groupBy(F.floor(F.col("run") / fan_in).cast("int").alias("run"), "sha", "length", "check").agg(
            F.min("first").alias("first"), F.sum("copies").alias("copies"),
        )
        partitions = -(-partitions // fan_in)
        if partitions <= 1:
            return runs.drop("run")
        runs = runs.sortWithinPartitions("run", "sha")


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN,
) -> DataFrame:
    """Per row of ``docs``: its id, keep_id, group_size, kept and text_sha256.

    Texts are equal when identical after every run of ASCII white space became one space. Of equal
    texts the row with the smallest id stays; of rows that share that id too, exactly one. A null
    text counts as empty, a null id as larger than all others. Other columns are not looked at. An
    empty table gives an empty result.
    """
    work = Work(docs.sparkSession)
    text = normalised(F.col(text_col))
    digests = docs.select(F.col(id_col).alias("id"), text.alias("text")).select(
        "id",
        F.unhex(F.sha2("text", 256)).alias("sha"),
        F.length("text").alias("length"),
        F.xxhash64("text").alias("check"),
        F.spark_partition_id().alias("run"),
        F.monotonically_increasing_id().alias("row"),
    )
    # Written once: the row numbers stay as they are when a task runs again, and each text is read once.
    digests = work.write(digests.sortWithinPartitions("sha"), "digests")
    last = digests.agg(F.max("run")).first()[0]
    runs = digests.select(
        "run", "sha", "length", "check",
        F.struct(F.col("id").isNull().alias("none"), "id", "row").alias("first"),
        F.lit(1).cast("bigint").alias("copies"),
    )
    texts = merged_runs(runs, (last or 0) + 1, fan_in)
    return digests.join(texts, ["sha", "length", "check"]).select(
        F.col("id").alias(id_col),
        F.col("first.id").alias("keep_id"),
        F.col("copies").alias("group_size"),
        (F.col("row") == F.col("first.row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def without_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`exact_duplicates` keeps, with all their columns.

    Of rows with the same id and equal texts any one stays.
    """
    sha, keep = fresh(docs, "text_sha256"), fresh(docs, "keep_id")
    kept = exact_duplicates(docs, id_col, text_col).where("kept").select(
        F.col("keep_id").alias(keep), F.col("text_sha256").alias(sha + "_"),
    )
    rows = docs.withColumn(sha, F.sha2(normalised(F.col(text_col)), 256)).dropDuplicates([id_col, sha])
    same = rows[id_col].eqNullSafe(kept[keep]) & (rows[sha] == kept[sha + "_"])
    return rows.join(kept, same, "left_semi").select(*docs.columns)
