"""Helpers of the corpus operators: tables written to the shared folder, names, hashes of words."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.staging import scratch_folder

WHITE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, for those that lack it."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    # On the driver's own disk: Spark serves the file from here to the executors.
    archive = os.path.join(tempfile.mkdtemp(prefix="tablegauge-"), "tablegauge-package.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for at, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(at, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(package)))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


class Work:
    """A folder for the written intermediate tables of one call.

    The folder lies in ``spark.checkpoint.dir``. A written table cuts the lineage: lost executors
    never cost more than the running stage. Tables that no later plan reads are dropped early, the
    rest when the driver's JVM ends.
    """

    def __init__(self, spark: SparkSession):
        ship_package(spark)
        self.spark = spark
        self.folder = f"{scratch_folder(spark)}/tablegauge-llm/{uuid.uuid4().hex}"
        path, files = self._at(self.folder)
        files.deleteOnExit(path)

    def _at(self, folder: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def write(self, df: DataFrame, name: str, *partitions: str, **options: str) -> DataFrame:
        """Partition columns are the last ones of ``df``; each of their values can be dropped by itself."""
        df.write.options(**options).partitionBy(*partitions).parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            path, files = self._at(f"{self.folder}/{name}")
            files.delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


MOST_DRAWN = 1_000_000


def drawn(docs: DataFrame, id_col: str, text_col: str, most: int, by: str | None = None, kinds: int = 1) -> DataFrame:
    """Texts of the ``most`` smallest id hashes, per value of ``by`` if given: id, text and ``by``, one row per id.

    Rows without an id, text or value of ``by`` are left out; ``kinds`` is how many values that has. Only ids
    are ranked, and of those only about twice as many as wanted, whose hashes lie below a bound made from
    the number of rows; texts are fetched last.
    """
    keys = [by] if by else []
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *keys).dropna()
    ids = docs.select("id", *keys, F.pmod(F.xxhash64("id"), F.lit(1 << 30)).cast("double").alias("place"))
    if by:
        ids = ids.join(docs.groupBy(by).agg(F.count("*").alias("rows")), by)
    else:
        ids = ids.withColumn("rows", F.lit(docs.count()))
    below = ids.where(F.col("place") * F.col("rows") < float((2 * most + 100) << 30))
    order = Window.partitionBy(*keys).orderBy("place", "id")
    chosen = below.select("id", *keys, "place").distinct().withColumn("nth", F.row_number().over(order))
    chosen = chosen.where(F.col("nth") <= most).select("id", *keys)
    if most * kinds <= MOST_DRAWN:
        chosen = F.broadcast(chosen)
    return docs.join(chosen, ["id", *keys]).dropDuplicates(["id", *keys])


def in_fold(id_column: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold`` modulo ``folds`` (a null id: never)."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % folds == fold, F.lit(False))


def parts_of(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of ``column``, so that memory stays bounded."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
    # A worker outlives its task: what earlier slices freed goes back to the system.
    pa.default_memory_pool().release_unused()


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column on end, and where each text begins and the last one ends."""
    texts = pc.fill_null(column, "").cast(pa.large_binary())
    texts = pa.concat_arrays([texts])
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    every = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return every[at[0] : at[-1]], at - at[0]


_BASE = 0x9E3779B97F4A7C15 | 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WHITE = np.zeros(256, dtype=bool)
_IS_WHITE[[32, 9, 10, 11, 12, 13]] = True
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        n = max(n + (n >> 3), 1 << 20)
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"], _POWERS["down"]


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every bit of the result depends on every bit of ``x``."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions at which the words of all texts begin and end."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    inside = ~_IS_WHITE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = at[1:][at[1:] > at[:-1]]
    last[edges - 1] = inside[edges - 1]
    edges = at[:-1][at[1:] > at[:-1]]
    first[edges] = inside[edges]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of all texts, and where each text's words begin."""
    begin, end = word_spans(data, at)
    up, down = _powers(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    hashes = (sums[end] - sums[begin]) * down[begin]
    hashes = mixed(hashes + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return hashes, np.searchsorted(begin, at)
