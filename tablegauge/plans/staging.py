"""Written intermediate tables and small pinned tables.

A base that several later plans read is written once, as Parquet in the shared folder the
session names in ``spark.checkpoint.dir``. A written table cuts the lineage, so the loss of an
executor never repeats the scan behind it, and every reader sees the same rows.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..errors import TableGaugeError


_LOCAL_FOLDERS: dict[str, str] = {}


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one only where Spark runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise TableGaugeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="tablegauge-")
    return _LOCAL_FOLDERS[app]


class Staging:
    """The written tables of one profile."""

    def __init__(self, spark: SparkSession):
        self._spark = spark
        self._folder: str | None = None

    def path(self, name: str) -> str:
        if self._folder is None:
            self._folder = f"{scratch_folder(self._spark)}/tablegauge/{uuid.uuid4().hex}"
        return f"{self._folder}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        return self._spark.read.schema(df.schema).parquet(path)

    def pin(self, df: DataFrame, name: str, bounded: bool) -> DataFrame:
        """Compute a small table once.

        ``bounded`` says that the schema bounds its rows (one per column or pair of columns);
        then it becomes a local table in the plan. Otherwise, as with groups, it is written.
        """
        if not bounded:
            return self.write(df, name)
        # One partition: what is derived from it needs no exchange.
        return self._spark.createDataFrame(df.toArrow(), schema=df.schema).coalesce(1)

    def close(self) -> None:
        if self._folder is None:
            return
        jvm = self._spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self._folder)
        path.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(path, True)
        self._folder = None
