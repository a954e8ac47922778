"""Session helpers: where intermediate tables go, and how lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# With it Spark deletes a query's shuffle files when it ends; else they wait for the driver's garbage collection.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_stored: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def work_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only a
    local session without that setting (tests, notebooks) gets a fresh folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not sc.master.startswith("local"):
                raise RuntimeError(
                    "set spark.checkpoint.dir to a folder all executors can reach"
                )
            shared = tempfile.mkdtemp(prefix="sitefeed-")
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage of iterative jobs and survives lost executors. Unlike
    a checkpoint, the result is columnar: later reads prune columns, push
    filters, and give the optimizer a real size for its broadcast decision. What
    the query shuffled is deleted as soon as the table is written.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    _stored[table] = path
    return table


def read_together(tables: list[DataFrame]) -> DataFrame:
    """Tables of one schema made by ``materialize``, as one scan however many they are."""
    first = tables[0]
    return first.sparkSession.read.schema(first.schema).parquet(*[_stored[t] for t in tables])


class BucketedRows:
    """Rows added from time to time, in one folder per bucket; a reader opens only the buckets it names.

    Nothing that was written is written again, so ``n`` additions cost what their rows cost.
    """

    def __init__(self, spark: SparkSession, label: str, columns: list[str], buckets: int):
        self.spark, self.columns, self.buckets = spark, columns, buckets
        self.path = f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.present: set[int] = set()
        self.schema: StructType | None = None

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.columns), F.lit(self.buckets)).cast("int")

    def numbers(self, rows: DataFrame) -> set[int]:
        """The buckets of the rows: at most as many numbers as there are buckets."""
        return {r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect()}

    def add(self, rows: DataFrame) -> None:
        rows = rows.select(*self.columns)
        self.schema = rows.schema
        self.present |= self.numbers(rows)
        placed = rows.withColumn("bucket", self.bucket())
        placed.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(self.path)

    def read(self, wanted: set[int]) -> DataFrame | None:
        """The rows of those buckets; None when they hold none."""
        paths = [f"{self.path}/bucket={b}" for b in sorted(wanted & self.present)]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else None

    def discard(self) -> None:
        _delete(self.spark, self.path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``materialize`` once nothing lazy refers to them."""
    for table in tables:
        path = _stored.pop(table, None)
        if path:
            _delete(table.sparkSession, path)
