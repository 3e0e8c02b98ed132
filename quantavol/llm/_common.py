"""Shared folders, staged tables and distributed ranks of the training-data operators."""

from __future__ import annotations

import ctypes
import uuid
from typing import ClassVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where spark.checkpoint.dir is unset, as in local tests.
LOCAL_SHARED = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines of the cluster share, from spark.checkpoint.dir.

    Only a local master, where there is one machine, may leave it unset.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return (path or LOCAL_SHARED).rstrip("/")


class Stage:
    """A folder of intermediate tables under the shared one.

    Tables cut the lineage: a lost executor costs the tasks that it ran, not what came before.
    drop() removes what is no longer read; release() removes whole folders once results are written.
    """

    #: Every folder of this process that is still there, oldest first.
    made: ClassVar[list[Stage]] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        Stage.made.append(self)

    @classmethod
    def release(cls, since: int = 0) -> None:
        """Deletes the folders made since there were so many: for those whose results have been written."""
        for stage in cls.made[since:]:
            stage.drop("")
        del cls.made[since:]

    def table(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        to = f"{self.path}/{name}"
        df.write.option("compression", codec).mode("errorifexists").parquet(to)
        return self.spark.read.schema(df.schema).parquet(to)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def tidy() -> None:
    """Gives memory that a task no longer uses back to the machine; Python workers outlive tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to do
        pass


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def need(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that others may have any name; asks for those that are missing."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*(F.col(f"`{n}`") for n in names))


def fresh(taken: DataFrame | list[str], *wanted: str) -> tuple[str, ...]:
    """Names like the wanted ones that no column has, whatever the case."""
    used, out = {c.lower() for c in (taken.columns if isinstance(taken, DataFrame) else taken)}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return tuple(out)


def n_words(text: Column) -> Column:
    """Words of a text without Python: runs outside [\\x20\\x09-\\x0D]; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def dense_rank(stage: Stage, df: DataFrame, groups: list[str], order: list[str], to: str, name: str) -> DataFrame:
    """Adds a gapless rank from 0 within each group, with no task that holds a whole group.

    Rows are range-partitioned by group, order and a row number that only separates equal rows;
    each partition ranks its own rows, and the counts of (partition, group) give the offsets.
    The sorted rows are a written table, so both reads see the same partitions.
    """
    spark = stage.spark
    keys = [*groups, *order]
    n = partitions(spark)
    sorted_ = (
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(n, *keys, "_tie")
        .sortWithinPartitions(*keys, "_tie")
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
        .drop("_tie")
    )
    rows = stage.table(sorted_, name)
    counts = rows.groupBy("_part", *groups).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_low"))
    from pyspark.sql import Window

    # One row for each partition and group: as many as there are partitions for the largest group.
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    counts = counts.withColumn("_base", F.col("_base") - F.col("_low")).drop("_n", "_low")
    names = [f"_g{i}" for i in range(len(groups))]
    counts = counts.select(F.col("_part").alias("_p"), *(F.col(g).alias(a) for g, a in zip(groups, names)), "_base")
    on = F.col("_part") == F.col("_p")
    for g, a in zip(groups, names):
        on = on & F.col(g).eqNullSafe(F.col(a))
    return rows.join(counts, on).withColumn(to, (F.col("_at") + F.col("_base")).cast("long")).drop("_part", "_at", "_p", "_base", *names)


def arrow_schema(fields: dict[str, pa.DataType]) -> pa.Schema:
    return pa.schema(list(fields.items()))
