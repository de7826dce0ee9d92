"""Tables in the folder that driver and executors share, and checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of fixed width, and bytes of what one row holds, up to which a side is sent to all executors.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Where the setting is absent, a local master gets a temporary folder and any
    other master a folder under the warehouse.
    """
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
            _own_dirs[app] = tempfile.mkdtemp(prefix="docquarry-")
        else:
            _own_dirs[app] = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_docquarry"
    return _own_dirs[app]


def cut(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The plan above it starts from files, so a lost executor costs a re-read and
    never a recomputation, and values that depend on task placement are frozen.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docquarry-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Remove the tables that ``cut`` has written for this application; results read from them must be stored before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/docquarry-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if its counted rows are few, else as it is; for rows of fixed width."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def in_parts(df: DataFrame, key: str, size, most: int = BROADCAST_BYTES) -> list[DataFrame]:
    """``df`` by hash of ``key`` in as many parts as keep each below ``most`` bytes on average; ``size`` gives a row's bytes."""
    held = df.agg(F.coalesce(F.sum(size), F.lit(0)).cast("long")).first()[0]
    parts = 1 + held // most
    return [df] if parts == 1 else [df.filter(F.pmod(F.xxhash64(key), F.lit(parts)) == i) for i in range(parts)]
