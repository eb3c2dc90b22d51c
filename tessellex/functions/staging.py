"""Tables written once in a folder that every executor can read, so that lineage ends there."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes that a broadcast side may hold, by the measure of ``held_bytes``.
BROADCAST_BYTES = 32 << 20
#: Rows of one key beyond which a join deals that key into several tasks.
HOT_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, a fresh local one if the session runs in this one process, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessellex-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found


def _forget(spark: SparkSession, path: str) -> None:
    """Delete a staged table; a session that is already stopped leaves it."""
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the gateway is gone: nothing can be deleted any more
        return


def fresh_folder(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing else uses; what is written there is deleted when the driver exits."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    return path


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet under the shared folder and return the table that reads it.

    The rows survive lost executors, and later plans start from files instead of recomputing
    their input. The folder is deleted by ``release``, or when the driver exits.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}/{tag}"
    df.write.parquet(path)
    atexit.register(_forget, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete a table that ``stage`` returned; nothing that reads it may run any more."""
    _forget(df.sparkSession, df._staged_path)


def _width(kind: T.DataType, column) -> object:
    """Bytes of a value in a row of a join's table, as a column or a number."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        inner = 8 if not isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType)) else 64
        return F.greatest(F.coalesce(F.size(column), F.lit(0)), F.lit(0)) * inner + 32
    if isinstance(kind, T.StructType):
        return sum((_width(f.dataType, column.getField(f.name)) for f in kind.fields), F.lit(16))
    return F.lit(8)


def held_bytes(df: DataFrame) -> int:
    """What df would hold in memory as the broadcast side of a join, measured over all rows: values, and 32 bytes a row for its head and its place in the hash table."""
    width = sum((_width(f.dataType, F.col(f"`{f.name}`")) for f in df.schema.fields), F.lit(32))
    return int(df.agg(F.sum(width.cast("long"))).first()[0] or 0)


def small(df: DataFrame) -> DataFrame:
    """A staged df with a broadcast hint if its measured bytes are within BROADCAST_BYTES; else df itself."""
    return F.broadcast(df) if held_bytes(df) <= BROADCAST_BYTES else df


def salted(many: DataFrame, once: DataFrame, on: list[str], how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """many joined with once (one row a key) on columns without nulls; a key with over HOT_ROWS rows in many is dealt into several tasks.

    counts has the keys and how many rows of many each has, as ``many``; without it they are counted,
    if many (then staged) has more rows than that at all. At most its rows / HOT_ROWS keys are hot;
    those, a number with each, are broadcast.
    """
    if counts is None:
        if many.count() <= HOT_ROWS:
            return many.join(once, on, how)
        counts = many.groupBy(*on).agg(F.count("*").alias("many"))
    hot = stage(counts.filter(F.col("many") > HOT_ROWS).select(*on, F.ceil(F.col("many") / HOT_ROWS).cast("int").alias("_deals")), "hot")
    if not hot.head(1):
        return many.join(once, on, how)
    deals = F.coalesce("_deals", F.lit(1))
    left = many.join(F.broadcast(hot), on, "left").withColumn("_deal", F.pmod(F.xxhash64(*many.columns), deals).cast("int")).drop("_deals")
    right = once.join(F.broadcast(hot), on, "left").withColumn("_deal", F.explode(F.sequence(F.lit(0), deals - 1))).drop("_deals")
    return left.join(right, [*on, "_deal"], how).drop("_deal")
