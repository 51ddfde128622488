"""Shared helpers of the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadmill.session import free_name  # noqa: F401

#: What separates words: blanks and the controls from tab to carriage return.
SPACE = "\\x20\\x09-\\x0D"
#: Rows of an Arrow batch; texts of 100 kB then make batches of some 25 MB.
BATCH_ROWS = 256
#: Bytes of a table up to which it is broadcast.
BROADCAST_BYTES = 32 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker holds at a time, however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset, as in tests."""
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        conf = set_dir.get() if set_dir.isDefined() else tempfile.mkdtemp(prefix="threadmill-")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(conf)
    return conf


def saved(df: DataFrame) -> DataFrame:
    """df, computed once and cut from its lineage by a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def released(spark: SparkSession) -> None:
    """Lets go what earlier steps shuffled and nothing refers to any more: Spark removes that once the driver's garbage is collected, and not before."""
    gc.collect()  # what Python still holds in cycles, the driver holds too
    spark.sparkContext._jvm.System.gc()


def shared_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder in the shared one, which goes when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(where)
    system.deleteOnExit(where)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once as a Parquet table in the shared folder: what is wide is a fraction of its size there."""
    path = f"{shared_folder(df.sparkSession, name)}/table"
    nothing = [f.name for f in df.schema if isinstance(f.dataType, T.NullType)]  # Parquet has no such type
    bare = df.drop(*nothing)
    bare.write.parquet(path)
    back = df.sparkSession.read.schema(bare.schema).parquet(path)
    return back.withColumns({c: F.lit(None) for c in nothing}).select(*df.columns) if nothing else back


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df (a saved one, as it is counted) marked for broadcasting if its rows take ``most`` bytes or less, else df."""
    def size(c, kind):
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.octet_length(c)
        return F.size(c) * 16 if isinstance(kind, T.ArrayType) else F.lit(0)

    bytes_of = sum((F.coalesce(size(F.col(f.name), f.dataType), F.lit(0)) for f in df.schema), F.lit(16 + 16 * len(df.columns))).cast("long")
    total = df.agg(F.sum(bytes_of)).first()[0] or 0
    return F.broadcast(df) if total <= most else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(expr, body):
    """body(x) for x = expr, which is evaluated once: in a lambda a plain column expression would be evaluated for each element."""
    return F.element_at(F.transform(F.array(expr), body), 1)


def word_array(text):
    """The words of a text: runs of anything but SPACE; null gives none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")
