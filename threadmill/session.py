"""Sessions and checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "threadmill", time_zone: str = "UTC", **conf) -> SparkSession:
    """A session with an explicit time zone and adaptive execution; other settings stay the cluster's."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", time_zone).config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; a temporary one only where that is unset, as in tests."""
    sc = spark.sparkContext
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    now = sc._jsc.sc().getCheckpointDir()
    if not conf:
        conf = now.get() if now.isDefined() else tempfile.mkdtemp(prefix="threadmill-")
    if now.isEmpty():
        sc.setCheckpointDir(conf)
    return conf


def saved(df: DataFrame) -> DataFrame:
    """df computed once and cut from its lineage by a checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have: _name, with more underscores as needed."""
    taken = {c.lower() for c in df.columns}
    while (name := f"_{name}").lower() in taken:
        pass
    return name
