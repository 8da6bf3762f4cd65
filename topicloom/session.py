"""Session factory and the shared folder that iterative plans cut their lineage at."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    b = SparkSession.builder.master(master).config("spark.sql.shuffle.partitions", str(partitions)).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where it is unset (tests on one machine) a temporary folder is set."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="shared-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def bound_batches(spark: SparkSession, most: int = 32 << 20) -> None:
    """Bound the bytes of the Arrow batches sent to a Python worker; only lowers what the session has."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(re.sub(r"\D", "", spark.conf.get(key)) or 0)
    if not 0 < now <= most:
        spark.conf.set(key, str(most))


def cut(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: the lineage ends, and lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
