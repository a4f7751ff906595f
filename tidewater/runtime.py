"""Session helpers shared by all operators: table access, parallelism, lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it (clusters ship it with --py-files)."""
    root, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, have) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data directory."""
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parallelism(spark: SparkSession) -> int:
    """Tasks that keep the cluster busy: the shuffle width, at least three waves of its cores."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the plan; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Before CPU-heavy Python stages: widen inputs whose scan has fewer splits than the cluster has cores.

    Large inputs already have one task per file split and are returned as they are. Hashing on keys that are
    nearly unique keeps the layout the same when a task is retried.
    """
    spark = df.sparkSession
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    wanted = parallelism(spark)
    if estimated_bytes(df) >= split * wanted:
        return df
    return df.repartition(wanted, *keys)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder of spark.checkpoint.dir; a local folder only where none is configured (tests, local mode)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local["):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidewater-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared checkpoint folder and cut its lineage; survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of checkpoints."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def read_bytes(spark: SparkSession, path: str) -> bytes | None:
    """A small file of a shared folder, or None."""
    rows = spark.read.format("binaryFile").load(path).select("content").collect() if _exists(spark, path) else []
    return bytes(rows[0][0]) if rows else None


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Writes a small file beside its place and moves it there, so that readers never see a part of it."""
    p, fs = _fs(spark, path)
    part = f"{path}.{uuid.uuid4().hex}"
    out = fs.create(p(part))
    out.write(bytearray(data))
    out.close()
    if not fs.rename(p(part), p(path)):
        fs.delete(p(part), False)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path
    return p, p(path).getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p(path))
