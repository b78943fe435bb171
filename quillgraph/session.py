"""A session with the settings the operators count on."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "quillgraph", **conf: str) -> SparkSession:
    """ANSI mode, UTC, adaptive execution with skew joins; pass more settings by their names with
    underscores for dots. Shuffle partitions and memory are left to the cluster."""
    b = SparkSession.builder.appName(app)
    for k, v in {"spark.sql.ansi.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", **{k.replace("_", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def share_code(spark: SparkSession) -> None:
    """Lets Python workers that start from now on find this package where the driver found it, whatever
    folder the driver was started in. On a cluster the package is installed or sent with --py-files."""
    env, here = spark.sparkContext.environment, str(Path(__file__).resolve().parents[1])
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if here not in known:
        env["PYTHONPATH"] = os.pathsep.join([here, *filter(None, known)])


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which executors and driver share. Only where it is
    unset and Spark runs in one process (tests), a folder of this machine is set."""
    jsc = spark.sparkContext._jsc.sc()
    known = jsc.getCheckpointDir()
    if known.isDefined():
        return known.get()
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
    spark.sparkContext.setCheckpointDir(folder)
    return jsc.getCheckpointDir().get()


def written(df: DataFrame, what: str, **options: str) -> DataFrame:
    """df as a table in the shared folder, read back: a lost executor costs no recomputation. It goes
    when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, what: str, n: int, key: str) -> DataFrame:
    """df as a table in the shared folder in n buckets of a key, read back as dealt so: joins and groupings by the key
    move nothing. df itself is best dealt by the key to n tasks, as each task writes a file for each of its buckets."""
    spark = df.sparkSession
    name = f"{what}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    df.write.format("parquet").bucketBy(n, key).options(path=path, compression="zstd").saveAsTable(name)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name alone; the files stay
    return out


@contextmanager
def staying(spark: SparkSession) -> Iterator[None]:
    """Jobs begun inside join rows that are dealt by some of their keys where they lie, and read buckets as such. None
    of their tables is broadcast but by a hint: a file of few MB can hold rows of a hundred times that in the driver."""
    conf = {
        "spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
