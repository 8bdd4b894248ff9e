"""Session settings and lineage cuts."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "quarry", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; ``master`` only for local runs and tests."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster. A temporary one only on a local master: elsewhere executors would write to it
    what nobody else can read, so a missing setting is an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quarry-"))
    return named or sc.getCheckpointDir()


def scratch(spark: SparkSession) -> str:
    """A fresh path in the shared folder, deleted when the application ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/quarry/{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that losing an executor costs no
    recomputation beyond this point. A written table is computed once, where ``checkpoint()`` runs
    its plan twice, and its file sizes give the planner true statistics."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_by(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """Like :func:`cut`, with the rows of a ``key`` in one of so many buckets: joins and groupings by ``key`` read the table
    where it lies, only their other side travels."""
    name = f"quarry_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", scratch(df.sparkSession)).saveAsTable(name)
    out = df.sparkSession.table(name)
    df.sparkSession.sql(f"DROP TABLE {name}")  # the name only: the files stay, and the plan of ``out`` knows them and their buckets
    return out


def drop(df: DataFrame) -> None:
    """Delete the files of a table that :func:`cut` wrote, once nothing reads it any more."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/quarry/" in folder:
            where = jvm.org.apache.hadoop.fs.Path(folder)
            where.getFileSystem(conf).delete(where, True)


def parallelism(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)
