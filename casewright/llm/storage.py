"""Intermediate tables in the folder that driver and executors share.

Lineage is cut by writing parquet below ``spark.checkpoint.dir``: a lost
executor costs a task, not the steps before it.  Where the setting is absent
(tests, a laptop) a temporary folder stands in, and only with a local master.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession

SPARKS_OWN, BATCH_BYTES = f"{64 << 20}b", 4 << 20
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder, or a local one for local masters."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _own[app] = tempfile.mkdtemp(prefix="casewright-")
    return _own[app]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet in the shared folder and read it back."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/casewright/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _remove_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    def remove() -> None:
        with suppress(Exception):
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    atexit.register(remove)


def release(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files behind a table from :func:`materialize` once nothing reads it."""
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/casewright/" in f:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(f)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of bounded bytes, where the session still has Spark's own bound: a worker holds texts several times over."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == SPARKS_OWN:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
