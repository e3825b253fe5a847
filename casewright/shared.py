"""Intermediate tables and size-checked broadcasts.

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
from pyspark.sql import functions as F

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


def written(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as parquet in the shared folder, in folders of the columns ``by``, and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/casewright/{name}-{uuid.uuid4().hex}"
    (df.repartition(*by).write.partitionBy(*by) if by else df.write).parquet(path)

    def remove() -> None:
        with suppress(Exception):
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    atexit.register(remove)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = 200_000) -> DataFrame:
    """A broadcast of ``df`` if it was counted and has at most ``most`` rows; else Spark chooses the join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def shares(spark: SparkSession, rows: int, most: int = 250_000) -> int:
    """Partitions for a shuffle of so many rows: Spark's own number, or more, so that what one task sorts doesn't grow with the input."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // most))
