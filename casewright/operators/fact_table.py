"""Facts as files by workspace, refreshed a workspace at a time.

A refresh writes a new version of the workspaces that it names, beside what is
there, and then one log row for each: the log is what makes a version current.
Readers take the newest logged version of each workspace, so that they see all
of a refresh or nothing of it, and the files of other workspaces stay as they are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "workspace_id string, version string, place bigint, fact_rows bigint, cases bigint, refreshed_at timestamp"


class FactTable:
    """Facts below a folder; ``workspace_id`` and a column of cases are all that it knows of them."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, cases: str = "metadata_cases"):
        self.spark, self.folder, self.cases = spark, folder.rstrip("/"), cases
        self.schema = schema

    def log(self) -> DataFrame:
        """All refreshes, one row a workspace each."""
        if not self._there(f"{self.folder}/log"):
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).parquet(f"{self.folder}/log")

    def _there(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def current(self) -> DataFrame:
        """The newest log row of each workspace."""
        return self.log().groupBy("workspace_id").agg(F.max_by(F.struct("version", "place", "fact_rows", "cases", "refreshed_at"), "place").alias("r")).select("workspace_id", "r.*")

    def refresh(self, facts: DataFrame, workspaces: list[str]) -> DataFrame:
        """Exchange the facts of these workspaces, also for none; the new log rows."""
        version = uuid.uuid4().hex
        own = facts.where(F.col("workspace_id").isin(workspaces))
        path = f"{self.folder}/facts/{version}"
        own.repartition("workspace_id", "fact_date").write.partitionBy("workspace_id").parquet(path)
        place = (self.log().agg(F.max("place")).first()[0] or 0) + 1
        asked = self.spark.createDataFrame([(w,) for w in workspaces], "workspace_id string")
        zero = F.lit(0).cast("bigint")
        counted = self._files(path).groupBy("workspace_id").agg(F.count("*").alias("n"), F.sum(self.cases).alias("c")) if self._rows(path) else self.spark.createDataFrame([], "workspace_id string, n bigint, c bigint")
        rows = asked.join(counted, "workspace_id", "left").select("workspace_id", F.lit(version).alias("version"), F.lit(place).cast("bigint").alias("place"), F.coalesce("n", zero).alias("fact_rows"), F.coalesce("c", zero).alias("cases"), F.current_timestamp().alias("refreshed_at"))
        rows.coalesce(1).write.mode("append").parquet(f"{self.folder}/log")
        return self.log().where(F.col("version") == version)

    def _rows(self, path: str) -> bool:
        fs = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return any("workspace_id=" in f.getPath().getName() for f in fs.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(fs))

    def _files(self, *paths: str, base: str | None = None) -> DataFrame:
        return self.spark.read.option("basePath", base or paths[0]).schema(self.schema).parquet(*paths)

    def read(self) -> DataFrame:
        """The current facts of all workspaces; one path for each of them."""
        live = [(r["version"], r["workspace_id"]) for r in self.current().where("fact_rows > 0").select("version", "workspace_id").toLocalIterator()]
        if not live:
            return self.spark.createDataFrame([], self.schema)
        out = None
        for version in sorted({v for v, _ in live}):
            base = f"{self.folder}/facts/{version}"
            part = self._files(base).where(F.col("workspace_id").isin([w for v, w in live if v == version]))
            out = part if out is None else out.unionByName(part)
        return out
