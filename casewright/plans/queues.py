"""Queue snapshots over the event table: each event is a job."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewright.registry import query, table
from casewright.streaming import lifecycle

JOBS_SQL = "jobs AS (SELECT event_id AS job_id, CASE event_type WHEN 'view' THEN 'PENDING' WHEN 'click' THEN 'RETRYING' WHEN 'error' THEN 'PROCESSING' ELSE 'DONE' END AS status, user_id % 10 AS priority, ts AS created_at, CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 10 DAY END AS locked_until, event_id % 5 AS attempt FROM events), now AS (SELECT TIMESTAMP '2024-01-20 00:00:00' AS t)"


def jobs(spark, d):
    status = F.when(F.col("event_type") == "view", "PENDING").when(F.col("event_type") == "click", "RETRYING").when(F.col("event_type") == "error", "PROCESSING").otherwise("DONE")
    return table(spark, d, "events").select(F.col("event_id").alias("job_id"), status.alias("status"), (F.col("user_id") % 10).alias("priority"), F.col("ts").alias("created_at"), F.when(F.col("event_id") % 3 == 0, F.expr("ts + INTERVAL 10 DAYS")).alias("locked_until"), (F.col("event_id") % 5).alias("attempt"))


def now():
    return F.expr("TIMESTAMP_NTZ '2024-01-20 00:00:00'")


@query(f"WITH {JOBS_SQL} SELECT job_id, priority FROM jobs, now WHERE status IN ('PENDING', 'RETRYING') AND (locked_until IS NULL OR locked_until < t) ORDER BY priority DESC, created_at, job_id LIMIT 25")
def st_claim(spark, d):
    return lifecycle.claim(jobs(spark, d), now(), 25).select("job_id", "priority")


@query(f"WITH {JOBS_SQL} SELECT CASE WHEN status = 'PROCESSING' AND locked_until < t AND attempt >= 3 THEN 'DEAD_LETTER' WHEN status = 'PROCESSING' AND locked_until < t THEN 'RETRYING' ELSE status END AS status, count(*) AS n FROM jobs, now GROUP BY 1")
def st_reclaim(spark, d):
    return lifecycle.reclaim(jobs(spark, d), now()).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT job_id, status, wait FROM (SELECT event_id AS job_id, CASE WHEN event_type = 'error' AND event_id % 5 + 1 >= 3 THEN 'DEAD_LETTER' WHEN event_type = 'error' THEN 'RETRYING' ELSE 'DONE' END AS status, CASE WHEN event_type = 'error' AND event_id % 5 + 1 < 3 THEN 5 * (2 ** (event_id % 5))::INT END AS wait FROM events)")
def st_retry(spark, d):
    """Failures wait longer each time, and the last one goes to the dead letters."""
    j = table(spark, d, "events").select(F.col("event_id").alias("job_id"), F.when(F.col("event_type") == "error", "FAILED").otherwise("DONE").alias("status"), (F.col("event_id") % 5).alias("attempt"))
    return lifecycle.retried(j).select("job_id", "status", "wait")


@query("WITH s AS (SELECT event_id, ['VALIDATE','SPLIT','NORMALIZE','CONVERT','METADATA_EXTRACT','REDACT','TRANSLATE','CHUNK','EMBED','KG_EXTRACT'] AS steps, event_id % 10 + 1 AS k, event_id % 3 = 0 AS g FROM events) SELECT event_id, steps[k] AS step, CASE WHEN steps[k] = 'EMBED' AND NOT g THEN NULL ELSE steps[k + 1] END AS following FROM s")
def st_pipeline(spark, d):
    step = F.get(F.array(*(F.lit(x) for x in lifecycle.STEPS)), (F.col("event_id") % 10).cast("int"))
    return table(spark, d, "events").select("event_id", step.alias("step"), lifecycle.next_step(step, F.col("event_id") % 3 == 0).alias("following"))


@query("SELECT o.c_custkey AS id, CASE WHEN o.c_custkey % 2 = 0 THEN o.c_acctbal + 1 ELSE o.c_acctbal END AS balance, o.c_mktsegment AS kept FROM customer o")
def dml_upsert_case(spark, d):
    """Every second row comes anew; one column keeps its old value."""
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("kept"))
    new = old.where("id % 2 = 0").select("id", (F.col("balance") + 1).alias("balance"), F.lit("changed").alias("kept"))
    return lifecycle.latest_wins(old, new, ["id"], ["kept"])


@query("SELECT event_type AS kind, count(*) AS n FROM events WHERE event_type = 'purchase' OR event_type NOT IN ('view', 'error') OR date_diff('day', ts::DATE, DATE '2024-01-31') <= CASE event_type WHEN 'view' THEN 10 ELSE 20 END GROUP BY 1")
def dml_retention(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("kind"), F.col("ts").alias("created_at"))
    return lifecycle.retained(rows, F.lit("2024-01-31").cast("date"), {"view": 10, "error": 20}, ["purchase"]).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)")
def dml_insert_ignore(spark, d):
    """New keys only."""
    known = table(spark, d, "lineitem").where("l_quantity > 40").select("l_orderkey")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id")).join(known, F.col("id") == F.col("l_orderkey"), "left_anti")


@query("SELECT user_id, min(ts) AS first FROM events GROUP BY 1")
def st_idem(spark, d):
    e = table(spark, d, "events").select("user_id", "ts")
    return lifecycle.once(e, "user_id", "ts", "1 day").select("user_id", F.col("ts").alias("first"))
