"""Jobs as a stream over the event table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from casewright.registry import query, table
from casewright.shared import shared_dir
from casewright.streaming import stateful

LIFE = """WITH RECURSIVE ev AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, CASE event_type WHEN 'view' THEN 'submit' WHEN 'click' THEN 'claim' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'fail' ELSE event_type END AS kind, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT DISTINCT user_id, 0::BIGINT AS k, NULL::BIGINT AS ms, NULL::VARCHAR AS kind, NULL::INT AS step, NULL::VARCHAR AS status, NULL::INT AS attempt, NULL::BIGINT AS lease, false AS emits, NULL::BIGINT AS x_at, NULL::INT AS x_step, NULL::VARCHAR AS x_status, NULL::INT AS x_attempt FROM ev
  UNION ALL SELECT user_id, k, ms, kind,
    CASE WHEN kind = 'submit' AND (s IS NULL OR s IN ('DONE', 'DEAD_LETTER')) THEN 1 WHEN kind = 'done' AND s = 'PROCESSING' AND step < 9 THEN step + 1 ELSE step END,
    CASE WHEN kind = 'submit' AND (s IS NULL OR s IN ('DONE', 'DEAD_LETTER')) THEN 'PENDING' WHEN kind = 'claim' AND s IN ('PENDING', 'RETRYING') THEN 'PROCESSING' WHEN kind = 'fail' AND s = 'PROCESSING' THEN CASE WHEN a + 1 >= 3 THEN 'DEAD_LETTER' ELSE 'RETRYING' END WHEN kind = 'done' AND s = 'PROCESSING' THEN CASE WHEN step < 9 THEN 'PENDING' ELSE 'DONE' END ELSE s END,
    CASE WHEN kind = 'submit' AND (s IS NULL OR s IN ('DONE', 'DEAD_LETTER')) THEN 0 WHEN kind = 'fail' AND s = 'PROCESSING' THEN a + 1 WHEN kind = 'done' AND s = 'PROCESSING' AND step < 9 THEN 0 ELSE a END,
    CASE WHEN kind = 'claim' AND s IN ('PENDING', 'RETRYING') THEN ms + 43200000 WHEN s = 'PROCESSING' AND kind NOT IN ('done', 'fail') THEN l END,
    (kind = 'submit' AND (s IS NULL OR s IN ('DONE', 'DEAD_LETTER'))) OR (kind = 'claim' AND s IN ('PENDING', 'RETRYING')) OR (kind IN ('done', 'fail') AND s = 'PROCESSING'),
    x_at, step, s, a
  FROM (SELECT ev.user_id, ev.k, ev.ms, ev.kind, f.step, CASE WHEN f.status = 'PROCESSING' AND f.lease <= ev.ms THEN CASE WHEN f.attempt + 1 >= 3 THEN 'DEAD_LETTER' ELSE 'RETRYING' END ELSE f.status END AS s, CASE WHEN f.status = 'PROCESSING' AND f.lease <= ev.ms THEN f.attempt + 1 ELSE f.attempt END AS a,
    CASE WHEN f.lease > ev.ms THEN f.lease END AS l, CASE WHEN f.status = 'PROCESSING' AND f.lease <= ev.ms THEN f.lease END AS x_at FROM f JOIN ev ON ev.user_id = f.user_id AND ev.k = f.k + 1)),
steps AS (SELECT ['VALIDATE', 'SPLIT', 'NORMALIZE', 'CONVERT', 'METADATA_EXTRACT', 'REDACT', 'TRANSLATE', 'CHUNK', 'EMBED', 'KG_EXTRACT'] AS names),
ended AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC) = 1)
SELECT user_id AS document, ms AS at_ms, names[step] AS step, status, attempt, kind AS cause FROM f, steps WHERE emits
UNION ALL SELECT user_id, x_at, names[x_step], x_status, x_attempt, 'expired' FROM f, steps WHERE x_at IS NOT NULL
UNION ALL SELECT user_id, lease, names[step], CASE WHEN attempt + 1 >= 3 THEN 'DEAD_LETTER' ELSE 'RETRYING' END, attempt + 1, 'expired' FROM ended, steps WHERE status = 'PROCESSING' AND lease <= (SELECT epoch_us(max(ts)) // 1000 - 3600000 FROM events)"""


@query(LIFE)
def st_lifecycle(spark, d):
    """Users as documents and their events as those of jobs with leases of twelve hours, through a stream with state and timers."""
    schema = table(spark, d, "events").schema
    kind = F.when(F.col("event_type") == "view", "submit").when(F.col("event_type") == "click", "claim").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "fail").otherwise(F.col("event_type"))
    stream = spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]")  # a pattern, as a stream takes no single file by name
    rows = stream.select(F.col("user_id").alias("document"), F.col("event_id").alias("event"), kind.alias("kind"), F.col("ts").cast("timestamp").alias("at"))
    out = stateful.drained(stateful.transitions(rows, lease_minutes=720, graph=False), f"{shared_dir(spark)}/casewright/jobs-{uuid.uuid4().hex}")
    return out.select("document", F.unix_millis("at").alias("at_ms"), "step", "status", "attempt", "cause")
