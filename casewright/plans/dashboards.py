"""Usage dashboards over the event stream, conversations and labels.

Events stand in for retrieval runs, feedback and fetch attempts; the newest
event is "now".
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casewright.registry import query, table

NOW_SQL = "now AS (SELECT max(ts) AS t FROM events)"


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def with_now(e: DataFrame) -> DataFrame:
    """Events beside the newest timestamp, one row that is broadcast."""
    return e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now"))))


@query("SELECT ts::DATE AS day, count(*) AS runs FROM events GROUP BY 1")
def agg_queries_daily(spark, d):
    return events(spark, d).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("runs"))


@query("SELECT event_type, round(avg(value), 4) AS avg_value, round(quantile_cont(value, 0.95), 4) AS p95 FROM events GROUP BY 1")
def agg_latency(spark, d):
    """Average and exact interpolated percentile."""
    return events(spark, d).groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("avg_value"), F.round(F.percentile("value", F.lit(0.95)), 4).alias("p95"))


@query("SELECT count(*) AS total, count(*) FILTER (event_type = 'view') AS hits, round(CASE WHEN count(*) = 0 THEN 0 ELSE count(*) FILTER (event_type = 'view') / count(*) END, 6) AS rate FROM events")
def agg_cache_rate(spark, d):
    hits = F.count_if(F.col("event_type") == "view")
    return events(spark, d).agg(F.count("*").alias("total"), hits.alias("hits"), F.round(F.coalesce(F.try_divide(hits, F.count("*")), F.lit(0.0)), 6).alias("rate"))


@query("SELECT round(avg(value), 4) AS rating, count(*) FILTER (event_type = 'purchase') AS up, count(*) FILTER (event_type = 'error') AS down FROM events")
def agg_feedback(spark, d):
    return events(spark, d).agg(F.round(F.avg("value"), 4).alias("rating"), F.count_if(F.col("event_type") == "purchase").alias("up"), F.count_if(F.col("event_type") == "error").alias("down"))


@query("SELECT json_extract_string(props, '$.k') AS key, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, key LIMIT 10")
def agg_top_questions(spark, d):
    return events(spark, d).groupBy(F.get_json_object("props", "$.k").alias("key")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(10)


@query(f"WITH {NOW_SQL} SELECT count(DISTINCT user_id) AS users FROM events, now WHERE ts > t - INTERVAL 7 DAY")
def agg_active_users(spark, d):
    return with_now(events(spark, d)).where("ts > now - INTERVAL 7 DAYS").agg(F.count_distinct("user_id").alias("users"))


@query("SELECT user_id, count(*) AS runs, max(ts) AS newest FROM events GROUP BY 1 ORDER BY runs DESC, user_id LIMIT 10")
def agg_top_users(spark, d):
    return events(spark, d).groupBy("user_id").agg(F.count("*").alias("runs"), F.max("ts").alias("newest")).orderBy(F.desc("runs"), "user_id").limit(10)


MODELS_SQL = "m AS (SELECT *, CASE user_id % 4 WHEN 0 THEN 'Gemini-pro' WHEN 1 THEN 'gpt-x' WHEN 2 THEN 'o1' ELSE 'local' END AS model FROM events)"


@query(f"""WITH {MODELS_SQL}, combined AS (SELECT 'hosted' AS provider, model, count(*) AS calls, avg(value) AS latency FROM m WHERE event_type = 'click' GROUP BY ALL UNION ALL SELECT 'hosted', model, count(*), avg(value) FROM m WHERE event_type = 'purchase' GROUP BY ALL UNION ALL SELECT 'worker', 'unknown', count(*), avg(value) FROM m WHERE event_type = 'error' UNION ALL
SELECT CASE WHEN model ILIKE 'gemini%' THEN 'gemini' WHEN model ILIKE 'gpt%' OR model ILIKE 'o%' THEN 'openai' ELSE 'worker' END, model, count(DISTINCT user_id), NULL FROM m WHERE event_type = 'view' GROUP BY ALL)
SELECT provider, model, sum(calls)::BIGINT AS calls, round(avg(latency))::BIGINT AS avg_latency FROM combined GROUP BY ALL""")
def agg_llm_usage(spark, d):
    """Four rollups of model calls as one: averages are averages of the rollups' averages, and providers are inferred where only the model is known."""
    name = F.get(F.array(*(F.lit(x) for x in ("Gemini-pro", "gpt-x", "o1", "local"))), (F.col("user_id") % 4).cast("int"))
    e = events(spark, d).withColumn("model", name)

    def rollup(kind: str, provider, model, latency: bool = True) -> DataFrame:
        calls = F.count("*") if latency else F.count_distinct("user_id")
        return e.where(F.col("event_type") == kind).groupBy(provider.alias("provider"), model.alias("model")).agg(calls.alias("calls"), (F.avg("value") if latency else F.max(F.lit(None).cast("double"))).alias("latency"))

    inferred = F.when(F.col("model").ilike("gemini%"), "gemini").when(F.col("model").ilike("gpt%") | F.col("model").ilike("o%"), "openai").otherwise("worker")
    both = rollup("click", F.lit("hosted"), F.col("model")).unionByName(rollup("purchase", F.lit("hosted"), F.col("model"))).unionByName(rollup("error", F.lit("worker"), F.lit("unknown"))).unionByName(rollup("view", inferred, F.col("model"), latency=False))
    return both.groupBy("provider", "model").agg(F.sum("calls").alias("calls"), F.round(F.avg("latency")).cast("bigint").alias("avg_latency"))


@query("SELECT ts::DATE AS day, event_type AS level, count(*) AS n FROM events GROUP BY ALL")
def agg_fb_trend(spark, d):
    return events(spark, d).groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("level")).agg(F.count("*").alias("n"))


@query("SELECT tag, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS tag FROM part) GROUP BY 1 ORDER BY n DESC, tag LIMIT 20")
def agg_fb_tags(spark, d):
    return table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(20)


SLA_SQL = "jobs AS (SELECT event_type AS step, value * 1000 AS ms, event_id % 7 = 0 AS failed FROM events)"


@query(f"WITH {SLA_SQL} SELECT step, count(*) AS total, count(*) FILTER (failed) AS failed, round(avg(ms) FILTER (NOT failed), 2) AS avg_ms, round(quantile_cont(ms, 0.95) FILTER (NOT failed), 2) AS p95_ms FROM jobs GROUP BY 1")
def agg_sla(spark, d):
    """Totals, failures and the durations of the jobs that did not fail."""
    failed, ms = F.col("event_id") % 7 == 0, F.col("value") * 1000
    done = F.when(~failed, ms)
    return events(spark, d).groupBy(F.col("event_type").alias("step")).agg(F.count("*").alias("total"), F.count_if(failed).alias("failed"), F.round(F.avg(done), 2).alias("avg_ms"), F.round(F.percentile(done, F.lit(0.95)), 2).alias("p95_ms"))


@query(f"WITH {NOW_SQL} SELECT ts::DATE AS day, count(*) AS documents, sum(length(props))::BIGINT AS bytes, count(*) FILTER (event_type = 'error') AS failed FROM events, now WHERE ts::DATE > t::DATE - 10 GROUP BY 1")
def agg_ingest_volume(spark, d):
    return with_now(events(spark, d)).where("to_date(ts) > date_sub(to_date(now), 10)").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("documents"), F.sum(F.length("props")).alias("bytes"), F.count_if(F.col("event_type") == "error").alias("failed"))


@query(f"WITH {NOW_SQL}, w AS (SELECT user_id % 5 AS source, count(*) FILTER (ts >= t - INTERVAL 1 HOUR) AS total, count(*) FILTER (ts >= t - INTERVAL 1 HOUR AND event_type IN ('error','view','click')) AS checks, count(*) FILTER (ts >= t - INTERVAL 1 HOUR AND event_type = 'error') AS failures, count(*) FILTER (ts >= t - INTERVAL 1 HOUR AND event_type = 'signup') AS limited, count(*) FILTER (ts >= date_trunc('day', t)) AS today FROM events, now GROUP BY 1) SELECT *, CASE WHEN today >= 90 THEN 'daily_fetch_limit_reached' WHEN (checks > 0 AND failures / checks > 0.2) OR (total > 0 AND limited / total > 0.1) THEN 'stop_window_triggered' END AS reason FROM w")
def agg_window_stats(spark, d):
    """Rates of the last hours and today's count decide whether a source pauses."""
    recent = F.expr("ts >= now - INTERVAL 1 HOURS")
    kind = F.col("event_type")
    w = with_now(events(spark, d)).groupBy((F.col("user_id") % 5).alias("source")).agg(F.count_if(recent).alias("total"), F.count_if(recent & kind.isin("error", "view", "click")).alias("checks"), F.count_if(recent & (kind == "error")).alias("failures"), F.count_if(recent & (kind == "signup")).alias("limited"), F.count_if(F.expr("ts >= date_trunc('day', now)")).alias("today"))
    over = F.coalesce(F.try_divide("failures", "checks") > 0.2, F.lit(False)) | F.coalesce(F.try_divide("limited", "total") > 0.1, F.lit(False))
    return w.withColumn("reason", F.when(F.col("today") >= 90, "daily_fetch_limit_reached").when(over, "stop_window_triggered"))


@query("SELECT * FROM (SELECT conv_id, turn, role, length(text) AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE role IN ('user','assistant')) WHERE back <= 8")
def win_last_n(spark, d):
    """The last eight messages of each conversation."""
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return table(spark, d, "conversations").where("role IN ('user', 'assistant')").select("conv_id", "turn", "role", F.length("text").alias("chars"), back.alias("back")).where("back <= 8")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 ELSE 2 END, ts DESC, event_id) AS k FROM events) WHERE k = 1")
def win_latest_extraction(spark, d):
    """The newest row of the best kind, one for each key."""
    rank = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "signup", 1).otherwise(2)
    return events(spark, d).groupBy("user_id").agg(F.min_by(F.struct("event_id", "event_type"), F.struct(rank, -F.unix_micros(F.col("ts").cast("timestamp")), F.col("event_id"))).alias("r")).select("user_id", "r.*")


@query("SELECT user_id, ts, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS k FROM events) WHERE k = 1")
def win_distinct_on(spark, d):
    return events(spark, d).groupBy("user_id").agg(F.max_by(F.struct("ts", "event_id"), F.struct(F.col("ts"), -F.col("event_id"))).alias("r")).select("user_id", "r.*")


@query("SELECT coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic, count(*) AS n, round(avg(n_chars), 3) AS avg_chars FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY ALL")
def jn_left_meta(spark, d):
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("labelled"), "quality", "toxic")
    j = table(spark, d, "documents").select("doc_id", "n_chars").join(labels, F.col("doc_id") == F.col("labelled"), "left")
    return j.groupBy(F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(-1)).alias("toxic")).agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 3).alias("avg_chars"))


@query("SELECT lang, source, count(*) AS n, count(*) FILTER (n_chars > 2000) AS long, round(avg(n_chars), 3) AS avg_chars FROM documents GROUP BY ALL")
def agg_doc_status(spark, d):
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") > 2000).alias("long"), F.round(F.avg("n_chars"), 3).alias("avg_chars"))


@query("SELECT window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS window_start FROM events) GROUP BY ALL")
def ext_windows(spark, d):
    """Tumbling hours."""
    return events(spark, d).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
