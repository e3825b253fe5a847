"""Queue upserts, reviews, workflows and acquisition over events, orders and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewright.registry import query, table
from casewright.streaming import lifecycle

NOW = "TIMESTAMP '2024-01-20 00:00:00'"


def _now():
    return F.expr("TIMESTAMP_NTZ '2024-01-20 00:00:00'")


@query("""WITH o AS (SELECT o_orderkey AS case_id, 'ecourts' AS source, o_orderkey % 100 AS priority, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'done' ELSE 'pending' END AS status, 'old' AS note FROM orders WHERE o_orderkey % 3 > 0), n AS (SELECT o_orderkey AS case_id, 'ecourts' AS source, 50 AS priority, 'pending' AS status, CASE WHEN o_orderkey % 2 = 0 THEN 'new' END AS note, o_orderkey % 10 = 4 AS forced FROM orders WHERE o_orderkey % 4 = 0)
SELECT coalesce(o.case_id, n.case_id) AS case_id, coalesce(o.source, n.source) AS source, greatest(o.priority, n.priority)::BIGINT AS priority, CASE WHEN n.case_id IS NULL THEN o.status WHEN o.case_id IS NULL OR o.status = 'failed' OR n.forced THEN 'pending' ELSE o.status END AS status, coalesce(n.note, o.note) AS note FROM o FULL JOIN n ON o.case_id = n.case_id""")
def dml_queue_upsert(spark, d):
    o, key = table(spark, d, "orders"), F.col("o_orderkey")
    base = lambda where: o.where(where).select(key.alias("case_id"), F.lit("ecourts").alias("source"), "o_orderstatus")
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "done").otherwise("pending")
    old = base("o_orderkey % 3 > 0").select("case_id", "source", (F.col("case_id") % 100).alias("priority"), status.alias("status"), F.lit("old").alias("note"))
    new = base("o_orderkey % 4 = 0").select("case_id", "source", F.lit(50).cast("bigint").alias("priority"), F.lit("pending").alias("status"), F.when(F.col("case_id") % 2 == 0, "new").alias("note"), (F.col("case_id") % 10 == 4).alias("forced"))
    return lifecycle.queued(old, new)


@query("SELECT l_orderkey AS id, l_linenumber AS section FROM lineitem WHERE l_orderkey % 3 > 0 UNION ALL SELECT o_orderkey, 99 FROM orders WHERE o_orderkey % 3 = 0")
def dml_replace_children(spark, d):
    """Every third parent's children are exchanged for one."""
    old = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("section"))
    new = table(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), F.lit(99).alias("section"))
    return lifecycle.replaced(old, new, "id")


@query("SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 'RESOLVED' WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'RESOLVED' ELSE event_type END AS status, event_type NOT IN ('view', 'click') AND NOT (event_type = 'error' AND event_id % 2 = 0) AS refused FROM events")
def dml_feedback_resolve(spark, d):
    """Open feedback resolves; of errors only some may."""
    wanted = F.when((F.col("event_type") == "error") & (F.col("event_id") % 2 == 1), "LATER").otherwise("RESOLVED")
    rows = table(spark, d, "events").select("event_id", F.col("event_type").alias("status"), wanted.alias("wanted"))
    out = lifecycle.transition(rows, {"view": ["RESOLVED"], "click": ["RESOLVED"], "error": ["RESOLVED"]}, "wanted")
    return out.select("event_id", "status", F.col("error").isNotNull().alias("refused"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' THEN 'approved' ELSE l_returnflag END AS status, CASE WHEN l_returnflag <> 'N' THEN l_returnflag || ' cannot become approved' END AS error FROM lineitem")
def dml_review_resolve(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("status"), F.lit("approved").alias("wanted"))
    return lifecycle.transition(rows, {"N": ["approved", "rejected"], "R": []}, "wanted").drop("wanted")


@query("WITH chosen AS (SELECT DISTINCT user_id FROM events WHERE user_id % 2 = 0 ORDER BY 1 LIMIT 500) SELECT status, count(*) AS n FROM (SELECT CASE WHEN user_id IN (FROM chosen) AND event_type IN ('view', 'click') THEN 'CANCELLED' WHEN event_type IN ('view', 'click') THEN 'PENDING' ELSE 'DONE' END AS status FROM events UNION ALL SELECT 'NEW' FROM chosen) GROUP BY 1")
def dml_batch_reprocess(spark, d):
    """Open jobs of the chosen documents are cancelled and each gets a first job."""
    e = table(spark, d, "events").select(F.col("event_id").alias("job_id"), F.col("user_id").alias("document_id"), F.lit("CHUNK").alias("step"), F.when(F.col("event_type").isin("view", "click"), "PENDING").otherwise("DONE").alias("status"))
    after, new = lifecycle.reprocessed(e.where("document_id % 2 = 0"), e)
    return after.select("status").unionByName(new.select(F.lit("NEW").alias("status"))).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'DELETED' ELSE 'ACTIVE' END AS status, doc_id % 5 = 0 AS hidden FROM documents")
def dml_soft_delete(spark, d):
    """Deletion is a status."""
    rows = table(spark, d, "documents").select("doc_id", F.lit("ACTIVE").alias("status"), F.when(F.col("doc_id") % 5 == 0, "DELETED").otherwise("ACTIVE").alias("wanted"))
    out = lifecycle.transition(rows, {"ACTIVE": ["DELETED", "ACTIVE"]}, "wanted")
    return out.select("doc_id", "status", (F.col("status") == "DELETED").alias("hidden"))


@query("SELECT o_orderkey AS case_id, source, priority, place FROM orders, (VALUES ('hldc', 100, 1), ('ecourts', 90, 2), ('indian_kanoon', 80, 3)) p(source, priority, place) WHERE o_totalprice > 200000 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def st_seed(spark, d):
    """A plan of three sources for each target that is not queued."""
    targets = table(spark, d, "orders").where("o_totalprice > 200000").select(F.col("o_orderkey").alias("case_id"))
    queue = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("case_id"))
    return lifecycle.seeded(targets, queue, [("hldc", 100), ("ecourts", 90), ("indian_kanoon", 80)])


@query("SELECT p_partkey AS case_id, source, priority, place::INT AS place FROM part, LATERAL (SELECT * FROM (VALUES ('hldc', 100, 1), ('ecourts', 90, 2), ('indian_kanoon', 80, 3)) v(source, priority, k)) CROSS JOIN LATERAL (SELECT CASE WHEN p_size IN (9, 13) THEN k ELSE k - 1 END AS place) WHERE p_size IN (9, 13) OR k > 1")
def cls_plan_fetch(spark, d):
    """Sources of each case in order; one of them serves two states only, and places are numbered after it is left out."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("case_id"), "p_size")
    steps = F.array(*(F.struct(F.lit(s).alias("source"), F.lit(n).alias("priority")) for s, n in (("hldc", 100), ("ecourts", 90), ("indian_kanoon", 80))))
    own = F.filter(steps, lambda s: (s["source"] != "hldc") | F.col("p_size").isin(9, 13))
    return p.select("case_id", F.posexplode(own).alias("k", "s")).select("case_id", "s.source", "s.priority", (F.col("k") + 1).alias("place"))


@query("WITH a AS (SELECT doc_id, left(sha256(text), 16) AS sha FROM documents WHERE text IS NOT NULL), k AS (SELECT sha FROM a WHERE doc_id % 10 = 0) SELECT min(doc_id) AS artifact_id, sha, 'VALIDATE' AS step FROM a WHERE sha NOT IN (FROM k) GROUP BY sha")
def st_store(spark, d):
    """New contents become documents with a first job; known ones don't."""
    a = table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("artifact_id"), F.left(F.sha2("text", 256), F.lit(16)).alias("sha"))
    docs, jobs = lifecycle.stored(a, a.where("artifact_id % 10 = 0"))
    return docs.join(jobs.select("artifact_id", "step"), "artifact_id")


@query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A') AND o_orderpriority NOT IN ('1-URGENT', '5-LOW') THEN 'text_ready' ELSE CASE o_orderpriority WHEN '1-URGENT' THEN 'blocked' WHEN '5-LOW' THEN 'dead' ELSE 'targeted' END END AS status FROM orders) GROUP BY 1")
def st_artifact_trigger(spark, d):
    status = F.when(F.col("o_orderpriority") == "1-URGENT", "blocked").when(F.col("o_orderpriority") == "5-LOW", "dead").otherwise("targeted")
    c = table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), status.alias("status"))
    arts = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.when(F.col("l_returnflag") == "A", "text").otherwise("pdf").alias("kind"))
    return lifecycle.text_ready(c, arts).groupBy("status").agg(F.count("*").alias("n"))


@query(f"SELECT event_id AS task_id FROM events WHERE event_type IN ('view', 'error') AND ts + INTERVAL 3 DAY < {NOW} ORDER BY ts + INTERVAL 3 DAY, event_id LIMIT 50")
def st_sla(spark, d):
    status = F.when(F.col("event_type") == "view", "PENDING").when(F.col("event_type") == "error", "IN_PROGRESS").otherwise("DONE")
    t = table(spark, d, "events").select(F.col("event_id").alias("task_id"), status.alias("status"), F.expr("ts + INTERVAL 3 DAYS").alias("due_at"))
    return lifecycle.overdue(t, _now()).select("task_id")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' AND o_totalprice > 1000 THEN 'ACTIVE' ELSE o_orderstatus END AS status, CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus || ' cannot become ACTIVE' WHEN o_totalprice <= 1000 THEN 'amount' END AS error FROM orders")
def st_wf(spark, d):
    """A workflow step: the transition must exist, then the first failing guard refuses it."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("was"), F.col("o_orderstatus").alias("status"), "o_totalprice", F.lit("ACTIVE").alias("wanted"))
    moved = lifecycle.transition(o, {"O": ["ACTIVE"], "F": ["DELETED"]}, "wanted")
    error = F.coalesce("error", lifecycle.guarded(moved, [("amount", F.col("o_totalprice") > 1000)]))
    return moved.withColumn("error", error).select("id", F.when(F.col("error").isNull(), F.col("wanted")).otherwise(F.col("was")).alias("status"), "error")


@query("SELECT c_custkey AS id, max(v) AS version, arg_max(shown, v) AS shown FROM (SELECT c_custkey, c_name AS shown, 1 AS v FROM customer UNION ALL SELECT o_custkey, o_orderpriority, 2 + o_orderkey FROM orders) GROUP BY 1")
def snk_upsert(spark, d):
    """Bulk upsert on a natural key: the latest batch's row stays."""
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("shown"), F.lit(1).cast("bigint").alias("v"))
    new = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("shown"), (F.col("o_orderkey") + 2).alias("v"))
    return old.unionByName(new).groupBy("id").agg(F.max("v").alias("version"), F.max_by("shown", "v").alias("shown"))
