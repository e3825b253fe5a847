"""Each filter builder by itself over the cases, and filters of queues, reviews, audits and wiki articles."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewright.operators import filters as f
from casewright.plans.cases import CASES_SQL, cases
from casewright.registry import query, table

EVENT_SQL = "e AS (SELECT event_id, ts, user_id, event_type, value, coalesce(try_cast(json_extract_string(props, '$.k') AS INT), -1) AS k FROM events)"


def _events(spark, d):
    return table(spark, d, "events").withColumn("k", F.coalesce(F.get_json_object("props", "$.k").try_cast("int"), F.lit(-1)))


@query(f"WITH {CASES_SQL} SELECT case_id, disposition FROM cases WHERE lower(coalesce(nullif(disposition, 'F'), '')) IN ('o')")
def flt_in_lower(spark, d):
    """Membership without case; null counts as empty."""
    c = cases(spark, d).withColumn("shown", F.nullif("disposition", F.lit("F")))
    return c.where(f.in_lower("shown", [" O ", ""])).select("case_id", "disposition")


@query(f"WITH {CASES_SQL} SELECT case_id, state_code FROM cases WHERE state_code IN (1, 3)")
def flt_in_int(spark, d):
    return cases(spark, d).where(f.in_int("state_code", ["1", " 3", "x", "2.5"])).select("case_id", "state_code")


@query(f"WITH {CASES_SQL} SELECT case_id, offences FROM cases WHERE list_contains(offences, 'R')")
def flt_array_any(spark, d):
    return cases(spark, d).where(f.array_any("offences", ["r", "zz"])).select("case_id", "offences")


@query(f"WITH {CASES_SQL} SELECT case_id, state_code, district_code FROM cases WHERE (state_code = 1 AND district_code = 6) OR (state_code = 4 AND district_code = 9)")
def flt_pair_or(spark, d):
    """Composite pairs; malformed ones drop out."""
    return cases(spark, d).where(f.pair_or("state_code", "district_code", ["1:6", "4:9", "5", "a:b"])).select("case_id", "state_code", "district_code")


@query(f"WITH {CASES_SQL} SELECT case_id, registration_date FROM cases WHERE registration_date BETWEEN DATE '1996-02-01' AND DATE '1996-04-30'")
def flt_date_range(spark, d):
    return cases(spark, d).where(f.date_range("registration_date", "1996-02-01", "1996-04-30")).select("case_id", "registration_date")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-10'")
def flt_dash_date(spark, d):
    """The whole last day counts."""
    return table(spark, d, "events").where(f.before_next_day("ts", "2024-01-05", "2024-01-09")).select("event_id")


@query("WITH units AS (SELECT 1 AS r UNION SELECT n_nationkey FROM nation WHERE n_regionkey = 1) SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT r FROM units)")
def flt_dash_unit(spark, d):
    """A unit or any of its children."""
    tree = table(spark, d, "nation").select(F.col("n_nationkey").alias("unit"), F.col("n_regionkey").alias("parent"))
    return f.unit_or_children(table(spark, d, "customer"), "c_nationkey", tree, 1).select("c_custkey")


@query(f"WITH {CASES_SQL} SELECT case_id FROM cases WHERE court_level = '2-HIGH' AND disposition = 'O'")
def flt_dash_eq(spark, d):
    """Equality on known columns; empty values ask for nothing."""
    c = cases(spark, d)
    return c.where(f.equal_columns(c, {"court_level": "2-HIGH", "disposition": "O", "case_type": ""})).select("case_id")


@query(f"WITH {CASES_SQL} SELECT case_id FROM cases WHERE commercial_safe")
def flt_commercial_default(spark, d):
    """Anything but a literal "false" keeps to safe rows."""
    return cases(spark, d).where(f.commercial_default("commercial_safe", "no")).select("case_id")


@query("SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAYS")
def flt_recent(spark, d):
    """Seven days up to a stated time, here the newest event."""
    e = table(spark, d, "events")
    newest = e.agg(F.max("ts").alias("as_of"))  # one row
    return e.crossJoin(F.broadcast(newest)).where(f.recent("ts", F.col("as_of"), 7)).select("event_id")


@query(f"WITH {EVENT_SQL} SELECT event_id FROM e WHERE CASE WHEN k % 3 = 0 THEN 'approved' WHEN k % 3 = 1 THEN 'pending' ELSE 'rejected' END = 'approved' AND (event_type = 'view' OR coalesce(CASE WHEN k % 4 > 0 THEN event_type END, '') = '')")
def flt_wiki(spark, d):
    """Approved articles unless a status is asked, of a court level or of none."""
    e = _events(spark, d)
    rows = e.select("event_id", F.when(F.col("k") % 3 == 0, "approved").when(F.col("k") % 3 == 1, "pending").otherwise("rejected").alias("status"), F.when((F.col("k") % 4 > 0) | (F.col("event_type") == "view"), F.col("event_type")).alias("court_level"))
    return rows.where(f.wiki({"court_level": "View"})).select("event_id")


@query(f"WITH {EVENT_SQL} SELECT event_id FROM e WHERE event_type = 'error' AND k >= 50")
def flt_review(spark, d):
    """A review queue by status, type and least priority."""
    rows = _events(spark, d).select("event_id", F.col("event_type").alias("entity_type"), F.lit("pending").alias("status"), F.col("k").alias("priority"))
    return rows.where(f.review({"status": "pending", "entity_type": "error", "min_priority": 50})).select("event_id")


@query(f"WITH {EVENT_SQL} SELECT event_id FROM e WHERE user_id = 12 AND k % 2 = 1")
def flt_feedback(spark, d):
    """Only a user's own rows unless they are an administrator."""
    rows = _events(spark, d).select("event_id", "user_id", F.col("event_type").alias("feedback_type"), (F.col("k") % 2 == 1).alias("resolved"))
    return rows.where(f.feedback({"resolved": "true"}, user=12, admin=False)).select("event_id")


@query("SELECT event_id FROM events WHERE event_type = 'purchase' AND user_id = 12 AND ts >= TIMESTAMP '2024-01-03' AND ts <= TIMESTAMP '2024-01-20'")
def flt_audit(spark, d):
    rows = table(spark, d, "events").select("event_id", F.col("event_type").alias("action"), "user_id", F.col("ts").alias("created_at"))
    return rows.where(f.audit({"action": "purchase", "user_id": 12, "from": "2024-01-03", "to": "2024-01-20", "entity_id": None})).select("event_id")


@query("WITH g AS (SELECT DISTINCT p_size % 5 AS level, p_partkey % 1000 AS doc FROM part WHERE p_partkey % 50 = 0), r AS (SELECT c_custkey AS doc_id, c_custkey % 5 AS level, CASE WHEN c_custkey % 11 = 0 THEN 'DELETED' ELSE 'ACTIVE' END AS status FROM customer) SELECT doc_id FROM r WHERE status <> 'DELETED' AND (level <= 1 OR doc_id IN (SELECT doc FROM g) OR level IN (SELECT level FROM g WHERE level >= 3))")
def flt_access_chunks(spark, d):
    """Rows by rank, by a grant of the document, or by a grant of the level even where it names a document."""
    key = F.col("c_custkey")
    docs = table(spark, d, "customer").select(key.alias("doc_id"), F.get(F.array(*(F.lit(x) for x in f.LEVELS)), (key % 5).cast("int")).alias("level"), F.when(key % 11 == 0, "DELETED").otherwise("ACTIVE").alias("status"))
    p = table(spark, d, "part").where("p_partkey % 50 = 0")
    level = F.when(F.col("p_size") % 5 >= 3, F.get(F.array(*(F.lit(x) for x in f.LEVELS)), (F.col("p_size") % 5).cast("int")))
    grants = p.select(F.lit(1).alias("user_id"), (F.col("p_partkey") % 1000).alias("g_doc_id"), level.alias("g_level"), F.lit(None).cast("timestamp").alias("expires_at"))
    return f.accessible(docs, grants, 1, "INTERNAL", F.lit("2024-01-01").cast("timestamp")).select("doc_id")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'FURNITURE')")
def flt_status_searchable(spark, d):
    """Documents whose status can be searched."""
    names = F.create_map(*(F.lit(x) for pair in (("BUILDING", "SEARCHABLE"), ("MACHINERY", "KG_EXTRACTING"), ("FURNITURE", "ACTIVE"), ("HOUSEHOLD", "FAILED"), ("AUTOMOBILE", "DELETED")) for x in pair))
    return table(spark, d, "customer").select("c_custkey", names[F.col("c_mktsegment")].alias("status")).where(F.col("status").isin(f.SEARCHABLE)).select("c_custkey")


@query("""WITH q AS (SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 'SELECT ' || role || ' FROM t;' WHEN 1 THEN 'with a as (select 1) select * from a' WHEN 2 THEN 'DROP TABLE t' WHEN 3 THEN 'SELECT 1; SELECT 2' ELSE 'select a into b from c' END AS sql FROM conversations) SELECT conv_id, turn, turn % 5 < 2 AS allowed FROM q""")
def flt_sql_guard(spark, d):
    """Which statements may run: one SELECT or WITH, no word that writes, no second statement, no SELECT INTO."""
    n = F.col("turn") % 5
    sql = F.when(n == 0, F.concat(F.lit("SELECT "), "role", F.lit(" FROM t;"))).when(n == 1, "with a as (select 1) select * from a").when(n == 2, "DROP TABLE t").when(n == 3, "SELECT 1; SELECT 2").otherwise("select a into b from c")
    return table(spark, d, "conversations").select("conv_id", "turn", f.read_only(sql).alias("allowed"))
