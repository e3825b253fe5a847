"""Smaller read paths, their writes, and the checks on documents.

Orders are documents or cases, their line items the parts, jobs and attempts;
nations are workspaces or units with customers as members; events are jobs,
notifications, tasks and questions; parts are uploaded files.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from casewright.registry import query, table


def _newest(n: int, key: str, *order):
    """Condition column: among the first ``n`` rows of its key; use as a window column."""
    return F.row_number().over(Window.partitionBy(key).orderBy(*order)) <= n


@query("WITH p AS (SELECT * FROM documents WHERE lang = 'en' AND source IS NOT NULL) SELECT doc_id, source, (SELECT count(*) FROM p) AS total FROM p ORDER BY doc_id DESC LIMIT 25 OFFSET 25")
def rd_docs(spark, d):
    """A page of documents of one status, and how many there are."""
    p = table(spark, d, "documents").where("lang = 'en' AND source IS NOT NULL").select("doc_id", "source")
    total = p.agg(F.count("*").alias("total"))  # one row
    return p.orderBy(F.desc("doc_id")).offset(25).limit(25).crossJoin(F.broadcast(total))


@query("SELECT o_orderkey AS id, o_orderstatus AS status, coalesce(parts, 0) AS parts, coalesce(steps, []) AS steps FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS parts, list(l_linenumber ORDER BY l_linenumber) AS steps FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def rd_doc_detail(spark, d):
    """Each document with its number of parts and their ordered numbers; parts are grouped before the join."""
    parts = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("parts"), F.array_sort(F.collect_list("l_linenumber")).alias("steps"))
    out = table(spark, d, "orders").join(parts, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return out.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.coalesce("parts", F.lit(0)).alias("parts"), F.coalesce("steps", F.array().cast("array<int>")).alias("steps"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS chunk, length(text) AS chars FROM conversations")
def rd_chunks(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return table(spark, d, "conversations").select("conv_id", "turn", (F.row_number().over(w) - 1).cast("long").alias("chunk"), F.char_length("text").cast("long").alias("chars"))


@query("SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def rd_batch_jobs(spark, d):
    return table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "event_type")


@query("WITH c AS (SELECT conv_id, max(turn) AS updated, CASE WHEN conv_id % 5 = 0 THEN conv_id % 3 = 0 END AS pinned FROM conversations GROUP BY 1) SELECT * FROM c ORDER BY pinned DESC NULLS LAST, updated DESC, conv_id LIMIT 50")
def rd_conversations(spark, d):
    """Pinned conversations first, unknown last."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("updated")).withColumn("pinned", F.when(F.col("conv_id") % 5 == 0, F.col("conv_id") % 3 == 0))
    return c.orderBy(F.desc_nulls_last("pinned"), F.desc("updated"), "conv_id").limit(50)


@query("SELECT conv_id, arg_max(turn, turn) AS turn, arg_max(text, turn) AS summary FROM (SELECT conv_id, turn, min(text) AS text FROM conversations WHERE text IS NOT NULL GROUP BY ALL) GROUP BY 1")
def dml_summary(spark, d):
    """The latest text of each conversation replaces those before it."""
    c = table(spark, d, "conversations").where("text IS NOT NULL").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    return c.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("text", "turn").alias("summary"))


@query("SELECT s_suppkey AS profile, s_name AS name, coalesce(n, 0) AS approved FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) ON l_suppkey = s_suppkey")
def rd_profiles(spark, d):
    n = table(spark, d, "lineitem").where("l_returnflag = 'A'").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    return table(spark, d, "supplier").join(n, F.col("l_suppkey") == F.col("s_suppkey"), "left").select(F.col("s_suppkey").alias("profile"), F.col("s_name").alias("name"), F.coalesce("n", F.lit(0)).alias("approved"))


@query("SELECT n_nationkey AS workspace, n_name AS name, coalesce(m, 0) AS members, coalesce(s, 0) AS documents FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS m FROM customer GROUP BY 1) ON c_nationkey = n_nationkey LEFT JOIN (SELECT s_nationkey, count(*) AS s FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey")
def rd_workspaces(spark, d):
    """Counts are grouped before the joins, so that one does not multiply the other."""
    m = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("m"))
    s = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("s"))
    out = table(spark, d, "nation").join(m, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(s, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return out.select(F.col("n_nationkey").alias("workspace"), F.col("n_name").alias("name"), F.coalesce("m", F.lit(0)).alias("members"), F.coalesce("s", F.lit(0)).alias("documents"))


@query("SELECT n_name AS workspace, c_name AS member, row_number() OVER (PARTITION BY n_nationkey ORDER BY c_custkey) AS place FROM customer JOIN nation ON c_nationkey = n_nationkey")
def rd_members(spark, d):
    out = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return out.select(F.col("n_name").alias("workspace"), F.col("c_name").alias("member"), F.row_number().over(Window.partitionBy("n_nationkey").orderBy("c_custkey")).cast("long").alias("place"))


@query("SELECT r_name AS unit, list(n_name ORDER BY n_name) AS children, sum(coalesce(c, 0))::BIGINT AS documents FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY 1) ON c_nationkey = n_nationkey GROUP BY 1")
def rd_org(spark, d):
    """Units with their children and the documents below them."""
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("c"))
    below = table(spark, d, "nation").join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return below.groupBy(F.col("r_name").alias("unit")).agg(F.array_sort(F.collect_list("n_name")).alias("children"), F.sum(F.coalesce("c", F.lit(0))).alias("documents"))


@query("SELECT user_id, count(*) AS total, count(*) FILTER (event_id % 2 = 1) AS unread, (list(event_id ORDER BY ts DESC, event_id DESC))[1:20] AS page FROM events WHERE event_type <> 'view' GROUP BY 1")
def rd_notifications(spark, d):
    """Of each user the visible events: number, unread, and the newest twenty.

    Ranks cut each user's rows to the page before they are gathered.
    """
    seen = table(spark, d, "events").where("event_type <> 'view'").select("user_id", "event_id", "ts")
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    top = F.when(F.col("at") <= 20, F.struct("at", "event_id"))
    out = seen.withColumn("at", F.row_number().over(w)).groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(F.col("event_id") % 2 == 1).alias("unread"), F.array_sort(F.collect_list(top)).alias("page"))
    return out.withColumn("page", F.col("page")["event_id"])


@query("SELECT event_id, event_type = 'error' OR coalesce(on_, true) AS sent FROM events LEFT JOIN (SELECT c_custkey, c_acctbal > 0 AS on_ FROM customer WHERE c_mktsegment <> 'BUILDING') ON c_custkey = user_id")
def dml_notify(spark, d):
    """A user without a preference is told; what is critical is always told."""
    prefs = table(spark, d, "customer").where("c_mktsegment <> 'BUILDING'").select("c_custkey", (F.col("c_acctbal") > 0).alias("on_"))
    out = table(spark, d, "events").join(prefs, F.col("c_custkey") == F.col("user_id"), "left")
    return out.select("event_id", ((F.col("event_type") == "error") | F.coalesce("on_", F.lit(True))).alias("sent"))


@query("SELECT c_custkey AS id, c_name AS name FROM customer ORDER BY c_custkey DESC LIMIT 100")
def rd_users(spark, d):
    return table(spark, d, "customer").orderBy(F.desc("c_custkey")).limit(100).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 50")
def rd_nl_history(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "ts")
    return e.withColumn("new", _newest(50, "user_id", F.desc("ts"), F.desc("event_id"))).where("new").select("user_id", "event_id")


@query("SELECT event_type AS role, count(*) AS open FROM events WHERE event_type IN ('click', 'error') AND value < 50 GROUP BY 1")
def rd_tasks(spark, d):
    return table(spark, d, "events").where(F.col("event_type").isin("click", "error") & (F.col("value") < 50)).groupBy(F.col("event_type").alias("role")).agg(F.count("*").alias("open"))


@query("SELECT doc_id AS id, CASE WHEN text IS NULL THEN 'missing' WHEN n_chars > 20000 THEN 'too large' WHEN lang = 'fr' THEN 'type not allowed' WHEN doc_id % 9 = 0 THEN 'checksum differs' END AS reason FROM documents")
def val_document(spark, d):
    """Why a file is refused, null if it passes; the first reason counts.  Every ninth was cut after its checksum was taken."""
    docs = table(spark, d, "documents")
    stated = F.sha2("text", 256)
    found = F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit("?"))).otherwise(F.col("text"))
    reason = F.when(F.col("text").isNull(), "missing").when(F.col("n_chars") > 20_000, "too large").when(F.col("lang") == "fr", "type not allowed").when(F.sha2(found, 256) != stated, "checksum differs")
    return docs.select(F.col("doc_id").alias("id"), reason.alias("reason"))


@query("WITH n AS (SELECT p_partkey AS id, (p_size * 3)::BIGINT AS pages, least(ceil(p_retailprice / 250)::BIGINT, p_size * 3) AS parts FROM part), e AS (SELECT id, pages, ceil(pages / parts)::BIGINT AS each, unnest(generate_series(1, parts)) AS part FROM n) SELECT id, part, (part - 1) * each + 1 AS first, least(part * each, pages) AS last FROM e WHERE (part - 1) * each < pages")
def pdf_plan(spark, d):
    """Page ranges of the parts of a large file: by size, at most one part a page."""
    pages = (F.col("p_size") * 3).cast("long")
    n = table(spark, d, "part").select(F.col("p_partkey").alias("id"), pages.alias("pages"), F.least(F.ceil(F.col("p_retailprice") / 250), pages).alias("parts"))
    e = n.select("id", "pages", F.ceil(F.col("pages") / F.col("parts")).alias("each"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("parts"))).alias("part"))
    return e.where("(part - 1) * each < pages").select("id", "part", F.expr("(part - 1) * each + 1").alias("first"), F.expr("least(part * each, pages)").alias("last"))


@query("SELECT doc_id, coalesce(lang, CASE WHEN n_chars % 10 >= 7 THEN 'found' END) AS lang FROM documents")
def meta_autofill(spark, d):
    """A sure finding fills what is null, and never replaces a value."""
    sure = F.col("n_chars") % 10 / 10.0 >= 0.7
    return table(spark, d, "documents").select("doc_id", F.coalesce("lang", F.when(sure, "found")).alias("lang"))


@query("SELECT doc_id, concat_ws('; ', CASE WHEN n_chars % 10 < 7 THEN 'low confidence' END, CASE WHEN lang IS NULL THEN 'missing lang' END, CASE WHEN source IS NULL THEN 'missing source' END) AS reasons FROM documents")
def meta_review(spark, d):
    """Reasons for a review, joined; empty if there is none."""
    why = [F.when(F.col("n_chars") % 10 / 10.0 < 0.7, "low confidence"), *(F.when(F.col(c).isNull(), f"missing {c}") for c in ("lang", "source"))]
    return table(spark, d, "documents").select("doc_id", F.concat_ws("; ", *why).alias("reasons"))


@query("SELECT l_orderkey AS answer, l_linenumber AS citation, p_size AS current FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity::BIGINT <> p_size")
def stale_citations(spark, d):
    """Citations of a version that is no longer current."""
    out = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey")).where(F.col("l_quantity").cast("bigint") != F.col("p_size"))
    return out.select(F.col("l_orderkey").alias("answer"), F.col("l_linenumber").alias("citation"), F.col("p_size").alias("current"))
