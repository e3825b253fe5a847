"""Source dashboards and worded answers over the daily facts, and rollups of queues, feedback and users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.plans.cases import ARTIFACTS_SQL, CASES_SQL, FACTS_SQL, FAILURES_SQL, artifacts, cases, facts, failures
from casewright.registry import query, table


def _grouped(n: Column) -> Column:
    """A count with Indian digit groups: three digits, then twos."""
    s = n.cast("string")
    head = F.substr(s, F.lit(1), F.length(s) - 3)
    twos = F.regexp_replace(F.reverse(F.regexp_replace(F.reverse(head), r"(\d\d)(?=\d)", "$1,")), r"^,", "")
    return F.when(F.length(s) <= 3, s).otherwise(F.concat(twos, F.lit(","), F.right(s, F.lit(3))))


INTENTS = {
    "source_performance": (["source_name", "commercial_safe"], ["total_cases", "text_available", "translated", "fetch_failed"], 10),
    "outcomes": (["disposition"], ["total_cases", "criminal_targets", "text_available"], 10),
    "volume": (["year", "state_code", "district_code", "court_level"], ["total_cases", "criminal_targets", "text_available"], 12),
    "coverage": (["state_code", "district_code", "court_level", "language"], ["total_cases", "criminal_targets", "text_available", "translated", "redacted"], 10),
}
MEASURES = {"total_cases": "metadata_cases", "criminal_targets": "targets", "text_available": "with_text", "translated": "with_translation", "redacted": "with_redaction", "fetch_failed": "failed_fetches"}


def detail(rows: DataFrame, intent: str) -> DataFrame:
    """The largest groups of an intent."""
    keys, measures, most = INTENTS.get(intent, INTENTS["coverage"])
    made = rows.withColumns({"source_name": F.coalesce(F.nullif("case_type", F.lit("")), F.lit("unknown")), "disposition": F.coalesce(F.nullif("disposition", F.lit("")), F.lit("unknown")), "year": F.date_trunc("year", "fact_date").cast("date")})
    order = [F.desc("year")] if intent == "volume" else []
    return made.groupBy(*keys).agg(*(F.sum(MEASURES[m]).alias(m) for m in measures)).orderBy(*order, F.desc("total_cases"), *keys).limit(most)


def _detail_sql(intent: str) -> str:
    keys, measures, most = INTENTS[intent]
    named = {"source_name": "coalesce(nullif(case_type, ''), 'unknown')", "disposition": "coalesce(nullif(disposition, ''), 'unknown')", "year": "date_trunc('year', fact_date)::DATE"}
    shown = ", ".join(f"{named.get(k, k)} AS {k}" for k in keys)
    order = "year DESC, " if intent == "volume" else ""
    return f"(SELECT {shown}, {', '.join(f'sum({MEASURES[m]})::BIGINT AS {m}' for m in measures)} FROM facts GROUP BY {', '.join(map(str, range(1, len(keys) + 1)))} ORDER BY {order}total_cases DESC, {', '.join(str(i + 1) for i in range(len(keys)))} LIMIT {most})"


@query(f"WITH {FACTS_SQL} " + " UNION ALL ".join(f"SELECT '{i}' AS intent, concat_ws('/', {', '.join(f'{k}::VARCHAR' for k in INTENTS[i][0])}) AS label, total_cases, text_available FROM {_detail_sql(i)}" for i in INTENTS))
def agg_answer_detail(spark, d):
    """The detail rows of all four intents."""
    out, f = None, facts(spark, d)
    for intent, (keys, _, _) in INTENTS.items():
        part = detail(f, intent).select(F.lit(intent).alias("intent"), F.concat_ws("/", *(F.col(k).cast("string") for k in keys)).alias("label"), "total_cases", "text_available")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""WITH {FACTS_SQL}, t AS (SELECT sum(metadata_cases)::BIGINT AS c, sum(targets)::BIGINT AS g FROM facts), top AS (SELECT string_agg(disposition || ' ' || CASE WHEN length(total_cases::VARCHAR) > 3 THEN left(total_cases::VARCHAR, length(total_cases::VARCHAR) - 3) || ',' || right(total_cases::VARCHAR, 3) ELSE total_cases::VARCHAR END, '; ' ORDER BY total_cases DESC, disposition) AS s FROM (SELECT * FROM {_detail_sql('outcomes')} LIMIT 5)),
n AS (SELECT c, g, CASE WHEN length(c::VARCHAR) > 5 THEN left(c::VARCHAR, length(c::VARCHAR) - 5) || ',' || right(left(c::VARCHAR, length(c::VARCHAR) - 3), 2) || ',' || right(c::VARCHAR, 3) WHEN length(c::VARCHAR) > 3 THEN left(c::VARCHAR, length(c::VARCHAR) - 3) || ',' || right(c::VARCHAR, 3) ELSE c::VARCHAR END AS cs FROM t)
SELECT 'District outcome analytics: ' || cs || ' district-court metadata cases match the current analytics slice.' AS heading, 'Top breakdown: ' || s || '.' AS breakdown FROM n, top""")
def agg_answer_text(spark, d):
    """A worded answer from totals and the five largest groups."""
    f = facts(spark, d)
    total = f.agg(F.sum("metadata_cases").alias("c"))
    top = detail(f, "outcomes").orderBy(F.desc("total_cases"), "disposition").limit(5)
    lines = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("total_cases")).alias("n"), F.col("disposition").alias("k")))).alias("rows"))  # five rows
    words = F.array_join(F.transform("rows", lambda r: F.concat(r["k"], F.lit(" "), _grouped(-r["n"]))), "; ")
    heading = F.concat(F.lit("District outcome analytics: "), _grouped(F.col("c")), F.lit(" district-court metadata cases match the current analytics slice."))
    return total.crossJoin(F.broadcast(lines)).select(heading.alias("heading"), F.concat(F.lit("Top breakdown: "), words, F.lit(".")).alias("breakdown"))


@query(f"WITH {ARTIFACTS_SQL} SELECT case_id, has_text, ocr_required, redacted, translated, artifact_language FROM artifacts")
def agg_artifact_rollup(spark, d):
    return artifacts(spark, d).select("case_id", "has_text", "ocr_required", "redacted", "translated", "artifact_language")


@query(f"WITH {FAILURES_SQL} SELECT * FROM failures")
def agg_failure_rollup(spark, d):
    return failures(spark, d)


@query("SELECT o_orderkey AS case_id, coalesce(bool_or(p_size > 25), false) AS active, coalesce(bool_or(s_suppkey % 3 = 0), false) AS translated FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1")
def agg_document_rollup(spark, d):
    """Flags over the documents and translations of each case; a case without any has them false."""
    lines = table(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_partkey", "l_suppkey")
    docs = lines.join(table(spark, d, "part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"), "left").join(table(spark, d, "supplier").select("s_suppkey"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
    rolled = docs.groupBy(F.col("l_orderkey").alias("case_id")).agg(F.bool_or(F.col("p_size") > 25).alias("active"), F.bool_or(F.col("s_suppkey") % 3 == 0).alias("translated"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id")).join(rolled, "case_id", "left").select("case_id", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("active", "translated")))


@query(r"SELECT regexp_extract(url, '\.([a-z0-9]{1,5})(?:[?#]|$)', 1) AS mime, count(*) AS n FROM pages GROUP BY 1 ORDER BY n DESC, mime LIMIT 20")
def agg_mime(spark, d):
    return table(spark, d, "pages").groupBy(F.regexp_extract("url", r"\.([a-z0-9]{1,5})(?:[?#]|$)", 1).alias("mime")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "mime").limit(20)


@query("SELECT count(*) AS total, count(*) FILTER (l_tax < 0.03) AS flagged, round(avg(1 - l_tax), 6) AS avg_confidence FROM lineitem")
def agg_ocr(spark, d):
    return table(spark, d, "lineitem").agg(F.count("*").alias("total"), F.count_if(F.col("l_tax") < 0.03).alias("flagged"), F.round(F.avg(1 - F.col("l_tax")), 6).alias("avg_confidence"))


@query("SELECT count(*) AS entries, count(DISTINCT user_id) AS users, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END)::BIGINT AS hits FROM events")
def agg_cache_stats(spark, d):
    return table(spark, d, "events").agg(F.count("*").alias("entries"), F.count_distinct("user_id").alias("users"), F.count_if(F.col("event_type") == "view").alias("hits"))


@query("SELECT user_id AS entry, count(*) AS hits FROM events WHERE event_type = 'view' GROUP BY 1 ORDER BY hits DESC, entry LIMIT 10")
def agg_top_cached(spark, d):
    return table(spark, d, "events").where("event_type = 'view'").groupBy(F.col("user_id").alias("entry")).agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), "entry").limit(10)


@query("SELECT event_type AS level, count(*) AS n, round(avg(value), 4) AS rating FROM events GROUP BY 1")
def agg_fb_level(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("level")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("rating"))


@query("SELECT count(*) FILTER (event_type = 'view') AS pending, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type NOT IN ('view', 'error')) AS done, (SELECT count(*) FROM lineitem WHERE l_linestatus = 'O') AS stored FROM events")
def agg_stage_counts(spark, d):
    """Queue and artifact stages side by side."""
    kind = F.col("event_type")
    queue = table(spark, d, "events").agg(F.count_if(kind == "view").alias("pending"), F.count_if(kind == "error").alias("failed"), F.count_if(~kind.isin("view", "error")).alias("done"))
    return queue.crossJoin(F.broadcast(table(spark, d, "lineitem").agg(F.count_if(F.col("l_linestatus") == "O").alias("stored"))))  # one row each


@query("SELECT l_orderkey AS article, count(*) FILTER (l_quantity > 10) AS material, count(*) FILTER (l_quantity > 10 AND l_discount > 0.02) AS cited, round(count(*) FILTER (l_quantity > 10 AND l_discount > 0.02) / nullif(count(*) FILTER (l_quantity > 10), 0), 6) AS coverage, count(*) FILTER (l_quantity > 10) > 0 AND count(*) FILTER (l_quantity > 10) = count(*) FILTER (l_quantity > 10 AND l_discount > 0.02) AS approvable FROM lineitem GROUP BY 1")
def agg_wiki_coverage(spark, d):
    """Cited material claims of each article; it may be approved if all are cited and there is one."""
    material, cited = F.col("l_quantity") > 10, F.col("l_discount") > 0.02
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("article")).agg(F.count_if(material).alias("material"), F.count_if(material & cited).alias("cited"))
    return n.select("*", F.round(F.try_divide("cited", "material"), 6).alias("coverage"), ((F.col("material") > 0) & (F.col("material") == F.col("cited"))).alias("approvable"))


@query("SELECT o_custkey AS user_id, list_sort(list(DISTINCT o_orderpriority)) AS roles FROM orders GROUP BY 1")
def agg_users_roles(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.array_sort(F.collect_set("o_orderpriority")).alias("roles"))


@query(f"WITH {CASES_SQL}, o AS (SELECT court_level AS label, count(*) AS n FROM cases GROUP BY 1) SELECT label, n, row_number() OVER (ORDER BY n DESC, label) AS place FROM o QUALIFY place <= 3")
def win_rank_options(spark, d):
    """The most frequent labels with their places."""
    n = cases(spark, d).groupBy(F.col("court_level").alias("label")).agg(F.count("*").alias("n"))
    top = n.orderBy(F.desc("n"), "label").limit(3)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "label"))).withColumn("place", F.col("place").cast("bigint"))


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY CASE WHEN c_mktsegment = 'BUILDING' THEN 0 WHEN c_mktsegment = 'MACHINERY' THEN 1 ELSE 2 END, c_acctbal DESC, c_custkey LIMIT 40")
def srt_multi_rank(spark, d):
    """Ordered by a rank of labels, then by value."""
    rank = F.when(F.col("c_mktsegment") == "BUILDING", 0).when(F.col("c_mktsegment") == "MACHINERY", 1).otherwise(2)
    return table(spark, d, "customer").orderBy(rank, F.desc("c_acctbal"), "c_custkey").limit(40).select("c_custkey", "c_acctbal")


@query(f"WITH {CASES_SQL} SELECT case_id, decision_date FROM cases ORDER BY decision_date DESC NULLS LAST, case_id LIMIT 100")
def srt_nulls_last(spark, d):
    return cases(spark, d).select("case_id", "decision_date").orderBy(F.desc_nulls_last("decision_date"), "case_id").limit(100)


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 75")
def lim_offset(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(75).limit(25).select("o_orderkey")


@query(f"WITH {CASES_SQL} SELECT case_id, state_name, district_name, language, failed FROM cases")
def jn_left_multi(spark, d):
    """Cases with places, artifacts and failures, each aggregated before it joins."""
    return cases(spark, d).select("case_id", "state_name", "district_name", "language", "failed")


@query("SELECT o_orderkey, c_mktsegment, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def jn_inner_equi(spark, d):
    nation = table(spark, d, "nation")  # 25 rows by definition
    who = table(spark, d, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_mktsegment", "n_name")
    return table(spark, d, "orders").join(who, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment", "n_name")


@query("SELECT l_orderkey, l_linenumber, s_name FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN 'x' ELSE l_suppkey::VARCHAR END AS k FROM lineitem) LEFT JOIN supplier ON try_cast(k AS BIGINT) = s_suppkey")
def jn_cast_key(spark, d):
    """Text keys meet integer keys; what is no number meets nothing."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") == 7, "x").otherwise(F.col("l_suppkey").cast("string")).try_cast("bigint").alias("k"))
    return lines.join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), "s_name"), "k", "left").select("l_orderkey", "l_linenumber", "s_name")


@query("SELECT p_partkey AS id, kind, label FROM part, LATERAL (VALUES ('brand', p_brand), ('type', p_type)) v(kind, label)")
def jn_lateral_values(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_brand", "p_type").unpivot(["id"], [F.col("p_brand").alias("brand"), F.col("p_type").alias("type")], "kind", "label")


@query("SELECT label, count(*) AS n FROM (SELECT lower(c_mktsegment) AS label FROM customer UNION ALL SELECT lower(p_type) FROM part) GROUP BY 1")
def set_union_all(spark, d):
    both = table(spark, d, "customer").select(F.lower("c_mktsegment").alias("label")).unionByName(table(spark, d, "part").select(F.lower("p_type").alias("label")))
    return both.groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT key, min(ord) AS first, arg_min(shown, ord) AS shown FROM (SELECT lower(q) AS key, q AS shown, ord FROM (SELECT c_mktsegment AS q, c_custkey AS ord FROM customer UNION ALL SELECT lower(p_type), 1000000 + p_partkey FROM part)) GROUP BY 1")
def set_query_union(spark, d):
    """Two query lists as one, each wording once, the first spelling kept."""
    a = table(spark, d, "customer").select(F.col("c_mktsegment").alias("q"), F.col("c_custkey").alias("ord"))
    b = table(spark, d, "part").select(F.lower("p_type").alias("q"), (F.col("p_partkey") + 1_000_000).alias("ord"))
    return a.unionByName(b).groupBy(F.lower("q").alias("key")).agg(F.min("ord").alias("first"), F.min_by("q", "ord").alias("shown"))
