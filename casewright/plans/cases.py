"""Case rows and their daily facts over orders and lineitem.

Orders stand in for court cases (region: state, nation: district, priority:
court level, status: disposition), line items for their text artifacts and
fetch attempts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casewright.operators import fact_table
from casewright.registry import query, table
from casewright.shared import shared_dir, written

ARTIFACTS_SQL = """artifacts AS (SELECT l_orderkey AS case_id, bool_or(l_returnflag IN ('A','R')) AS has_text, bool_or(l_linestatus = 'O') AS ocr_required,
  bool_or(l_discount > 0.08) AS redacted, bool_or(l_tax >= 0.07) AS translated, max(nullif(l_returnflag, '')) AS artifact_language, min(l_shipdate)::DATE AS first_ship,
  list_sort(list(DISTINCT l_returnflag)) AS offences FROM lineitem GROUP BY l_orderkey)"""
FAILURES_SQL = "failures AS (SELECT l_orderkey AS case_id, count(*) AS failed FROM lineitem WHERE l_quantity > 45 GROUP BY l_orderkey)"
CASES_SQL = f"""{ARTIFACTS_SQL}, {FAILURES_SQL}, cases AS (SELECT o_orderkey AS case_id, r_regionkey AS state_code, r_name AS state_name, n_nationkey AS district_code, n_name AS district_name,
  o_orderpriority AS court_level, c_mktsegment AS case_type, CASE o_orderstatus WHEN 'P' THEN '' ELSE o_orderstatus END AS disposition, o_orderdate::DATE AS registration_date,
  CASE WHEN o_orderstatus <> 'O' THEN first_ship END AS decision_date, o_orderpriority <> '5-LOW' AS commercial_safe, o_totalprice AS amount,
  'ws-' || (o_custkey % 2) AS workspace_id, CASE WHEN o_orderkey % 7 = 0 THEN 'BNS' ELSE 'IPC' END AS statute, (300 + o_orderkey % 3)::VARCHAR AS section, 'src' || (o_orderkey % 2) AS source_name, CASE WHEN o_orderkey % 2 = 0 THEN 'open' ELSE 'restricted' END AS license_classification,
  coalesce(has_text, false) AS has_text, coalesce(ocr_required, false) AS ocr_required, coalesce(redacted, false) AS redacted, coalesce(translated, false) AS translated,
  coalesce(artifact_language, 'unknown') AS language, coalesce(failed, 0) AS failed, coalesce(offences, []) AS offences
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN artifacts a ON a.case_id = o_orderkey LEFT JOIN failures f ON f.case_id = o_orderkey)"""
DIMS = ["fact_date", "workspace_id", "state_code", "district_code", "court_level", "case_type", "statute", "section", "offence", "disposition", "language", "source_name", "license_classification", "commercial_safe"]
FACTS_SQL = f"""{CASES_SQL}, facts AS (SELECT coalesce(decision_date, registration_date) AS fact_date, workspace_id, state_code, district_code, court_level, case_type, statute, section, nullif(offences[1], '') AS offence, disposition, language, source_name, license_classification, commercial_safe,
  count(*) AS metadata_cases, count(*) FILTER (amount > 200000) AS targets, count(*) FILTER (has_text) AS with_text, count(*) FILTER (ocr_required) AS with_ocr, count(*) FILTER (translated) AS with_translation,
  count(*) FILTER (redacted) AS with_redaction, sum(failed)::BIGINT AS failed_fetches,
  avg(date_diff('day', registration_date, decision_date)) AS avg_days, quantile_cont(date_diff('day', registration_date, decision_date), 0.95) AS p95_days
  FROM cases GROUP BY ALL)"""


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a case: flags over its artifacts, and its failed fetches, in one pass."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg(
        F.bool_or(F.col("l_returnflag").isin("A", "R")).alias("has_text"), F.bool_or(F.col("l_linestatus") == "O").alias("ocr_required"),
        F.bool_or(F.col("l_discount") > 0.08).alias("redacted"), F.bool_or(F.col("l_tax") >= 0.07).alias("translated"),
        F.max(F.nullif("l_returnflag", F.lit(""))).alias("artifact_language"), F.min("l_shipdate").cast("date").alias("first_ship"), F.array_sort(F.collect_set("l_returnflag")).alias("offences"),
        F.min("l_returnflag").alias("first_offence"),  # for those who need no more of them: a set makes the aggregate one of objects
        F.count_if(F.col("l_quantity") > 45).alias("failed"),
    )


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where("l_quantity > 45").groupBy(F.col("l_orderkey").alias("case_id")).agg(F.count("*").alias("failed"))


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases with labels; artifacts are aggregated before they join."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")  # 25 and 5 rows by definition
    places = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    who = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))
    base = table(spark, sf_dir, "orders").join(who, F.col("o_custkey") == F.col("c_custkey")).withColumn("case_id", F.col("o_orderkey"))
    rolled = base.join(artifacts(spark, sf_dir), "case_id", "left")
    off = F.lit(False)
    return rolled.select(
        "case_id", F.col("r_regionkey").alias("state_code"), F.col("r_name").alias("state_name"), F.col("n_nationkey").alias("district_code"), F.col("n_name").alias("district_name"), F.col("o_orderpriority").alias("court_level"),
        F.col("c_mktsegment").alias("case_type"), F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus")).alias("disposition"), F.col("o_orderdate").cast("date").alias("registration_date"),
        F.when(F.col("o_orderstatus") != "O", F.col("first_ship")).alias("decision_date"), (F.col("o_orderpriority") != "5-LOW").alias("commercial_safe"), F.col("o_totalprice").alias("amount"),
        F.concat(F.lit("ws-"), F.col("o_custkey") % 2).alias("workspace_id"), F.when(F.col("o_orderkey") % 7 == 0, "BNS").otherwise("IPC").alias("statute"), (300 + F.col("o_orderkey") % 3).cast("string").alias("section"),
        F.concat(F.lit("src"), F.col("o_orderkey") % 2).alias("source_name"), F.when(F.col("o_orderkey") % 2 == 0, "open").otherwise("restricted").alias("license_classification"),
        *(F.coalesce(c, off).alias(c) for c in ("has_text", "ocr_required", "redacted", "translated")), F.coalesce("artifact_language", F.lit("unknown")).alias("language"),
        F.coalesce("failed", F.lit(0).cast("bigint")).alias("failed"), F.coalesce("offences", F.array().cast("array<string>")).alias("offences"), "first_offence",
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily facts of fourteen dimensions; only a case's first offence counts, and the percentile is exact.

    Cases are counted by dimensions and days first; the percentile lies between two of these counts in the order of
    days, so that no aggregate holds objects.
    """
    days = F.datediff("decision_date", "registration_date")
    rows = cases(spark, sf_dir).select("*", F.coalesce("decision_date", "registration_date").alias("fact_date"), F.nullif("first_offence", F.lit("")).alias("offence"), days.alias("days"))
    told = {"targets": F.count_if(F.col("amount") > 200000), "with_text": F.count_if("has_text"), "with_ocr": F.count_if("ocr_required"), "with_translation": F.count_if("translated"), "with_redaction": F.count_if("redacted"), "failed_fetches": F.sum("failed")}
    daily = rows.groupBy(*DIMS, "days").agg(F.count("*").alias("metadata_cases"), *(c.alias(name) for name, c in told.items()))
    n = F.when(F.col("days").isNotNull(), F.col("metadata_cases")).otherwise(0)
    order = Window.partitionBy(*DIMS).orderBy(F.asc_nulls_last("days"))
    placed = daily.select("*", n.alias("n"), F.sum(n).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum(n).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("known"))
    at = (F.col("known") - 1) * F.lit(0.95)
    day_of = lambda place: F.max(F.when((F.col("upto") - F.col("n") <= place) & (place < F.col("upto")), F.col("days")))
    low, high = day_of(F.floor(at)), day_of(F.ceil(at))
    out = placed.groupBy(*DIMS).agg(F.sum("metadata_cases").alias("metadata_cases"), *(F.sum(name).alias(name) for name in told), F.sum(F.col("days") * F.col("n")).alias("sum"), F.max("known").alias("known"), low.alias("low"), high.alias("high"))
    share = at - F.floor(at)
    p95 = F.when(F.col("low") == F.col("high"), F.col("low").cast("double")).otherwise((1 - share) * F.col("low") + share * F.col("high"))
    return out.select(*DIMS, "metadata_cases", *told, F.try_divide(F.col("sum").cast("double"), F.col("known")).alias("avg_days"), p95.alias("p95_days"))


@query(f"WITH {FACTS_SQL} SELECT * REPLACE (round(avg_days, 4) AS avg_days, round(p95_days, 4) AS p95_days) FROM facts")
def agg_fact_refresh(spark, d):
    return facts(spark, d).withColumns({"avg_days": F.round("avg_days", 4), "p95_days": F.round("p95_days", 4)})


@query(f"WITH {FACTS_SQL}, w AS (SELECT 'ws-' || k AS workspace_id FROM range(3) t(k)) SELECT w.workspace_id, coalesce(n, 0) AS fact_rows, coalesce(c, 0) AS cases FROM w LEFT JOIN (SELECT workspace_id, count(*) AS n, sum(metadata_cases)::BIGINT AS c FROM facts GROUP BY 1) f ON f.workspace_id = w.workspace_id")
def agg_fact_log(spark, d):
    """One log row a refreshed workspace; a workspace without cases logs 0."""
    n = facts(spark, d).groupBy("workspace_id").agg(F.count("*").alias("n"), F.sum("metadata_cases").alias("c"))
    w = spark.range(3).select(F.concat(F.lit("ws-"), "id").alias("workspace_id"))
    zero = F.lit(0).cast("bigint")
    return w.join(n, "workspace_id", "left").select("workspace_id", F.coalesce("n", zero).alias("fact_rows"), F.coalesce("c", zero).alias("cases"))


@query(f"WITH {FACTS_SQL}, old AS (SELECT workspace_id, metadata_cases FROM facts WHERE fact_date < DATE '1997-01-01') SELECT workspace_id, count(*) AS fact_rows, sum(metadata_cases)::BIGINT AS cases FROM (SELECT * FROM old WHERE workspace_id <> 'ws-1' UNION ALL SELECT workspace_id, metadata_cases FROM facts WHERE workspace_id = 'ws-1') GROUP BY 1")
def agg_fact_reload(spark, d):
    """A table of facts of which one workspace is refreshed; the others keep what they have."""
    f = written(facts(spark, d), "facts")  # read three times
    store = fact_table.FactTable(spark, f"{shared_dir(spark)}/casewright/facts-{uuid.uuid4().hex}", f.schema)
    every = [r["workspace_id"] for r in f.select("workspace_id").distinct().toLocalIterator()]
    store.refresh(f.where("fact_date < DATE '1997-01-01'"), every)
    store.refresh(f, ["ws-1"])
    return store.read().groupBy("workspace_id").agg(F.count("*").alias("fact_rows"), F.sum("metadata_cases").alias("cases"))


@query(f"WITH {FACTS_SQL} SELECT sum(metadata_cases)::BIGINT AS metadata_cases, sum(targets)::BIGINT AS targets, sum(with_text)::BIGINT AS with_text, sum(with_ocr)::BIGINT AS with_ocr, sum(with_translation)::BIGINT AS with_translation, sum(with_redaction)::BIGINT AS with_redaction, sum(failed_fetches)::BIGINT AS failed_fetches, count(DISTINCT state_code) AS states, round(avg(avg_days))::BIGINT AS avg_of_bucket_avg_days, round(max(p95_days))::BIGINT AS max_of_bucket_p95_days, round(sum(avg_days * metadata_cases) FILTER (avg_days IS NOT NULL) / sum(metadata_cases) FILTER (avg_days IS NOT NULL), 4) AS weighted_avg_days FROM facts WHERE commercial_safe")
def agg_summary(spark, d):
    """Totals of the facts; averages of bucket averages as dashboards show them, and a weighted one."""
    f = facts(spark, d).where("commercial_safe")
    sums = [F.sum(c).alias(c) for c in ("metadata_cases", "targets", "with_text", "with_ocr", "with_translation", "with_redaction", "failed_fetches")]
    known = F.when(F.col("avg_days").isNotNull(), F.col("metadata_cases"))
    return f.agg(*sums, F.count_distinct("state_code").alias("states"), F.round(F.avg("avg_days")).cast("bigint").alias("avg_of_bucket_avg_days"), F.round(F.max("p95_days")).cast("bigint").alias("max_of_bucket_p95_days"), F.round(F.sum(F.col("avg_days") * F.col("metadata_cases")) / F.sum(known), 4).alias("weighted_avg_days"))


@query(f"WITH {CASES_SQL} SELECT date_trunc('month', registration_date)::DATE AS bucket, state_code, district_code, count(*) AS cases, round(sum(amount), 2) AS amount FROM cases GROUP BY ALL ORDER BY bucket, state_code, district_code LIMIT 500")
def agg_volume(spark, d):
    """Cases by month and place, the first 500 buckets."""
    bucket = F.date_trunc("month", "registration_date").cast("date").alias("bucket")
    return cases(spark, d).groupBy(bucket, "state_code", "district_code").agg(F.count("*").alias("cases"), F.round(F.sum("amount"), 2).alias("amount")).orderBy("bucket", "state_code", "district_code").limit(500)


@query(f"WITH {CASES_SQL}, top AS (SELECT state_code, district_code, court_level, language, commercial_safe, count(*) AS cases, count(*) FILTER (has_text) AS with_text FROM cases GROUP BY ALL ORDER BY cases DESC, state_code, district_code, court_level, language, commercial_safe LIMIT 200) SELECT top.*, r_name AS state_name, n_name AS district_name FROM top LEFT JOIN region ON r_regionkey = state_code LEFT JOIN nation ON n_nationkey = district_code AND n_regionkey = state_code")
def agg_coverage(spark, d):
    """The 200 largest groups, labelled after the limit."""
    keys = ["state_code", "district_code", "court_level", "language", "commercial_safe"]
    top = cases(spark, d).groupBy(*keys).agg(F.count("*").alias("cases"), F.count_if("has_text").alias("with_text")).orderBy(F.desc("cases"), *keys).limit(200)
    states = table(spark, d, "region").select(F.col("r_regionkey").alias("state_code"), F.col("r_name").alias("state_name"))
    districts = table(spark, d, "nation").select(F.col("n_nationkey").alias("district_code"), F.col("n_regionkey").alias("state_code"), F.col("n_name").alias("district_name"))
    return top.join(states, "state_code", "left").join(districts, ["state_code", "district_code"], "left")


@query(f"WITH {CASES_SQL} SELECT coalesce(nullif(disposition, ''), 'unknown') AS disposition, count(*) AS cases, count(*) FILTER (decision_date IS NOT NULL) AS decided FROM cases GROUP BY 1 ORDER BY cases DESC, disposition LIMIT 100")
def agg_outcomes(spark, d):
    return cases(spark, d).groupBy(F.coalesce(F.nullif("disposition", F.lit("")), F.lit("unknown")).alias("disposition")).agg(F.count("*").alias("cases"), F.count("decision_date").alias("decided")).orderBy(F.desc("cases"), "disposition").limit(100)


@query(f"WITH {CASES_SQL}, options AS (UNPIVOT (SELECT court_level, case_type, disposition, language, state_name, district_name FROM cases) ON court_level, case_type, disposition, language, state_name, district_name INTO NAME kind VALUE label), ranked AS (SELECT kind, label, count(*) AS cases, row_number() OVER (PARTITION BY kind ORDER BY count(*) DESC, label) AS place FROM options WHERE label <> '' GROUP BY kind, label) SELECT kind, label, cases FROM ranked WHERE place <= 500")
def agg_filter_options(spark, d):
    """Values of each filter by frequency, at most 500 a kind; six columns are unpivoted in one pass."""
    from pyspark.sql import Window

    kinds = ["court_level", "case_type", "disposition", "language", "state_name", "district_name"]
    long = cases(spark, d).select(*kinds).unpivot([], kinds, "kind", "label").where("label <> ''")
    counted = long.groupBy("kind", "label").agg(F.count("*").alias("cases"))
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("cases"), "label"))
    return counted.withColumn("place", place).where("place <= 500").drop("place")


@query(f"WITH {CASES_SQL} SELECT coalesce(offence, 'unknown') AS offence, state_code, district_code, court_level, count(*) AS cases, count(*) FILTER (language = 'unknown') AS missing, count(*) FILTER (has_text) AS ready FROM (SELECT *, unnest(CASE WHEN len(offences) = 0 THEN ['unknown'] ELSE offences END) AS offence FROM cases) GROUP BY ALL ORDER BY cases DESC, offence, state_code, district_code, court_level LIMIT 200")
def agg_targets(spark, d):
    """Cases by each of their offences; a case without one counts as unknown."""
    each = F.explode(F.when(F.size("offences") == 0, F.array(F.lit("unknown"))).otherwise(F.col("offences")))
    keys = ["offence", "state_code", "district_code", "court_level"]
    return cases(spark, d).withColumn("offence", each).groupBy(*keys).agg(F.count("*").alias("cases"), F.count_if(F.col("language") == "unknown").alias("missing"), F.count_if("has_text").alias("ready")).orderBy(F.desc("cases"), *keys).limit(200)


@query(f"WITH {CASES_SQL}, long AS (UNPIVOT (SELECT court_level, case_type, disposition, language, state_name FROM cases) ON court_level, case_type, disposition, language, state_name INTO NAME kind VALUE key) SELECT kind, coalesce(nullif(key, ''), 'unknown') AS key, count(*) AS n FROM long GROUP BY ALL UNION ALL SELECT 'offence', unnest(offences), count(*) FROM cases GROUP BY 2 UNION ALL SELECT 'scalar', 'total', count(*) FROM cases UNION ALL SELECT 'scalar', 'target', count(*) FILTER (amount > 200000) FROM cases")
def agg_count_report(spark, d):
    """Facet counts and totals from one pass over the cases."""
    c = cases(spark, d)
    facets = F.array(*(F.struct(F.lit(k).alias("kind"), F.coalesce(F.nullif(F.col(k), F.lit("")), F.lit("unknown")).alias("key")) for k in ("court_level", "case_type", "disposition", "language", "state_name")))
    extra = [F.transform("offences", lambda x: F.struct(F.lit("offence").alias("kind"), x.alias("key"))), F.array(F.struct(F.lit("scalar").alias("kind"), F.lit("total").alias("key"))), F.when(F.col("amount") > 200000, F.array(F.struct(F.lit("scalar").alias("kind"), F.lit("target").alias("key")))).otherwise(F.array())]
    return c.select(F.explode(F.concat(facets, *extra)).alias("f")).groupBy("f.kind", "f.key").agg(F.count("*").alias("n"))


@query(f"WITH {CASES_SQL} SELECT case_id, state_code, district_code, court_level, registration_date, decision_date FROM cases WHERE lower(coalesce(court_level, '')) IN ('1-urgent', '2-high') AND state_code IN (1, 2) AND list_has_any(offences, ['R', 'N']) AND ((state_code = 1 AND district_code = 1) OR (state_code = 2 AND district_code = 8) OR (state_code = 2 AND district_code = 12)) AND registration_date BETWEEN DATE '1993-01-01' AND DATE '1997-12-31' AND commercial_safe")
def flt_case(spark, d):
    """All dashboard filters together."""
    from casewright.operators import filters as f

    where = f.all_of(f.in_lower("court_level", ["1-URGENT", " 2-high"]), f.in_int("state_code", ["1", "2", "x"]), f.array_any("offences", ["r", "n"]), f.pair_or("state_code", "district_code", ["1:1", "2:8", "2:12", "bad"]), f.date_range("registration_date", "1993-01-01", "1997-12-31"), f.commercial_default("commercial_safe", None))
    return cases(spark, d).where(where).select("case_id", "state_code", "district_code", "court_level", "registration_date", "decision_date")


@query(f"WITH {CASES_SQL} SELECT case_id, state_name, court_level FROM cases WHERE lower(state_name) LIKE '%asia%' OR lower(case_type) LIKE '%asia%' OR lower(disposition) LIKE '%asia%' OR case_id::VARCHAR = 'asia'")
def flt_case_search(spark, d):
    from casewright.operators.filters import like_any

    return cases(spark, d).where(like_any(["state_name", "case_type", "disposition"], " ASIA", "case_id")).select("case_id", "state_name", "court_level")


@query(f"WITH {CASES_SQL} SELECT case_id, decision_date, registration_date FROM cases ORDER BY decision_date DESC NULLS LAST, registration_date DESC NULLS LAST, case_id LIMIT 50 OFFSET 100")
def rd_cases(spark, d):
    """The third page of 50, newest decisions first and undecided cases last."""
    c = cases(spark, d).select("case_id", "decision_date", "registration_date")
    return c.orderBy(F.desc_nulls_last("decision_date"), F.desc_nulls_last("registration_date"), "case_id").offset(100).limit(50)


@query(f"WITH {CASES_SQL} SELECT (SELECT count(*) FROM cases) AS total, (SELECT count(*) FROM cases WHERE commercial_safe) AS safe")
def lim_total(spark, d):
    """The count beside a page, as an aggregate of its own."""
    return cases(spark, d).agg(F.count("*").alias("total"), F.count_if("commercial_safe").alias("safe"))


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def jn_anti(spark, d):
    lines = table(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey")
    return table(spark, d, "orders").select("o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'O')")
def jn_semi_exists(spark, d):
    """Two EXISTS filters; different rows may satisfy them."""
    o, lines = table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem")
    for where in ("l_returnflag = 'R'", "l_linestatus = 'O'"):
        o = o.join(lines.where(where).select("l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    return o


@query("SELECT c_custkey, coalesce(n, 0) AS orders, coalesce(newest, DATE '1970-01-01') AS newest FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_orderdate)::DATE AS newest FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def jn_scalar_sub(spark, d):
    """Correlated counts as one aggregate and a left join."""
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max("o_orderdate").cast("date").alias("newest"))
    return table(spark, d, "customer").select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0).cast("bigint")).alias("orders"), F.coalesce("newest", F.lit("1970-01-01").cast("date")).alias("newest"))


@query("SELECT l_orderkey, p_brand, coalesce(year, 2010) AS year FROM (SELECT l_orderkey, lpad(l_partkey::VARCHAR, 8, '0') AS code, CASE WHEN l_linenumber > 1 THEN year(l_shipdate) END AS year FROM lineitem) LEFT JOIN (SELECT p_partkey, p_brand FROM part) ON ltrim(code, '0') = p_partkey::VARCHAR")
def jn_code_lookup(spark, d):
    """Codes with leading zeros meet integer keys in one canonical form; a missing year is 2010."""
    lines = table(spark, d, "lineitem").select("l_orderkey", F.lpad(F.col("l_partkey").cast("string"), 8, "0").alias("code"), F.when(F.col("l_linenumber") > 1, F.year("l_shipdate")).alias("year"))
    codes = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("key"), "p_brand")
    return lines.join(codes, F.ltrim("code", F.lit("0")) == F.col("key"), "left").select("l_orderkey", "p_brand", F.coalesce("year", F.lit(2010)).cast("bigint").alias("year"))


@query("SELECT l_orderkey AS case_id, list_sort(list(DISTINCT p_brand)) AS acts, list_sort(list(DISTINCT p_size)) AS sections FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def jn_index_build(spark, d):
    """Acts and sections of each case as sorted sets."""
    j = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, d, "part").select("p_partkey", "p_brand", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy(F.col("l_orderkey").alias("case_id")).agg(F.array_sort(F.collect_set("p_brand")).alias("acts"), F.array_sort(F.collect_set("p_size")).alias("sections"))


@query("SELECT o_custkey AS cust, to_json(list({'k': o_orderkey, 'p': o_orderpriority} ORDER BY o_orderkey))::VARCHAR AS orders FROM orders GROUP BY 1")
def agg_json_nested(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy(F.col("o_custkey").alias("cust")).agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("p"))))).alias("orders"))
