"""Details, exports, rows and pages: what stands in for what is said at each query."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewright.operators import case_rows, details, entities, exports, filters
from casewright.plans.cases import CASES_SQL, DIMS, FACTS_SQL, cases, facts
from casewright.registry import query, table
from casewright.shared import written
from casewright.sources import readers
from casewright.streaming import lifecycle

CELL = """CASE WHEN regexp_matches({0}, '[",\\n\\r]') THEN '"' || replace({0}, '"', '""') || '"' ELSE coalesce({0}, '') END"""


def _line(names: list[str]) -> str:
    return " || ',' || ".join(CELL.format(f"{n}::VARCHAR") for n in names)


FACT_COLUMNS = ["fact_date", "state_code", "district_code", "court_level", "statute", "section", "offence", "disposition", "language", "source_name", "commercial_safe", "metadata_cases", "targets", "with_text", "with_translation", "with_redaction", "failed_fetches"]
FACT_ORDER = ["case_type", "license_classification", *(c for c in DIMS if c not in ("fact_date", "case_type", "license_classification", "workspace_id"))]


@query(f"WITH {FACTS_SQL} SELECT place::INT AS place, line FROM (SELECT row_number() OVER (ORDER BY fact_date DESC, metadata_cases DESC, {', '.join(f'{c} NULLS FIRST' for c in FACT_ORDER)}) AS place, {_line(FACT_COLUMNS)} AS line FROM facts WHERE workspace_id = 'ws-1' AND state_code IN (1, 3) AND commercial_safe) WHERE place <= 10000 UNION ALL SELECT 0, '{','.join(FACT_COLUMNS)}'")
def snk_csv_fact(spark, d):
    """Facts of a workspace and two states as a CSV file, the newest 10,000; the file's lines."""
    f = facts(spark, d).where("workspace_id = 'ws-1' AND state_code IN (1, 3) AND commercial_safe")
    order = [F.desc("fact_date"), F.desc("metadata_cases"), *map(F.asc_nulls_first, FACT_ORDER)]
    return exports.lines_of(spark, exports.export(f, order, exports.csv_line([F.col(c) for c in FACT_COLUMNS]), ",".join(FACT_COLUMNS)))


CNR_COLUMNS = ["case_id", "source_name", "state_code", "state_name", "district_code", "district_name", "court_level", "case_type", "registration_date", "decision_date", "disposition", "offences", "commercial_safe"]


@query(f"WITH {CASES_SQL}, c AS (SELECT * REPLACE (array_to_string(offences, '|') AS offences) FROM cases WHERE court_level IN ('1-URGENT', '2-HIGH') AND commercial_safe) SELECT place::INT AS place, line FROM (SELECT row_number() OVER (ORDER BY decision_date DESC NULLS LAST, registration_date DESC NULLS LAST, case_id DESC) AS place, {_line(CNR_COLUMNS)} AS line FROM c) WHERE place <= 5000 UNION ALL SELECT 0, '{','.join(CNR_COLUMNS)}'")
def snk_csv_cnr(spark, d):
    """Cases of two court levels as a CSV file, 5,000 unless more are asked for; offences by bars."""
    c = cases(spark, d).where("court_level IN ('1-URGENT', '2-HIGH') AND commercial_safe").withColumn("offences", F.array_join("offences", "|"))
    order = [F.desc_nulls_last("decision_date"), F.desc_nulls_last("registration_date"), F.desc("case_id")]
    return exports.lines_of(spark, exports.export(c, order, exports.csv_line([F.col(x) for x in CNR_COLUMNS]), ",".join(CNR_COLUMNS), exports.DEFAULT))


@query("""WITH a AS (SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at_, user_id, event_type, props, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS place FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25')
SELECT 'json' AS kind, (place - 1)::INT AS place, '{"id":' || event_id || ',"at":"' || at_ || '","user":' || user_id || ',"action":"' || event_type || '","details":"' || replace(props, '"', '\\"') || '"}' AS line FROM a WHERE place <= 10000
UNION ALL SELECT 'csv', place::INT, event_id || ',' || at_ || ',' || user_id || ',' || event_type || ',' || '"' || replace(props, '"', '""') || '"' FROM a WHERE place <= 10000 UNION ALL SELECT 'csv', 0, 'id,at,user,action,details'""")
def snk_audit(spark, d):
    """The newest 10,000 audit rows between two dates, as JSON lines and as CSV."""
    e = table(spark, d, "events").where("ts >= TIMESTAMP_NTZ '2024-01-05' AND ts < TIMESTAMP_NTZ '2024-01-25'")
    rows = e.select(F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("at"), F.col("user_id").alias("user"), F.col("event_type").alias("action"), F.col("props").alias("details"), "ts")
    order, names = [F.desc("ts"), F.desc("id")], ["id", "at", "user", "action", "details"]
    json = exports.lines_of(spark, exports.export(rows, order, F.to_json(F.struct(*names)), None))
    csv = exports.lines_of(spark, exports.export(rows, order, exports.csv_line([F.col(n) for n in names]), ",".join(names)))
    return json.select(F.lit("json").alias("kind"), "place", "line").unionByName(csv.select(F.lit("csv").alias("kind"), "place", "line"))


MASKED = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '(?:\+91[\s-]?|0)?[6-9]\d{9}', '[MASKED_PHONE]', 'g'), '\b\d{4}[\s-]?\d{4}[\s-]?\d{4}\b', '[MASKED_AADHAAR]', 'g'), '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b', '[MASKED_EMAIL]', 'g'), '\b[A-Z]{2,4}[/-]\d{3,8}\b', '[MASKED_ID]', 'g'), '\b[A-Z]{5}\d{4}[A-Z]\b', '[MASKED_PAN]', 'g')"


@query(f"""WITH cited AS (SELECT conv_id, turn, i, (conv_id * 7 + turn * 3 + i) % 50 AS v FROM conversations, range(2) r(i) WHERE role = 'assistant'),
m AS (SELECT conv_id, turn, to_json(role)::VARCHAR || ',' || to_json(left({MASKED}, 5000))::VARCHAR || ',' || to_json('t' || turn)::VARCHAR || ',' || to_json(coalesce((SELECT string_agg('Doc ' || v, '; ' ORDER BY i) FROM cited c WHERE c.conv_id = x.conv_id AND c.turn = x.turn), ''))::VARCHAR AS line FROM conversations x)
SELECT conv_id AS conv, 'role,content,created_at,citations' || chr(10) || string_agg(line, chr(10) ORDER BY turn) AS csv, coalesce((SELECT list('Citation "Doc ' || v || '" references a superseded document version' ORDER BY turn, i) FROM cited c WHERE c.conv_id = m.conv_id AND v % 4 = 0), []) AS warnings FROM m GROUP BY conv_id""")
def snk_conv(spark, d):
    """Conversations as masked CSV with their citations, and warnings of superseded versions; assistants cite two of fifty versions, each fourth of which is old."""
    t = table(spark, d, "conversations")
    messages = t.select(F.col("conv_id").alias("conv"), F.col("turn").alias("message"), "role", F.col("text").alias("content"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("created_at"))
    cited = t.where("role = 'assistant'").select(F.col("conv_id").alias("conv"), F.col("turn").alias("message"), F.explode(F.array(F.lit(0), F.lit(1))).alias("index")).withColumn("version", (F.col("conv") * 7 + F.col("message") * 3 + F.col("index")) % 50)
    versions = spark.range(50).select(F.col("id").alias("version"), (F.col("id") % 4 != 0).alias("current"))
    return exports.conversations(messages, cited.withColumn("title", F.concat(F.lit("Doc "), F.col("version").cast("string"))), versions)


LINES = "li AS (SELECT l_orderkey AS case_id, l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS id, l_suppkey, l_shipdate, l_returnflag, l_linestatus, l_quantity, l_tax FROM lineitem)"
PARTS = {"sources": "l_returnflag = 'N'", "events": "l_linestatus = 'O'", "artifacts": "l_returnflag = 'R'", "queue": "l_returnflag = 'A'", "attempts": "true"}


def _lines(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("case_id"), (F.col("l_orderkey") * 1_000_000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("id"), "l_suppkey", "l_shipdate", "l_returnflag", "l_linestatus", "l_quantity", "l_tax")


@query(f"WITH {LINES} " + " UNION ALL ".join(f"SELECT case_id, '{name}' AS part, row_number() OVER (PARTITION BY case_id ORDER BY l_shipdate DESC, id)::INT AS place, id AS child FROM li WHERE {where} QUALIFY place <= {3 if name == 'attempts' else 1000000}" for name, where in PARTS.items()))
def rd_case_detail(spark, d):
    """Five child sets of every case, newest first; of attempts the newest three, since orders are short."""
    li = _lines(spark, d)
    order = [F.desc("l_shipdate"), F.col("id")]
    return details.children("case_id", [(name, li.where(where), F.col("id"), order, 3 if name == "attempts" else None) for name, where in PARTS.items()])


@query(f"""WITH {LINES}, a AS (SELECT case_id, id, CASE WHEN l_quantity > 20 THEN l_suppkey END AS document, CASE WHEN l_tax < 0.03 THEN 'metadata_only' ELSE 'text' END AS kind, l_shipdate FROM li WHERE l_returnflag <> 'A')
SELECT case_id, 'artifacts' AS part, row_number() OVER (PARTITION BY case_id ORDER BY document IS NOT NULL DESC, l_shipdate DESC, id)::INT AS place, id AS child FROM a
UNION ALL SELECT case_id, 'queue', row_number() OVER (PARTITION BY case_id ORDER BY l_quantity DESC, l_shipdate DESC, id)::INT, id FROM li WHERE l_returnflag = 'A'
UNION ALL SELECT case_id, 'attempts', place::INT, id FROM (SELECT case_id, id, row_number() OVER (PARTITION BY case_id ORDER BY l_shipdate DESC, id) AS place FROM li) WHERE place <= 2
UNION ALL SELECT case_id, 'available', 1, arg_max(id, (l_shipdate, -id)) FROM a WHERE document IS NOT NULL AND kind <> 'metadata_only' GROUP BY case_id""")
def rd_fetch_status(spark, d):
    """Artifacts, queue and attempts of every case, and the artifact whose document can be shown."""
    li = _lines(spark, d)
    a = li.where("l_returnflag <> 'A'").withColumns({"document": F.when(F.col("l_quantity") > 20, F.col("l_suppkey")), "kind": F.when(F.col("l_tax") < 0.03, "metadata_only").otherwise("text")})
    new = [F.desc("l_shipdate"), F.col("id")]
    rows = details.children("case_id", [("artifacts", a, F.col("id"), [F.desc(F.col("document").isNotNull()), *new], None), ("queue", li.where("l_returnflag = 'A'"), F.col("id"), [F.desc("l_quantity"), *new], None), ("attempts", li, F.col("id"), new, 2)])
    first = details.first_available(a.withColumnsRenamed({"id": "artifact", "l_shipdate": "created_at"}), "case_id")
    return rows.unionByName(first.select("case_id", F.lit("available").alias("part"), F.lit(1).alias("place"), F.col("available").alias("child")))


@query("SELECT u.user_id AS document, CASE WHEN u.user_id % 4 = 0 THEN 'ACTIVE' ELSE 'CHUNKING' END AS status, list(event_type || ':' || CASE WHEN event_id % 3 = 0 THEN 'FAILED' ELSE 'COMPLETED' END ORDER BY ts, event_type || ':' || CASE WHEN event_id % 3 = 0 THEN 'FAILED' ELSE 'COMPLETED' END) AS jobs FROM (SELECT DISTINCT user_id FROM events) u JOIN events e ON e.user_id = u.user_id GROUP BY u.user_id UNION ALL SELECT -1, 'UPLOADED', []")
def rd_status(spark, d):
    """Every document with its status and its jobs in order; users are documents, their events jobs, and one has none."""
    e = table(spark, d, "events")
    docs = e.select(F.col("user_id").alias("document")).distinct().withColumn("status", F.when(F.col("document") % 4 == 0, "ACTIVE").otherwise("CHUNKING"))
    none = spark.range(1).select(F.lit(-1).cast("bigint").alias("document"), F.lit("UPLOADED").alias("status"))
    jobs = e.select(F.col("user_id").alias("document"), F.col("event_type").alias("step"), F.when(F.col("event_id") % 3 == 0, "FAILED").otherwise("COMPLETED").alias("status"), F.col("ts").alias("created_at"))
    return details.with_jobs(docs.unionByName(none), jobs)


@query("SELECT conv_id AS document, arg_max(coalesce(text, ''), (turn, coalesce(text, ''))) AS text FROM conversations WHERE role <> 'system' AND turn % 3 <> 1 GROUP BY 1")
def rd_text(spark, d):
    """The newest TEXT extraction of each document; turns are extractions of several kinds."""
    t = table(spark, d, "conversations").where("role <> 'system'")
    rows = t.select(F.col("conv_id").alias("document"), F.when(F.col("turn") % 3 == 1, "LAYOUT").otherwise("TEXT").alias("kind"), F.col("turn").alias("created_at"), F.coalesce("text", F.lit("")).alias("text"))
    return details.newest_text(rows)


@query("""WITH u AS (SELECT c_custkey AS u, c_mktsegment AS seg FROM customer), d AS (SELECT s_suppkey AS doc, ['PUBLIC', 'INTERNAL', 'CONFIDENTIAL', 'RESTRICTED'][1 + (s_suppkey % 4)::INT] AS level FROM supplier),
g AS (SELECT o_custkey AS u, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 120 END AS doc, CASE WHEN o_orderkey % 3 = 0 THEN 'CONFIDENTIAL' END AS level FROM orders WHERE o_orderkey % 40 = 0 AND (o_orderstatus = 'O' OR o_orderdate > TIMESTAMP '1997-01-01'))
SELECT u AS "user", doc AS document FROM u, d WHERE CASE seg WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 2 ELSE 1 END >= CASE level WHEN 'PUBLIC' THEN 0 WHEN 'INTERNAL' THEN 1 WHEN 'CONFIDENTIAL' THEN 2 ELSE 3 END
UNION SELECT g.u, d.doc FROM g JOIN d ON d.doc = g.doc UNION SELECT g.u, d.doc FROM g JOIN d ON g.doc IS NULL AND d.level = g.level""")
def flt_access_doc(spark, d):
    """Which users may see which documents: customers by clearance, and by grants made of orders."""
    ranks = {"PUBLIC": 0, "INTERNAL": 1, "CONFIDENTIAL": 2, "RESTRICTED": 3}
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user"), F.when(F.col("c_mktsegment") == "BUILDING", "PUBLIC").when(F.col("c_mktsegment") == "MACHINERY", "CONFIDENTIAL").otherwise("INTERNAL").alias("clearance"))
    docs = table(spark, d, "supplier").select(F.col("s_suppkey").alias("document"), F.get(F.array(*map(F.lit, ranks)), (F.col("s_suppkey") % 4).cast("int")).alias("level"))
    o, k = table(spark, d, "orders").where("o_orderkey % 40 = 0"), F.col("o_orderkey")
    grants = o.select(F.col("o_custkey").alias("user"), F.when(k % 3 > 0, k % 120).alias("document"), F.when(k % 3 == 0, "CONFIDENTIAL").alias("level"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")).alias("expires_at"))
    return details.accessible(docs, users, grants, F.expr("TIMESTAMP_NTZ '1997-01-01'"), ranks)


@query("WITH c AS (SELECT conv_id % 10 AS workspace, conv_id * 1000 + turn AS entry, [(conv_id * 7 + turn) % 40, (turn * 5) % 40] AS cited FROM conversations) SELECT workspace, entry FROM c WHERE workspace <> 3 AND NOT (workspace = 4 AND list_has_any(cited, [5, 12])) AND NOT (workspace = 5 AND list_contains(cited, 7))")
def dml_cache_invalidate(spark, d):
    """What stays of a cache of answers after one workspace and three documents are invalidated."""
    t, c, n = table(spark, d, "conversations"), F.col("conv_id"), F.col("turn")
    cache = t.select((c % 10).alias("workspace"), (c * 1000 + n).alias("entry"), F.array((c * 7 + n) % 40, (n * 5) % 40).alias("cited"))
    gone = spark.createDataFrame([(4, 5), (4, 12), (5, 7)], "workspace bigint, document bigint")
    return details.invalidated(cache, spark.createDataFrame([(3,)], "workspace bigint"), gone).select("workspace", "entry")


@query("SELECT user_id AS document, event_id AS job, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS place, CASE WHEN event_type <> 'error' THEN round(value * 1000) END AS duration_ms FROM events")
def agg_history(spark, d):
    """Jobs of each document in order with the milliseconds that they took; errors never end."""
    e = table(spark, d, "events")
    start = F.col("ts").cast("timestamp")
    end = F.when(F.col("event_type") != "error", F.timestamp_micros(F.unix_micros(start) + F.round(F.col("value") * 1000).cast("bigint") * 1000))
    jobs = e.select(F.col("user_id").alias("document"), F.col("event_id").alias("job"), start.alias("created_at"), start.alias("started_at"), end.alias("completed_at"))
    return details.history(jobs).select("document", "job", "place", "duration_ms")


@query("WITH h AS (SELECT item_id % 3 AS q, item_id AS id, CASE item_id % 3 WHEN 0 THEN 0.0002 WHEN 1 THEN length(text) / 1000.0 ELSE 0.0 END::DOUBLE AS rank FROM benchmark) SELECT q, id, round(rank / greatest(max(rank) OVER (PARTITION BY q), 0.001), 9) AS share FROM h")
def win_max_lexical(spark, d):
    """Ranks over the greatest of their query, which counts a thousandth at least."""
    n = F.col("item_id") % 3
    hits = table(spark, d, "benchmark").select(n.alias("q"), F.col("item_id").alias("id"), F.when(n == 0, 0.0002).when(n == 1, F.length("text") / 1000.0).otherwise(0.0).alias("rank"))
    return details.normalized_ranks(hits).select("q", "id", F.round("share", 9).alias("share"))


@query("WITH k AS (SELECT p_brand AS key, max(p_size) AS top FROM part WHERE p_size < 30 GROUP BY 1), n AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN 'new' || p_partkey ELSE p_brand END AS key FROM part WHERE p_size >= 30) SELECT id, n.key, (coalesce(top, 0) + row_number() OVER (PARTITION BY n.key ORDER BY id))::INT AS version FROM n LEFT JOIN k ON k.key = n.key")
def agg_max_version(spark, d):
    """New configurations take the version after the greatest of their key, or the first."""
    p = table(spark, d, "part")
    known = p.where("p_size < 30").select(F.col("p_brand").alias("key"), F.col("p_size").alias("version"))
    new = p.where("p_size >= 30").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("new"), F.col("p_partkey").cast("string"))).otherwise(F.col("p_brand")).alias("key"), F.col("p_partkey").alias("at"))
    return details.next_versions(known, new, "key").select("id", "key", "version")


@query("SELECT event_id, total FROM (SELECT event_id, count(*) OVER () AS total, ts FROM events WHERE event_type = 'error') ORDER BY ts DESC, event_id LIMIT 50 OFFSET 100")
def win_total(spark, d):
    """The third page of notifications, with the number of all."""
    e = table(spark, d, "events").where("event_type = 'error'")
    return details.page(e, [F.desc("ts"), F.col("event_id")], 50, 100).select("event_id", "total")


@query("SELECT o_orderkey, (5 - left(o_orderpriority, 1)::INT) * 10 AS priority FROM orders ORDER BY priority DESC, o_orderdate, o_orderkey LIMIT 60")
def srt_composite(spark, d):
    """The next jobs: highest priority first, then the oldest."""
    o = table(spark, d, "orders").withColumn("priority", (5 - F.left("o_orderpriority", F.lit(1)).cast("int")) * 10)
    return o.orderBy(F.desc("priority"), "o_orderdate", "o_orderkey").limit(60).select("o_orderkey", "priority")


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def jn_set_anti(spark, d):
    """Candidates that are not there already."""
    there = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id")).distinct()
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id")).join(there, "id", "left_anti")


@query(f"WITH {CASES_SQL} SELECT case_id, unnest(CASE WHEN len(o) = 0 THEN ['unknown'] ELSE o END) AS offence FROM (SELECT case_id, CASE WHEN case_id % 6 = 0 THEN [] ELSE offences END AS o FROM cases)")
def jn_lateral_unnest(spark, d):
    """A row for each offence of a case, and one 'unknown' for a case without any."""
    none = F.array().cast("array<string>")
    c = cases(spark, d).select("case_id", F.when(F.col("case_id") % 6 == 0, none).otherwise(F.col("offences")).alias("o"))
    return c.select("case_id", F.explode(F.when(F.size("o") == 0, F.array(F.lit("unknown"))).otherwise(F.col("o"))).alias("offence"))


@query("WITH h AS (SELECT doc_id AS id, left(sha256(coalesce(text, '')), 16) AS hash FROM documents), k AS (SELECT id, CASE WHEN id % 5 = 0 THEN 'old' ELSE hash END AS hash FROM h WHERE id % 3 > 0) SELECT id, hash FROM h WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.id = h.id AND k.hash = h.hash)")
def vec_skip(spark, d):
    """Documents that have no vector of their present content: never had one, or another text had it."""
    h = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.left(F.sha2(F.coalesce("text", F.lit("")), 256), F.lit(16)).alias("hash"))
    known = h.where("id % 3 > 0").withColumn("hash", F.when(F.col("id") % 5 == 0, "old").otherwise(F.col("hash")))
    return details.changed(h, known)


RULES = [
    {"category": "murder", "acts": ["penal code"], "sections": ["302", "103"]}, {"category": "rape", "sections": ["376"]}, {"category": "child_sexual_offence", "acts": ["pocso"]},
    {"category": "ring_fraud", "keywords": ["ring"]},
]
STATE_SQL = " ".join(f"WHEN {k} THEN '{v}'" for k, v in case_rows.STATES.items())


@query(f"""WITH r AS (SELECT p_partkey AS k, p_size AS n, p_name, p_type FROM part)
SELECT k AS id, CASE WHEN k % 4 = 0 THEN 'ddl-' || k ELSE 'CN' || k END AS source_case_id, CASE WHEN k % 5 > 0 OR k % 4 > 0 THEN 'CN' || k END AS cnr, (k % 11)::INT AS state_code, CASE (k % 11)::INT {STATE_SQL} END AS state_name, n::INT AS district_code, CASE WHEN n % 2 = 0 THEN 2 END AS court_no,
  'DC-' || (k % 11) || '-' || n || CASE WHEN n % 2 = 0 THEN '-2' ELSE '' END AS court_code, CASE WHEN p_type = 'ECONOMY' THEN 'sessions' WHEN p_type = 'SMALL' THEN 'magistrate' ELSE 'district' END AS court_level, make_date(2018, 1 + n % 12, 5) AS filing_date, CASE WHEN n % 3 = 0 THEN 'Acquitted' ELSE 'Convicted' END AS disposition,
  CASE n % 3 WHEN 0 THEN false WHEN 1 THEN true END AS bailable, ['Indian Penal Code'] AS acts_cited, CASE WHEN n % 4 = 0 THEN ['302', '376'] ELSE [(100 + n)::VARCHAR] END AS sections_cited,
  list_concat(CASE WHEN n % 4 = 0 THEN ['murder', 'rape'] WHEN n = 3 THEN ['murder'] ELSE []::VARCHAR[] END, CASE WHEN contains(p_name, 'ring') THEN ['ring_fraud'] ELSE []::VARCHAR[] END) AS offence_categories,
  n % 4 = 0 OR n = 3 OR contains(p_name, 'ring') OR n % 5 = 1 AS is_target, CASE WHEN n % 4 = 0 THEN ['victim'] ELSE []::VARCHAR[] END AS sensitive_flags FROM r""")
def cls_row(spark, d):
    """Raw rows with loose names, numbers, dates and lists in canonical form."""
    p, k, n = table(spark, d, "part"), F.col("p_partkey"), F.col("p_size")
    s = lambda c: c.cast("string")
    no = F.lit(None).cast("string")
    row = F.create_map(
        F.lit("ddl_case_id"), F.when(k % 4 == 0, F.concat(F.lit(" ddl-"), s(k))).otherwise("nan"), F.lit("cino"), F.when(k % 5 > 0, F.concat(F.lit("CN"), s(k))).otherwise(""), F.lit("cnr"), F.when((k % 5 == 0) & (k % 4 > 0), F.concat(F.lit("CN"), s(k))).otherwise(no),
        F.lit("state_code"), F.concat(s(k % 11), F.lit(".0")), F.lit("dist_code"), s(n), F.lit("court_no"), F.when(n % 2 == 0, "2").otherwise("x"), F.lit("judge_position"), F.when(F.col("p_type") == "ECONOMY", "Additional Sessions Judge").when(F.col("p_type") == "SMALL", "JMFC").otherwise("Civil Judge"),
        F.lit("date_of_filing"), F.date_format(F.make_date(F.lit(2018), 1 + n % 12, F.lit(5)), "dd/MM/yyyy"), F.lit("disp_name"), F.when(n % 3 == 0, " Acquitted ").otherwise("Convicted"), F.lit("bailable"), F.when(n % 3 == 0, "No").when(n % 3 == 1, "true").otherwise("?"),
        F.lit("act"), F.lit("Indian Penal Code; nan"), F.lit("section"), F.when(n % 4 == 0, "302; 376").otherwise(F.concat(F.lit("IPC "), s(100 + n))), F.lit("remark"), F.when(F.contains("p_name", F.lit("ring")), F.col("p_name")).otherwise(""), F.lit("force_criminal_target"), F.when(n % 5 == 1, "1").otherwise(no),
    )
    c = case_rows.canonical(row, RULES, {"rape": ["victim"]})
    names = ["source_case_id", "cnr", "state_code", "state_name", "district_code", "court_no", "court_code", "court_level", "filing_date", "disposition", "bailable", "acts_cited", "sections_cited", "offence_categories", "is_target", "sensitive_flags"]
    return p.select(k.alias("id"), c.alias("c")).select("id", *(f"c.{x}" for x in names))


@query("""WITH m AS (SELECT p_partkey AS id, p_size % 3 AS n, p_name, p_type, p_brand, p_partkey % 2 AS t FROM part),
e AS (SELECT id, unnest([['text_artifact_type', 'judgment'], ['cnr', CASE n WHEN 0 THEN 'D' || id WHEN 1 THEN 'O' || id END], ['court_level', CASE n WHEN 0 THEN p_type ELSE 'district' END], ['state_code', CASE WHEN n = 0 THEN '9' END], ['commercial_safe', CASE n WHEN 0 THEN 'false' WHEN 1 THEN 'true' END],
  ['source_language', CASE WHEN t = 0 THEN 'hi' ELSE 'mr' END], ['target_language', CASE WHEN t = 0 THEN 'en' END], ['translation_status', CASE WHEN t = 0 THEN CASE n WHEN 1 THEN 'approved' ELSE 'pending' END END], ['redaction_status', CASE WHEN n = 2 THEN 'redacted' ELSE 'none' END], ['source_name', p_brand]]) AS kv FROM m)
SELECT id, kv[1] AS key, kv[2] AS value FROM e WHERE kv[2] IS NOT NULL""")
def txt_legalmeta(spark, d):
    """Metadata of chunks from nested documents and extractions, in order of preference."""
    p, n, k = table(spark, d, "part"), F.col("p_size") % 3, F.col("p_partkey")
    s, no = k.cast("string"), F.lit(None)
    district = F.when(n == 0, F.struct(F.concat(F.lit("D"), s).alias("cnr"), F.lit(9).alias("state_code"), F.col("p_type").alias("court_level"), F.lit(False).alias("commercial_safe")))
    document = F.to_json(F.struct(
        F.lit("judgment").alias("text_artifact_type"), district.alias("district"), F.when(n < 2, F.concat(F.lit("O"), s)).alias("cnr"), F.lit("district").alias("court_level"), F.when(n == 1, F.lit(True)).alias("commercial_safe"), F.lit("mr").alias("source_language"), F.col("p_brand").alias("source_name"),
        F.when(n == 2, F.struct(F.lit("redacted").alias("redaction_status"))).alias("redaction"), F.lit("none").alias("redaction_status"),
    ))
    extraction = F.to_json(F.struct(F.when(k % 2 == 0, F.struct(F.lit("hi").alias("source_language"), F.lit("en").alias("target_language"), F.when(n == 1, F.lit("approved")).otherwise(no).alias("qa_status"), F.lit("pending").alias("translation_status"))).alias("translation")))
    return p.select(k.alias("id"), F.explode(case_rows.chunk_metadata(document, extraction)).alias("key", "value"))


@query("WITH j AS (SELECT p_partkey AS id, p_size % 4 AS n, p_brand, p_name, p_type FROM part) SELECT id, CASE n WHEN 0 THEN 'N' || id WHEN 1 THEN 'CN' || id WHEN 2 THEN p_brand || ':' || id END AS judgment_id, CASE WHEN n % 2 = 0 THEN p_name ELSE p_type END AS title, CASE WHEN n = 3 THEN 'kept' ELSE 'new' END AS court, p_brand AS source FROM j")
def cls_judgment(spark, d):
    """Ids of judgments by fallbacks, and payloads after a second extraction."""
    p, n, k = table(spark, d, "part"), F.col("p_size") % 4, F.col("p_partkey").cast("string")
    no = F.lit(None).cast("string")
    row = F.create_map(F.lit("neutral_citation"), F.when(n == 0, F.concat(F.lit(" N"), k)).otherwise("null"), F.lit("cnr"), F.when(n == 1, F.concat(F.lit("CN"), k)).otherwise(""), F.lit("court"), F.when(n == 2, F.col("p_brand")), F.lit("case_number"), F.when(n > 1, k))
    old = F.create_map(F.lit("title"), F.col("p_type"), F.lit("court"), F.lit("kept"), F.lit("source"), F.col("p_brand"))
    new = F.create_map(F.lit("title"), F.when(n % 2 == 0, F.col("p_name")).otherwise(" "), F.lit("court"), F.when(n < 3, "new").otherwise(no))
    out = p.select(F.col("p_partkey").alias("id"), case_rows.judgment_id(row).alias("judgment_id"), case_rows.merged_payload(old, new).alias("m"))
    return out.select("id", "judgment_id", *(F.col("m")[x].alias(x) for x in ("title", "court", "source")))


@query("SELECT 'state' AS map, r_regionkey::VARCHAR AS key, r_name AS value FROM region UNION ALL SELECT 'district', n_regionkey || '|' || n_nationkey, n_name FROM nation UNION ALL SELECT 'court', c_nationkey || '|' || (c_custkey % 40), min(c_mktsegment) FROM customer GROUP BY ALL UNION ALL SELECT 'type', p_name, min(p_type) FROM part GROUP BY ALL")
def src_keymap(spark, d):
    """Code tables as one table of composite keys."""
    n, r, c, p = (table(spark, d, x) for x in ("nation", "region", "customer", "part"))
    named = r.select(F.concat(F.lit(" "), F.col("r_regionkey").cast("string"), F.lit(".0 ")).alias("code"), "r_name")
    return case_rows.code_maps({"state": (named, ["code"], "r_name"), "district": (n, ["n_regionkey", "n_nationkey"], "n_name"), "court": (c.withColumn("no", F.col("c_custkey") % 40), ["c_nationkey", "no"], "c_mktsegment"), "type": (p, ["p_name"], "p_type")})


@query("WITH c AS (SELECT c_custkey AS id, c_nationkey AS n, c_mktsegment AS m FROM customer), f AS (SELECT id, unnest([['states', array_to_string(list_sort(list_distinct([n::VARCHAR, '9'])), '|')], ['statutes', lower(m) || CASE WHEN id % 2 = 0 THEN '' ELSE '' END], ['commercial_safe', CASE WHEN id % 3 = 0 THEN 'false' ELSE 'true' END]]) AS kv FROM c) SELECT id, kv[1] AS filter, kv[2] AS applied FROM f")
def prj_filter_echo(spark, d):
    """The filters of each request as they were understood."""
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    asked = F.create_map(
        F.lit("states"), F.array(F.lit(" 9"), F.col("c_nationkey").cast("string"), F.lit("x"), F.lit("9")), F.lit("statutes"), F.array(F.concat(F.col("c_mktsegment"), F.lit(" ")), F.lit(None).cast("string"), F.lit("")),
        F.lit("sections"), F.array(F.lit(" ")), F.lit("commercial_safe"), F.when(k % 3 == 0, F.array(F.lit("False"))).when(k % 3 == 1, F.array(F.lit("yes"))),
    )
    return c.select(k.alias("id"), F.explode(filters.echo(asked, ["states"])).alias("filter", "v")).select("id", "filter", F.array_join("v", "|").alias("applied"))


@query("SELECT lower(n_name) AS category, CASE WHEN n_nationkey % 4 = 0 THEN [] ELSE [(300 + n_nationkey)::VARCHAR, 'A' || n_nationkey] END AS sections FROM nation UNION ALL SELECT lower(r_name), [r_regionkey::VARCHAR] FROM region")
def src_yaml(spark, d):
    """Rules of configuration files, one written of the nations and one of the regions."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    k = F.col("n_nationkey")
    own = F.when(k % 4 == 0, F.lit("  sections: []")).otherwise(F.concat(F.lit("  sections: ['"), (300 + k).cast("string"), F.lit("', \"A"), k.cast("string"), F.lit("\"]  ")))
    lines = F.concat(F.lit("# a rule\n- category: "), F.lower("n_name"), F.lit("\n"), own, F.lit("\n  note: x: y"))
    one = exports.export(n, [F.col("n_nationkey")], lines, None)
    two = exports.export(r, [F.col("r_regionkey")], F.concat(F.lit("- category: '"), F.lower("r_name"), F.lit("'\n  sections: ["), F.col("r_regionkey").cast("string"), F.lit("]")), None)
    return readers.rules(spark, f"{one}/*.txt").unionByName(readers.rules(spark, f"{two}/*.txt"))


@query("SELECT c_custkey::VARCHAR AS id, 'a \"' || c_name || '\",' || chr(10) || c_mktsegment AS name FROM customer")
def src_csv(spark, d):
    """A CSV file with a byte-order mark, quotes, commas and line feeds in its cells, written and read."""
    c = table(spark, d, "customer")
    name = F.concat(F.lit('a "'), "c_name", F.lit('",\n'), "c_mktsegment")
    folder = exports.export(c, [F.col("c_custkey")], exports.csv_line([F.col("c_custkey"), name]), "\ufeffid,name", most=1_000_000)
    return readers.csv(spark, folder)


@query("SELECT r_regionkey AS k, r_name AS name, NULL::INT AS more FROM region UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation")
def src_parquet(spark, d):
    """Files of differing schemas, read by name."""
    a = table(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))
    b = table(spark, d, "nation").select(F.col("n_regionkey").alias("more"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("k"))
    paths = [f.rsplit("/", 1)[0] for x in (a, b) for f in written(x, "parts").inputFiles()[:1]]
    return readers.parquet_by_name(spark, paths).select("k", "name", "more")


@query("SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 'WorksFor' WHEN 2 THEN 'related_to' END AS kind FROM part")
def gr_edge_type(spark, d):
    """Edge types by the ontology: leaked field names and absent ones go, unknown ones become related_to."""
    n = F.col("p_size") % 4
    given = F.when(n == 0, "works for").when(n == 1, "Source-Entity").when(n == 2, F.col("p_type"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), entities.edge_type(given, ["WorksFor", "related_to"], closed=False).alias("kind"))


@query("SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC)::INT AS place FROM documents")
def rd_versions(spark, d):
    """Every version of each source, newest first."""
    rows = details.children("source", [("version", table(spark, d, "documents"), F.col("doc_id"), [F.desc("doc_id")], None)])
    return rows.select("source", F.col("child").alias("doc_id"), "place")


@query("WITH o AS (SELECT doc_id, 'hi' AS target, left(sha256(coalesce(text, '')), 8) AS hash, 1 AS version FROM documents WHERE doc_id % 2 = 0), n AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'mr' ELSE 'hi' END AS target, left(sha256(coalesce(lang, '')), 8) AS hash FROM documents WHERE doc_id % 3 = 0) SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, coalesce(o.target, n.target) AS target, coalesce(n.hash, o.hash) AS hash, CASE WHEN n.hash IS NULL THEN o.version ELSE 2 END AS version FROM o FULL JOIN n ON o.doc_id = n.doc_id AND o.target = n.target")
def dml_translation(spark, d):
    """Upsert of translations by document and target language."""
    t = table(spark, d, "documents")
    sha = lambda c: F.left(F.sha2(F.coalesce(c, F.lit("")), 256), F.lit(8)).alias("hash")
    old = t.where("doc_id % 2 = 0").select("doc_id", F.lit("hi").alias("target"), sha("text"), F.lit(1).alias("version"))
    new = t.where("doc_id % 3 = 0").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "mr").otherwise("hi").alias("target"), sha("lang"), F.lit(2).alias("version"))
    return lifecycle.latest_wins(old, new, ["doc_id", "target"], [])


@query("WITH j AS (SELECT event_id AS id, CASE event_type WHEN 'view' THEN 'seed' WHEN 'click' THEN 'discover' WHEN 'error' THEN 'process' ELSE event_type END AS t, CASE WHEN event_id % 2 = 0 THEN event_id % 50 END AS v FROM events), a AS (SELECT id, t, unnest(CASE t WHEN 'seed' THEN [{'name': 'limit', 'usual': 1000}] WHEN 'discover' THEN [{'name': 'start', 'usual': 1}, {'name': 'count', 'usual': 100}] WHEN 'process' THEN [{'name': 'limit', 'usual': 100}] END) AS x, v FROM j) SELECT id, x.name AS name, CASE WHEN x.name = 'start' THEN 1 ELSE coalesce(nullif(v, 0), x.usual) END::INT AS number, NULL AS error FROM a UNION ALL SELECT id, NULL, NULL, 'unsupported job type: ' || t FROM j WHERE t NOT IN ('seed', 'discover', 'process')")
def st_batch(spark, d):
    """Batch jobs with the numbers that their handlers take; unknown kinds are refused."""
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "view", "seed").when(F.col("event_type") == "click", "discover").when(F.col("event_type") == "error", "process").otherwise(F.col("event_type"))
    v = F.when(F.col("event_id") % 2 == 0, (F.col("event_id") % 50).cast("string"))
    jobs = e.select(F.col("event_id").alias("id"), kind.alias("job_type"), F.to_json(F.struct(v.alias("limit"), v.alias("count"), F.lit("?").alias("start"))).alias("params"))
    out = lifecycle.dispatched(jobs)
    return out.where("error is null").select("id", F.explode("arguments").alias("name", "number"), "error").unionByName(out.where("error is not null").select("id", F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("number"), "error"))


@query("SELECT conv_id, string_agg('[' || k || '] [Source: ' || role || ', Page ' || turn || ']:' || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY k) AS context FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) GROUP BY 1")
def txt_context(spark, d):
    """Numbered evidence of each conversation as one text."""
    return details.numbered(table(spark, d, "conversations"), "conv_id", F.col("turn"), F.col("role"), F.col("turn"), F.col("text")).select("conv_id", "context")
