"""Seeds, evidence, gaps and traces; attempts, dead letters, source states and order links."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewright.operators import search, traces
from casewright.plans.cases import CASES_SQL, FACTS_SQL, cases, facts
from casewright.registry import query, table
from casewright.sources import readers
from casewright.streaming import lifecycle

#: Conversations ask about the parts of their number: articles with statutes, sections and issues.
ARTICLES = "qs AS (SELECT conv_id AS q, 'question ' || conv_id AS text FROM conversations GROUP BY 1), arts AS (SELECT p_partkey % 120 AS q, p_partkey AS place, p_name AS title, CASE WHEN p_size % 2 = 0 THEN ['IPC'] ELSE ['BNS', 'IPC'] END AS statutes, CASE WHEN p_size % 3 = 0 THEN []::VARCHAR[] ELSE [p_size::VARCHAR] END AS sections, [lower(p_type)] AS issues FROM part), top AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY place) AS k FROM arts QUALIFY k <= 3)"


def _articles(spark, d):
    qs = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("q")).agg(F.concat(F.lit("question "), F.first("conv_id").cast("string")).alias("text"))
    p, n = table(spark, d, "part"), F.col("p_size")
    no = F.array().cast("array<string>")
    arts = p.select((F.col("p_partkey") % 120).alias("q"), F.col("p_partkey").alias("place"), F.col("p_name").alias("title"), F.when(n % 2 == 0, F.array(F.lit("IPC"))).otherwise(F.array(F.lit("BNS"), F.lit("IPC"))).alias("statutes"), F.when(n % 3 == 0, no).otherwise(F.array(n.cast("string"))).alias("sections"), F.array(F.lower("p_type")).alias("issues"))
    return qs, arts


@query(f"WITH {ARTICLES} SELECT q, k::INT AS k, concat_ws(' ', text, title, array_to_string(statutes, ' '), CASE WHEN len(sections) > 0 THEN 'Section ' || sections[1] END, array_to_string(issues, ' ')) AS seed FROM top JOIN qs USING (q) UNION ALL SELECT q, 0, array_to_string(list_concat([text], coalesce((SELECT list(n ORDER BY f) FROM (SELECT n, min(o) AS f FROM (SELECT unnest(list_concat(list_concat([title], issues), list_concat(statutes, list_transform(sections, lambda s: 'Section ' || s)))) AS n, k * 100 + generate_subscripts(list_concat(list_concat([title], issues), list_concat(statutes, sections)), 1) AS o FROM top t WHERE t.q = qs.q) GROUP BY n)), [])), chr(10)) FROM qs")
def fus_seed(spark, d):
    """Seeds of a question by its first three articles, and (k = 0) the seed of its graph search."""
    qs, arts = _articles(spark, d)
    return traces.wiki_seeds(qs, arts).unionByName(traces.graph_seeds(qs, arts).select("q", F.lit(0).alias("k"), "seed"))


@query("WITH w AS (SELECT DISTINCT p_partkey % 50 AS q, p_partkey AS doc FROM part WHERE p_size < 12) SELECT q, o_orderkey * 10 + l_linenumber AS chunk, o_orderkey AS document, 0.75::DOUBLE AS similarity FROM w JOIN orders ON o_orderkey = doc JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' AND l_linenumber <= 2")
def fus_fetch(spark, d):
    """Chunks that articles cite, of documents that may be searched, as hits of a fixed similarity; orders are documents, their lines chunks."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document"), "l_linenumber").distinct()
    chunks = li.select((F.col("document") * 10 + F.col("l_linenumber")).alias("chunk"), "document")
    docs = table(spark, d, "orders").select(F.col("o_orderkey").alias("document"), F.when(F.col("o_orderstatus") == "P", "UPLOADED").when(F.col("o_orderstatus") == "O", "ACTIVE").otherwise("SEARCHABLE").alias("status"))
    p = table(spark, d, "part").where("p_size < 12")
    wanted = p.select((F.col("p_partkey") % 50).alias("q"), F.explode(F.array(F.col("p_partkey") * 10 + 1, F.col("p_partkey") * 10 + 2)).alias("chunk"))
    return traces.fetched(chunks, docs, wanted)


@query("WITH a AS (SELECT conv_id AS q, 'question ' || conv_id AS text, CASE WHEN conv_id % 2 = 0 THEN 'doctrine' END AS profile, count(*) FILTER (length(text) > 300) AS evidence, count(*) FILTER (role = 'system') AS approved FROM conversations GROUP BY 1) SELECT q, text, profile, evidence, approved FROM a WHERE approved = 0 AND evidence > 0 UNION ALL SELECT -event_id, event_type, NULL, 1, 0 FROM events WHERE value > 60")
def fus_gap(spark, d):
    """The log of gaps with those of today's questions: evidence, but no approved article."""
    t = table(spark, d, "conversations")
    asked = t.groupBy(F.col("conv_id").alias("q")).agg(F.count_if(F.length("text") > 300).alias("evidence"), F.count_if(F.col("role") == "system").alias("approved")).withColumns({"text": F.concat(F.lit("question "), F.col("q").cast("string")), "profile": F.when(F.col("q") % 2 == 0, "doctrine")})
    log = table(spark, d, "events").where("value > 60").select((-F.col("event_id")).alias("q"), F.col("event_type").alias("text"), F.lit(None).cast("string").alias("profile"), F.lit(1).cast("bigint").alias("evidence"), F.lit(0).cast("bigint").alias("approved"))
    return traces.with_gaps(log, asked)


STEPS = ["vector", "lexical", "graph", "rerank"]


@query(f"WITH s AS (SELECT conv_id AS run, turn, ([{', '.join(repr(s) for s in STEPS)}])[1 + (turn % 4)::INT] AS key, CASE WHEN role = 'user' THEN 'ok' ELSE 'skipped' END AS status, CASE WHEN turn % 3 <> 2 THEN length(text) END AS ms, turn AS items, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE turn < 4) SELECT run, 'question ' || run AS query, run % 5 = 0 AS cache_hit, coalesce(max(items) FILTER (key = 'vector'), 0) AS vector_results, coalesce(max(items) FILTER (key = 'lexical'), 0) AS lexical_results, coalesce(max(items) FILTER (key = 'graph'), 0) AS graph_results, coalesce(sum(ms), 0)::BIGINT AS total_latency_ms, list(k || '. ' || upper(key) || ' [' || status || ']' || coalesce(' ' || ms || ' ms', '') ORDER BY k) AS steps FROM s GROUP BY run")
def fus_trace(spark, d):
    """Runs with counts and times, recorded with their steps and read back; the first turns of a conversation are steps."""
    t = table(spark, d, "conversations").where("turn < 4")
    key = F.get(F.array(*map(F.lit, STEPS)), (F.col("turn") % 4).cast("int"))
    step = F.struct(F.col("turn"), F.struct(key.alias("key"), F.upper(key).alias("title"), F.when(F.col("role") == "user", "ok").otherwise("skipped").alias("status"), F.when(F.col("turn") % 3 != 2, F.length("text").cast("bigint")).alias("latency_ms"), F.col("turn").cast("bigint").alias("items")).alias("s"))
    runs = t.groupBy(F.col("conv_id").alias("run")).agg(F.array_sort(F.collect_list(step)).alias("x")).select("run", F.concat(F.lit("question "), F.col("run").cast("string")).alias("query"), (F.col("run") % 5 == 0).alias("cache_hit"), F.transform("x", lambda x: x["s"]).alias("steps"))
    return traces.trace(*traces.recorded(runs))


@query("WITH v AS (SELECT vec_id AS id, vec_id / 100.0 AS similarity FROM embeddings WHERE vec_id % 5 < 3), l AS (SELECT vec_id AS id FROM embeddings WHERE vec_id % 9 = 0), u AS (SELECT id FROM v UNION SELECT id FROM l) SELECT id, list_filter([CASE WHEN id IN (SELECT id FROM v) THEN 'vector' END, CASE WHEN id IN (SELECT id FROM l) THEN 'lexical' END, CASE WHEN id % 4 = 0 THEN 'graph' END, CASE WHEN id % 6 = 0 THEN 'graph_path' END, CASE WHEN id % 10 = 0 THEN 'wiki' END], lambda s: s IS NOT NULL) AS sources FROM u")
def fus_sources(spark, d):
    """Which searches found a hit, in their order; graph, paths and articles only add to hits that are there."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"))
    v, lex = e.where("id % 5 < 3").select("id", (F.col("id") / 100).alias("similarity")), e.where("id % 9 = 0").select("id", F.lit(1.0).alias("rank"))
    return search.fuse(v, lex, e.where("id % 4 = 0"), 1_000_000, paths=e.where("id % 6 = 0"), wiki=e.where("id % 10 = 0")).select("id", "sources")


COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query(f"SELECT q, id, round(similarity, 5) AS similarity FROM (SELECT b.vec_id AS q, a.vec_id AS id, {COS} AS similarity, row_number() OVER (PARTITION BY b.vec_id ORDER BY {COS} DESC, a.vec_id) AS k FROM embeddings a, embeddings b WHERE b.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND a.label % 2 = 0 AND a.vec_id % 30 > 9 AND {COS} >= 0.3) WHERE k = 1")
def topk_cache(spark, d):
    """For each question whose id is divisible by 50 the most similar live entry of its preset, if similar enough."""
    e = table(spark, d, "embeddings")
    entries = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.when(F.col("label") % 2 == 0, "balanced").otherwise("concise").alias("preset"), (F.col("vec_id") % 30).alias("expires"))
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("v"))
    return search.cached_answers(entries, asked, "balanced", F.lit(9), 0.3).select("q", "id", F.round("similarity", 5).alias("similarity"))


DUE = "q AS (SELECT event_id AS id, user_id AS case_id, (['ecourts', 'indian_kanoon', 'hldc'])[1 + (user_id % 3)::INT] AS source, ts, (event_id % 4)::INT AS attempt, (['hit', 'miss', 'rate_limited', 'captcha_required', 'http_error', 'blocked_by_policy'])[1 + (event_id % 6)::INT] AS outcome, event_type IN ('view', 'click') AS tried FROM events)"


@query(f"WITH {DUE}, d AS (SELECT * REPLACE (tried AND source <> 'hldc' AS tried), tried AS due FROM q) SELECT id, CASE WHEN NOT tried THEN CASE WHEN due THEN 'pending' ELSE 'done' END WHEN outcome = 'hit' THEN 'succeeded' WHEN outcome = 'miss' THEN 'miss' WHEN outcome IN ('captcha_required', 'blocked_by_policy') THEN 'blocked' WHEN attempt + 1 < 3 THEN 'rate_limited' ELSE 'failed' END AS status, CASE WHEN tried THEN attempt + 1 ELSE attempt END AS attempt, CASE WHEN tried AND outcome IN ('rate_limited', 'http_error') AND attempt + 1 < 3 THEN 5 * 2 ** (attempt + 1) END::BIGINT AS wait, CASE WHEN tried AND outcome = 'captcha_required' THEN 'required' END AS captcha FROM d")
def st_acquire(spark, d):
    """Queue rows after the attempts of those that were due, none of a paused source: status, count, wait and captcha of each."""
    e = table(spark, d, "events")
    pick = lambda names, n: F.get(F.array(*map(F.lit, names)), n.cast("int"))
    now = F.lit("2024-02-01").cast("timestamp")
    queue = e.select(F.col("event_id").alias("id"), F.col("user_id").alias("case_id"), pick(["ecourts", "indian_kanoon", "hldc"], F.col("user_id") % 3).alias("source"), F.when(F.col("event_type").isin("view", "click"), "pending").otherwise("done").alias("status"), (F.col("event_id") % 4).cast("int").alias("attempt"), F.lit(3).alias("most"), F.lit(None).cast("timestamp").alias("next_at"), F.lit(None).cast("string").alias("error"))
    due = queue.select("id", "source", "status", F.lit(0).alias("priority"), now.alias("due_at"))
    taken = lifecycle.acquired(due, spark.createDataFrame([("hldc",)], "source string"), now, 1_000_000_000).select("id")
    results = e.join(taken, e["event_id"] == taken["id"], "left_semi").select(F.col("event_id").alias("id"), pick(["hit", "miss", "rate_limited", "captcha_required", "http_error", "blocked_by_policy"], F.col("event_id") % 6).alias("outcome"), F.lit(None).cast("string").alias("error"))
    rows, after = lifecycle.attempted(queue, results, now)
    return after.join(rows.select("id", "captcha"), "id", "left").select("id", "status", "attempt", (F.unix_seconds("next_at") - F.unix_seconds(now)).alias("wait"), "captcha")


@query(f"WITH {DUE}, told AS (SELECT case_id, CASE WHEN source = 'ecourts' AND outcome = 'hit' THEN 'ecourts_hit' WHEN source = 'indian_kanoon' AND outcome = 'hit' THEN 'ik_hit' WHEN source = 'indian_kanoon' AND outcome = 'miss' THEN 'ik_miss' WHEN source = 'ecourts' AND outcome = 'rate_limited' THEN 'ecourts_pending' WHEN outcome = 'hit' THEN 'text_ready' WHEN outcome = 'rate_limited' THEN 'ik_pending' WHEN outcome = 'captcha_required' THEN 'ecourts_pending' WHEN outcome = 'blocked_by_policy' THEN 'blocked' ELSE 'targeted' END AS s, id FROM q WHERE outcome <> 'http_error' AND NOT (outcome = 'blocked_by_policy' AND source <> 'ecourts') AND tried AND id % 7 = 0), last AS (SELECT case_id, arg_max(s, id) AS s FROM told GROUP BY 1) SELECT c_custkey AS case_id, CASE WHEN c_custkey % 9 = 0 THEN 'dead' ELSE coalesce(s, 'targeted') END AS status FROM customer LEFT JOIN last ON case_id = c_custkey")
def st_process(spark, d):
    """States of cases after a batch of attempts; final ones stay."""
    e = table(spark, d, "events").where("event_type IN ('view', 'click') AND event_id % 7 = 0")
    pick = lambda names, n: F.get(F.array(*map(F.lit, names)), n.cast("int"))
    tries = e.select(F.col("user_id").alias("case_id"), pick(["ecourts", "indian_kanoon", "hldc"], F.col("user_id") % 3).alias("source"), pick(["hit", "miss", "rate_limited", "captcha_required", "http_error", "blocked_by_policy"], F.col("event_id") % 6).alias("outcome"), F.col("event_id").alias("at"))
    known = table(spark, d, "customer").select(F.col("c_custkey").alias("case_id"), F.when(F.col("c_custkey") % 9 == 0, "dead").otherwise("targeted").alias("status"))
    return lifecycle.after_attempts(known, tries)


@query("WITH f AS (SELECT user_id % 40 AS external_id, 'src' || user_id % 3 AS source, event_type || event_id AS error, ts, event_id FROM events WHERE event_type = 'error'), l AS (SELECT external_id, source, arg_max(error, ts) AS error, max(ts) AS failed_at, count(*) AS n FROM f GROUP BY ALL), k AS (SELECT s_suppkey AS external_id, 'src' || s_suppkey % 3 AS source, 'old' AS error, TIMESTAMP '2023-01-01' AS failed_at, s_suppkey % 4 AS retry_count FROM supplier) SELECT external_id, source, coalesce(l.error, k.error) AS error, coalesce(l.failed_at, k.failed_at) AS failed_at, CASE WHEN k.retry_count IS NULL THEN n - 1 ELSE k.retry_count + coalesce(n, 0) END AS retry_count FROM k FULL JOIN l USING (external_id, source)")
def snk_dlq(spark, d):
    """Dead letters after a batch of failures: one row a key, with its retries and its newest error."""
    e = table(spark, d, "events").where("event_type = 'error'")
    failed = e.select((F.col("user_id") % 40).alias("external_id"), F.concat(F.lit("src"), (F.col("user_id") % 3).cast("string")).alias("source"), F.concat("event_type", F.col("event_id").cast("string")).alias("error"), F.col("ts").alias("failed_at"))
    s = F.col("s_suppkey")
    known = table(spark, d, "supplier").select(s.alias("external_id"), F.concat(F.lit("src"), (s % 3).cast("string")).alias("source"), F.lit("old").alias("error"), F.expr("TIMESTAMP_NTZ '2023-01-01'").alias("failed_at"), (s % 4).alias("retry_count"))
    return lifecycle.dead_letters(known, failed)


@query(f"WITH {CASES_SQL}, now AS (SELECT max(ts) AS t FROM events) SELECT 'cases' AS part, source_name AS source, license_classification AS kind, count(*) AS n, count(*) FILTER (has_text) AS good FROM cases GROUP BY ALL UNION ALL SELECT 'queue', 'src' || user_id % 2, event_type, count(*), 0 FROM events GROUP BY ALL UNION ALL SELECT 'attempts', 'src' || user_id % 2, event_type, count(*), 0 FROM events, now WHERE ts > t - INTERVAL 24 HOUR GROUP BY ALL UNION ALL SELECT 'artifacts', 'src' || l_suppkey % 2, l_returnflag, count(*), count(*) FILTER (l_discount < 0.05) FROM lineitem GROUP BY ALL")
def agg_source_status(spark, d):
    """Sources by cases and licence, by queue, by the attempts of the last day, and by artifacts."""
    e = table(spark, d, "events")
    newest = e.agg(F.max("ts").alias("t"))  # one row
    src = lambda c: F.concat(F.lit("src"), (F.col(c) % 2).cast("string")).alias("source")
    zero = F.lit(0).cast("bigint").alias("good")
    own = cases(spark, d).groupBy(F.col("source_name").alias("source"), F.col("license_classification").alias("kind")).agg(F.count("*").alias("n"), F.count_if("has_text").alias("good")).select(F.lit("cases").alias("part"), "source", "kind", "n", "good")
    queue = e.groupBy(src("user_id"), F.col("event_type").alias("kind")).agg(F.count("*").alias("n")).select(F.lit("queue").alias("part"), "source", "kind", "n", zero)
    late = e.crossJoin(F.broadcast(newest)).where(F.expr("ts > t - INTERVAL 24 HOURS")).groupBy(src("user_id"), F.col("event_type").alias("kind")).agg(F.count("*").alias("n")).select(F.lit("attempts").alias("part"), "source", "kind", "n", zero)
    arts = table(spark, d, "lineitem").groupBy(src("l_suppkey"), F.col("l_returnflag").alias("kind")).agg(F.count("*").alias("n"), F.count_if(F.col("l_discount") < 0.05).alias("good")).select(F.lit("artifacts").alias("part"), "source", "kind", "n", "good")
    return own.unionByName(queue).unionByName(late).unionByName(arts)


@query(f"WITH {FACTS_SQL}, now AS (SELECT max(ts) AS t FROM events) SELECT 'source' AS part, source_name AS source, license_classification || ' ' || commercial_safe::VARCHAR AS state, sum(metadata_cases)::BIGINT AS n FROM facts GROUP BY ALL UNION ALL SELECT 'queue', 'src' || user_id % 5, event_type, count(*) FROM events GROUP BY ALL UNION ALL SELECT 'attempts', 'src' || user_id % 5, event_type, count(*) FROM events, now WHERE ts >= t - INTERVAL 7 DAY GROUP BY ALL UNION ALL SELECT * FROM (SELECT 'quota', 'src' || user_id % 5, strftime(ts, '%Y-%m-%d'), count(*) FROM events GROUP BY ALL ORDER BY 3 DESC, 2 LIMIT 50)")
def agg_source_perf(spark, d):
    """Sources by facts with licence, by queue, by the attempts of seven days, and the newest fifty days of their quotas."""
    e = table(spark, d, "events")
    newest = e.agg(F.max("ts").alias("t"))  # one row
    source = F.concat(F.lit("src"), F.col("user_id") % 5).alias("source")
    told = lambda part, rows: rows.select(F.lit(part).alias("part"), "source", "state", "n")
    by_fact = facts(spark, d).groupBy(F.col("source_name").alias("source"), F.concat_ws(" ", "license_classification", F.col("commercial_safe").cast("string")).alias("state")).agg(F.sum("metadata_cases").alias("n"))
    queue = e.groupBy(source, F.col("event_type").alias("state")).agg(F.count("*").alias("n"))
    late = e.crossJoin(F.broadcast(newest)).where(F.expr("ts >= t - INTERVAL 7 DAYS")).groupBy(source, F.col("event_type").alias("state")).agg(F.count("*").alias("n"))
    quota = e.groupBy(source, F.date_format("ts", "yyyy-MM-dd").alias("state")).agg(F.count("*").alias("n")).orderBy(F.desc("state"), "source").limit(50)
    return told("source", by_fact).unionByName(told("queue", queue)).unionByName(told("attempts", late)).unionByName(told("quota", quota))


HISTORY = """<h1>Case</h1><table><tr><td>1</td><td>{a}-0{m}-2018</td><td><a href="/view_order?id={k}&x=1">Order {k}</a></td></tr><tr><td>2</td><td>0{m}/11/19</td><td><a href="#" onclick="displayPdf('x', 'o{k}.pdf')">{w}</a></td></tr><tr><td><a href='/view_order?id={k}&x=1'>again</a></td></tr></table><p><a href="/home">home</a> <a href="z{k}.PDF"> </a></p>"""


@query("WITH p AS (SELECT p_partkey AS id, 1 + p_size % 9 AS m, p_size % 2 = 0 AS j FROM part) SELECT id AS page_id, r.ref AS ref, r.d AS order_date, r.l AS label, r.j AS is_judgment, r.c AS chosen FROM (SELECT id, unnest([{'ref': '/view_order?id=' || id || '&x=1', 'd': '12-0' || m || '-2018', 'l': 'Order ' || id, 'j': false, 'c': false}, {'ref': 'o' || id || '.pdf', 'd': '0' || m || '/11/19', 'l': CASE WHEN j THEN 'Judgment' ELSE 'Daily' END, 'j': j, 'c': true}, {'ref': 'z' || id || '.PDF', 'd': NULL, 'l': 'order', 'j': false, 'c': false}]) AS r FROM p)")
def src_html_orders(spark, d):
    """Order files of case pages with dates and wording, and the one that is shown."""
    html, parts = F.lit(HISTORY), table(spark, d, "part")
    for mark, value in (("{k}", F.col("p_partkey").cast("string")), ("{m}", (1 + F.col("p_size") % 9).cast("string")), ("{a}", F.lit("12")), ("{w}", F.when(F.col("p_size") % 2 == 0, "Judgment").otherwise("Daily"))):
        html = F.replace(html, F.lit(mark), value)
    links = readers.order_links(parts.select(F.col("p_partkey").alias("page_id"), html.alias("html")))
    best = readers.chosen_orders(links).select("page_id", "ref", F.lit(True).alias("chosen"))
    return links.join(best, ["page_id", "ref"], "left").select("page_id", "ref", "order_date", "label", "is_judgment", F.coalesce("chosen", F.lit(False)).alias("chosen"))
