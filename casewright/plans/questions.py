"""Questions, scopes, languages and labels over conversations and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewright.functions import classify, language, scopes, text
from casewright.operators import conversations, names
from casewright.registry import query, table

#: Messages as questions about cases: the turn picks a wording, ids fill it.
ASKED_SQL = """asked AS (SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN 'What happened in FIR No. ' || (100 + conv_id) || ' of 2020?' WHEN 1 THEN 'Compare cases ' || (100 + conv_id) || ' and ' || (200 + conv_id) || '/2021' WHEN 2 THEN 'Who was the accused'
  WHEN 3 THEN 'List the cases' WHEN 4 THEN 'What is the difference?' ELSE 'Crime ' || (300 + conv_id) || '-2019 and case ' || (300 + conv_id) END AS q FROM conversations)"""


def _asked(spark, d):
    n, c = F.col("turn") % 6, lambda k: (F.col("conv_id") + k).cast("string")
    t = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    q = F.when(n == 0, t("What happened in FIR No. ", c(100), " of 2020?")).when(n == 1, t("Compare cases ", c(100), " and ", c(200), "/2021")).when(n == 2, "Who was the accused").when(n == 3, "List the cases").when(n == 4, "What is the difference?").otherwise(t("Crime ", c(300), "-2019 and case ", c(300)))
    return table(spark, d, "conversations").select("conv_id", "turn", q.alias("q"))


@query(f"WITH {ASKED_SQL} SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN [(100 + conv_id)::VARCHAR, (100 + conv_id) || '/2020'] WHEN 1 THEN [(200 + conv_id) || '/2021', (100 + conv_id)::VARCHAR] WHEN 5 THEN [(300 + conv_id) || '/2019', (300 + conv_id)::VARCHAR] ELSE []::VARCHAR[] END AS scopes FROM asked")
def txt_scopes(spark, d):
    """Case references of each question."""
    return _asked(spark, d).select("conv_id", "turn", scopes.extracted(F.col("q")).alias("scopes"))


@query("SELECT conv_id, turn, (100 + conv_id) || '/2020' AS scope FROM conversations")
def txt_scope_norm(spark, d):
    """Several wordings of one case come to one form."""
    n, k = F.col("turn") % 4, (F.col("conv_id") + 100).cast("string")
    c = F.when(n == 0, F.concat(F.lit("FIR No. "), k, F.lit(" of 2020"))).when(n == 1, F.concat(F.lit("case number "), k, F.lit("-2020"))).when(n == 2, F.concat(k, F.lit(" / 2020 "))).otherwise(F.concat(F.lit("cr. no "), k, F.lit(" OF 2020")))
    return table(spark, d, "conversations").select("conv_id", "turn", text.case_scope(c).alias("scope"))


@query("SELECT conv_id, turn, [(100 + conv_id) || '/2020', (500 + turn)::VARCHAR] AS scopes FROM conversations")
def txt_scope_merge(spark, d):
    """The most specific scope of each key, in first-seen order."""
    k, m = (F.col("conv_id") + 100).cast("string"), (F.col("turn") + 500).cast("string")
    return table(spark, d, "conversations").select("conv_id", "turn", scopes.merged(F.array(k, m, F.concat(k, F.lit("/2020")), F.lit(" "), k)).alias("scopes"))


@query("SELECT c_custkey AS id, (c_custkey % 3 = 0 OR c_custkey % 2 = 1) AND c_custkey % 5 > 0 AS hit FROM customer")
def txt_scope_match(spark, d):
    """Equal, or of one key where one side lacks the rest."""
    k = F.col("c_custkey")
    signal = F.concat(F.when(k % 5 > 0, k).otherwise(k + 1).cast("string"), F.when(k % 2 == 1, F.lit("")).when(k % 3 == 0, F.lit("/20")).otherwise(F.lit("/21")))
    return table(spark, d, "customer").select(k.alias("id"), text.scopes_match(signal, F.concat(k.cast("string"), F.lit("/20"))).alias("hit"))


@query(f"""WITH {ASKED_SQL} SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN 'explicit_single' WHEN 1 THEN 'explicit_multi' WHEN 5 THEN 'explicit_single' WHEN 2 THEN CASE WHEN conv_id % 2 = 0 THEN 'global' ELSE 'follow_up_single' END WHEN 4 THEN CASE WHEN conv_id % 2 = 0 THEN 'follow_up_multi' ELSE 'global' END ELSE 'global' END AS source, turn % 6 = 2 AND conv_id % 2 = 0 AS clarify FROM asked""")
def cls_scope(spark, d):
    """Whether a question names cases, follows up on one or several, must be clarified, or is global."""
    even = F.col("conv_id") % 2 == 0
    s = scopes.resolved(F.col("q"), scopes.extracted(F.col("q")), F.lit("7/2001"), F.when(even, F.array(F.lit("7/2001"), F.lit("8/2002"))).otherwise(F.array().cast("array<string>")), F.when(even, "multi").otherwise("single"))
    return _asked(spark, d).select("conv_id", "turn", s.alias("s")).select("conv_id", "turn", "s.source", "s.clarify")


#: The same wordings in another order in each conversation.
TALK = "(turn * turn + conv_id * 7 + turn * (conv_id % 5)) % 6"
TALK_SQL = f"""WITH RECURSIVE r AS (SELECT conv_id, turn, {TALK} AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
f AS (SELECT DISTINCT conv_id, NULL::BIGINT AS turn, 0::BIGINT AS k, NULL::VARCHAR AS pinned, NULL::VARCHAR[] AS multi, NULL::VARCHAR AS mode, NULL::VARCHAR AS source FROM r
  UNION ALL SELECT r.conv_id, r.turn, r.k, CASE n WHEN 0 THEN (100 + r.conv_id) || '/2020' WHEN 5 THEN (300 + r.conv_id) || '/2019' ELSE f.pinned END,
    CASE WHEN n IN (0, 5) THEN NULL WHEN n = 1 THEN [(200 + r.conv_id) || '/2021', (100 + r.conv_id)::VARCHAR] ELSE f.multi END,
    CASE WHEN n IN (0, 5) THEN 'single' WHEN n = 1 OR (n = 4 AND f.mode = 'multi') THEN 'multi' WHEN n = 2 AND f.mode <> 'multi' AND f.pinned IS NOT NULL THEN 'single' ELSE 'global' END,
    CASE WHEN n IN (0, 5) THEN 'explicit_single' WHEN n = 1 THEN 'explicit_multi' WHEN n = 4 AND f.mode = 'multi' THEN 'follow_up_multi' WHEN n = 2 AND f.mode <> 'multi' AND f.pinned IS NOT NULL THEN 'follow_up_single' ELSE 'global' END
  FROM f JOIN r ON r.conv_id = f.conv_id AND r.k = f.k + 1)
SELECT conv_id, turn, pinned AS case_reference, coalesce(len(multi), 0)::INT AS several, mode AS last_mode, source FROM f WHERE k > 0"""


@query(TALK_SQL)
def cls_pin(spark, d):
    """What each conversation has pinned after each of its questions."""
    n, c = F.expr(TALK), lambda k: (F.col("conv_id") + k).cast("string")
    t = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    q = F.when(n == 0, t("What happened in FIR No. ", c(100), " of 2020?")).when(n == 1, t("Compare cases ", c(100), " and ", c(200), "/2021")).when(n == 2, "Who was the accused").when(n == 3, "List the cases").when(n == 4, "What is the difference?").otherwise(t("Crime ", c(300), "-2019 and case ", c(300)))
    p = conversations.pinned(table(spark, d, "conversations").select("conv_id", "turn"), q)
    return p.select("conv_id", "turn", "pin.case_reference", F.coalesce(F.size("pin.last_multi"), F.lit(0)).alias("several"), "pin.last_mode", F.col("pin.last_source").alias("source"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 'hi' WHEN doc_id % 4 = 2 THEN 'en' ELSE lang END AS source FROM documents WHERE lang IS NOT NULL")
def txt_lang_norm(spark, d):
    """Names, regions and scripts of languages."""
    n = F.col("doc_id") % 4
    stated = F.when(n == 0, F.concat(F.upper("lang"), F.lit("_IN"))).when(n == 1, F.concat(F.lit(" "), "lang")).when(n == 2, "unknown").otherwise("English")
    script = F.when(n == 3, "Devanagari").when(n == 2, F.lit(None)).when(F.col("lang") == "en", "latin")
    return table(spark, d, "documents").where("lang IS NOT NULL").select("doc_id", language.source_language(stated, script).alias("source"))


@query("SELECT doc_id, list_filter(['Erly', 'Tion be', 'a', 'than'], lambda t: contains(lower(text), lower(t))) AS terms FROM documents WHERE text IS NOT NULL")
def txt_glossary(spark, d):
    """Glossary terms of each whole text."""
    terms = spark.createDataFrame([("than",), (" Erly",), ("Tion be",), ("",), ("a",)], "source string")
    docs = table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), "text")
    return names.found_names(docs, terms.select(F.btrim("source").alias("name"))).select(F.col("id").alias("doc_id"), F.col("names").alias("terms"))


@query("SELECT doc_id, CASE WHEN lang = 'en' OR doc_id % 7 = 0 THEN 'approved' WHEN doc_id % 10 < 7 THEN 'needs_review' ELSE 'pending' END AS qa FROM documents WHERE lang IS NOT NULL")
def txt_tr_qa(spark, d):
    key = F.col("doc_id")
    return table(spark, d, "documents").where("lang IS NOT NULL").select("doc_id", language.translation_status(F.col("lang"), F.lit("en"), F.when(key % 7 == 0, "identity").otherwise("model"), (key % 10) / 10).alias("qa"))


@query(r"SELECT conv_id, turn, CASE WHEN length(trim(text, E' \t\n')) < 10 THEN 0.0 ELSE round(least(1.0, length(trim(text, E' \t\n')) / 200), 6) END AS confidence FROM conversations WHERE regexp_full_match(text, '[ -~\n\t]*')")
def txt_page_conf(spark, d):
    """Confidence of a page's own text; plain ASCII is printable throughout."""
    plain = table(spark, d, "conversations").where(F.col("text").rlike(r"\A[ -~\n\t]*\z"))
    return plain.select("conv_id", "turn", F.round(language.page_confidence(F.col("text")), 6).alias("confidence"))


@query("""WITH q AS (SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 'Section 302A of the IPC before the sessions court, per eCourts' WHEN 1 THEN 'bnss search and seizure with a seal' WHEN 2 THEN 'ndps section 50 fsl report, magistrate' WHEN 3 THEN 'hostile witness in a trial court (HLDC)' ELSE 'nothing' END AS q FROM conversations)
SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 'IPC' WHEN 1 THEN 'BNS' WHEN 2 THEN 'NDPS' END AS statute, CASE turn % 5 WHEN 0 THEN '302a' WHEN 2 THEN '50' END AS section, CASE turn % 5 WHEN 0 THEN 'sessions' WHEN 2 THEN 'magistrate' WHEN 3 THEN 'district' END AS court_level, CASE turn % 5 WHEN 0 THEN 'ecourts' WHEN 3 THEN 'hldc' END AS source_name,
CASE turn % 5 WHEN 1 THEN ['search_and_seizure', 'chain_of_custody'] WHEN 2 THEN ['section_50_ndps', 'forensic_evidence'] WHEN 3 THEN ['hostile_witness'] ELSE []::VARCHAR[] END AS tags FROM q""")
def cls_infer(spark, d):
    """Statute, section, court level, source and issue tags of a question."""
    n = F.col("turn") % 5
    q = F.when(n == 0, "Section 302A of the IPC before the sessions court, per eCourts").when(n == 1, "bnss search and seizure with a seal").when(n == 2, "ndps section 50 fsl report, magistrate").when(n == 3, "hostile witness in a trial court (HLDC)").otherwise("nothing")
    return table(spark, d, "conversations").select("conv_id", "turn", classify.inferred(q).alias("i")).select("conv_id", "turn", "i.*")


@query("SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 OR p_size % 6 = 1 THEN 'RESTRICTED' ELSE 'INTERNAL' END AS level FROM part")
def cls_sensitivity(spark, d):
    """Restricted by category or by any flag."""
    cats = F.array(F.when(F.col("p_size") % 4 == 0, "rape").otherwise("theft"))
    flags = F.when(F.col("p_size") % 6 == 1, F.array(F.lit("minor_identity"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), classify.sensitivity(cats, flags, ["rape", "child_sexual_offence"]).alias("level"))


@query("""WITH o AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 'hit' WHEN 2 THEN 'miss' WHEN 3 THEN 'rate_limited' WHEN 4 THEN 'captcha_failed' WHEN 5 THEN 'http_error' ELSE 'other' END AS o, CASE l_returnflag WHEN 'R' THEN 'ecourts' WHEN 'A' THEN 'indian_kanoon' ELSE 'hldc' END AS s FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN o = 'hit' THEN CASE s WHEN 'ecourts' THEN 'ecourts_hit' WHEN 'indian_kanoon' THEN 'ik_hit' ELSE 'text_ready' END WHEN o = 'miss' AND s = 'indian_kanoon' THEN 'ik_miss' WHEN o = 'rate_limited' THEN CASE s WHEN 'ecourts' THEN 'ecourts_pending' ELSE 'ik_pending' END WHEN o = 'captcha_failed' THEN 'blocked' WHEN o = 'http_error' THEN 'dead' ELSE 'targeted' END AS status FROM o""")
def cls_status(spark, d):
    """Case status of each attempt's outcome."""
    k, flag = F.col("l_linenumber"), F.col("l_returnflag")
    outcome = F.when(k == 1, "hit").when(k == 2, "miss").when(k == 3, "rate_limited").when(k == 4, "captcha_failed").when(k == 5, "http_error").otherwise("other")
    source = F.when(flag == "R", "ecourts").when(flag == "A", "indian_kanoon").otherwise("hldc")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", classify.case_status(source, outcome).alias("status"))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 0.98::DOUBLE ELSE 0.5 END AS confidence, p_size % 2 = 0 AS accepted FROM part")
def cls_candidate(spark, d):
    """A candidate page is sure if the case number stands in its body."""
    number = F.concat(F.lit("CN"), F.lpad(F.col("p_partkey").cast("string"), 8, "0"))
    body = F.concat(F.lit("Case "), F.when(F.col("p_size") % 2 == 0, F.lower(number)).otherwise("unknown"), F.lit("."))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), classify.candidate(body, number).alias("c")).select("id", "c.*")


@query("SELECT p_partkey AS id, CASE WHEN p_size % 3 < 2 THEN [(p_size + 100)::VARCHAR, (p_size + 200) || 'A'] ELSE ['THEFT ACT'] END AS sections FROM part")
def cls_norm(spark, d):
    n = F.col("p_size") % 3
    a, b = (F.col("p_size") + 100).cast("string"), F.concat((F.col("p_size") + 200).cast("string"), F.lit("a"))
    listed = F.when(n == 0, F.concat(a, F.lit("; "), b, F.lit(", nan"))).when(n == 1, F.concat(F.lit("IPC "), a, F.lit(" r/w "), b)).otherwise("Theft Act|none")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), classify.sections(listed).alias("sections"))


@query("SELECT p_partkey AS id, p_size AS n, CASE p_size % 3 WHEN 0 THEN true WHEN 1 THEN false END AS flag, CASE WHEN p_size % 5 < 4 THEN make_date(2018, 1 + p_size % 12, 1 + p_size % 28) END AS day FROM part")
def cls_parse(spark, d):
    """Loose integers, tri-state booleans and dates in four formats."""
    n = F.col("p_size")
    day = F.make_date(F.lit(2018), 1 + n % 12, 1 + n % 28)
    as_text = F.when(n % 5 == 0, F.date_format(day, "yyyy-MM-dd")).when(n % 5 == 1, F.concat(F.date_format(day, "dd-MM-yyyy"), F.lit(" 10:00"))).when(n % 5 == 2, F.date_format(day, "dd/MM/yyyy")).when(n % 5 == 3, F.date_format(day, "yyyy/MM/dd")).otherwise("soon")
    flag = F.when(n % 3 == 0, "Yes").when(n % 3 == 1, " F").otherwise("maybe")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), classify.loose_int(F.concat(n.cast("string"), F.lit(".0"))).alias("n"), classify.loose_bool(flag).alias("flag"), classify.loose_date(as_text).alias("day"))


@query("SELECT p_partkey AS id, list_filter([CASE WHEN p_size % 2 = 0 THEN 'murder' END, CASE WHEN p_size % 3 = 0 THEN 'kidnap' END, CASE WHEN p_name LIKE '%widget%' THEN 'cheque' END], lambda x: x IS NOT NULL) AS categories FROM part")
def cls_offence(spark, d):
    """Offence categories in the order of the rules."""
    n = F.col("p_size")
    found = F.array_compact(F.array(F.when(n % 2 == 0, "302"), F.when(n % 3 == 0, "363"), F.lit("999")))
    rules = [{"category": "murder", "sections": ["302"]}, {"category": "kidnap", "acts": ["penal"], "sections": ["363", "364"]}, {"category": "cheque", "keywords": ["Widget"]}]
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), classify.offences(found, F.lit("Indian Penal Code"), F.col("p_name"), rules).alias("categories"))


@query("SELECT conv_id, turn, turn % 3 = 0 AS district FROM conversations")
def cls_district_q(spark, d):
    """Questions for the analytics route."""
    n = F.col("turn") % 3
    q = F.when(n == 0, "How many cases by district in the eCourts metadata?").when(n == 1, "Cite a sample judgment from each district court, how many?").otherwise("What is the doctrine?")
    return table(spark, d, "conversations").select("conv_id", "turn", (classify.question_plan(q)["route"] == "district_analytics").alias("district"))
