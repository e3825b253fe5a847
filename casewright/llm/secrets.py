"""Secret scan, DataFrame functions and Spark's own forest only.

Candidates are long runs of token characters with a digit.  Each is described
by its length, kinds of characters and changes between them, coverage by
dictionary words, the path of its document and the words around it; a random
forest trained from labelled findings tells secrets from other identifiers.

Defined cases: null or blank text has no candidates; a null path is empty;
repeated rows are scanned as often as they occur; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.llm.storage import materialize

BLANKS = "[\\x20\\x09-\\x0D]+"
RUN = "[A-Za-z0-9+/_-]{12,}={0,2}"
KEYS = "key|token|secret|passw|pwd|api|auth|bearer|credential|private|access"
OTHERS = "commit|sha|hash|uuid|md5|checksum|digest|build|version|revision|etag|order|invoice|phone|call|card|account|tracking|isbn|trace|request|sample|example|placeholder|dummy|doc"
CALM = "test|example|sample|fixture|mock|doc|vendor|lock|node_modules|dist|min"
#: Words that dictionary coverage counts; longer ones first.
DICTIONARY = "placeholder credential development production password username security template document example request account service message version content storage default session private project library testing address comment context feature install network payload release company please change secret public client server config number string sample insert update delete select create script system object module export import online mobile dummy token value print input class field table index model image local admin login email world hello world super title https order build cache check click error event fetch first group label level limit other param phone point query ready reset route scope share shift short start state store style theme track user name test file path code data host port http html json text true null your here this that with from page view item list type auth hash main node time date key api app url www com org the and for not new old set get".split()
#: Openings of tokens that issuers mark.
PREFIXES = "^(AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|sk_live_|rk_live_|sk-|xox[abprs]-|AIza|eyJ|SG|npm_|pypi-)"
FEATURES = ["length", "digit_share", "upper_share", "lower_share", "other_share", "turns", "case_turns", "distinct_share", "vowel_share", "hex", "digits_only", "covered", "prefix", "key_near", "other_near", "assigned", "quoted", "calm_path", "grouped"]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """(doc, place, run, value, around, glue, path): each candidate of each whole text."""
    words = F.split(F.col(text_col), BLANKS, -1)
    worth = docs.where(F.col(text_col).rlike(RUN)).select(F.col(id_col).alias("doc"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"), words.alias("words"))
    places = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get("words", i).rlike(RUN) & F.get("words", i).rlike("[0-9]"))
    found = worth.withColumn("places", places)
    # only the neighbours of candidates leave the array
    near = F.transform("places", lambda i: F.struct(i.alias("place"), F.get("words", i).alias("word"), F.array_join(F.array(F.when(i > 1, F.get("words", i - 2)), F.when(i > 0, F.get("words", i - 1)), F.get("words", i + 1)), " ").alias("around"), F.when(i > 0, F.get("words", i - 1)).alias("before")))
    # an outer explode: the filter that Spark infers for the inner one would split the text anew for each word
    one = found.select("doc", "path", F.explode_outer(near).alias("x")).where("x.word is not null").select("doc", "path", "x.*")
    runs = one.select("doc", "path", "place", "around", "before", "word", F.posexplode(F.regexp_extract_all("word", F.lit(f"({RUN})"), 1)).alias("run", "value"))
    glue = F.concat_ws(" ", F.coalesce("before", F.lit("")), F.col("word").substr(F.lit(1), F.position(F.col("value"), F.col("word")) - 1))
    return runs.where(F.col("value").rlike("[0-9]")).select("doc", "place", "run", "value", "around", glue.alias("glue"), "path")


def described(found: DataFrame) -> DataFrame:
    """``found`` with FEATURES, each a double."""
    v, n = F.col("value"), F.char_length("value")
    low = F.lower(v)
    near = F.lower(F.concat_ws(" ", "around", "glue"))

    def count(pattern: str) -> Column:
        return F.regexp_count(v, F.lit(pattern))

    columns = {
        "length": n, "digit_share": count("[0-9]") / n, "upper_share": count("[A-Z]") / n, "lower_share": count("[a-z]") / n, "other_share": count("[^A-Za-z0-9]") / n,
        "turns": (count("[A-Za-z](?=[0-9])") + count("[0-9](?=[A-Za-z])")) / n, "case_turns": (count("[a-z](?=[A-Z])") + count("[A-Z](?=[a-z])")) / n,
        "distinct_share": F.size(F.array_distinct(F.split(v, ""))) / n, "vowel_share": F.regexp_count(low, F.lit("[aeiou]")) / n,
        "hex": v.rlike("^([0-9a-f]+|[0-9A-F]+)$").cast("double"), "digits_only": v.rlike("^[0-9]+$").cast("double"),
        "covered": F.lit(1.0) - F.char_length(F.regexp_replace(low, F.lit("|".join(DICTIONARY)), F.lit(""))) / n,
        "prefix": v.rlike(PREFIXES).cast("double"), "key_near": near.rlike(KEYS).cast("double"), "other_near": near.rlike(OTHERS).cast("double"),
        "assigned": F.col("glue").rlike("[=:]\\s*[\"'`]?$").cast("double"), "quoted": F.col("glue").rlike("[\"'`]$").cast("double"),
        "calm_path": F.lower("path").rlike(CALM).cast("double"), "grouped": v.rlike("^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-").cast("double"),
    }
    return found.withColumns({k: c.cast("double") for k, c in columns.items()})


def made_findings(spark: SparkSession, rows: int = 6000, seed: int = 3) -> DataFrame:
    """Labelled findings: (value, around, glue, path, label), the same for the same arguments."""
    base = spark.range(0, rows, 1, 4).select(F.col("id").alias("k"), *(F.sha2(F.concat_ws("/", F.lit(seed), F.lit(j), "id"), 256).alias(f"h{j}") for j in range(4)))

    def pick(options: list[str], salt: int) -> Column:
        return F.get(F.array(*(F.lit(o) for o in options)), F.pmod(F.xxhash64("k", F.lit(salt)), F.lit(len(options))).cast("int"))

    def number(salt: int, lo: int, hi: int) -> Column:
        return (F.pmod(F.xxhash64("k", F.lit(salt)), F.lit(hi - lo + 1)) + lo).cast("int")

    b64 = F.regexp_replace(F.base64(F.unhex(F.concat("h0", "h1"))), "[+/=]", "x")
    digits = F.concat(F.conv(F.substring("h2", 1, 12), 16, 10), F.conv(F.substring("h3", 1, 12), 16, 10))
    words = F.concat_ws("_", pick(DICTIONARY, 11), pick(DICTIONARY, 12), pick(DICTIONARY, 13), F.substring(digits, 1, 2))
    kind = F.pmod(F.xxhash64("k", F.lit(seed)), F.lit(14))
    secret = kind < 7
    value = (
        F.when(kind == 0, F.substring("h0", 1, 40)).when(kind == 1, F.col("h0").substr(F.lit(1), number(21, 24, 64))).when(kind == 2, b64.substr(F.lit(1), number(22, 20, 64)))
        .when(kind == 3, F.concat(F.lit("AKIA"), F.upper(F.substring(b64, 1, 16)))).when(kind == 4, F.concat(pick(["ghp_", "sk_live_", "xoxb-", "AIza", "glpat-", "npm_"], 23), F.substring(b64, 1, 36)))
        .when(kind == 5, F.substring("h0", 1, 32)).when(kind == 6, b64.substr(F.lit(5), number(24, 14, 30)))
        .when(kind == 7, F.substring(digits, 1, 16)).when(kind == 8, words).when(kind == 9, F.substring("h1", 1, 40)).when(kind == 10, F.concat_ws("-", F.substring("h1", 1, 8), F.substring("h1", 9, 4), F.substring("h1", 13, 4), F.substring("h1", 17, 4), F.substring("h1", 21, 12)))
        .when(kind == 11, F.concat(pick(["your_api_key_here_", "example_token_value_", "changeme_password_", "test_secret_key_"], 25), F.substring(digits, 1, 3)))
        .when(kind == 12, F.substring(digits, 1, 13)).otherwise(F.concat(F.regexp_replace(F.translate(F.substring("h3", 1, 24), "0123456789", "aeioustnrl"), "[^a-z]", "e"), F.substring(digits, 1, 2)))
    )
    key = pick(["token", "api_key", "secret", "password", "access_key", "auth_token", "client_secret", "private_key", "bearer"], 31)
    plain = pick(["commit", "sha", "order", "invoice", "call", "the", "card", "tracking", "uuid", "build", "of", "request"], 32)
    sign, quote = pick([" =", " =", ":", "="], 33), pick(['"', '"', "'", ""], 34)
    close = F.when(secret | (kind == 11), F.concat(key, sign)).when(kind.isin(7, 12, 13), plain).otherwise(F.concat(plain, pick(["", ":", " =", ""], 35)))
    before = F.when(secret | (kind == 11), F.concat_ws(" ", F.regexp_extract(sign, "[=:]", 0), quote)).otherwise(F.concat_ws(" ", F.regexp_extract(close, "[=:]?$", 0), F.lit("")))
    path = F.when((kind == 11) | (number(36, 0, 9) == 0), pick(["tests/fixtures/a.json", "docs/example.md", "sample/config.yml"], 37)).otherwise(pick(["src/app.py", "config/prod.env", "notes.txt", "src0", "deploy.sh", ""], 38))
    return base.select(value.alias("value"), F.concat_ws(" ", pick(["in", "with", "set", "and", "value"], 39), close, pick(["is", "the", ";", "then", ""], 40)).alias("around"), before.alias("glue"), path.alias("path"), secret.cast("double").alias("label"))


def train(findings: DataFrame, trees: int = 40, depth: int = 8, seed: int = 1, max_rows: int = 100_000) -> RandomForestClassificationModel:
    """A forest from labelled findings; of more than ``max_rows`` a share is drawn by hash."""
    share = min(1.0, max_rows / max(1, findings.count()))
    drawn = findings.where(F.pmod(F.xxhash64("value", "around"), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = materialize(described(drawn).select(*FEATURES, F.col("label").cast("double").alias("label")), "findings")
    return RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed).fit(_assembled(rows))


def _assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="x", handleInvalid="keep").transform(rows)


def scan(docs: DataFrame, model: RandomForestClassificationModel, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """(doc, place, run, value_sha256, shown, length, score, is_secret) for every candidate."""
    scored = model.transform(_assembled(described(candidates(docs, id_col, text_col, path_col))))
    score = vector_to_array("probability")[1]
    shown = F.concat(F.substring("value", 1, 4), F.lit("..."))
    return scored.select("doc", "place", "run", F.sha2("value", 256).alias("value_sha256"), shown.alias("shown"), F.col("length").cast("int").alias("length"), F.round(score, 6).alias("score"), (score >= least).alias("is_secret"))
