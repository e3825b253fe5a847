"""Full-text search against a plain stemmer and plain loops."""

from __future__ import annotations

import re
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from casewright.functions.stems import STOP_WORDS, stem
from casewright.operators import fulltext
from casewright.plans.fulltexts import STEMS

# word and stem, by the published vocabulary of the algorithm
KNOWN = "consign consign consigned consign consistency consist consolation consol knackeries knackeri generously generous communities communiti dying die news news proceeding proceed hopping hop hoped hope happy happi say say cry cri by by enjoy enjoy apologies apolog analogously analog rationally ration possibly possibl skies sky ties tie cries cri gas gas this this kiwis kiwi kiss kiss bliss bliss agreed agre bleed bleed luxuriate luxuri hopefulness hope formalize formal electricity electr adjustable adjust replacement replac adoption adopt roll roll controll control rate rate cease ceas inning inning yellow yellow youth youth".split()
DOCS = {
    1: "The running dogs run; a dog ran to the court.", 2: "Courts of appeal, appealing courts", 3: "", 4: None, 5: "appeal to the high court was heard", 6: "high hearing: court", 7: "the of and", 8: "Über naïve Gerichte 2020 2020",
    9: "court " * 50 + "appeal " + "x " * 30 + "court appeal", 10: "dog",
}


def spoken(text: str | None) -> list[tuple[str, int]]:
    return [(stem(w), k + 1) for k, w in enumerate(re.findall(r"[^\W_]+", (text or "").lower())) if w not in STOP_WORDS]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(DOCS.items()), "id bigint, text string")


@pytest.fixture(scope="module")
def table(docs):
    return fulltext.index(docs, [(F.col("text"), fulltext.D)])


def test_stems():
    assert [stem(w) for w in KNOWN[::2]] == KNOWN[1::2]


def test_stems_in_sql_are_the_same():
    ends = "s ed ing ly ational ization fulness ousli iviti ement ogi li ness ative ical eed eedly ies ied y e ll ism ion tion sion er".split()
    roots = "hop hopp bat fizz luxur relat gener commun arsen trou yell boy cry sky happ conflat vil digit oper sens decis hes val radic rev allow infer adjust depend angular homolog effect bowdl prob cont rol plast r o an".split()
    vocab = sorted({r + e for r in roots for e in ends} | set(KNOWN) | {a + b + c for a in "abcy" for b in "aeyt" for c in "stye"})
    con = duckdb.connect()
    con.execute("CREATE TABLE vocab (word VARCHAR)")
    con.executemany("INSERT INTO vocab VALUES (?)", [(w,) for w in vocab])
    got = dict(con.sql(f"WITH {STEMS} SELECT word, term FROM stems").fetchall())
    assert got == {w: stem(w) for w in vocab}


def test_postings(table):
    want = defaultdict(list)
    for d, t in DOCS.items():
        for w, k in spoken(t):
            want[w, d].append(k)
    assert {(r.term, r.id): [p.pos for p in r.places] for r in table.collect()} == want


def test_lookup_reads_few_folders(table):
    found = fulltext.lookup(table, ["court", "dog"])
    assert {r.term for r in found.collect()} == {"court", "dog"}
    assert "PartitionFilters: [bucket" in found._jdf.queryExecution().executedPlan().toString()


def plain(query: str) -> set[int]:
    """By hand: OR of clauses, phrases by distance."""
    out = set()
    for clause in re.split(r"\bor\b", query.lower()):
        parts = []
        for part in re.findall(r'-?"[^"]*"|\S+', clause):
            terms = [(t, k) for t, k in spoken(part)]
            if terms:
                parts.append((part[0] != "-", [(t, k - terms[0][1]) for t, k in terms]))
        if not parts:
            continue
        for d, text in DOCS.items():
            at = set(spoken(text))
            holds = lambda item: any(all((t, p + k) in at for t, k in item) for _, p in at)  # noqa: B023, E731
            if all(holds(item) == wanted for wanted, item in parts):
                out.add(d)
    return out


@pytest.mark.parametrize("query", ["court", "running dog", '"high court"', '"appeal to the high courts"', "dogs OR appeals", "court -dog", "-court", '"court appeal" OR naïve', "the", "", '-"high court" court', "2020 gerichte", '"dog dogs"', "hearing OR heard OR -x"])
def test_web_queries(table, docs, query):
    assert {r.id for r in fulltext.matches(table, docs, query).collect()} == plain(query)


def density(text: str | None, terms: set[str]) -> float:
    """All shortest stretches by trying each."""
    at = [(t, k) for t, k in spoken(text) if t in terms]
    whole = [(i, j) for i in range(len(at)) for j in range(i, len(at)) if {t for t, _ in at[i : j + 1]} == terms]
    covers = [(i, j) for i, j in whole if not any((a, b) != (i, j) and i <= a and b <= j for a, b in whole)]
    return sum(0.1 / (1 + (at[j][1] - at[i][1]) - (j - i)) for i, j in covers)


@pytest.mark.parametrize("query", ["court appeal", "dog", "court high heard", "court court"])
def test_cover_density(table, docs, query):
    got = {r.id: r.density for r in fulltext.websearch(table, docs, query).collect()}
    want = {d: density(DOCS[d], {stem(w) for w in query.split()}) for d in plain(query)}
    assert got == pytest.approx(want)


def test_ranks(spark, table):
    got = {r.id: r.rank for r in fulltext.any_term(table, spark.createDataFrame([(1, "courts Appeal the")], "q int, text string")).collect()}

    def rank(text):
        n = {t: sum(w == t for w, _ in spoken(text)) for t in ("court", "appeal")}
        return sum(0.1 * sum(1 / (k * k) for k in range(1, c + 1)) / fulltext.LIMIT for c in n.values()) / 2

    assert got == pytest.approx({d: rank(t) for d, t in DOCS.items() if rank(t)})


def test_fields_weigh(spark):
    rows = spark.createDataFrame([(1, "dog", "x dog"), (2, "x", "dogs dog"), (3, None, None)], "id int, title string, body string")
    table = fulltext.index(rows, [(F.col("title"), fulltext.A), (F.col("body"), fulltext.D)])
    got = {r.id: r.rank for r in fulltext.any_term(table, spark.createDataFrame([(1, "dog")], "q int, text string")).collect()}
    assert got == pytest.approx({1: (1.0 + 0.1 / 4) / fulltext.LIMIT, 2: (0.1 + 0.1 / 4) / fulltext.LIMIT})


def test_empty_index(spark, docs):
    none = fulltext.index(docs.where("false"), [(F.col("text"), fulltext.D)])
    assert fulltext.matches(none, docs.where("false"), "court").count() == 0


def test_a_stem_opens_its_word():
    """What the choice of words before stemming rests on."""
    import itertools

    from casewright.functions import stems

    roots = ["la", "sens", "hop", "control", "gener", "commun", "vi", "duplic", "y", "dyi", "log", "bb", "arsen", "a"]
    ends = ["", *stems.STEP_2, *stems.STEP_3, *stems.STEP_4, "bility", "ies", "ied", "sses", "ing", "ed", "eedly", "ingly", "y", "s", "e", "ll"]
    made = {r + a + b for r, a, b in itertools.product(roots, ends, ends)} | set(stems.WHOLE) | set(stems.KEPT)
    for w in made:
        t = stems.stem(w)
        assert w[:1] == t[:1] and w.startswith(t[: max(1, len(t) - stems.CHANGED)])


def test_postings_of_some_terms_are_those_of_all(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    asked = [(t,) for t in ("la", "thi", "tion", "onent", "nothing")]
    some = fulltext.postings(docs, [(F.col("text"), fulltext.D)], spark.createDataFrame(asked, "term string"))
    every = fulltext.postings(docs, [(F.col("text"), fulltext.D)]).where(F.col("term").isin([t for (t,) in asked]))
    rows = lambda df: sorted((r.term, r.id, r.len, [tuple(p) for p in r.places]) for r in df.collect())
    assert rows(some) == rows(every) != []


def test_no_word_carries_its_text(spark):
    """The explode keeps the number of words, not the words themselves, beside each word."""
    docs = spark.createDataFrame([(1, "a b")], "id int, text string")
    plan = fulltext.postings(docs, [(F.col("text"), fulltext.D)])._jdf.queryExecution().optimizedPlan().toString()
    generate = next(x for x in plan.splitlines() if "Generate posexplode" in x)
    assert "[2]" in generate.split("),")[1] or "[1]" in generate


def test_quality_trims_a_text_once(spark):
    from casewright.functions import text

    plan = spark.createDataFrame([(" a​ ",)], "t string").select(text.quality(F.col("t")))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(t#") == 1
