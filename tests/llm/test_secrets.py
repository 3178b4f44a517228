"""Secret spans against Python's regular expressions over every text."""

import hashlib
import random
import re
import time

from sondage.llm.queries import QUERIES
from sondage.llm.secrets import RULES, Rule, candidates, find_secrets, secret_report, trigram_postings
from sondage.llm.trigrams import trigram_query, trigrams

ORDER = {r.kind: i for i, r in enumerate(RULES)}
BASE = {
    "assign": re.compile(
        r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
        r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    ),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}
# Tokens in one plain expression; the rule reads every run once.
JWT = r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"


def plain(text):
    text = text or ""
    spans = []
    for m in BASE["assign"].finditer(text):
        if len(m[2]) >= 12:
            spans.append((m.start(), 0, m.end(), "assign"))
    for m in BASE["access"].finditer(text):
        if len(m[0]) >= 18:
            spans.append((m.start(), 1, m.end(), "access"))
    for m in BASE["hex"].finditer(text):
        if len(m[0]) >= 16:
            spans.append((m.start(), 2, m.end(), "hex"))
    base = ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(spans))
    for rule in RULES[3:]:
        jwt = rule.kind == "jwt"
        for m in re.finditer(JWT if jwt else rule.expression(), text):
            if len(m[0 if jwt else rule.group]) >= rule.least:
                spans.append((m.start(), ORDER[rule.kind], m.end(), rule.kind))
    every = ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(spans))
    counts = [sum(s[3] == k for s in spans) for k in BASE]
    return (*counts, hashlib.sha256(base.encode()).hexdigest(), every)


def check(rows, texts):
    assert sorted((str(r[0]), *r[1:]) for r in rows) == sorted((str(i), *plain(t)) for i, t in texts)


def test_query(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    check(QUERIES["op4_trigram_secrets"](spark, folder).collect(), [tuple(r) for r in docs])


def test_small_cases(spark):
    key = "Ab0+/_.=-xyzXYZ"
    texts = [
        (1, None), (2, ""), (3, f"password={key}"), (3, f"password={key}"), (4, f"x PASSWD : '{key} q"),
        (5, f"password: secret: {key}"), (6, "token==" + "a" * 12), (7, f"😀 É api_key\" = \"{key}\" Api-Key={key} ApIkEy:{key}"),
        (8, "AKIA" + "B" * 14 + " AKIA" + "B" * 13 + " AKIAAKIA" + "C" * 20), (9, "0123456789abcdef" * 3 + "g" + "f" * 15),
        (None, "ghp_" + "a" * 36 + " xoxb-" + "1-" * 10), (10, "eyJabc.eyJdef.ghi" + "x" * 20 + " AIza" + "b" * 35),
        (11, "-----BEGIN RSA PRIVATE KEY-----\nabc"), (12, "to ken " * 4000 + f"secret={key}"), (13, "toKen='ſecret: " + key),
        (14, "password token secret AKIA ghp_ passwd=" + "a" * 11),
    ]
    df = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS kinds", "3 AS found")
    check(secret_report(df).collect(), texts)


def test_trigram_queries():
    assert RULES[0].query()[2] == ["cre", "ecr", "ret", "sec"]
    assert RULES[2].query() == []
    assert Rule("short", (("ab", "abcd"), ".+")).query() == []
    assert Rule("joint", (("ab", "abcd"), "x+")).query() == [["abx"], ["abc", "bcd", "cdx"]]
    assert Rule("two", (("abc",), ".*", ("xyz", "xyzw"))).query() == [["abc", "xyz"], ["abc", "xyz", "yzw"]]


def test_candidates_hold_every_match(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("doc_id AS row", "text")
    named = {r["row"]: set(r["kinds"]) for r in candidates(trigram_postings(docs, RULES), RULES).collect()}
    for row, text in docs.collect():
        for rule in RULES:
            if rule.query() and re.search(rule.expression(), text):
                assert rule.kind in named[row]
    assert len(named) < docs.count()


def test_empty_table(spark):
    assert secret_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_tokens_of_three_parts_at_random(spark):
    rng = random.Random(3)
    pieces = ["eyJ", "eyJ", "a", "-_0Zz", ".", ".", " ", "eyJabcdefghijklm.eyJ", "x" * 25]
    texts = [(i, "".join(rng.choices(pieces, k=rng.randint(1, 30)))) for i in range(1500)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    rows = secret_report(df).collect()
    check(rows, texts)
    assert sum("jwt" in r["spans"] for r in rows) > 100


def test_hostile_texts_of_a_megabyte(spark):
    """Beginnings of matches over and over: each rule reads them in seconds."""
    n = 1_000_000
    beginnings = ["eyJ", "eyJa.", "eyJa.eyJ", "AKIA", "secret ", "token=\"", "ghp_", "xoxb-", "AIza", "-----BEGIN ", "PRIVATE KEY-----", "0f", "."]
    texts = [(i, b * (n // len(b))) for i, b in enumerate(beginnings)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(8)
    begun = time.monotonic()
    rows = {r["doc_id"]: r for r in secret_report(df).collect()}
    assert time.monotonic() - begun < 60
    assert len(rows) == len(texts) and rows[0]["spans"] == rows[9]["spans"] == ""
    assert rows[11]["n_hex"] == 1 and rows[3]["n_access"] == 1


# Expressions with the alternatives that must at least be found (None: a full scan).
ODD = {
    "abc": 1, "ab(c|d)e": 2, "(abc|bcd)+a": 2, "a(bc)?d": None, "(ab){2,3}c": 1, "[ab]cde": 2, "[^a]bcd": 1, "abc|b": None,
    "(?i)ABcD": 1, "a.*bcd": 1, "(?:ab|ba)(?:cd|dc)": 4, "a++bcd": 1, "(?>abc|ab)cd": 2, "(?=abc)ab": None, "ab(?!c)da": 1,
    "(?<!a)bcda?": 1, "^abc$|bcda": 2, "(a)\\1bcd": None, "(abc)*": None, "a{3}": 1, "a{2,}b": 1, "é?abc": 1, "[a-d]{3}": None,
    "(?:a|ab)(?:c|bc)d": 3, "((abc)d?)+": 1, "ab?cd": 2, "(?s)abc": None, "[a&&[b]]cd": None, "[a[bc]]cda": None, "\\p{L}abc": None, "((": None,
}


def test_derived_queries_lose_no_match():
    rng = random.Random(11)
    texts = ["".join(rng.choices("aaabbbcccddAe\né", k=rng.randint(1, 14))) for _ in range(20_000)]
    for expression, least in ODD.items():
        query = trigram_query(expression)
        assert (len(query) >= least) if least else query == [], expression
        if not query:
            continue
        found = [t for t in texts if re.search(expression, t)]
        assert found, expression
        for text in found:
            assert any(trigrams(text).issuperset(clause) for clause in query), (expression, text)


def test_many_alternatives():
    names = tuple(f"key{i}_" for i in range(100))
    assert len(Rule("many", (names, "[a-z]+")).query()) == 100


def test_index_of_own_rules(spark):
    """Rules that are patterns only, with and without mandatory trigrams."""
    rules = (Rule("order", ("(?:ord|inv)-[0-9]{4}",)), Rule("digits", ("[0-9]{6}",)), Rule("name", ("(?i)MR?S [a-z]+",)))
    assert [r.query() for r in rules[1:]] == [[], [["ms "], ["mrs", "rs "]]] and rules[0].query()
    texts = [(1, "ORD-1234 ord-1234, inv-99 inv-9999"), (2, "123456 ms smith"), (3, "ord inv"), (4, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    rows = {r["doc_id"]: r["found"] for r in find_secrets(df, rules=rules).collect()}
    spans = {i: {k: [tuple(s[x] for x in ("start", "end")) for s in found[k]] for k in ("order", "digits", "name")} for i, found in rows.items()}
    none = {"order": [], "digits": [], "name": []}
    assert spans == {1: none | {"order": [(9, 17), (26, 34)]}, 2: none | {"digits": [(0, 6)], "name": [(7, 15)]}, 3: none, 4: none}
