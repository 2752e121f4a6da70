import hashlib
import random
import re

from leafmill.llm import secrets
from tests.llm.conftest import CLEAN, SECRET

PARTS = ["token", "Secret", "PASSWORD", "passwd", "api_key", "apiKEY", "=", ":", " ", '"', "'", "AKIA", "ABCDEF1234567890", "0123456789abcdef", "deadbeef", "x", "\n", "é", "👍", "abcdefgh", "ghp_", "A" * 36, "xoxb-1234567890", "eyJ" + "a" * 12, ".", "-----BEGIN RSA PRIVATE KEY-----", "AIza" + "b" * 35, ",", "token=token:"]
BASE = [
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
]


def every(text, rules):
    return sorted((m.start(), k, kind, m.end()) for k, (kind, r, g, least) in enumerate(rules) for m in r.finditer(text) if len(m.group(g)) >= least)


def texts():
    rng = random.Random(1)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, 14))) for _ in range(1500)] + [None, "", CLEAN, f"token={SECRET}" * 400, "token=secret=abcdefghij", "token=token:abcdefgh12", "AKIAAKIA" + "Z" * 8, "AKIA" + "Z" * 11]


def test_against_a_plain_scan(spark):
    rows = [(i, t, 1, 1) for i, t in enumerate(texts())]
    rows += [(9000 + i, f"token={SECRET}", 1, 1) for i in range(50)] + [(None, "AKIA" + "Q" * 12, 1, 1)]
    got = {(r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in secrets.digest(spark.createDataFrame(rows, "doc_id long, text string, k1 int, spans int")).collect()}
    rules = [(r.kind, re.compile(r.pattern, re.ASCII), r.group, r.least) for r in secrets.RULES]
    say = lambda found: ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in found)
    want = set()
    for i, t, *_ in rows:
        base = every(t or "", BASE)
        n = [sum(k == kind for _, _, k, _ in base) for kind in secrets.BASE]
        want.add((i, *n, hashlib.sha256(say(base).encode()).hexdigest(), say(every(t or "", rules))))
    assert got == want


def test_trigram_queries_never_lose_a_match():
    for rule in secrets.RULES:
        query, pattern = secrets.trigram_query(rule.pattern), re.compile(rule.pattern, re.ASCII)
        assert bool(query) == (rule.kind != "hex")
        for t in texts():
            for m in pattern.finditer(t or ""):
                own = m.group().lower()
                assert all(any(all(x in own for x in choice) for choice in part) for part in query), (rule.kind, own)
    assert secrets.trigram_query("a|bcd") == [] and secrets.trigram_query("[a-z]+") == []
    assert secrets.trigram_query("abc(?:def)?g") and secrets.trigram_query("(?i:ABCD)") == [frozenset({frozenset({"abc", "bcd"})})]


def test_index(spark):
    docs = spark.createDataFrame([("xx TOKEN yy",), ("to ken",), ("akia",)], "text string")
    found = secrets.candidates(secrets.build_index(docs))
    assert sorted(r.kinds for r in found.collect()) == [["access"], ["assign"]]


def test_redaction(spark, edge):
    docs = spark.createDataFrame([(1, f"a token = {SECRET} b AKIA{'Z' * 12} c", 7), (2, CLEAN, 8), (3, None, 9), (4, SECRET * 2, 1), (4, SECRET * 2, 1)], "doc_id long, text string, _runs int")
    got = sorted((r.doc_id, r.text, r._runs) for r in secrets.redact(docs).collect())
    assert got == [(1, "a [SECRET] b [SECRET] c", 7), (2, CLEAN, 8), (3, None, 9), (4, "[SECRET]", 1), (4, "[SECRET]", 1)]
    out = secrets.redact(edge)
    assert out.columns == edge.columns and out.count() == edge.count() and secrets.redact(edge.limit(0)).count() == 0
    assert secrets.digest(edge).count() == edge.count() and secrets.digest(edge.limit(0)).count() == 0
    assert secrets.spans(out).count() == 0
