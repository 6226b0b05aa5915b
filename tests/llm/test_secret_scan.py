import hashlib
import random
import re

import pytest
from edge import DOCS, awkward, docs, rows

from fleetlens.llm.secret_scan import BASE, MORE, secret_scan
from fleetlens.llm.trigrams import query

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def brute_base(text):
    """The contract's expressions, matched in full and filtered after."""
    hits = {
        "assign": [m for m in ASSIGN.finditer(text) if len(m[2]) >= 12],
        "access": [m for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18],
        "hex": [m for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16],
    }
    spans = sorted((m.start(), k, m.end(), kind) for k, (kind, ms) in enumerate(hits.items()) for m in ms)
    joined = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)
    return *(len(v) for v in hits.values()), hashlib.sha256(joined.encode()).hexdigest()


def texts():
    rng = random.Random(5)
    parts = [
        "password", "PassWD", "secret", "token", "api_key", "ApiKey", "apikey", "=", ":", " ", "'", '"', "abcdefghijkl", "Zz9+/_.=-Zz9+/",
        "short", "AKIA", "ABCDEFGHIJKLMN", "AKIAABCDEFGHIJ1234", "0123456789abcdef", "deadbeef", "é", "\U0001f600", "\n", "K", "ſecret",
        "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1" * 18, "eyJhbGciOi.eyJzdWIiOi.c2lnbmF0dXJl",
    ]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 30))) for _ in range(400)]


def test_base_spans_against_brute_force(spark):
    data = awkward() + [(1000 + i, t) for i, t in enumerate(texts())] + [
        (2000, "token: secret: abcdefghijklmnop"), (2001, "token=secret=abcdefghijklmnop"), (2002, "ab" * 40_000),
        (2003, ("x" * 200 + "0123456789abcdef0 ") * 800), (2004, "AKIAKIA" + "B" * 13), (2005, "a password='" + "z" * 12),
    ]
    got = rows(secret_scan(docs(spark, data)), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256")
    assert got == sorted(((i, *brute_base(t or "")) for i, t in data), key=str)


def test_spans_of_all_rules(spark):
    text = "é key -----BEGIN PRIVATE KEY----- ghp_" + "Z1" * 18 + " token=" + "q" * 12
    out = secret_scan(docs(spark, [(1, text)])).first()
    kinds = [s.split(":") for s in out.spans.split(",")]
    assert [k for k, _, _ in kinds] == ["private_key", "hub_token", "assign"]
    assert [text[int(a) : int(b)] for _, a, b in kinds] == ["-----BEGIN PRIVATE KEY-----", "ghp_" + "Z1" * 18, "token=" + "q" * 12]


def test_no_python_in_the_plan(spark):
    plan = secret_scan(docs(spark, [(1, "a")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty_table(spark):
    assert rows(secret_scan(spark.createDataFrame([], DOCS)), "doc_id", "spans") == []


@pytest.mark.parametrize("rule", BASE + MORE, ids=lambda r: r.kind)
def test_queries_hold_for_every_match(rule):
    conditions = query(rule.pattern)
    assert bool(conditions) == (rule.kind != "hex")
    for text in texts():
        if re.search(rule.pattern, text):
            low = text.lower()
            assert all(any(all(g in low for g in clause) for clause in c) for c in conditions)


def test_query_of_branches_and_repeats():
    assert query("abc|xyzw") == [[frozenset({"abc"}), frozenset({"xyz", "yzw"})]]
    assert query("ab?cd") == [[frozenset({"abc", "bcd"}), frozenset({"acd"})]]
    assert query("abc.*def") == [[frozenset({"abc"})], [frozenset({"def"})]]
    assert query("(?:abc)+x") == [[frozenset({"abc"})]]
    assert query("[a-z]+") == query("(abc)*") == query("ab|abc") == []
