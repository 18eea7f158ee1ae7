import random
import re

import pytest

from bytelane.llm import secrets
from bytelane.llm.trigrams import trigram_query


def brute_spans(text):
    out = []
    for number, rule in enumerate(secrets.RULES):
        for m in re.finditer(rule.pattern, text or "", re.ASCII):
            if len(m.group(rule.value_group)) >= rule.value_chars:
                out.append((m.start(), number, m.end()))
    return sorted(out)


def base_spans(text):
    """The contract's own wording, without lengths inside the patterns."""
    assign = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [(m.start(), 0, m.end()) for m in re.finditer(assign, text or "", re.ASCII) if len(m.group(1)) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text or "") if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text or "") if len(m.group()) >= 24]
    return sorted(out)


def texts():
    rnd = random.Random(4)
    parts = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "apikey", "=", ":", " ", '"', "'", "abcdef", "ab", "AKIA", "AKIAX",
             "A1B2C3D4E5F6G7H8", "0123456789abcdef01234567", "é🥰", "\n", "token=token:abcdef", "ghp_" + "a" * 36, "xoxb-1234567890-a",
             "-----BEGIN RSA PRIVATE KEY-----", "eyJabcdefghij0.abcdefghij0.abcdefghij0", "K", "ſecret=abcdefg"]
    out = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 25))) for _ in range(400)]
    return out + ["", None, "token=" * 200 + "abcdefgh", "token: abcdefg, " * 3000, "AKIA" * 20, "x" * 200_000 + " secret='abcdefgh'"]


def test_spans_against_brute_force(spark):
    rows = [(i % 390, t, "a", "b") for i, t in enumerate(texts())] + [(None, "token=abcdefg", "", ""), (None, "x", "", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, rules string, rule string")
    got = secrets.find_spans(df).collect()
    assert sorted((str(r["doc_id"]), r["text"] or "", [tuple(s) for s in r["secret_spans"]]) for r in got) == sorted(
        (str(i), t or "", brute_spans(t)) for i, t, *_ in rows)
    for _, t, *_ in rows:
        assert [s for s in brute_spans(t) if s[1] < 3] == base_spans(t)
    assert secrets.find_spans(df.limit(0)).count() == 0


def test_all_columns_pass_through(spark):
    names = ["_s0", "_S1", "_rules", "_candidate", "_candidate_", "rules", "id", "trigram", "secret_spans"]
    df = spark.createDataFrame([(1, "token=abcdefg", *[f"own {n}" for n in names]), (1, None, *[""] * len(names))], ["doc_id", "text", *names])
    got = secrets.find_spans(df, out="found")
    assert got.columns == [*df.columns, "found"]
    rows = got.orderBy("_rules").collect()
    assert [len(r["found"]) for r in rows] == [0, 1]
    assert all(rows[1][n] == f"own {n}" for n in names)
    with pytest.raises(ValueError, match="has a column"):
        secrets.find_spans(df)


def test_trigram_queries_hold_for_every_match():
    for rule in secrets.RULES:
        query = trigram_query(rule.pattern)
        for t in texts():
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
            for m in re.finditer(rule.pattern, t or "", re.ASCII):
                assert any(all(g in low for g in s) for s in query), (rule, m)
    assert trigram_query("[0-9a-f]{24,}") == [frozenset()]
    assert trigram_query("abc[xy]") == [frozenset({"abc", "bcx"}), frozenset({"abc", "bcy"})]
    assert trigram_query("a(bc)?de") == [frozenset({"abc", "bcd", "cde"}), frozenset({"ade"})]


@pytest.mark.parametrize("n", [0, 1, 2, 10, 99, 100, 101])
def test_running_sums(spark, n):
    from pyspark.sql import functions as F

    xs = list(range(1, n + 1))
    df = spark.createDataFrame([(xs,)], "xs array<int>")
    assert df.select(secrets.running_sums(F.col("xs")).alias("s")).first()["s"] == [sum(xs[:i + 1]) for i in range(n)]
