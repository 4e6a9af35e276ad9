"""Secrets that no base expression finds: recall and false alarms of a model learnt from the given documents, on planted texts
that are made by other code than the model's own examples; the base part against a naive scan."""
from __future__ import annotations

import random
import re
import string

import pytest

from filigrane.llm import secret_scan
from tests.llm.test_operators import odd_rows, table

L, U, D = string.ascii_lowercase, string.ascii_uppercase, string.digits
SHAPES = {
    "alnum": lambda some, n: some(L + U + D, n),
    "base64": lambda some, n: some(L + U + D + "+/", 40),
    "ghp": lambda some, n: "ghp_" + some(L + U + D, 36),
    "sk": lambda some, n: "sk-" + some(L + U + D, 48),
    "jwt": lambda some, n: f"eyJ{some(L + U + D, 17)}.eyJ{some(L + U + D, 40)}.{some(L + U + D + '_-', 42)}x",
    "uuid": lambda some, n: "-".join(some("0123456789abcdef", k) for k in (8, 4, 4, 4, 12)),
    "upper hex": lambda some, n: some("0123456789ABCDEF", 32),
    "letters": lambda some, n: some(L + U, n),
    "lower and digits": lambda some, n: some(L + D, n),
}
CUES = ("", "bearer ", "pwd = ", "api key: ", "our credential is ")
HARMLESS = ["2024-05-17", "17.05.2024", "10:32:07", "2024-05-17T12:33:01.123Z", "1.22.3", "v1.22.3-alpha1", "v12.0.1", "release-2.14.0", "3.14159265358979",
            "https://en.wikipedia.org/wiki/Suffix_array#Construction", "http://example.org/a/b/c/index.html", "www.example.com/products/item-1234",
            "https://news.example.com/2024/05/17/some-long-title-of-a-story.html?id=12345", "getUserAccountInformationFromDatabase",
            "CamelCaseIdentifierWithManyWords", "XMLHttpRequestFactoryBuilder", "someVeryLongVariableNameForTesting123", "parseJSONResponseBody",
            "org.apache.spark.sql.catalyst.expressions", "snake_case_name_of_a_function", "MAX_BUFFER_SIZE_IN_BYTES", "10.1000/xyz123",
            "978-3-16-148410-0", "+49-170-1234567", "Donaudampfschifffahrtsgesellschaft", "internationalization", "AB-1234-CD", "A4-210", "ISO-8859-15",
            "utf8mb4_unicode_ci", "/usr/local/lib/python3.13/site-packages", "C3PO", "x86_64", "H2SO4", "42,000.00", "1,234,567,890", "12345678901234567890"]


@pytest.fixture(scope="module")
def learnt(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = [r.text for r in docs.where("doc_id % 7 = 3").collect()]
    return secret_scan.learn(docs.where("doc_id % 7 <> 3")), texts


def setting(rng, texts, value):
    ws = rng.choice(texts).split(" ")
    at = rng.randint(0, len(ws))
    text = " ".join([*ws[max(0, at - 40):at], value, *ws[at:at + 40]])
    return text, len(" ".join(ws[max(0, at - 40):at])) + (at > 0)


@pytest.mark.parametrize("shape", SHAPES)
def test_recall(learnt, shape):
    model, texts = learnt
    rng = random.Random(shape)
    for cue in CUES:
        found = 0
        for _ in range(60):
            value = SHAPES[shape](lambda pool, n: "".join(rng.choices(pool, k=n)), rng.randint(20, 40))
            text, at = setting(rng, texts, cue + value)
            at = text.index(value)
            found += any(a == at and abs(e - at - len(value)) <= 1 for a, e in secret_scan.tagged(text, model))
        assert found >= 54, (cue, found)


def test_false_alarms(learnt):
    model, texts = learnt
    rng = random.Random(0)
    bad = []
    for value in HARMLESS * 10:
        text, _ = setting(rng, texts, value)
        at = text.index(value)
        bad += [text[a:e] for a, e in secret_scan.tagged(text, model) if a < at + len(value) and at < e]
    assert len(bad) <= 0.01 * 10 * len(HARMLESS), bad


def test_prose_is_clean(learnt):
    """Held-out documents: what is tagged beyond base spans is next to nothing."""
    model, texts = learnt
    more = [t[a:b] for t in texts for s, e in secret_scan.tagged(t, model) for a, b in secret_scan.beyond(t, s, e, secret_scan.base_spans(t))]
    assert len(more) <= 0.01 * len(texts), more


def naive(text):
    """Base spans by trying every start."""
    out, at = [], 0
    assign = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    for kind, rule, enough in (("assign", assign, lambda m: len(m[1]) >= 12), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
                               ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16)):
        at = 0
        while at <= len(text):
            m = rule.match(text, at)
            if m:
                out += [(kind, *m.span())] if enough(m) else []
                at = m.end()
            else:
                at += 1
    return sorted(out, key=lambda s: (s[1], secret_scan.KINDS.index(s[0])))


def test_base_spans_against_naive_scan():
    rng = random.Random(6)
    bits = ["password", "Secret", "api_key", "APIKEY", "token", '"', "'", " ", "  ", ":", "=", "abcdef012345", "AKIA", "ABCDEF", "0123456789", "deadbeef", "é", "\n", "x"]
    for _ in range(3000):
        text = "".join(rng.choices(bits, k=rng.randint(0, 14)))
        assert secret_scan.base_spans(text) == naive(text)


def test_edges(spark, learnt):
    model, _ = learnt
    rows = [(r[0], r[1]) for r in odd_rows()] + [(50, "ghp_a8dJ29dkKe02mvQpz81LsYw0Zx7"), (51, "x" * 300_000 + " " + "aB3" * 100_000), (52, "_" * 1000)]
    got = secret_scan.find_secrets(table(spark, rows), model).collect()
    assert len(got) == len(rows) and all(r.spans is not None for r in got)
    assert [s.found for r in got if r.doc_id == 50 for s in r.spans] == ["ghp_a8dJ29dkKe02mvQpz81LsYw0Zx7"]
