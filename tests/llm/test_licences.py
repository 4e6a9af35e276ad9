"""License scans: the base part against brute force and SQL, the templates on changed notices and on prose."""
from __future__ import annotations

import random
import re

import pytest

from filigrane.llm import catalog, licences
from tests.compare import connect, norm
from tests.llm.test_operators import odd_rows, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}


def brute(text):
    ws = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    at = sorted((k, label) for p, label in PHRASES.items() for k in range(len(ws)) if tuple(ws[k:k + len(p)]) == p)
    return len(ws), [k for k, _ in at], ",".join(sorted({x for _, x in at}))


def test_base_part(spark):
    rng = random.Random(8)
    pool = ["MIT", "license", "Apache", "general", "public", "LICENSE", "x", "é", "mit-license", "\n", "GENERAL\tpublic", "licenses", "Mit"]
    docs = odd_rows() + [(100 + k, " ".join(rng.choices(pool, k=rng.randint(0, 40)))) for k in range(80)]
    got = licences.scan_licences(table(spark, docs)).collect()
    assert len(got) == len(docs)
    have = sorted(((r.doc_id, r.n_words, [p.start for p in r.places], ",".join(sorted({p.label for p in r.places}))) for r in got), key=repr)
    assert have == sorted(((i, *brute(t)) for i, t, *_ in docs), key=repr)
    assert licences.scan_licences(table(spark, [])).count() == 0


def test_base_columns_equal_sql(spark):
    """What SQL can say of the registered query, over the whole table."""
    sf = "/root/testdata/sf0.01"
    want = connect(sf).execute(r"""
      WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM documents),
      i AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS k FROM w),
      h AS (SELECT doc_id, k - 1 AS k, CASE WHEN ws[k] = 'mit' AND ws[k + 1] = 'license' THEN 'mit'
              WHEN ws[k] = 'apache' AND ws[k + 1] = 'license' THEN 'apache'
              WHEN ws[k] = 'general' AND ws[k + 1] = 'public' AND ws[k + 2] = 'license' THEN 'gpl' END AS label FROM i)
      SELECT w.doc_id, len(ws), count(label), min(k) FILTER (label IS NOT NULL), max(k) FILTER (label IS NOT NULL),
             coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '')
      FROM w LEFT JOIN h ON h.doc_id = w.doc_id GROUP BY w.doc_id, ws""").fetchall()
    got = catalog.QUERIES["op13_license_scan"](spark, sf).collect()
    assert sorted((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == sorted(map(tuple, want)), norm
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    assert {"cc-by-nc"} <= {x for r in got for x in r.labels.split(",")}
    assert all(0 <= r.score <= 1 and (r.score > 0) == (r.labels != "") for r in got)


def prose(rng, n):
    pool = ("the a of and to in is that for it with as was software use copy permission notice any this free work public person "
            "files party rights terms house river copyright include without following").split()
    return " ".join(rng.choices(pool, k=n))


def changed(rng, text, keys, how):
    ws = text.split()
    if how == "comment":
        return "\n".join(" * " + " ".join(ws[k:k + 9]) for k in range(0, len(ws), 9))
    if how == "case":
        return text.upper()
    if how == "names" and len(ws) >= 30:  # words put in and left out away from the phrases
        flat = [(k, x) for k, w in enumerate(ws) for x in licences.words(w)]
        alts = [licences.words(alt) for key in keys for alt in key.split("|")]
        held = {flat[k + j][0] for alt in alts for k in licences.find_phrase([x for _, x in flat], alt) for j in range(len(alt))}
        free = [k for k in range(5, len(ws)) if not {k - 1, k, k + 1} & held]
        at = rng.choice(free)
        ws[at:at + 1] = ["acme", "corp", "2024"]
    return "  ".join(ws)


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(5)
    docs, want = [], {}
    for label, text, keys in licences.default_templates():
        for how in ("plain", "comment", "case", "names"):
            k = len(docs)
            docs.append((k, f"{prose(rng, 80)}\n{changed(rng, text, keys, how)}\n{prose(rng, 50)}"))
            want[k] = label
    docs += [(10_000 + k, prose(rng, 400)) for k in range(200)]
    docs += [(20_000, "You may use this software for any purpose. Permission notice and disclaimer: see the licence."),
             (20_001, "The licensed driver was under the apache version of the law; the BSD source and binary forms differ."),
             (20_002, "under CC: BY the way, NC is North Carolina since 4.0 came")]
    got = {r.doc_id: r for r in licences.scan_licences(table(spark, docs)).collect()}
    return want, got


def test_templates_are_found(judged):
    want, got = judged
    found = [label in {m.label for m in got[k].matches} for k, label in want.items()]
    assert sum(found) == len(found), [want[k] for k, f in zip(want, found) if not f]
    assert all(len({m.label for m in got[k].matches}) == 1 for k in want)  # and nothing else


def test_prose_is_clean(judged):
    _, got = judged
    assert [k for k, r in got.items() if k >= 10_000 and r.matches] == []


def test_missing_phrase_and_moved_words(spark):
    text = next(t for label, t, _ in licences.TEMPLATES if label == "mpl")
    ws = text.split()
    rng = random.Random(1)
    docs = [(1, text), (2, text.replace("Mozilla", "Godzilla")), (3, " ".join(rng.sample(ws, len(ws)))),
            (4, text + " and once more: " + text), (5, None)]
    got = {r.doc_id: [m.label for m in r.matches] for r in licences.scan_licences(table(spark, docs)).collect()}
    assert got == {1: ["mpl"], 2: [], 3: [], 4: ["mpl", "mpl"], 5: []}


def test_very_repetitive_text():
    """Work grows with the words times the places of a word in a template."""
    index = licences.build_index(licences.default_templates(), 10, {})
    anchors = frozenset(w for t in index for w in t.places)
    ws = licences.words(" ".join(t for _, t, _ in licences.TEMPLATES) + " license software copyright" * 100_000)
    assert {m[0] for m in licences.match(ws, index, anchors)} >= {"mit", "isc", "mpl", "gpl", "apache"}
