"""The corpus operators against brute force on small tables, and their edge cases."""
from __future__ import annotations

import hashlib
import random
import re
import string
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from filigrane.llm import catalog, copies, decontaminate, forest, language, lines, mixing, pii, repeats, secret_scan, shards, words
from tests.compare import compare, connect

SMALL = "/root/testdata/sf0.001"
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, _id string, _text long, _keep int, shard int, "
          "epoch string, tokens int, node long, `_mix` int, spans string")


def table(spark, rows):
    """Rows of (doc_id, text[, lang, source]) with extra columns whose names the operators use inside."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src1", None, "x", 7, 1, 2, "e", 3, 4, 5, None)
            for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def odd_rows():
    """Nulls, empty, blank, repeated, tied and long texts."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 8)))
    long = " ".join(word() for _ in range(30_000))
    line = "this line stands in many documents"
    return [(1, None, None, None), (2, "", None, "src1"), (3, " \t\n\x0b\x0c\r "), (4, long), (5, long), (5, long), (None, "a b c"),
            (None, None), (6, "a b  c"), (7, "a\tb\nc"), (8, f"{line}\nx\n {line.upper()} "), (9, f"{line}\n{line}"), (10, line),
            (11, "\n\n"), (12, "$$$ ### 123"), (13, "é" * 19), (14, "É" * 25), (-3, "a b c")]


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, odd_rows())


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---- exact dedup

def test_exact_groups(odd, none):
    want = []
    norm = [(i, re.sub(r"[\x20\x09-\x0d]+", " ", t or "")) for i, t, *_ in odd_rows()]
    for i, t in norm:
        ids = [j for j, u in norm if u == t and j is not None]
        keep = min(ids, default=None)
        want.append((i, keep, sum(u == t for _, u in norm), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    assert rows(copies.exact_groups(odd)) == sorted(want, key=repr)
    assert copies.exact_groups(none).count() == 0
    assert copies.exact_dedup(none).count() == 0
    assert copies.exact_dedup(odd).columns == odd.columns


def test_hot_text(spark):
    df = table(spark, [(k, "same  text" if k % 3 else f"t{k}") for k in range(600)])
    got = copies.exact_groups(df, salts=4).where("group_size > 1").collect()
    assert {r.keep_id for r in got} == {1} and {r.group_size for r in got} == {400} and sum(r.kept for r in got) == 1


# ---- line dedup

def brute_lines(docs):
    key = lambda x: x.encode().lower().strip(lines.BLANK).decode()
    n, last = defaultdict(int), {}
    for i, t in docs:
        for k in {key(x) for x in t.split("\n")}:
            n[k] += 1
            last[k] = max(last.get(k, i), i)
    out = []
    for i, t in docs:
        ls = t.split("\n")
        kept = [x for x in ls if not (len(key(x)) >= 20 and n[key(x)] >= 3 and last[key(x)] != i)]
        out.append((None if i == -2 ** 63 else i, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_lines(odd, none):
    docs = [(-2 ** 63 if i is None else i, t or "") for i, t, *_ in odd_rows()]
    assert rows(lines.dedup_lines(odd)) == brute_lines(docs)
    assert lines.dedup_lines(none).count() == 0


def test_lines_full_filter(spark):
    """A filter far too small suspects everything; the result is the same."""
    rng = random.Random(1)
    docs = [(k, "\n".join(f"a line that may be repeated {rng.randint(0, 40)}" for _ in range(rng.randint(1, 9)))) for k in range(80)]
    assert rows(lines.dedup_lines(table(spark, docs), max_bits=1 << 10)) == brute_lines(docs)


# ---- secrets

def test_base_spans():
    text = 'API_KEY: "abcdefghijkl" token=short secret=token=abcdefghijklmnop AKIAABCDEFGHIJKLMN AKIASHORT ' + "0a" * 8 + " ſecret=abcdefghijklmnop"
    got = [(k, text[a:b]) for k, a, b in secret_scan.base_spans(text)]
    assert got == [("assign", 'API_KEY: "abcdefghijkl'), ("assign", "secret=token=abcdefghijklmnop"),
                   ("access", "AKIAABCDEFGHIJKLMN"), ("hex", "0a" * 8)]


def planted(n, seed=2):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 9)))
    text = lambda: " ".join(word() for _ in range(rng.randint(20, 60)))
    value = lambda m: "".join(rng.choices("0123456789abcdef", k=m))
    out = []
    for k in range(n):
        t = text()
        if k % 4 == 0:
            t += f" password={value(18)} " + text()
        elif k % 4 == 1:
            t += f' token = "{value(40)}" ' + text()
        out.append((k, t))
    return out


def test_secret_model(spark, odd, none):
    docs = table(spark, planted(200))
    model = secret_scan.learn(docs)
    hidden = "deploy it with ghp_a8dJ29dkKe02mvQpz81LsYw0Zx7 as agreed"
    assert [hidden[a:b] for a, b in secret_scan.tagged(hidden, model)] == ["ghp_a8dJ29dkKe02mvQpz81LsYw0Zx7"]
    assert secret_scan.tagged("the meeting in 2024 was at 10:30, see page 14", model) == []
    got = secret_scan.find_secrets(odd, model).collect()
    assert len(got) == len(odd_rows()) and all(r.spans is not None for r in got)
    assert secret_scan.find_secrets(none, model).count() == 0
    assert secret_scan.learn(none) is None
    assert secret_scan.find_secrets(docs, None).where(F.size("spans") > 0).count() == 100


def test_viterbi_and_gradient():
    """The decoder against all taggings; the fit separates what is separable."""
    rng = np.random.default_rng(0)
    m = secret_scan.Model(rng.normal(size=(4, secret_scan.TYPES, 3)), rng.normal(size=(4, 3)), rng.normal(size=(3, 3)))
    for n in range(1, 6):
        s = m.scores(rng.integers(0, secret_scan.TYPES, n), 1)
        best = max(np.ndindex(*[3] * n), key=lambda y: sum(s[k, y[k]] for k in range(n)) + sum(m.step[a, b] for a, b in zip(y, y[1:])))
        assert m.viterbi(s) == list(best)
    types = [np.array([0, 9, 40, 0]), np.array([0, 0, 1])] * 5
    tags = [np.array([0, 0, 1, 0]), np.array([0, 0, 0])] * 5
    fitted = secret_scan.fit(types, tags, [0] * 10, rounds=80)
    assert all(fitted.viterbi(fitted.scores(a, 0)) == list(b) for a, b in zip(types, tags))


# ---- personal data

def naive_pii(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and sum(sum(map(int, str(int(c) * (1 + k % 2)))) for k, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_pii_base():
    rng = random.Random(4)
    for _ in range(3000):
        t = "".join(rng.choices("a1.@-_ +(é2", k=rng.randint(0, 40)))
        assert [s[:3] for s in pii.spans(t) if s[0] in pii.BASE_KINDS] == naive_pii(t), t
    for t in ("4111 1111 1111 1111", "4111-1111-1111-1112", "1.2.3.4.5.6.7.256 0001.2.3.255", "+1 (988) 555-2485.", "a@b.c_d@e.f x@y"):
        assert [s[:3] for s in pii.spans(t) if s[0] in pii.BASE_KINDS] == naive_pii(t)


def test_pii_checks_and_context(odd, none):
    kinds = lambda t: [s[0] for s in pii.spans(t)]
    assert kinds("IBAN GB82 WEST 1234 5698 7654 32 please") == ["iban"]
    assert kinds("IBAN GB82 WEST 1234 5698 7654 33 please") == []
    assert kinds("my ssn is 123-45-6789") == ["ssn"] and kinds("part 123-45-6789") == []
    score = lambda t: pii.spans(t)[0][3]
    assert score("call +1 (988) 555-2485") > score("then +1 (988) 555-2485") > score("order +1 (988) 555-2485")
    got = pii.find_pii(odd).collect()
    assert len(got) == len(odd_rows()) and not any(r.spans for r in got)
    assert pii.find_pii(none).count() == 0


# ---- sharding

def brute_shards(points, count):
    """points: (size, tie, dims)."""
    out = {}

    def split(members, lo, k):
        if k == 1:
            out.update((m, lo) for m in members)
            return
        d = max(range(len(points[0][2])), key=lambda j: (max((points[m][2][j] for m in members), default=0)
                                                         - min((points[m][2][j] for m in members), default=0), -j))
        key = lambda m: (points[m][2][d], points[m][1])
        want, upto, left = sum(points[m][0] for m in members) * (k // 2) // k, 0, []
        keys = sorted({key(m) for m in members})
        for x in keys:
            same = [m for m in members if key(m) == x]
            upto += sum(points[m][0] for m in same)
            if upto > want:
                break
            left += same
        split(left, lo, k // 2)
        split([m for m in members if m not in set(left)], lo + k // 2, k - k // 2)
    split(list(range(len(points))), 0, count)
    return out


@pytest.mark.parametrize("count", [1, 2, 7])
def test_sharding(spark, count):
    rng = random.Random(count)
    points = [(rng.randint(8, 900), rng.randrange(1 << 32), (rng.randint(0, 9) * 50_000, rng.randint(0, 3))) for _ in range(300)]
    df = spark.createDataFrame([(k, s, t, *d) for k, (s, t, d) in enumerate(points)], "k long, _size long, _tie long, a long, b long")
    got = {r.k: r.shard for r in shards.assign(df, ["a", "b"], count).collect()}
    assert got == brute_shards(points, count)


def test_shard_edges(odd, none):
    dims = [("source", shards.hashed(F.col("source"))), ("length", shards.magnitude(F.length("text")))]
    got = shards.shard(odd, dims, 4).collect()
    assert sorted(r.size for r in got) == sorted(len((t or "").encode()) + 8 for _, t, *_ in odd_rows())
    for s in {r.shard for r in got}:
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own)))
    assert shards.shard(none, dims, 4).count() == 0
    total = sum(r.size for r in got)
    assert {r.shard for r in shards.shard(odd, dims, target_bytes=total).collect()} == {0}
    assert max(r.shard for r in shards.shard(odd, dims, target_bytes=200_000).collect()) < -(-total // 200_000)
    with pytest.raises(ValueError):
        shards.shard(odd, dims)


# ---- mixing

def fill(cap, weight, budget):
    """Water-filling one token at a time would give; here by repeated passes."""
    full = set()
    while True:
        rest = budget - sum(cap[k] for k in full)
        w = sum(weight[k] for k in cap if k not in full)
        more = {k for k in cap if k not in full and cap[k] * w <= rest * weight[k]}
        if not more:
            return {k: cap[k] if k in full else rest * weight[k] // w for k in cap}
        full |= more


def test_fill(spark):
    rng = random.Random(9)
    nodes = [(p, f"c{k}", rng.randint(1, 500), rng.randint(1, 6), 400 * (1 + len(p))) for p in ("x", "yy") for k in range(7)]
    df = spark.createDataFrame(nodes, "p string, c string, _cap long, _weight long, _budget long")
    got = {(r.p, r.c): r._alloc for r in mixing.fill(df, ["p"], "c").collect()}
    for p in ("x", "yy"):
        own = [n for n in nodes if n[0] == p]
        budget = min(own[0][4], sum(n[2] for n in own))
        want = fill({n[1]: n[2] for n in own}, {n[1]: n[3] for n in own}, own[0][4])
        assert {c: v for (q, c), v in got.items() if q == p} == want and sum(want.values()) <= budget


def test_mix_edges(odd, none):
    one = lambda d, n: mixing.mix(d, [("lang", F.col("lang")), ("source", F.col("source"))], [F.lit(1), F.lit(1)], F.lit(n))
    assert one(none, 100).count() == 0 and one(odd, 0).count() == 0
    got = one(odd, 100_000).collect()
    assert sum(r._mix.take for r in got) >= 99_990
    assert {r._mix.epoch for r in got} == {0, 1}
    every = one(odd, 10 ** 9).collect()  # more than there is: two whole epochs of all leaves with tokens
    assert len(every) == 2 * sum(1 for r in odd_rows() if len(r) < 3)


# ---- language

def test_language(spark, odd, none):
    docs = catalog.documents(spark, "/root/testdata/sf0.01")
    model = language.learn(docs.where(~catalog.held_out(docs)))
    got = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id")
    held = got.where(catalog.held_out(got))
    assert held.where("lang = lang_pred").count() >= 0.98 * held.count()
    odd_got = language.identify(odd, model).collect()
    assert len(odd_got) == len(odd_rows()) and all(0 <= r.score <= 1 for r in odd_got)
    assert {r.doc_id: r.lang_pred for r in odd_got if r.doc_id in (1, 2, 3, 11, 12)} == dict.fromkeys((1, 2, 3, 11, 12), "und")
    assert language.identify(none, model).count() == 0
    assert language.learn(none) is None and language.learn(odd.withColumn("lang", F.lit(None).cast("string"))) is None
    assert {r.lang_pred for r in language.identify(odd, None).collect()} == {"und"}
    assert language.learn(odd) is not None  # a single language
    kept = language.keep_known(odd, model, 0.0)
    assert kept.columns == odd.columns and kept.count() == sum(any(c.isalpha() for c in t or "") for _, t, *_ in odd_rows())


# ---- Jaccard join

def test_words():
    h, at = words.hash_words(["Ab cd", "", "ab,CD! é", None or "", "x"])
    assert list(np.diff(at)) == [2, 0, 3, 0, 1] and list(h[:2]) == list(h[2:4])


def jaccard_truth(docs, similarity=0.8):
    split = lambda t: tuple(re.findall("[0-9a-z\x80-\U0010ffff]+", t.lower()))
    first = {}
    for i, t in sorted(docs):
        first.setdefault(split(t), i)
    sets = {i: {w[k:k + 5] for k in range(max(1, len(w) - 4))} for w, i in first.items() if w}
    near = {i: [j for j in sets if j != i and len(s & sets[j]) >= similarity * len(s | sets[j]) - 1e-9] for i, s in sets.items()}
    group = {}
    for i in sorted(sets):
        if i not in group:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in group:
                    group[x] = i
                    todo += near[x]
    out = []
    for i, t in docs:
        w = split(t)
        c = first[w] if w else i
        out.append((i, c, group[c] if w else i, len(near[c]) if w else 0))
    return sorted(out, key=repr)


def edited(rng, n, changes):
    base = ["".join(rng.choices("abcdefg", k=4)) for _ in range(n)]
    out = list(base)
    for k in rng.sample(range(n), changes):
        out[k] = "".join(rng.choices("hijk", k=4))
    return base, out


def test_jaccard_join(spark, none, monkeypatch):
    rng = random.Random(6)
    docs = [(k, " ".join(rng.choices(["the", "of", "and", "to"], k=rng.randint(0, 4)))) for k in range(12)]
    base = ["".join(rng.choices("abcdefg", k=4)) for _ in range(120)]
    for k in range(12, 60):  # one group whose members are more and less alike
        text = list(base)
        for j in rng.sample(range(120), rng.randint(0, 3)):
            text[j] = "".join(rng.choices("hijk", k=4))
        docs.append((k, " ".join(text)))
    docs += [(100, docs[20][1].upper() + "!"), (-4, docs[30][1])]
    monkeypatch.setattr(forest, "TILE_DOCS", 10)  # several tiles
    assert rows(forest.near_duplicates(table(spark, docs))) == jaccard_truth(docs)
    assert forest.near_duplicates(none).count() == 0


def test_jaccard_odd(odd):
    got = {(r.doc_id, r.copy_of, r.class_id, r.n_links) for r in forest.near_duplicates(odd).collect()}
    assert (5, 4, 4, 0) in got and (1, 1, 1, 0) in got and (7, None, None, 0) in got and (-3, None, None, 0) in got
    assert forest.distinct_documents(odd).columns == odd.columns


def test_prefix_length():
    assert forest.prefix_length(0.8, 24, 8, 0.99999) == 4
    assert forest.prefix_length(0.8, 1, 8, 0.99999) == 1


# ---- decontamination

def test_wand_is_exhaustive():
    rng = random.Random(8)
    vocab = [f"w{k}" for k in range(60)]
    items = [decontaminate.parse(k, " ".join(rng.choices(vocab, k=rng.randint(3, 30)))) for k in range(90)]
    index = decontaminate.Index(items, {}, 1000)
    for _ in range(200):
        terms = sorted(rng.sample(range(len(index.terms)), rng.randint(1, 40)))
        score = defaultdict(float)
        for t in terms:
            for d, g in zip(index.docs[t], index.gains[t]):
                score[d] += g
        for threshold in (0.2, 0.5, 0.8):
            got = index.search(terms, threshold)
            assert sorted(d for d, _ in got) == sorted(d for d, s in score.items() if s + 1e-9 >= threshold)
            assert all(abs(s - min(1, score[d])) < 1e-6 for d, s in got)


def test_decontamination(spark, odd, none):
    rng = random.Random(10)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(3, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(k, f"{text(20)}? {text(6)}.") for k in range(8)] + [(8, text(12)), (None, "no id"), (9, None), (10, " ")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    q, a = items[3][1].split("? ")
    docs = [(0, f"{text(300)} {items[0][1].upper()} {text(50)}"), (1, text(400)), (2, f"{text(40)} {q}? {text(6)}."),
            (3, f"{text(30)} {a}"), (4, f"{items[8][1]} {text(5)} {items[1][1]}"), (5, items[2][1]), (5, text(9)), (None, items[5][1])]
    got = {(r.doc_id, r.contaminated, r["items"]) for r in decontaminate.judge(table(spark, docs), bench).collect()}
    assert got == {(0, True, "0"), (1, False, ""), (2, False, ""), (3, False, ""), (4, True, "1,8"), (5, True, "2"), (5, False, ""), (None, True, "5")}
    assert {r.doc_id for r in decontaminate.clean(table(spark, docs), bench).collect()} == {1, 2, 3, 5}  # of the two rows 5 the clean one stays
    assert decontaminate.judge(none, bench).count() == 0
    assert decontaminate.judge(odd, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.judge(odd, bench).count() == len(odd_rows())


# ---- suffix dedup

def brute_repeats(docs):
    """docs: (id, bytes)."""
    low = {}
    for i, b in docs:
        for j in range(len(b) - 49):
            s = b[j:j + 50]
            low[s] = min(low.get(s, i), i)
    out = []
    for i, b in docs:
        gone = [False] * len(b)
        for j in range(len(b) - 49):
            if low[b[j:j + 50]] < i:
                gone[j:j + 50] = [True] * 50
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((None if i == -2 ** 63 else i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=repr)


def test_earliest():
    rng = random.Random(1)
    for _ in range(20):
        parts = [bytes(rng.choices(b"abc", k=rng.randint(5, 80))) for _ in range(rng.randint(1, 30))]
        ids = np.array([rng.randint(-5, 50) for _ in parts])
        low = {}
        for p, i in zip(parts, ids):
            for j in range(len(p) - 4):
                low[p[j:j + 5]] = min(low.get(p[j:j + 5], 99), i)
        for p, g in zip(parts, repeats.earliest(parts, ids, 5)):
            assert list(g) == [low[p[j:j + 5]] for j in range(len(p) - 4)]


def repeated_docs():
    rng = random.Random(12)
    text = lambda n: "".join(rng.choices("abcd é", k=n))
    shared = [text(n) for n in (49, 50, 51, 70, 300)]
    docs = [(k, text(rng.randint(0, 60)).join(rng.choices(shared, k=rng.randint(0, 4))) + text(40)) for k in range(60)]
    # one passage in every document, with other neighbours each time
    return docs + [(100 + k, text(12) + shared[4][:45] + text(30)) for k in range(60)] + [(200, "x" * 500), (201, "x" * 120), (7, docs[3][1])]


@pytest.mark.parametrize("crowded", [8000, 5])
def test_repeats(spark, crowded, monkeypatch):
    monkeypatch.setattr(repeats, "CROWDED", crowded)
    docs = repeated_docs()
    assert rows(repeats.dedup_substrings(table(spark, docs))) == brute_repeats([(i, t.encode()) for i, t in docs])


def test_repeats_odd(odd, none, monkeypatch):
    docs = [(-2 ** 63 if i is None else i, (t or "").encode()) for i, t, *_ in odd_rows()]
    assert rows(repeats.dedup_substrings(odd)) == brute_repeats(docs)
    assert repeats.dedup_substrings(none).count() == 0
    monkeypatch.setattr(repeats, "STRETCH", 1000)  # long texts in pieces
    assert [x for *_, n, h in repeats.sections(docs[3][1][:5000]) for x in n] and sum(
        n.sum() for *_, n, _ in repeats.sections(docs[3][1][:5000])) == 4951


# ---- queries and pipeline

@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_queries_against_sql(spark, name):
    got = compare(spark, connect(SMALL), SMALL, name, catalog.QUERIES[name], catalog.ORACLES[name])
    assert got[0], got[1]


@pytest.mark.parametrize("name,columns", [
    ("op1_jaccard_join", {"doc_id", "class_id", "n_links"}), ("op2_language_id", {"doc_id", "held_out", "lang_pred", "score"}),
    ("op4_secret_scan", {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"}),
    ("op5_suffix_dedup", {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"}), ("op7_decontamination", {"doc_id", "contaminated"}),
    ("op9_sharding", {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}),
    ("op10_pii", {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"})])
def test_queries_are_whole(spark, name, columns):
    df = catalog.QUERIES[name](spark, SMALL)
    assert columns <= set(df.columns) and df.count() == catalog.documents(spark, SMALL).count()


def test_pipeline(spark):
    docs = catalog.documents(spark, SMALL)
    held, stages = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.checkpointed(stage(spark, held, SMALL))
        stages[name] = (held, out)
        if name != "sharding":
            assert out.columns == docs.columns
        held = out
    pairs = lambda d: [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()]
    before, after = stages["near_copies"]
    assert {i for i, _ in pairs(after)} == {i for i, _, c, _ in jaccard_truth(pairs(before)) if i == c}
    before, after = stages["decontamination"]
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    norm = lambda t: " ".join(re.findall("[0-9a-z\x80-\U0010ffff]+", t.lower()))
    dirty = {i for i, t in pairs(before) if any(norm(x) in norm(t) for x in items)}
    assert {i for i, _ in pairs(before)} - {i for i, _ in pairs(after)} == dirty
    before, after = stages["mixing"]
    n = lambda d: sum(len(re.findall(r"[^\x20\x09-\x0d]+", t)) for _, t in pairs(d))
    assert n(before) * 3 // 4 - 200 <= n(after)
    before, after = stages["sharding"]
    assert before.count() == after.count()
    assert len(rows(corpus_pipeline.run(spark, SMALL))) == after.count()


def test_pipeline_stages_on_empty(spark):
    docs = catalog.documents(spark, SMALL).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).count() == 0
