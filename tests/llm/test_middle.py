"""Fill-in-middle against plain string code and its own round trip."""
from __future__ import annotations

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from filigrane.llm import middle
from tests.llm.test_operators import odd_rows, table


def brute(text, doc_id, rate=100, spm=50, seed=7, unit="line"):
    text = text or ""
    units = list(text) if unit == "char" else re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k:k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, None)))
    if h4 % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a\n\r<PSM>é€😀 ", max_size=90), st.integers(-9, 10 ** 12), st.sampled_from(middle.UNITS), st.sampled_from([1, 2, 4, 7, 64]))
def test_cuts(text, doc_id, unit, block):
    got = middle.rearrange(text, doc_id, 100, 50, 7, unit, block)
    assert tuple(got.values()) == brute(text, doc_id, unit=unit)


@given(st.binary(max_size=40), st.integers(1, 9))
def test_every_cut(raw, block):
    text = raw.decode("latin-1")
    tree = middle.BlockTree(text.encode(), "char", block)
    for k in range(len(text) + 1):
        assert tree.cut(k) == (len(text[:k].encode()), k)


@pytest.mark.parametrize("rate, spm, unit", [(100, 50, "line"), (40, 0, "char"), (0, 50, "line"), (100, 100, "char")])
def test_table(spark, rate, spm, unit):
    rng = random.Random(4)
    docs = odd_rows() + [(100 + k, "".join(rng.choices("ab\né€😀<", k=rng.randint(0, 6000)))) for k in range(60)]
    docs += [(900, "ends in a newline\n"), (901, "with <M> inside"), (902, "\n"), (903, "<<S"), (None, "x\ny\nz")]
    out = middle.fill_in_middle(table(spark, docs), rate=rate, spm=spm, unit=unit)
    got = out.select("*", middle.restored("output", "form").alias("back")).collect()
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted(((d[0], *brute(d[1], d[0], rate, spm, 7, unit)) for d in docs), key=repr)
    assert sorted(((r.doc_id, r.back) for r in got), key=repr) == sorted(((d[0], d[1] or "") for d in docs), key=repr)


def test_empty_table_and_unknown_unit(spark):
    assert middle.fill_in_middle(table(spark, [])).count() == 0
    with pytest.raises(ValueError):
        middle.BlockTree(b"x", "word")
