"""Shares of overlapping claims against a position-by-position computation."""
import random

import pytest

from filigrane.operators import runs as R


def naive(claims):
    best = {}
    for v, c, lo, hi, at in claims:
        for i in range(lo, hi + 1):
            best[v, i] = min(best.get((v, i), (10 ** 9,)), (abs(i - at), c))
    out, last = [], None
    for (v, i), (_, c) in sorted(best.items()):
        if last and last[0] == v and last[2] == i - 1 and last[3] == c:
            last[2] = i
        else:
            last = [v, i, i, c]
            out.append(last)
    return sorted(map(tuple, out))


def shared(spark, claims, batch="10000"):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(claims, "vid long, cid long, lo long, hi long, at long")
        return sorted((r.vid, r.lo, r.hi, r.owner.cid) for r in R.share_runs(df, ["vid"], ["cid"], "at", ["cid"]).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def claims(rng, n, edges, width, far):
    out = []
    for c in range(n):
        lo = rng.randint(-200, far)
        hi = lo + rng.randint(0, width)
        out.append((rng.randint(0, edges), c % (n // 3 + 1), lo, hi, rng.randint(lo - 3, hi + 3)))
    return out


@pytest.mark.parametrize("n,edges,width,far,batch", [(300, 3, 40, 400, "10000"), (400, 2, 300, 9000, "50"), (900, 0, 60, 100, "40")])
def test_share_runs(spark, n, edges, width, far, batch, monkeypatch):
    """Ties, claims over chunk borders, gaps, repeated claims, groups in several batches, and one crowded edge."""
    data = claims(random.Random(n), n, edges, width, far)
    data += data[:20]
    assert shared(spark, data, batch) == naive(data)


def test_small_sweeps(monkeypatch):
    import pandas as pd
    rng = random.Random(2)
    data = claims(rng, 200, 5, 30, 200)
    part = pd.DataFrame([(v, 0, lo, hi, at, c, c) for v, c, lo, hi, at in sorted(data)], columns=["vid", "_ck", "lo", "hi", "_an", "_o0", "cid"])
    whole = R._envelope(part, ["vid", "_ck"], ["_o0"])
    monkeypatch.setattr(R, "SWEEP", 64)
    assert R._envelope(part, ["vid", "_ck"], ["_o0"]).values.tolist() == whole.values.tolist()
    again = R._envelope(whole, ["vid", "_ck"], ["_o0"])
    assert again.values.tolist() == whole.values.tolist()


def test_no_claims(spark):
    assert shared(spark, []) == []
