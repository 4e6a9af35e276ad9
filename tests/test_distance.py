"""The exact distance transform against all pairs, and masks of known width."""
import random

from filigrane.operators import distance as D


def masks():
    """Random masks from sparse to nearly full, bars, a disc, an image all on, one all off, single rows and columns."""
    rng = random.Random(4)
    out = [[[rng.random() < p for _ in range(w)] for _ in range(h)] for p, h, w in
           ((0.3, 12, 17), (0.8, 30, 9), (0.97, 25, 25), (0.995, 40, 31), (0.9, 1, 40), (0.9, 40, 1))]
    out.append([[7 <= y < 12 for _ in range(20)] for y in range(20)])
    out.append([[(y - 10) ** 2 + (x - 10) ** 2 <= 36 for x in range(21)] for y in range(21)])
    return out + [[[True] * 5] * 4, [[False] * 5] * 4, [[x != 3 for x in range(30)] for _ in range(3)]]


def test_distances(spark):
    rows = [(k, y, x, on) for k, m in enumerate(masks()) for y, r in enumerate(m) for x, on in enumerate(r)]
    got = {(r.image_id, r.y, r.x): r.d2 for r in D.distance_transform(spark.createDataFrame(rows, "image_id long, y long, x long, inside boolean"), "inside").collect()}
    want = {}
    for k, m in enumerate(masks()):
        off = [(y, x) for y, r in enumerate(m) for x, on in enumerate(r) if not on]
        for y, r in enumerate(m):
            for x, on in enumerate(r):
                if on:
                    want[k, y, x] = min(((y - a) ** 2 + (x - b) ** 2 for a, b in off), default=None)
    assert got == want
    assert max(v for (k, *_), v in got.items() if k == 6) == 9  # a bar of five rows: three to the outside from its middle


def test_empty(spark):
    assert D.distance_transform(spark.createDataFrame([], "image_id long, y long, x long, inside boolean"), "inside").count() == 0
