"""Clamped uniform B-splines by a basis table joined to the control points.

The table depends only on the number of control points and of parameters, so it is made once per number of control
points; positions and derivatives are then plain sums of basis times control value.
"""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filigrane.session import checkpointed


def _basis(n: int, k: int, u: float):
    """Values of the n basis functions of degree k on clamped uniform knots at u in [0, 1]."""
    t = [0.0] * (k + 1) + [j / (n - k) for j in range(1, n - k)] + [1.0] * (k + 1)
    span = k
    while span < n - 1 and u >= t[span + 1]:
        span += 1
    b = [1.0 if j == span else 0.0 for j in range(n + k)]
    for d in range(1, k + 1):
        b = [(0.0 if t[j + d] == t[j] else (u - t[j]) / (t[j + d] - t[j]) * b[j])
             + (0.0 if t[j + d + 1] == t[j + 1] else (t[j + d + 1] - u) / (t[j + d + 1] - t[j + 1]) * b[j + 1])
             for j in range(n + k - d)]
    return b[:n]


def _derived(n: int, k: int, u: float, order: int):
    if order == 0 or k == 0:
        return _basis(n, k, u) if order == 0 else [0.0] * n
    t = [0.0] * (k + 1) + [j / (n - k) for j in range(1, n - k)] + [1.0] * (k + 1)
    # the derivative is a spline of one degree less over the inner knots; its coefficients are differences
    low = _derived(n - 1, k - 1, u, order - 1)
    out = [0.0] * n
    for j in range(n - 1):
        s = k / (t[j + k + 1] - t[j + 1]) if t[j + k + 1] > t[j + 1] else 0.0
        out[j + 1] += s * low[j]
        out[j] -= s * low[j]
    return out


def basis_table(curves: DataFrame, col: str, m: int) -> DataFrame:
    """n_ctrl, ui, u, j, b0, b1, b2 for m + 1 evenly spaced parameters and every control-point count that occurs. The
    counts stay a table, however many there are."""
    def rows(batches):
        for b in batches:
            out = [(n, q, q / m, j, *v) for n in b.column(0).to_pylist() if n and n > 0 for q in range(m + 1)
                   for j, v in enumerate(zip(*(_derived(n, min(3, n - 1), q / m, o) for o in (0, 1, 2))))]
            names = ("n_ctrl", "ui", "u", "j", "b0", "b1", "b2")
            kinds = (pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.float64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)
    return curves.select(F.size(col).alias("n")).distinct().mapInArrow(
        rows, "n_ctrl INT, ui INT, u DOUBLE, j INT, b0 DOUBLE, b1 DOUBLE, b2 DOUBLE")


def _basis_rows(curves: DataFrame, col: str, m: int, name: str) -> DataFrame:
    """The basis table with a row per number of control points and parameter: {name} n, ui, u, the values b0, b1, b2 of all control
    points and bp, those at the parameter before. Written once: a plan over the curves would look as large as they are, and they
    would be shuffled to meet it."""
    t = basis_table(curves, col, m).groupBy("n_ctrl", "ui", "u").agg(F.array_sort(F.collect_list(F.struct("j", "b0", "b1", "b2"))).alias("b"))
    w = Window.partitionBy("n_ctrl").orderBy("ui")
    return checkpointed(t.selectExpr("n_ctrl", "ui", "u", *[f"b.{c} as {c}" for c in ("b0", "b1", "b2")]).withColumn("bp", F.lag("b0").over(w))
                        .withColumnsRenamed({c: f"{name}{c}" for c in ("n_ctrl", "b0", "b1", "b2", "bp")}))


def _weighted(basis: str, values: str) -> str:
    """Sum of basis times control value, nulls left out as in a grouped sum."""
    return f"aggregate(zip_with({basis}, {values}, (b, v) -> b * v), cast(null as double), (s, v) -> coalesce(s + v, s, v))"


def sample_curves(edges: DataFrame, m: int, ident=("vid",), profiles: dict | None = None) -> DataFrame:
    """ident, ui, u, x, y, the point before (px, py; null at the start), unit tangent tx, ty and signed curvature kappa of the
    curves `ctrl`; with profiles {name: column of control values} their values at the same parameters. An edge is sampled in its
    own row: nothing but the basis tables is shuffled."""
    s = edges.withColumn("_cn_ctrl", F.size("ctrl")).join(_basis_rows(edges, "ctrl", m, "_c"), "_cn_ctrl")
    for k, col in enumerate((profiles or {}).values()):
        t = _basis_rows(edges, col, m, f"_p{k}").drop("u", f"_p{k}b1", f"_p{k}b2", f"_p{k}bp")
        s = s.withColumn(f"_p{k}n_ctrl", F.size(col)).join(t, [f"_p{k}n_ctrl", "ui"])
    s = s.selectExpr(
        *ident, "ui", "u", *[f"{_weighted(f'_cb{o}', f'ctrl.{a}')} as {a}{o}" for a in "xy" for o in range(3)],
        *[f"{_weighted('_cbp', f'ctrl.{a}')} as p{a}" for a in "xy"],
        *[f"{_weighted(f'_p{k}b0', col)} as {out}" for k, (out, col) in enumerate((profiles or {}).items())])
    sp = "greatest(sqrt(x1 * x1 + y1 * y1), 1e-12D)"
    return s.selectExpr(*ident, "ui", "u", "x0 as x", "y0 as y", "px", "py", f"x1 / {sp} as tx", f"y1 / {sp} as ty",
                        f"(x1 * y2 - y1 * x2) / power({sp}, 3) as kappa", *(profiles or {}))


def sample_profile(edges: DataFrame, col: str, m: int, out: str, ident=("vid",)) -> DataFrame:
    """Values of a profile (its control values over the edge) at the same parameters."""
    s = edges.withColumn("_pn_ctrl", F.size(col)).join(_basis_rows(edges, col, m, "_p"), "_pn_ctrl")
    return s.selectExpr(*ident, "ui", f"{_weighted('_pb0', col)} as {out}")
