"""Scalar functions as SQL expressions over columns, usable in selectExpr and in plain SQL of either engine."""
from __future__ import annotations

from filigrane.tables import G_RES_GAP, G_RES_RHO


def clip(e: str, lo, hi) -> str:
    return f"least(greatest({e}, {lo}), {hi})"


def angle_deg(y: str, x: str) -> str:
    """Direction of a vector."""
    return f"degrees(atan2({y}, {x}))"


def angle_between_deg(ax: str, ay: str, bx: str, by: str) -> str:
    """Angle between two unit vectors."""
    return f"degrees(acos({clip(f'({ax}) * ({bx}) + ({ay}) * ({by})', '-1.0', '1.0')}))"


def acute_angle_deg(ax: str, ay: str, bx: str, by: str) -> str:
    """Angle between two undirected lines."""
    return f"degrees(acos(least(1.0, abs(({ax}) * ({bx}) + ({ay}) * ({by})))))"


def line_offset(px: str, py: str, ux: str, uy: str, qx: str, qy: str) -> str:
    """Distance of q from the line through p along the unit vector u."""
    return f"abs((({qy}) - ({py})) * ({ux}) - (({qx}) - ({px})) * ({uy}))"


def piecewise(x: str, knots, values) -> str:
    """Linear table lookup, held beyond the ends."""
    parts = [f"when {x} <= {knots[0]!r} then {values[0]!r}"]
    for k0, k1, v0, v1 in zip(knots, knots[1:], values, values[1:]):
        parts.append(f"when {x} <= {k1!r} then {v0!r} + ({x} - {k0!r}) / ({k1!r} - {k0!r}) * ({v1!r} - {v0!r})")
    return "case " + " ".join(parts) + f" else {values[-1]!r} end"


def g_blur(sa: str, sb: str) -> str:
    return f"sqrt(0.5 * (power({sa}, 2) + power({sb}, 2)))"


def g_rho(ra: str, rb: str, blur: str) -> str:
    return f"(least({ra}, {rb}) / greatest({blur}, 1e-6))"


def g_res_at(rho: str, blur: str) -> str:
    return f"({blur} * ({piecewise(rho, G_RES_RHO, G_RES_GAP)}))"


def g_res(ra: str, rb: str, sa: str, sb: str) -> str:
    """Gap below which two lines of these radii and blurs look like one."""
    blur = g_blur(sa, sb)
    return g_res_at(g_rho(ra, rb, blur), blur)


def smoothstep(e: str, lo: str, hi: str) -> str:
    t = clip(f"(({e}) - ({lo})) / (({hi}) - ({lo}))", "0.0", "1.0")
    return f"({t}) * ({t}) * (3.0 - 2.0 * ({t}))"


def log_floor(e: str, floor: str = "1e-6") -> str:
    return f"ln(greatest({e}, {floor}))"


def significant(e: str, digits: int, log10: str = "log10") -> str:
    """Rounded to so many significant digits (0 stays 0)."""
    scale = f"power(10.0, {digits} - 1 - floor({log10}(abs({e}))))"
    return f"case when ({e}) = 0 then 0.0 else floor(({e}) * {scale} + 0.5) / {scale} end"


def in_frame(x: str, y: str, w, h, margin="0.0") -> str:
    """Inside the frame, pixel centres at integers, with a margin."""
    return (f"({x} between -0.5 - {margin} and {w} - 0.5 + {margin} "
            f"and {y} between -0.5 - {margin} and {h} - 0.5 + {margin})")


def doubles(sql: str) -> str:
    """Numeric literals of a shared expression as doubles for Spark (which reads 0.5 as a decimal)."""
    import re
    return re.sub(r"(?<![\w.])(\d+\.\d+|\d+(?:\.\d+)?e-?\d+)(?![\w.])", r"\1D", sql)
