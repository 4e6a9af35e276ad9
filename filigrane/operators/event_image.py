"""Clusters of the events of one image in memory, as `events.cluster_events` finds them by joins."""
from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Rows of an image's group: a disc of an event's region (x, y, reach), or an event (x, y, its extent).
GIVEN = "image_id long, ev string, disc boolean, x double, y double, w double"
FOUND = "image_id long, ev string, x double, y double, extent double, cluster string"
_SCHEMA = pa.schema([("image_id", pa.int64()), ("ev", pa.string()), ("x", pa.float64()), ("y", pa.float64()), ("extent", pa.float64()), ("cluster", pa.string())])
#: Distances that one step measures.
STEP = 1 << 20


def meeting(x, y, w, first, n, a, others):
    """Of `others`, the events some disc of which meets a disc of event a. Discs stand event by event."""
    hit, s = np.zeros(len(others), bool), 0
    ends = np.cumsum(n[others])
    while s < len(others):
        t = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + STEP // n[a], "right")))
        m = n[others[s:t]]
        start = np.cumsum(m) - m
        d = np.arange(m.sum()) - np.repeat(start, m) + np.repeat(first[others[s:t]], m)
        rows = max(1, STEP // len(d))
        for k in range(first[a], first[a] + n[a], rows):
            mine = slice(k, min(k + rows, first[a] + n[a]))
            dx, dy = x[mine, None] - x[d], y[mine, None] - y[d]
            near = np.sqrt(dx * dx + dy * dy) < w[mine, None] + w[d]
            hit[s:t] |= np.logical_or.reduceat(near.any(axis=0), start)
        s = t
    return others[hit]


def complete_linkage(fits, a, b, d):
    """Cluster of every item (its smallest one), nearest pairs first, ties by a and b; two clusters join when every two of their items fit.
    fits: a square of booleans, true on its diagonal."""
    fits = fits.copy()
    cluster = np.arange(len(fits))
    members = [[k] for k in range(len(fits))]
    order = np.lexsort((b, a, d))
    for p, q in zip(a[order].tolist(), b[order].tolist()):
        p, q = cluster[p], cluster[q]
        if p == q or not fits[p, q]:
            continue
        p, q = min(p, q), max(p, q)
        cluster[members[q]] = p
        members[p] += members[q]
        fits[p] &= fits[q]
        fits[:, p] = fits[p]
    return cluster


def clusters(table: pa.Table) -> pa.Table:
    """The group of an image (GIVEN) to its events (FOUND). Every event has a disc."""
    ev, disc, x, y, w = (table[c].to_numpy() for c in ("ev", "disc", "x", "y", "w"))
    names, ev = np.unique(ev.astype(str), return_inverse=True)
    disc = disc.astype(bool)
    at = np.flatnonzero(~disc)
    at = at[np.argsort(ev[at])]
    ex, ey, extent = x[at], y[at], w[at]
    on = np.flatnonzero(disc)
    on = on[np.argsort(ev[on], kind="stable")]
    x, y, w = x[on], y[on], w[on]
    n = np.bincount(ev[on], minlength=len(names))
    first = np.cumsum(n) - n
    fits, pairs = np.eye(len(names), dtype=bool), []
    for a in range(len(names) - 1):
        dx, dy = ex[a] - ex[a + 1:], ey[a] - ey[a + 1:]
        d = np.sqrt(dx * dx + dy * dy)
        fits[a, a + 1:] = fits[a + 1:, a] = near = d <= extent[a] + extent[a + 1:]
        b = meeting(x, y, w, first, n, a, np.flatnonzero(near) + a + 1)
        pairs.append((np.full(len(b), a), b, d[b - a - 1]))
    cluster = complete_linkage(fits, *map(np.concatenate, zip(*pairs))) if pairs else np.arange(len(names))
    image = np.full(len(names), table["image_id"][0].as_py())
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip((image, names, ex, ey, extent, names[cluster]), _SCHEMA)], schema=_SCHEMA)
