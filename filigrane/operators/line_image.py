"""The line model of one image in memory: for images that fit a task what `lines.line_fixpoint` does in rounds of joins.

Samples stand in arrays, edge after edge, and a sample is known by its place there; -1 stands for none.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa

from filigrane import tables as T

CAUSES = np.array(["junction", "fade", "merged", "border", "node"])
#: Pairs of a merged sample and a sample of the stronger line that one step measures.
STEP = 1 << 18
#: Rows of an image's group and of what is known about it: kind, keys and values by type.
GIVEN = "kind int, image_id long, " + ", ".join([*(f"l{k} long" for k in range(4)), *(f"d{k} double" for k in range(6)), "b0 boolean, b1 boolean"])
KNOWN = "kind int, image_id long, vid long, " + ", ".join(
    [*(f"l{k} long" for k in range(7)), *(f"d{k} double" for k in range(6)), *(f"b{k} boolean" for k in range(5)), "s0 string, s1 string"])
_ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}
SCHEMA = pa.schema([(n, _ARROW[t]) for n, t in (f.split() for f in KNOWN.split(","))])
SAMPLE, RECORD, CLAIM = range(3)
SAMPLES, RUNS, EDGES, DEGREE, ACTIVE = range(5)
#: The tables at rest by kind, from the rows of KNOWN.
KINDS = {
    "samples": ("image_id", "vid", "l0 as i", "d0 as x", "d1 as y", "d2 as r", "d3 as st", "d4 as ds", "d5 as prom", "b0 as in_frame", "b1 as obs",
                "l1 as owner", "b2 as absorbed", "l2 as m_vid", "l3 as m_i", "b3 as line", "b4 as fill", "l4 as inner"),
    "runs": ("image_id", "vid", "l0 as run", "l1 as a", "l2 as b", "s0 as start_cause", "s1 as end_cause",
             "case when l3 is not null then struct(l3 as vid, l4 as i) end as start_into", "case when l5 is not null then struct(l5 as vid, l6 as i) end as end_into"),
    "edges": ("image_id", "vid", "l0 as run", "l1 as i0", "l2 as i1", "l3 as u", "l4 as w", "l5 as p0", "l6 as p1", "b0 as linked", "b1 as stub"),
    "degree": ("image_id", "l0 as jid", "l1 as n_lines"),
    "active": ("image_id", "l0 as jid"),
}


def _spans(lo, hi):
    """All positions of the spans lo..hi one after the other, and the span each belongs to."""
    n = np.maximum(hi - lo + 1, 0)
    of = np.repeat(np.arange(len(lo)), n)
    return np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + lo[of], of


def _starts(*cols):
    """True where a row differs from the one before it in some column."""
    new = np.ones(len(cols[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
    return new


def _medians(value, first, n, group):
    v = value[np.lexsort((value, group))]
    lo, hi = v[first + (n - 1) // 2], v[first + n // 2]
    return lo + (hi - lo) * np.where(n % 2 == 0, 0.5, 0.0)


def _give_back(pieces, far):
    """A-B-A without gaps: the piece of A farther from A goes to B, the first triple first. pieces: [lo, hi, owner] of one edge in order."""
    k = 0
    while k + 2 < len(pieces):
        p, q, n = pieces[k:k + 3]
        if not (p[1] + 1 == q[0] and q[1] + 1 == n[0] and p[2] == n[2] != q[2]):
            k += 1
            continue
        a, b = (k, k + 1) if far(p) > far(n) else (k + 1, k + 2)
        if a > 0 and pieces[a - 1][2] == q[2] and pieces[a - 1][1] + 1 == pieces[a][0]:
            a -= 1
        if b + 1 < len(pieces) and pieces[b + 1][2] == q[2] and pieces[b][1] + 1 == pieces[b + 1][0]:
            b += 1
        pieces[a:b + 1] = [[pieces[a][0], pieces[b][1], q[2]]]
        k = max(0, a - 2)
    return pieces


class Image:
    """samples: vid, i, x, y, r, st, ds, prom, in_frame, obs; records: a, b, i, j, distinct; claims: vid, jid, lo, hi, cx, cy. All arrays; positions of
    an edge are dense from 0."""

    def __init__(self, samples, records, claims, bridge, arm):
        self.bridge, self.arm = bridge, arm
        vid, i, *rest = samples
        order = np.lexsort((i, vid))
        self.x, self.y, self.r, self.st, self.ds, self.prom, self.in_frame, self.obs = (c[order] for c in rest)
        self.i, n = i[order], len(order)
        self.at = np.arange(n)
        self.vids, self.first, self.edge, size = np.unique(vid[order], return_index=True, return_inverse=True, return_counts=True)
        self.last = self.first + size - 1
        self.lo, self.hi = self.first[self.edge], self.last[self.edge]
        a, b, p, q = records
        (ea, ka), (eb, kb) = self._edge(a), self._edge(b)
        p, q = self.first[ea] + p, self.first[eb] + q
        ok = ka & kb & (p >= self.first[ea]) & (p <= self.last[ea]) & (q >= self.first[eb]) & (q <= self.last[eb])
        rec = np.stack([ea[ok], eb[ok], p[ok], q[ok]])
        self.rec = rec[:, np.lexsort(rec[::-1])]
        v, jid, lo, hi, cx, cy = claims
        e, known = self._edge(v)
        self.jids, at, j = np.unique(jid, return_index=True, return_inverse=True)
        self.cx, self.cy = cx[at], cy[at]
        lo, hi = np.maximum(self.first[e] + lo, self.first[e]), np.minimum(self.first[e] + hi, self.last[e])
        claims = np.stack([e, lo, hi, j])[:, known & (lo <= hi)]
        self.claims = claims[:, np.lexsort(claims[1::-1])]
        self.active = np.unique(j)

    def _edge(self, vid):
        e = np.minimum(np.searchsorted(self.vids, vid), len(self.vids) - 1)
        return e, self.vids[e] == vid

    def settle(self):
        """Rounds until every junction left has three lines and no stub is left."""
        self.absorbed = np.zeros(len(self.at), bool)
        while True:
            self.state()
            lost = self.active[self.degree[self.active] <= 2]
            stub = _spans(self.e_i0[self.e_stub], self.e_i1[self.e_stub])[0]
            new = stub[~self.absorbed[stub]]
            if not len(lost) and not len(new):
                return self
            self.active = np.setdiff1d(self.active, lost)
            self.claims = self.claims[:, ~np.isin(self.claims[3], lost)]
            self.absorbed[new] = True

    def _before(self, mask, own=True):
        """Per sample the latest one of the mask on its edge, itself among them or not."""
        p = np.maximum.accumulate(np.where(mask, self.at, -1)) if len(mask) else self.at
        if not own:
            p = np.concatenate([[-1], p[:-1]])[:len(mask)]
        return np.where(p >= self.lo, p, -1)

    def _after(self, mask, own=True):
        n = len(mask)
        p = np.minimum.accumulate(np.where(mask, self.at, n)[::-1])[::-1] if n else self.at
        if not own:
            p = np.concatenate([p[1:], [n]])[:n]
        return np.where(p <= self.hi, p, -1)

    def owners(self):
        """Claims put in order, as lines.owners: edge, lo, hi, owner."""
        e, lo, hi, j = self.claims
        new = _starts(e, j)
        new[1:] |= lo[1:] - hi[:-1] - 1 >= self.arm / self.ds[self.first[e[1:]]]
        at = np.flatnonzero(new)
        e, lo, hi, j = e[at], lo[at], np.maximum.reduceat(hi, at) if len(at) else hi, j[at]
        if len(e) < 3:
            return e, lo, hi, j
        mid = (e[2:] == e[:-2]) & (hi[:-2] + 1 == lo[1:-1]) & (hi[1:-1] + 1 == lo[2:]) & (j[2:] == j[:-2]) & (j[1:-1] != j[:-2])
        turn = np.unique(e[1:-1][mid])
        if not len(turn):
            return e, lo, hi, j

        def far(piece):
            at, c = slice(piece[0], piece[1] + 1), piece[2]
            return np.sqrt((self.x[at] - self.cx[c]) ** 2 + (self.y[at] - self.cy[c]) ** 2).min()
        keep = ~np.isin(e, turn)
        rows = [np.stack([e[keep], lo[keep], hi[keep], j[keep]])]
        for v in turn:
            on = e == v
            pieces = _give_back([list(p) for p in zip(lo[on].tolist(), hi[on].tolist(), j[on].tolist())], far)
            rows.append(np.array([[v, *p] for p in pieces]).T)
        rows = np.concatenate(rows, axis=1)
        return rows[:, np.lexsort(rows[1::-1])]

    def merged(self, owner):
        """Per sample the one of a stronger line that it lies in, as lines.merged_into."""
        into, gap, total = np.full(len(self.at), -1), self.bridge, len(self.at)
        free = self.obs & (owner < 0)
        a, b, p, q = self.rec[:, free[self.rec[2]] & free[self.rec[3]]]
        if not len(a):
            return into
        new = _starts(a, b)
        new[1:] |= p[1:] - p[:-1] > gap
        f = np.flatnonzero(new)
        g, n = np.cumsum(new) - 1, np.diff(np.append(f, len(a)))
        (pa_, ra, sa), (pb, rb, sb) = ([_medians(c[k], f, n, g) for c in (self.prom, self.r, self.st)] for k in (p, q))
        a_weaker = (pa_ < pb) | ((pa_ == pb) & ((ra < rb) | ((ra == rb) & (a[f] > b[f]))))
        fits = np.maximum(sa, sb) <= T.MERGE_BLUR_RATIO * np.minimum(sa, sb)
        i0, i1, j0, j1 = (m.reduceat(c, f) for c in (p, q) for m in (np.minimum, np.maximum))
        sub, dom, lo, hi, d0, d1 = (np.where(a_weaker, s, t)[fits] for s, t in (
            (a[f], b[f]), (b[f], a[f]), (i0, j0), (i1, j1), (j0, i0), (j1, i1)))
        # what a position of an edge is unresolved from on another one, and every position within `gap` of it
        wide = total + 2 * gap + 1
        key = (np.concatenate([a, b]) * len(self.vids) + np.concatenate([b, a])) * wide + np.concatenate([p, q]) + gap
        order = np.argsort(key, kind="stable")
        key, other = key[order], np.concatenate([q, p])[order]
        f = np.flatnonzero(_starts(key))
        key, least, most = key[f], np.minimum.reduceat(other, f), np.maximum.reduceat(other, f)
        k, of = _spans(lo, hi)
        on = free[k]
        k, of = k[on], of[on]
        base = (sub[of] * len(self.vids) + dom[of]) * wide + k + gap
        left, right = np.searchsorted(key, base - gap), np.searchsorted(key, base + gap, "right")
        on = right > left
        k, of, left, right = k[on], of[on], left[on], right[on]
        m0, m1 = least[left], most[left]
        for step in range(1, 2 * gap + 1):
            nxt = np.minimum(left + step, right - 1)
            m0, m1 = np.minimum(m0, least[nxt]), np.maximum(m1, most[nxt])
        m0, m1 = np.maximum(m0, d0[of]) - gap, np.minimum(m1, d1[of]) + gap
        m0, m1 = np.minimum(m0, m1), np.maximum(m0, m1)  # sequence() counts down too
        m0, m1 = np.maximum(m0, self.first[dom[of]]), np.minimum(m1, self.last[dom[of]])
        on = m0 <= m1
        k, of, m0, m1 = k[on], of[on], m0[on], m1[on]
        if not len(k):
            return into
        j, d = np.empty(len(k), np.int64), np.empty(len(k))
        ends, s = np.cumsum(m1 - m0 + 1), 0
        while s < len(k):
            t = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + STEP, "right")))
            c, row = _spans(m0[s:t], m1[s:t])
            d2 = (self.x[k[s:t]][row] - self.x[c]) ** 2 + (self.y[k[s:t]][row] - self.y[c]) ** 2
            start = np.flatnonzero(_starts(row))
            d[s:t] = np.minimum.reduceat(d2, start)
            hit = np.flatnonzero(d2 == d[s:t][row])
            j[s:t] = c[hit[np.searchsorted(hit, start)]]
            s = t
        order = np.lexsort((j, d, lo[of], dom[of], k))
        order = order[_starts(k[order], dom[of][order], lo[of][order])]
        k, of, j = k[order], of[order], j[order]
        order = np.lexsort((j, -dom[of], self.prom[j], k))
        k, j = k[order], j[order]
        best = np.append(np.flatnonzero(_starts(k))[1:], len(k)) - 1
        into[k[best]] = j[best]
        # chains to their end; what runs in a circle merges into nothing
        k = k[best]
        for _ in range(max(1, len(k).bit_length())):
            t = into[into[k]]
            if not (t >= 0).any():
                return into
            into[k] = np.where(t >= 0, t, into[k])
        into[k[into[into[k]] >= 0]] = -1
        return into

    def extended(self, line, can, lo, hi):
        """Lines carried on into claims, as events.extend_lines."""
        line, reach, n = line.copy(), self.bridge, len(line)
        if not len(lo):
            return line
        f, z = self.lo[lo], self.hi[lo]
        while True:
            b, a = self._before(line), self._after(line)
            left = np.where(lo > f, b[np.maximum(lo - 1, 0)], -1)
            left = np.where((left >= 0) & (lo - left <= reach), left, -1)
            right = np.where(hi < z, a[np.minimum(hi + 1, n - 1)], -1)
            right = np.where((right >= 0) & (right - hi <= reach), right, -1)
            last = np.where(b[hi] >= lo, b[hi], lo)
            first = np.where((a[lo] >= 0) & (a[lo] <= hi), a[lo], hi)
            f0 = np.where(left >= 0, left + 1, first)
            f1 = np.where(right >= 0, right - 1, last)
            on = ((left >= 0) | (right >= 0)) & (f0 <= f1)
            cover = np.zeros(n + 1, np.int64)
            np.add.at(cover, f0[on], 1)
            np.add.at(cover, f1[on] + 1, -1)
            new = (np.cumsum(cover[:-1]) > 0) & can & ~line
            if not new.any():
                return line
            line |= new

    def state(self):
        """Lines, runs and edges for the claims and absorbed samples as they are, as lines.line_state."""
        bk, none = self.bridge, self.at[:0]
        ce, clo, chi, cj = self.owners()
        owner = np.full(len(self.at), -1)
        k, of = _spans(clo, chi)
        owner[k] = cj[of]
        self.owner, self.into = owner, self.merged(owner)
        base = self.obs & (self.into < 0) & ~self.absorbed
        line = self.extended(base, self.in_frame & (~self.absorbed | (owner >= 0)), clo, chi)
        self.fill, self.inner = line & ~base, np.full(len(self.at), -1)
        # stretches of one owner within the lines, and the runs they make up
        k = np.flatnonzero(line)
        o = owner[k]
        new = _starts(self.edge[k], o)
        new[1:] |= k[1:] != k[:-1] + 1
        f = np.flatnonzero(new)
        end = np.append(f[1:], len(k)) - 1
        lo, hi, jid = (k[f], k[end], o[f]) if len(k) else (none, none, none)
        att = lo
        if len(k) and len(self.jids):
            d2 = np.where(o >= 0, (self.x[k] - self.cx[o]) ** 2 + (self.y[k] - self.cy[o]) ** 2, 0.0)
            d2 = np.where(np.isnan(d2), 0.0, d2)
            hit = np.flatnonzero(d2 == np.minimum.reduceat(d2, f)[np.cumsum(new) - 1])
            att = k[hit[np.searchsorted(hit, f)]]
        e = self.edge[lo]
        new = _starts(e)
        new[1:] |= lo[1:] != hi[:-1] + 1
        run = np.cumsum(new) - 1
        f = np.flatnonzero(new)
        end = np.append(f[1:], len(lo)) - 1 if len(lo) else f
        a, b, j0, j1, pieces, re = lo[f], hi[end], jid[f], jid[end], end - f + 1, e[f]
        number = np.arange(len(f)) - np.searchsorted(re, re) + 1
        inside = (pieces == 1) & (j0 >= 0)
        # what ends a run: the first of a merged sample, one out of the frame and the edge's own end, with fewer than `bridge`
        # samples before it that are not absorbed
        ca = np.cumsum(self.absorbed)
        ca = ca - ca[self.lo] + self.absorbed[self.lo]  # absorbed ones of the edge up to a sample
        pm, po = (self._before(m, False)[a] for m in (self.into >= 0, ~self.in_frame))
        nm, no = (self._after(m, False)[b] for m in (self.into >= 0, ~self.in_frame))
        far = self.hi[b] + 1
        s = np.maximum(np.maximum(pm, po), self.lo[a] - 1)
        t = np.minimum(np.minimum(np.where(nm >= 0, nm, far), np.where(no >= 0, no, far)), far)
        before = s >= self.lo[a]
        beyond = t < far
        gs = a - s - 1 - (ca[a] - self.absorbed[a] - np.where(before, ca[np.where(before, s, 0)], 0))
        u = np.where(beyond, t, 0)
        gt = t - b - 1 - (np.where(beyond, ca[u] - self.absorbed[u], ca[self.hi[b]]) - ca[b])
        start = np.select([j0 >= 0, gs >= bk, before & (s == pm), before], [0, 1, 2, 3], 4)
        stop = np.select([j1 >= 0, gt >= bk, beyond & (t == nm), beyond], [0, 1, 2, 3], 4)
        start_into = np.where(start == 2, self.into[np.where(start == 2, s, 0)], -1)
        end_into = np.where(stop == 2, self.into[np.where(stop == 2, np.minimum(t, len(self.at) - 1), 0)], -1)
        # edges: free stretches, and a link between claims that touch
        with_b = np.zeros(len(lo), bool)
        with_b[1:] = run[1:] == run[:-1]
        with_f = np.append(with_b[1:], False) if len(lo) else with_b
        prev, nxt = np.maximum(np.arange(len(lo)) - 1, 0), np.minimum(np.arange(len(lo)) + 1, len(lo) - 1)
        linked = (jid >= 0) & with_b & (jid[prev] >= 0)
        keep = (jid < 0) | linked
        i0, i1 = lo, np.where(linked, lo - 1, hi)
        u = np.where(with_b, jid[prev], -1)
        w = np.where(linked, jid, np.where(with_f, jid[nxt], -1))
        p0 = np.where(with_b, att[prev], lo)
        p1 = np.where(linked, att, np.where(with_f, att[nxt], hi))
        run, i0, i1, u, w, p0, p1, linked = (c[keep] for c in (run, i0, i1, u, w, p0, p1, linked))
        ds = self.ds[self.lo[i0]]
        pa_, na = self._before(~self.absorbed, False)[i0], self._after(~self.absorbed, False)[i1]
        pa_, na = np.where(pa_ >= 0, pa_, self.lo[i0] - 1), np.where(na >= 0, na, self.hi[i0] + 1)
        length = (i1 - i0 + 1 + (i0 - 1 - pa_) + (na - i1 - 1)) * ds
        cs, ct = start[run], stop[run]
        stub = (~linked & (length < self.arm) & ((u < 0) | (w < 0)) & ~((u < 0) & (cs == 4)) & ~((w < 0) & (ct == 4))
                & ~((u < 0) & (w >= 0) & (cs == 3)) & ~((w < 0) & (u >= 0) & (ct == 3)))
        # a short piece between two stretches merged into lines of one junction is part of that junction
        loose = (pieces[run] == 1) & ~stub & (cs == 2) & (ct == 2) & ((i1 - i0 + 1) * ds < self.arm)
        x, y = (owner[np.where(loose, c[run], 0)] if len(owner) else none for c in (start_into, end_into))
        loose = loose & (x >= 0) & (x == y)
        for c0, c1, cj in ((a[inside], b[inside], j0[inside]), (i0[loose], i1[loose], x[loose])):
            k, of = _spans(c0, c1)
            self.inner[k] = cj[of]
        gone = inside.copy()
        gone[run[loose]] = True
        self.line = line & (self.inner < 0)
        self.fill &= self.line
        self.r_edge, self.r_run, self.r_a, self.r_b, self.r_start, self.r_end, self.r_s_into, self.r_e_into = (
            c[~gone] for c in (re, number, a, b, start, stop, start_into, end_into))
        on = ~gone[run]
        self.e_run = number[run][on]
        self.e_i0, self.e_i1, self.e_u, self.e_w, self.e_p0, self.e_p1, self.e_linked, self.e_stub = (
            c[on] for c in (i0, i1, u, w, p0, p1, linked, stub))
        self.e_edge = self.edge[self.e_i0]
        live = np.concatenate([c[~self.e_stub] for c in (self.e_u, self.e_w)])
        self.degree = np.bincount(live[live >= 0], minlength=len(self.jids))

    def rows(self, image_id):
        """What is known at rest, as one table of all kinds."""
        parts = []

        def place(p):
            return (self.vids[self.edge[p]], p >= 0), (self.i[p], p >= 0)

        def jid(j):
            return (self.jids[j] if len(self.jids) else j, j >= 0)

        def add(kind, n, vid=None, **cols):
            def column(f):
                if f.name == "kind":
                    return pa.array(np.full(n, kind, np.int32))
                if f.name == "image_id":
                    return pa.array(np.full(n, image_id, np.int64))
                c = vid if f.name == "vid" else cols.get(f.name)
                if c is None:
                    return pa.nulls(n, f.type)
                v, ok = c if isinstance(c, tuple) else (c, None)
                return pa.array(v, f.type, mask=None if ok is None else ~ok)
            parts.append(pa.Table.from_arrays([column(f) for f in SCHEMA], schema=SCHEMA))
        m = place(self.into)
        add(SAMPLES, len(self.i), self.vids[self.edge], l0=self.i, l1=jid(self.owner), l2=m[0], l3=m[1], l4=jid(self.inner), d0=self.x, d1=self.y, d2=self.r,
            d3=self.st, d4=self.ds, d5=self.prom, b0=self.in_frame, b1=self.obs, b2=self.absorbed, b3=self.line, b4=self.fill)
        s, t = place(self.r_s_into), place(self.r_e_into)
        off = self.first[self.r_edge]
        add(RUNS, len(off), self.vids[self.r_edge], l0=self.r_run, l1=self.r_a - off, l2=self.r_b - off, l3=s[0], l4=s[1], l5=t[0], l6=t[1],
            s0=CAUSES[self.r_start], s1=CAUSES[self.r_end])
        off = self.first[self.e_edge]
        add(EDGES, len(off), self.vids[self.e_edge], l0=self.e_run, l1=self.e_i0 - off, l2=self.e_i1 - off, l3=jid(self.e_u), l4=jid(self.e_w),
            l5=self.e_p0 - off, l6=self.e_p1 - off, b0=self.e_linked, b1=self.e_stub)
        held = np.flatnonzero(self.degree)
        add(DEGREE, len(held), l0=self.jids[held], l1=self.degree[held])
        add(ACTIVE, len(self.active), l0=self.jids[self.active])
        return pa.concat_tables(parts)


def settle(bridge, arm):
    """A function of the group of an image (GIVEN) that gives its rows at rest (KNOWN)."""
    def of(table: pa.Table) -> pa.Table:
        kind = table["kind"].to_numpy()

        def part(k, *names):
            t = table.filter(pa.array(kind == k)).select(names)
            return [c.to_numpy() for c in t.columns]
        s = part(SAMPLE, "l0", "l1", "d0", "d1", "d2", "d3", "d4", "d5", "b0", "b1")
        if not len(s[0]):  # no samples, no lines
            return SCHEMA.empty_table()
        im = Image(s, part(RECORD, "l0", "l1", "l2", "l3"), part(CLAIM, "l0", "l1", "l2", "l3", "d0", "d1"), bridge, arm)
        return im.settle().rows(table["image_id"][0].as_py())
    return of
