"""Continuation paths against a step-by-step computation, and known geometry on toy skeletons."""
import math
import random
from collections import defaultdict

import pytest

from filigrane.operators import continuation as K

LAM = 12.0
RING = [(-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1)]


def draw(lines):
    """Thin 8-connected pixels of straight lines ((x0, y0), (x1, y1))."""
    out = set()
    for (x0, y0), (x1, y1) in lines:
        n = int(max(abs(x1 - x0), abs(y1 - y0), 1))
        out |= {(math.floor(y0 + (y1 - y0) * k / n + 0.5), math.floor(x0 + (x1 - x0) * k / n + 0.5)) for k in range(n + 1)}
    return out


def ray(c, deg, r):
    return c[0] + r * math.cos(math.radians(deg)), c[1] + r * math.sin(math.radians(deg))


def table(spark, images):
    rows = [(m, y, x, m * 1_000_000 + (y + 100) * 1000 + x) for m, px in enumerate(images) for y, x in sorted(px)]
    return spark.createDataFrame(rows, "image_id long, y long, x long, pid long")


def find(parent, v):
    while parent[v] != v:
        v = parent[v]
    return v


def naive(pix, lam, turn_max=30.0, merge=1.0, xmerge=3.0, reach=1.5):
    """One image {(y, x): pid}: walks every branch pixel by pixel, merges and pairs in loops."""
    at = {p: q for q, p in pix.items()}
    nbr = {}
    for (y, x), p in pix.items():
        nbr[p] = []
        for k, (dy, dx) in enumerate(RING):
            q = pix.get((y + dy, x + dx))
            if q is not None and not (dy and dx and ((y + dy, x) in pix or (y, x + dx) in pix)):
                nbr[p].append((k, q))
    hub = {p for p in nbr if len(nbr[p]) >= 3}
    node = {}
    for p in sorted(hub):
        todo = [p] if p not in node else []
        while todo:
            v = todo.pop()
            if v not in node:
                node[v] = p
                y, x = at[v]
                todo += [pix[y + dy, x + dx] for dy, dx in RING if pix.get((y + dy, x + dx)) in hub]
    node |= {p: -1 - p for p in nbr if len(nbr[p]) == 1}

    def walk(p, k, q, stop):
        path, code = [p, q], 0
        while len(nbr[q]) == 2 and q != stop:
            (k2, r), = [(c, r) for c, r in nbr[q] if r != path[-2]]
            path.append(r)
            q = r
        y, x = at[path[-2]]
        code = RING.index((y - at[q][0], x - at[q][1]))
        return path, p * 8 + k, q * 8 + code
    br, seen = {}, set()
    for p in sorted(nbr):
        if len(nbr[p]) != 2:
            for k, q in nbr[p]:
                path, a, b = walk(p, k, q, None)
                seen |= set(path)
                if a < b and not (len(path) == 2 and node[path[0]] == node[path[1]]):
                    br[a] = path
    for p in sorted(nbr):
        if len(nbr[p]) == 2 and p not in seen:
            path, a, b = walk(p, *min(nbr[p]), p)
            seen |= set(path)
            br[min(a, b)] = path if a < b else path[::-1]
    ring = {b for b, v in br.items() if v[0] == v[-1] and v[0] not in node}
    ends = {b: (None, None) if b in ring else (node[v[0]], node[v[-1]]) for b, v in br.items()}
    xy = {b: [at[p] for p in v] for b, v in br.items()}

    def arcs(c):
        out = [0.0]
        for u, v in zip(c, c[1:]):
            out.append(out[-1] + math.dist(u, v))
        return out
    size = {b: arcs(c)[-1] for b, c in xy.items()}

    def point(c, d, t):
        k = max(i for i in range(len(d)) if d[i] <= t + 1e-9)
        if k == len(d) - 1 or t - d[k] < 1e-9:
            return c[k]
        f = (t - d[k]) / (d[k + 1] - d[k])
        return tuple(c[k][i] + f * (c[k + 1][i] - c[k][i]) for i in (0, 1))
    way = {}
    for b, c in xy.items():
        for s in (0, 1):
            w = c[::-1] if s else c
            d = arcs(w)
            p, q = point(w, d, min(0.25 * lam, 0.3 * d[-1])), point(w, d, min(reach * lam, d[-1]))
            v = q[0] - p[0], q[1] - p[1]
            if math.hypot(*v) < 1e-6:
                v = w[-1][0] - w[0][0], w[-1][1] - w[0][1]
            n = math.hypot(*v)
            way[b * 2 + s] = ((v[0] / n, v[1] / n) if n > 1e-6 else None, w[0])

    def straight(a, b):
        (u, p), (v, q) = way[a], way[b]
        if u is None or v is None:
            return None
        c = -(u[0] * v[0] + u[1] * v[1])
        off = abs((q[0] - p[0]) * u[1] - (q[1] - p[1]) * u[0])
        if c < math.cos(math.radians(turn_max)) or off > 0.5 * lam + 0.25 * math.dist(p, q):
            return None
        return math.degrees(math.acos(min(1.0, c)))
    parent = {n: n for e in ends.values() for n in e if n is not None and n >= 0}

    def union(a, b):
        a, b = sorted((find(parent, a), find(parent, b)))
        parent[b] = a
    for b, (u, v) in ends.items():
        if u in parent and v in parent and size[b] <= merge * lam:
            union(u, v)

    def top(n):
        return find(parent, n) if n in parent else None

    def inner(b):
        u, v = map(top, ends[b])
        return u is not None and u == v

    def hang():
        out = defaultdict(list)
        for b, e in sorted(ends.items()):
            for s in (0, 1):
                if not inner(b) and top(e[s]) is not None:
                    out[top(e[s])].append(b * 2 + s)
        return out
    for b, (u, v) in sorted(ends.items()):
        h, u, v = hang(), top(u), top(v)
        if u is None or v is None or u == v or not merge * lam < size[b] <= xmerge * lam or len(h[u]) != 3 or len(h[v]) != 3:
            continue
        (p, q), (r, s) = [[a for a in h[n] if a // 2 != b] if len([a for a in h[n] if a // 2 != b]) == 2 else (None, None) for n in (u, v)]
        if p is None or r is None:
            continue
        if any(straight(p, x) is not None and straight(q, y) is not None for x, y in ((r, s), (s, r))):
            union(u, v)
    link, nodes, cross = {}, {}, []
    for n, al in hang().items():
        cand = sorted((t, a, b) for i, a in enumerate(al) for b in al[i + 1:] if (t := straight(a, b)) is not None)
        pairs = []
        for _, a, b in cand:
            if a not in link and b not in link:
                link[a], link[b] = b, a
                pairs.append((a, b))
        nodes[n] = (len(al), len(pairs))
        if len(al) >= 3:
            for i, (a, b) in enumerate(pairs):
                for c, d in pairs[i + 1:]:
                    g = [math.atan2(way[x][0][0] - way[y][0][0], way[x][0][1] - way[y][0][1]) for x, y in ((a, b), (c, d))]
                    t = abs(g[0] - g[1]) % math.pi
                    cross.append((n, round(math.degrees(min(t, math.pi - t)), 5)))
    left, paths = {b for b in br if not inner(b)}, {}
    while left:
        group, todo = set(), [min(left)]
        while todo:
            b = todo.pop()
            if b not in group:
                group.add(b)
                todo += [link[b * 2 + s] // 2 for s in (0, 1) if b * 2 + s in link]
        left -= group
        open_ = [a for b in group for a in (b * 2, b * 2 + 1) if a not in link]
        here = min(open_) if open_ else min(group) * 2
        seq, length = [here], size[here // 2]
        while (here ^ 1) in link and link[here ^ 1] // 2 not in {a // 2 for a in seq}:
            length += math.dist(way[here ^ 1][1], way[link[here ^ 1]][1])
            here = link[here ^ 1]
            seq.append(here)
            length += size[here // 2]
        paths[min(group)] = (tuple((a // 2, a % 2 == 1) for a in seq), round(length, 5), not open_)
    return paths, nodes, sorted(cross)


def found(spark, images):
    r = {k: v.collect() for k, v in K.continuation_paths(table(spark, images), LAM).items()}
    out = []
    for m in range(len(images)):
        of = {k: [x for x in v if x.image_id == m] for k, v in r.items()}
        members = defaultdict(list)
        for x in sorted(of["members"], key=lambda x: (x.path, x.pos)):
            members[x.path].append((x.bid, x.flipped))
        assert all(x.n_branches == len(members[x.path]) for x in of["paths"]) and len(of["paths"]) == len(members)
        out.append(({x.path: (tuple(members[x.path]), round(x.length, 5), x.closed) for x in of["paths"]},
                    {x.node: (x.n_arms, x.n_pairs) for x in of["nodes"]}, sorted((x.node, round(x.angle, 5)) for x in of["crossings"])))
    return out


def test_random_skeletons(spark):
    rng = random.Random(4)
    images = []
    for _ in range(24):
        p = lambda: (rng.randint(0, 70), rng.randint(0, 70))
        images.append(draw([(p(), p()) for _ in range(rng.randint(2, 9))]))
    images += [{(y, x) for y in range(25) for x in range(25) if rng.random() < q} for q in (0.2, 0.35, 0.5)]
    got = found(spark, images)
    for m, px in enumerate(images):
        assert got[m] == naive({(y, x): m * 1_000_000 + (y + 100) * 1000 + x for y, x in px}, LAM), m


@pytest.fixture(scope="module")
def toys(spark):
    c = (200, 200)
    diamond = {(y, x) for y in range(41) for x in range(41) if abs(y - 20) + abs(x - 20) == 20}
    p, q = (170.0, 200.0), (170.0 + 2 * LAM, 200.0)
    return found(spark, [
        draw([(ray(c, 180, 180), ray(c, 0, 180)), (ray(c, 240, 180), ray(c, 60, 180))]),
        draw([(ray(c, a, 150), c) for a in (90, 210, 330)]),
        draw([((20, 200), (380, 200)), ((200, 200), (200, 380))]),
        draw([(ray(p, 170, 150), p), (ray(p, 190, 150), p), (p, q), (q, ray(q, -10, 150)), (q, ray(q, 10, 150))]),
        diamond, {(5, 5)}, draw([((0, 0), (30, 0))])])


def lengths(toy):
    return sorted(n for _, n, _ in toy[0].values())


def branch_points(toy):
    return sum(a >= 3 and p < 2 for a, p in toy[1].values())


def test_crossing_goes_on(toys):
    assert len(toys[0][2]) == 1 and abs(toys[0][2][0][1] - 60) < 6 and branch_points(toys[0]) == 0
    assert sum(n > 300 for n in lengths(toys[0])) == 2


def test_fork_does_not(toys):
    assert branch_points(toys[1]) == 1 and not toys[1][2] and max(lengths(toys[1])) < 185


def test_line_of_a_t_goes_on(toys):
    assert branch_points(toys[2]) == 1 and not toys[2][2] and lengths(toys[2])[-1] > 340


def test_shared_stretch_is_a_crossing(toys):
    assert len(toys[3][2]) == 1 and abs(toys[3][2][0][1] - 20) < 8 and sum(n > 230 for n in lengths(toys[3])) == 2  # near the fork the lines share pixels


def test_ring_pixel_and_line(toys):
    (ring,) = toys[4][0].values()
    assert abs(ring[1] - 80 * math.sqrt(2)) < 1e-4 and len(ring[0]) == 1 and not toys[4][1]
    assert toys[5] == ({}, {}, []) and lengths(toys[6]) == [30.0]


def test_nothing(spark):
    assert all(t.count() == 0 for t in K.continuation_paths(table(spark, []), LAM).values())
