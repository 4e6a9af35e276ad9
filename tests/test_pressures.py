"""Pressures against an exact solve; what flows into a free node flows out."""
import numpy as np
import pytest

from filigrane.operators import network as N

NODES = "scene_id long, nid long, pressure double"
EDGES = "scene_id long, vid long, u long, v long, g double"


def nets():
    """Two layered scenes with conductances over four decades, a dead end, and a part that no held node reaches."""
    rng = np.random.default_rng(3)
    nodes, edges = [], []
    for scene in (0, 1):
        base = 100 * scene
        for k in range(36):
            nodes.append((scene, base + k, 1.0 if k < 4 else 0.0 if k >= 32 else None))
        for k in range(32):
            for v in {4 * (k // 4 + 1) + int(j) for j in rng.integers(0, 4, 2)} | {k + 4}:
                edges.append((scene, len(edges), base + k, base + v, float(10 ** rng.uniform(-2, 2))))
        edges.append((scene, len(edges), base + 17, base + 90, 0.5))
        edges.append((scene, len(edges), base + 91, base + 92, 2.0))
        nodes += [(scene, base + k, None) for k in (90, 91, 92, 93)]
    return nodes, edges


def exact(nodes, edges):
    at = {n: k for k, (_, n, _) in enumerate(nodes)}
    a, b = np.zeros((len(nodes),) * 2), np.zeros(len(nodes))
    for _, _, u, v, g in edges:
        for x, y in ((at[u], at[v]), (at[v], at[u])):
            a[x, x] += g
            a[x, y] -= g
    for k, (_, n, p) in enumerate(nodes):
        if p is not None or n % 100 in (91, 92, 93):
            a[k], b[k] = 0, 0.5 if p is None else p
            a[k, k] = 1
    return {n: x for (_, n, _), x in zip(nodes, np.linalg.solve(a, b))}


def test_pressures_solve_the_network(spark):
    nodes, edges = nets()
    n, e = spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)
    p = N.relax_pressure(n, e)
    got, want = {r.nid: r.p for r in p.collect()}, exact(nodes, edges)
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-9
    held = {k for _, k, x in nodes if x is not None}
    net = dict.fromkeys(want, 0.0)
    for r in N.orient(e, p).collect():
        assert r.flow >= 0
        net[r.u] -= r.flow
        net[r.v] += r.flow
    assert max(abs(x) for k, x in net.items() if k not in held) < 1e-9
    assert sum(net[k] for k in held) == pytest.approx(0, abs=1e-9)


def test_too_few_rounds_raise(spark):
    nodes, edges = nets()
    with pytest.raises(RuntimeError):
        N.relax_pressure(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES), rounds=3)
