"""Links between vectors against a scan of all pairs."""

import numpy as np

from quirefold.llm import vectors as V
from quirefold.llm.hnsw import Graph

VECTORS = "vec_id bigint, embedding array<float>, n_links bigint, kind int"


def frame(spark, rows):
    return spark.createDataFrame([(k, v, 5, 1) for k, v in rows], VECTORS).repartition(5)


def plain(rows, least=0.9):
    """(vec_id, n_links, component) of every row, sorted."""
    fine = lambda k, v: k is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)
    d = max((len(v) for _, v in rows if v), default=1)
    x = np.array([(np.float32(v).astype(float).tolist() if fine(k, v) else []) + [0.0] * (d - (len(v) if fine(k, v) else 0)) for k, v in rows]).reshape(-1, d)
    size = np.linalg.norm(x, axis=1)
    u = x / np.where(size, size, 1)[:, None]
    near = (u @ u.T >= least - 1e-12) & (size[:, None] > 0) & (size > 0)
    np.fill_diagonal(near, False)
    low = [k for k, _ in rows]
    while True:
        new = [min([low[i], *[low[j] for j in np.flatnonzero(near[i])]]) if near[i].any() else low[i] for i in range(len(rows))]
        if new == low:
            break
        low = new
    return sorted(((k, int(near[i].sum()), low[i]) for i, (k, _) in enumerate(rows)), key=str)


def found(spark, rows, **more):
    df = V.near_vectors(frame(spark, rows), **more)
    assert df.columns == ["vec_id", "n_links", "component_id", "kept"]
    got = df.collect()
    assert all(r.kept == (r.vec_id is None or r.component_id == r.vec_id) for r in got)
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str)


def cloud(n, d, seed):
    r = np.random.default_rng(seed)
    base = r.normal(size=(n, d))
    near = [b + r.normal(size=d) * s for b in base[:40] for s in (0.2, 0.42, 0.5)]
    big = [base[50] + 0.15 * r.normal(size=d) for _ in range(150)]
    return [v.tolist() for v in [*base, *near, *big]]


def test_all_links_in_many_cells(spark):
    rows = list(enumerate(cloud(300, 24, 1)))
    rows += [(1000 + k, rows[7][1]) for k in range(30)]  # copies
    rows += [(2000 + k, [3 * c for c in rows[k][1]]) for k in range(3)]  # longer, with the same direction
    want = plain(rows)
    assert found(spark, rows) == want
    assert found(spark, rows, shard_rows=40, block_rows=70) == want


def test_odd_vectors(spark):
    one, nan, inf = [1.0, 0.0, 0.5], float("nan"), float("inf")
    rows = [(1, one), (2, one), (3, None), (4, []), (5, [0.0, -0.0, 0.0]), (6, [1.0, None, 0.5]), (7, [nan] * 3), (8, [inf, 1.0, 0.0]), (None, one), (9, [1.0]), (10, [1.0, 0.0, 0.0]), (11, [-0.0, 3e38, 0.0]), (12, [0.0, 1e-40, 0.0])]
    assert found(spark, rows) == plain(rows)
    assert found(spark, []) == []
    assert found(spark, [(3, None)]) == [(3, 0, 3)]
    twice = found(spark, [(1, one), (1, one), (2, one)])
    assert twice == [(1, 2, 1), (1, 2, 1), (2, 2, 1)]


def test_graph_finds_what_a_scan_finds():
    r = np.random.default_rng(5)
    base = r.normal(size=(3000, 48))
    x = np.concatenate([base, base[:1000] + 0.35 * r.normal(size=(1000, 48)), base[0] + 0.1 * r.normal(size=(400, 48))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = Graph(x)
    beam = g.audited(0.9)
    assert 4 * beam < len(x)  # not a scan
    pairs = {(a, b) for i, j in g.within(x.astype(np.float32), 0.9, beam) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    scan = set(zip(*np.nonzero((x.astype(np.float32) @ x.astype(np.float32).T) >= 0.9), strict=True))
    assert len(pairs & scan) >= 0.99 * len(scan) and all(x[a] @ x[b] > 0.9 - 1e-5 for a, b in pairs)


def test_audit_widens_the_beam():
    r = np.random.default_rng(6)
    x = r.normal(size=(2500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = Graph(x)
    for layer in g.layers:  # a graph that has lost links needs more
        layer[:, 3:] = -1
    assert g.audited(0.6, target=0.9999) > g.audited(0.6, target=0.1)


def test_forest_joins_what_the_links_join():
    a, b = np.array([5, 9, 7, 2, 30, 31]), np.array([9, 7, 1, 2, 31, 30])
    assert sorted(zip(*[x.tolist() for x in V.forest(a, b)], strict=True)) == [(5, 1), (7, 1), (9, 1), (31, 30)]
    assert len(V.forest(a[:0], b[:0])[0]) == 0
