"""Embedding near-dedup and vector codes against plain versions."""

import hashlib
import math

import numpy as np
import pytest

from tallyfold.llm import veccodes, vecgraph

SCHEMA = "vec_id long, embedding array<double>, label int, node int, v string, n int, c int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], k, 1, "x", 2, 3) for i, v, k in rows], SCHEMA)


def plain_links(rows, cosine):
    good = [(i, np.array(v, float)) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    seen = {(i, tuple(v)): v for i, v in good}
    keys = list(seen)
    near = {k: {m for m in keys if m != k and len(m[1]) == len(k[1]) and np.dot(seen[k], seen[m]) / (np.linalg.norm(seen[k]) * np.linalg.norm(seen[m])) >= cosine} for k in keys}
    out = {}
    for k in keys:
        todo, met = [k], {k}
        while todo:
            new = near[todo.pop()] - met
            met |= new
            todo += new
        out[k] = (len({m[0] for m in near[k]} - {k[0]}), min(m[0] for m in met))
    return out


def clustered(seed, n, dim, spread):
    rng = np.random.default_rng(seed)
    middles = rng.standard_normal((n // 8, dim))
    return [m + s * rng.standard_normal(dim) for m in middles for s in rng.choice(spread, 8)]


@pytest.mark.parametrize("shard", [vecgraph.SHARD_VECTORS, 300])
def test_linked_vectors(spark, monkeypatch, shard):
    monkeypatch.setattr(vecgraph, "SHARD_VECTORS", shard)
    rows = [(i * 3, v.tolist(), i % 4) for i, v in enumerate(clustered(1, 800, 16, (0.05, 0.3, 0.45)))]
    rows += [(5000 + i, v.tolist(), 1) for i, v in enumerate(np.array([1.0, 2, 3, 4] * 4) + 0.35 * np.random.default_rng(2).standard_normal((300, 16)))]  # one large group, more and less alike
    rows += [(7000, None, 1), (7001, [], 1), (7002, [0.0] * 16, 1), (7003, [1.0] * 15 + [None], 1), (7004, [1.0] * 15 + [math.nan], 1), (7005, [math.inf] * 16, None), (None, [1.0] * 16, 2)]
    rows += [(8000, [1e-200] * 16, 1), (8001, [1e200] * 16, 1), (8002, [1.0, 0.0], 1), (8003, [3.0, -0.0], 1), (8003, [3.0, 0.0], 1), (8004, [-1.0, 0.0], 1), rows[0], rows[0], (9000, rows[0][1], 1)]
    got = vecgraph.link(frame(spark, rows), 0.9).collect()
    want = plain_links([(i, None if v is None else [x and x / max(map(abs, v)) for x in v] if v and all(x is not None and math.isfinite(x) for x in v) else v, k) for i, v, k in rows], 0.9)
    by = {}
    for (i, _), x in want.items():
        by.setdefault(i, set()).add(x)
    assert len(got) == len(rows) and max(x[0] for x in want.values()) > 100
    right = sum((r.n_links, r.component_id) in by[r.vec_id] for r in got if r.vec_id in by)
    assert right >= 0.99 * sum(r.vec_id in by for r in got)  # searches may miss some; no more than this
    assert sum(r.n_links for r in got if r.vec_id in by) <= sum(max(x[0] for x in by[r.vec_id]) for r in got if r.vec_id in by)
    rest = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got if r.vec_id not in by}
    assert rest == {None: (0, None, True)} | {i: (0, i, True) for i in range(7000, 7006)}
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)


def test_linked_vectors_of_empty_tables(spark):
    assert vecgraph.link(frame(spark, []), 0.9).count() == 0
    assert [tuple(r) for r in vecgraph.link(frame(spark, [(1, None, None)]), 0.9).collect()] == [(1, 0, 1, True)]


def test_audit_widens_the_beam():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((900, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = vecgraph.Graph(x)
    for layer in g.layers[:-1]:
        layer.edges[:] = -1  # no way down but the top
    g.layers[-1].edges[:, 2:] = -1  # hardly any edges
    g.beam_width = 1
    share = g.audit(0.9)
    assert g.beam_width > 1 and (share >= vecgraph.RECALL or g.beam_width >= len(g.x))


def plain_codes(rows, parts, rounds):
    kept = sorted(((i is None, i or 0, v, k) for i, v, k in rows if v and all(x is not None and math.isfinite(x) for x in v) and len(v) % parts == 0), key=lambda r: (r[0], r[1], [math.floor(1024 * x) for x in r[2]]))
    kept = [r for r in kept if len(r[2]) == len(kept[0][2])]
    x = np.array([[math.floor(1024 * y) for y in r[2]] for r in kept], np.int64).reshape(len(kept), parts, -1)
    books = x[: veccodes.ENTRIES].transpose(1, 0, 2).copy()
    near = lambda p: ((x[:, p, None, :] - books[p][None]) ** 2).sum(2)
    for _ in range(rounds):
        for p in range(parts):
            own = near(p).argmin(1)
            for e in set(own.tolist()):
                books[p, e] = x[own == e, p].sum(0) // (own == e).sum()
    d = [near(p) for p in range(parts)]
    code = ["".join(f"{d[p][i].argmin():02x}" for p in range(parts)) for i in range(len(kept))]
    error = [int(sum(d[p][i].min() for p in range(parts))) for i in range(len(kept))]
    labels = [r[3] for r in kept]
    total = {k: sum(e for e, m in zip(error, labels, strict=True) if m == k) for k in labels}
    sha = hashlib.sha256(",".join(map(str, books.ravel())).encode()).hexdigest()
    return sorted((-1 if r[0] else r[1], c, e, total[k], sha) for r, c, e, k in zip(kept, code, error, labels, strict=True))


def test_codes(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (0.2 * v).tolist(), [None, 1, 2][i % 3]) for i, v in enumerate(clustered(4, 640, 16, (0.02, 0.5)))]
    rows += [(1000 + i, [1.0 / 8] * 16, 1) for i in range(300)]  # one vector in a third of all rows
    rows += [(2000, None, 1), (2001, [0.1] * 15 + [None], 1), (2002, [0.1] * 15 + [math.nan], 1), (2003, [math.inf] * 16, 1), (2004, [], 1), (2005, [0.1] * 15, 1), (2006, [0.1] * 8, 1), (None, [0.3] * 16, None), rows[1], rows[1]]
    rng.shuffle(some := list(range(len(rows))))
    got = veccodes.encode(frame(spark, [rows[i] for i in some])).collect()
    assert sorted((-1 if r.vec_id is None else r.vec_id, *tuple(r)[1:]) for r in got) == plain_codes(rows, 4, 4)


def test_codes_of_few_vectors(spark):
    rows = [(3, [0.5, -0.25], None), (1, [0.25, 0.0], 7), (2, [-0.001, 0.0], 7)]
    got = veccodes.encode(frame(spark, rows), parts=2, rounds=1).collect()
    assert sorted(tuple(r) for r in got) == plain_codes(rows, 2, 1)
    assert veccodes.encode(frame(spark, [])).count() == 0 and veccodes.encode(frame(spark, [(1, None, 1)])).count() == 0


def test_cells_leave_what_can_be_nearest():
    rng = np.random.default_rng(6)
    entries = rng.integers(-300, 300, (200, 6))
    entries[150:] = entries[:50]  # ties
    x = np.concatenate([rng.integers(-400, 400, (500, 6)), entries])
    entry, far = veccodes.Cells(entries).nearest(x)
    d = ((x[:, None] - entries[None]) ** 2).sum(2)
    assert (entry == d.argmin(1)).all() and (far == d.min(1)).all()
