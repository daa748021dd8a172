import math

import numpy as np
import pytest

from shelfmark.llm import sphere_cells
from shelfmark.llm.ball_tree import BallTree, top_k
from shelfmark.llm.sphere_cells import near_vectors, spherical_kmeans

FIELDS = "vec_id long, embedding array<double>, key string, copies int, dim int, rank string"


def vectors(seed=0, n=120):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, 8))
    base[n // 2:n - 10] = base[:n // 2 - 10] + rng.normal(size=(n // 2 - 10, 8)) * 0.12
    base[n - 10:] = base[0]
    out = [(i, v.tolist()) for i, v in enumerate(base)]
    out += [(500, None), (520, [0.0] * 8), (540, [math.nan] + [1.0] * 7), (560, []),
            (580, [math.inf] * 8), (600, [None] + [1.0] * 7), (620, [1e200] * 8),
            (640, [1e-200] * 8), (660, [1.0, 2.0]), (680, [1.0, 2.0]), (None, base[0].tolist()),
            (40, (base[40] * 3).tolist()), (0, base[0].tolist())]
    return out


def frame(spark, data):
    return spark.createDataFrame([(*r, "k", 1, 2, "x") for r in data], FIELDS)


def usable(v, zero=False):
    return v and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))


@pytest.mark.parametrize("block", [1024, 16])
def test_links_equal_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(sphere_cells, "BLOCK", block)
    data = vectors()
    got = near_vectors(frame(spark, data), reach=1e9).collect()  # so far that it is exact
    assert len(got) == len(data)
    unit = [np.array(v) / max(map(abs, v)) if i is not None and usable(v) else None
            for i, v in data]
    unit = [None if u is None else u / np.linalg.norm(u) for u in unit]
    links = [[j for j, b in enumerate(unit) if j != i and a is not None and b is not None
              and len(a) == len(b) and a @ b >= 0.95] for i, a in enumerate(unit)]
    top = list(range(len(data)))
    for _ in data:
        top = [min([top[i], *(top[j] for j in links[i])], key=lambda k: data[k][0] or 0)
               for i in range(len(data))]
    want = sorted((i, len(links[k]), data[top[k]][0]) for k, (i, _) in enumerate(data)
                  if i not in (None, 0, 40))
    assert want == sorted((r.vec_id, r.n_links, r.component_id) for r in got
                          if r.vec_id not in (None, 0, 40))
    assert [(r.n_links, r.component_id) for r in got if r.vec_id is None] == [(0, None)]
    assert near_vectors(frame(spark, [])).count() == 0


def test_recall_with_the_usual_reach(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(1500, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    near = base[:500] + rng.normal(size=(500, 32)) * 0.32 / np.sqrt(32)
    rows = np.concatenate([base, near])
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    exact = int(((unit @ unit.T) >= 0.95).sum()) - len(unit)
    got = near_vectors(frame(spark, [(i, v.tolist()) for i, v in enumerate(rows)]))
    found = got.agg({"n_links": "sum"}).first()[0]
    assert 0 < exact and 0.99 * exact <= found <= exact


@pytest.mark.parametrize("block", [1024, 32])
def test_low_rank_links_are_all_found(spark, block, monkeypatch):
    monkeypatch.setattr(sphere_cells, "BLOCK", block)
    fitted, real = [], sphere_cells._fit
    monkeypatch.setattr(sphere_cells, "_fit", lambda *a: fitted.append(real(*a)) or fitted[-1])
    rng = np.random.default_rng(9)
    base = rng.normal(size=(1000, 4))
    near = base + rng.normal(size=(1000, 4)) * 0.12
    unit = np.concatenate([base, near]) @ np.linalg.qr(rng.normal(size=(256, 4)))[0].T
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    links = ((unit @ unit.T) >= 0.95).sum(axis=1) - 1
    got = near_vectors(frame(spark, [(i, v.tolist()) for i, v in enumerate(unit)]))
    assert {r.vec_id: r.n_links for r in got.collect()} == dict(enumerate(links.tolist()))
    assert bool(fitted[0][256]) == (block == 32)  # both cells and a single one are tried


def test_kmeans_centroids_are_unit_vectors():
    rows = np.random.default_rng(1).normal(size=(300, 6))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    assert np.allclose(np.linalg.norm(spherical_kmeans(rows, 12, 0), axis=1), 1)


@pytest.mark.parametrize("shard", [4096, 30])
def test_top_k_equals_brute_force(spark, shard):
    data = [r for r in vectors() if r[0] != 620] + [(700, [2.0 ** 58] * 8)]
    got = top_k(frame(spark, data), k=5, shard_rows=shard, query_rows=3).collect()
    ints = [(i, [math.floor(64 * x) for x in v]) for i, v in data
            if i is not None and usable(v, zero=True)]
    want, seen = [], set()
    for i, v in ints:
        if i % 20 == 0 and i not in seen:
            seen.add(i)
            scores = sorted((-max(-2 ** 63, min(2 ** 63 - 1, sum(
                max(-2 ** 62, min(2 ** 62, a)) * max(-2 ** 62, min(2 ** 62, b))
                for a, b in zip(v, w)))), j)
                for j, w in ints if j != i and len(w) == len(v))
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:5])]
    kept = {0, 40}  # ids that come twice may ask with either vector
    assert sorted(tuple(r) for r in got if r[0] not in kept) == sorted(
        w for w in want if w[0] not in kept)
    assert top_k(frame(spark, [])).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(2)
    rows, queries = rng.normal(size=(1000, 5)) * 50, rng.normal(size=(20, 5)) * 50
    tree = BallTree(rows)
    bound = tree.bounds(queries)
    for node, (start, stop) in enumerate(tree.spans):
        assert ((queries @ rows[tree.order[start:stop]].T).max(axis=1) <= bound[:, node]).all()
