import numpy as np
import pytest

from shelfmark.llm import minhash_bayes
from shelfmark.llm.minhash_bayes import least_matches, near_duplicates, overlaps
from tests_llm_odd import FIELDS, frame, rows


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4)) or (
        frozenset([tuple(words)]) if words else frozenset())


def components(data):
    sets = {}
    for i, text, *_ in data:
        if i is not None:
            sets.setdefault(i, []).append(shingles(text))
    top = {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= 75 * len(x | y)
                             for x in sets[a] for y in sets[b]):
                x, y = root(a), root(b)
                top[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def chain(n):
    """Texts of which only neighbours are alike, and a crowd alike to none but in part."""
    words = [f"w{i}" for i in range(400)]
    out = [(100 + i, " ".join(words[i * 4:i * 4 + 60]), "c") for i in range(n)]
    rng = np.random.default_rng(3)
    for i in range(n):
        own = [w if rng.random() > 0.05 else f"x{i}_{k}" for k, w in enumerate(words[:120])]
        out.append((300 + i, " ".join(own), "c"))
    return out


@pytest.mark.parametrize("data", [rows(), chain(30)], ids=["odd", "chain"])
def test_components_equal_brute_force(spark, data, monkeypatch):
    monkeypatch.setattr(minhash_bayes, "BLOCK", 8)  # several blocks in a small group
    got = near_duplicates(frame(spark, data)).collect()
    assert len(got) == len(data)
    want = components(data)
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None) == sorted(
        (i, want[i]) for i, *_ in data if i is not None)
    sizes = sorted((len(shingles(t)), -1 if i is None else i) for i, t, *_ in data)
    assert sizes == sorted((r.n_shingles, -1 if r.doc_id is None else r.doc_id) for r in got)
    for r in got:
        assert r.kept == (r.doc_id == r.component_id)


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], FIELDS)).count() == 0


def test_pruning_bounds_grow_and_keep_likely_pairs():
    bounds = least_matches(0.75, 1e-6)
    assert bounds == sorted(bounds) and bounds[-1] < 0.75 * 128
    rng = np.random.default_rng(1)
    left = rng.integers(0, 250, (2000, 128)).astype("u1")
    right = np.where(rng.random(left.shape) < 0.75, left, left + 1).astype("u1")
    assert len(minhash_bayes.surviving(left, right, bounds)) == 2000
    assert len(minhash_bayes.surviving(left, left + 1, bounds)) == 0


def test_overlaps():
    sets = [np.array(v, np.uint64) for v in ([1, 2, 3], [2, 3, 4], [9], [])]
    assert overlaps(sets)[:2, :3].tolist() == [[2, 2, 0], [2, 2, 0]]
