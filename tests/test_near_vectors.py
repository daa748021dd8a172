import tracemalloc

import numpy as np
import pytest

from pyspark.sql import functions as F

from shelfmark.operators import cosine
from shelfmark.operators.cosine import near_vectors


def units(n, dim, seed=3):
    rows = np.random.default_rng(seed).normal(size=(n, dim))
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def gathered(chunks):
    chunks = list(chunks)
    return [np.concatenate(side) for side in zip(*chunks)] if chunks else [[], [], []]


@pytest.mark.parametrize("threshold", [-2.0, -0.1, 0.3, 0.999999])
def test_short_products_lose_no_pair(monkeypatch, threshold):
    monkeypatch.setattr(cosine, "STRIP", 4_000)
    monkeypatch.setattr(cosine, "HITS", 9_000)
    left, right = units(301, 16), units(202, 16, 4)
    right[:9] = left[:9]
    for two, same in ((right, False), (left, True)):
        whole = left @ two.T
        near = np.triu(whole >= threshold, 1) if same else whole >= threshold
        expected = {(a, b): whole[a, b] for a, b in zip(*np.nonzero(near))}
        at, to, cosines = gathered(near_vectors(left, two, threshold, same))
        assert len(at) == len(expected)
        for a, b, sim in zip(at, to, cosines):
            assert abs(expected[a, b] - sim) < 1e-12


def test_a_pair_at_the_threshold_is_decided_in_doubles():
    # In short floats all of these are at 0.5, some a little above, some below.
    angles = np.arccos(0.5) + np.arange(-50, 51) * 1e-9
    right = np.stack([np.cos(angles), np.sin(angles)], axis=1)
    left = np.array([[1.0, 0.0]])
    at, to, _ = gathered(near_vectors(left, right, 0.5))
    assert to.tolist() == np.flatnonzero(right[:, 0] >= 0.5).tolist()
    assert 0 < len(to) < 101


def test_wide_blocks_meet_in_little_memory():
    # All cosines of two blocks were held at once, 128 MB in doubles.
    left, right = units(4096, 8), units(4096, 8, 5)
    tracemalloc.start()
    for _ in near_vectors(left, right, 0.9):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6


def test_many_vectors_lie_in_wider_blocks(spark):
    # A block goes to every other block, so all that is handed over shrinks with their number.
    rows = spark.range(1).select(F.array_repeat(F.lit(1.0), 64).alias("vec"))
    assert [cosine._block_rows(rows, n) for n in (0, 2_000, 50_000, 10**6)] == [
        1024, 1024, 1562, 4096]
    wide = spark.range(1).select(F.array_repeat(F.lit(1.0), 1024).alias("vec"))
    assert cosine._block_rows(wide, 10**6) == 1024
    assert cosine._block_rows(rows.limit(0), 0) == 1024


def test_a_partition_of_wider_blocks_holds_no_more_vectors(spark):
    rows = spark.range(300).select(
        "id", F.array(F.rand(1), F.rand(2)).alias("vec"), F.lit(1).alias("copies"))
    assert [cosine.Layout(rows, 0.9, 2, block).tile for block in (32, 1024, 4096)] == [64, 64, 16]
