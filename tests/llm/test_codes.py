import hashlib
import itertools
import math

import numpy as np
import pytest
from test_vectors import frame as vector_frame
from test_vectors import usable, vectors

from shelfmark.llm import vector_codes as codes


def brute(rows, entries, rounds, n_parts=4):
    """The definition, in Python's whole numbers: {position in rows: (code, error)} and a digest."""
    ints = {}
    for at, (_, v) in enumerate(rows):
        if usable(v, zero=True) and len(v) % n_parts == 0:
            ints[at] = [max(-codes.LIMIT, min(codes.LIMIT, math.floor(1024 * x))) for x in v]
    out, digests = {}, {}
    for dim in {len(v) for v in ints.values()}:
        own = {at: v for at, v in ints.items() if len(v) == dim}
        width = dim // n_parts
        first = sorted(own, key=lambda a: (rows[a][0] is None, rows[a][0] or 0,
                                           np.array(own[a], "<i4").tobytes()))[:entries]
        found, texts = {at: ([], 0) for at in own}, []
        for p in range(n_parts):
            part = {at: v[p * width:(p + 1) * width] for at, v in own.items()}
            book = [part[at] for at in first]

            def near(x, book=book):
                return min((sum((a - b) ** 2 for a, b in zip(x, e)), i)
                           for i, e in enumerate(book))

            for _ in range(rounds):
                mine = {}
                for x in part.values():
                    mine.setdefault(near(x)[1], []).append(x)
                for i, xs in mine.items():
                    book[i] = [sum(c) // len(xs) for c in zip(*xs)]
            for at, x in part.items():
                square, entry = near(x)
                found[at] = (found[at][0] + [entry], found[at][1] + square)
            texts += [str(c) for e in book for c in e]
        digest = hashlib.sha256(",".join(texts).encode()).hexdigest()
        out |= {at: (c, e, digest) for at, (c, e) in found.items()}
    return out


@pytest.mark.parametrize("entries,block", [(256, 128), (9, 4), (9, 128)])
def test_codes_equal_the_definition(spark, entries, block, monkeypatch):
    monkeypatch.setattr(codes, "BLOCK", block)
    data = vectors() + [(700, [9e5] * 8), (701, [-9e5, 9e5] * 4), (702, [3e9] * 8), (703, [0.25] * 4)]
    want = brute(data, entries, 3)
    got = codes.compress(vector_frame(spark, data), entries=entries, rounds=3,
                         label_col="key").collect()
    assert sorted((r.vec_id or -1, r.codes, r.error, r.codebooks_sha256) for r in got) == sorted(
        (data[at][0] or -1, c, min(e, codes.LONGEST), d) for at, (c, e, d) in want.items())


def test_label_sums_and_odd_tables(spark):
    rows = [(i, [float(i % 7), 1.0, 2.0, i / 3], "a" if i % 3 else None, i) for i in range(60)]
    rows += [(60, None, "a", 1), (61, [1.0, None, 2.0, 3.0], "b", 1), (62, [], "b", 1),
             (63, [1.0, 2.0, 3.0], "b", 1), (None, [5.0, 1.0, 1.0, 1.0], None, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string, of int")
    got = codes.vector_codes(df, entries=4).collect()
    assert len(got) == 61 and all(len(r.code) == 8 for r in got)
    label = {r[0]: r[2] for r in rows}
    sums = {}
    for r in got:
        sums[label[r.vec_id]] = sums.get(label[r.vec_id], 0) + r.error
    assert {(label[r.vec_id], r.label_error) for r in got} == set(sums.items())
    assert codes.vector_codes(df.limit(0)).count() == 0
    ties = spark.createDataFrame([(i, [1.0] * 4, None, 0) for i in range(500)], df.schema)
    assert {(r.code, r.error) for r in codes.vector_codes(ties).collect()} == {("00000000", 0)}


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (5, 2), (4, 1)])
def test_neighbours_on_the_curve_touch(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    keys = codes.hilbert_keys(cells, bits)
    assert len(set(keys.tolist())) == len(cells)
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_shortlists_hold_every_nearest_entry_and_shrink():
    rng = np.random.default_rng(3)
    entries = rng.integers(-300, 300, (64, 6))
    shares = []
    for _ in range(200):
        low = rng.integers(-300, 300, 6)
        high = low + rng.integers(0, 40, 6)
        points = rng.integers(low, high + 1, (50, 6))
        short = codes.box_shortlist(low, high, entries)
        assert set(codes.nearest(points, entries)[0]) <= set(short.tolist())
        shares.append(len(short) / len(entries))
    assert np.mean(shares) < 0.5
    assert codes.box_shortlist(entries[3], entries[3], entries).tolist() == [3]
