import hashlib

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from shelfmark.functions.hashing import bit_votes, text_signatures, token_hash, token_hashes
from shelfmark.operators import hamming, links
from shelfmark.operators.components import connected_components
from shelfmark.operators.links import compare_all, link_rows


def dense(n, seed=4):
    """Signatures a few bits from others, chains of them, and lone ones."""
    rng = np.random.default_rng(seed)
    out = list(rng.integers(0, 2**64, size=n // 8, dtype=np.uint64))
    while len(out) < n:
        x = out[int(rng.integers(len(out)))]
        for bit in rng.choice(64, rng.integers(1, 9), replace=False):
            x ^= np.uint64(1) << np.uint64(bit)
        out.append(x)
    return rng.permutation(np.unique(np.array(out, np.uint64)))


def plain(sigs, distance):
    found = links._Labels(np.arange(len(sigs)))
    for at, to in compare_all(sigs, sigs, distance):
        found.join(at, to)
    return found.low


@pytest.mark.parametrize("distance,bands", [(6, 7), (6, 8), (6, 10), (3, 6), (0, 1), (6, None)])
def test_linked_rows_are_those_of_all_pairs(monkeypatch, distance, bands):
    monkeypatch.setattr(links, "MASK", 0)  # masks, however few rows there are
    monkeypatch.setattr(links, "LOOKUP", 1)
    sigs = dense(3000)
    expected = plain(sigs, distance)
    assert (link_rows(sigs, distance, bands) == expected).all()
    for cut in (1, 1700):
        low = np.concatenate([link_rows(sigs[:cut], distance, bands),
                              link_rows(sigs[cut:], distance, bands) + cut])
        assert (link_rows(sigs, distance, bands, low, cut) == expected).all()


def test_signatures_that_agree_on_most_bits_are_linked():
    # No mask tells them apart, so every one of them would meet all.
    sigs = dense(2000) & np.uint64(0x3FF00FF03F)
    sigs = np.unique(sigs)
    for distance in (1, 6, 40, 64):
        assert (link_rows(sigs, distance) == plain(sigs, distance)).all()
    assert list(link_rows(sigs[:1], 6)) == [0] and len(link_rows(sigs[:0], 6)) == 0


def test_a_dense_place_is_joined_without_meeting_all_its_pairs(monkeypatch):
    # Components of 30,000 signatures took 450 million comparisons.
    rng = np.random.default_rng(7)
    seen = []
    whole = links.spans
    monkeypatch.setattr(links, "spans", lambda first, last: (
        seen.append(int((last - first).sum())), whole(first, last))[1])
    monkeypatch.setattr(links, "compare_all", lambda *_: pytest.fail("all pairs compared"))
    near = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (30_000, 3), np.uint64), axis=1)
    sigs = np.unique(np.concatenate([near, rng.integers(0, 2**64, 3_000, np.uint64)]))
    low = link_rows(sigs, 6)
    assert np.bincount(low).max() >= len(np.unique(near))
    assert sum(seen) < 30 * len(sigs)


@pytest.mark.parametrize("block", [40, 300, 5000])
def test_blocks_give_the_components_of_the_whole(spark, block):
    sigs = dense(1500, 9)
    rows = spark.createDataFrame(
        [(i, int(s)) for i, s in enumerate(sigs.view(np.int64).tolist())],
        "id long, signature long").repartition(3)
    edges = hamming.hamming_edges(rows, block=block)
    assert edges.filter(F.col("src") == F.col("dst")).count() == 0
    got = {r.node: r.component for r in connected_components(edges).collect()}
    low = plain(sigs, 6)
    alone = np.bincount(low, minlength=len(low))[low] == 1
    assert got == {i: int(low[i]) for i in np.flatnonzero(~alone).tolist()}


def test_hashes_of_words_are_those_of_sql(spark):
    words = ["", "a", "é", "漢字", *("x" * n for n in range(50, 70)), "ß" * 400]
    expected = [int(hashlib.md5(w.encode()).hexdigest()[:16], 16) for w in words]
    assert token_hashes(pa.array(words)).tolist() == expected
    assert token_hashes(pa.array(words)[3:]).tolist() == expected[3:]
    rows = spark.createDataFrame([(w,) for w in words], "w string")
    one = rows.select(token_hash(F.col("w")).alias("h")).collect()
    assert [r.h & (2**64 - 1) for r in one] == expected


def test_votes_of_long_texts_and_of_a_key_in_parts(spark):
    size = np.array([1, 254, 255, 256, 510, 70_000])
    hashes = np.random.default_rng(1).integers(0, 2**64, int(size.sum()), dtype=np.uint64)
    hashes[:1] = 2**64 - 1
    votes = bit_votes(hashes, size)
    ends = np.cumsum(size)
    for row, end, n in zip(votes, ends, size):
        own = hashes[end - n:end]
        assert row.tolist() == [int((own >> np.uint64(i) & np.uint64(1)).sum()) for i in range(64)]
    long = " ".join(f"w{i % 900}" for i in range(3000))
    rows = spark.createDataFrame(
        [("whole", long + " tail of it"), ("parts", long), ("parts", "Tail of it"), ("none", "..."),
         ("none", None), (None, "word")], "path string, text string")
    got = {r.path: r.signature for r in text_signatures(rows).collect()}
    assert got["whole"] == got["parts"] and set(got) == {"whole", "parts", None}
    word = int(hashlib.md5(b"word").hexdigest()[:16], 16)
    assert got[None] & (2**64 - 1) == word
    # Words were exploded: a row each went through the aggregate.
    plan = text_signatures(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan
