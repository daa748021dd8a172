import numpy as np
import pytest

from pyspark.sql import functions as F

from shelfmark.functions.hashing import text_signatures
from shelfmark.operators.components import connected_components, thin_edges
from shelfmark.operators import cosine
from shelfmark.operators.cosine import cosine_pairs, density_clusters, distinct_vectors
from shelfmark.operators.duplicates import duplicate_report, nested_groups, redundancy
from shelfmark.operators import hamming
from shelfmark.operators.hamming import band_masks, hamming_edges, hamming_pairs


def brute_components(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: root(x) for x in parent}


def test_components_of_chains_hubs_and_loops(spark):
    rng = np.random.default_rng(5)
    edges = [(i, i + 1) for i in range(0, 60)]  # a chain
    edges += [(500, int(x)) for x in range(600, 900)]  # a hub with most of the nodes
    edges += [(int(a), int(b)) for a, b in rng.integers(1000, 1300, size=(200, 2))]
    df = spark.createDataFrame(edges, "src long, dst long").repartition(5)
    expected = brute_components([e for e in edges if e[0] != e[1]])
    for rows in (df, thin_edges(df.filter("src <> dst"))):
        got = {r.node: r.component for r in connected_components(rows).collect()}
        assert got == expected
    assert connected_components(df.limit(0)).count() == 0


def test_a_task_leaves_one_forest_of_its_edges(spark):
    edges = [(a, b) for a in range(220) for b in range(a)]  # more than one batch of rows
    thin = thin_edges(spark.createDataFrame(edges, "src long, dst long").coalesce(1))
    assert thin.count() == 219
    assert {r.component for r in connected_components(thin).collect()} == {0}


def test_blocks_meet_without_a_shuffle(spark):
    rows = spark.range(400).select("id", F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: (
        F.xxhash64("id", i) % 1000).cast("double")).alias("vec"), F.lit(1).alias("copies"))
    layout = cosine.Layout(rows, 0.3, None, 16)
    assert layout.compared()[0] > 300
    met = layout.meet(lambda left, right, at, to, cosines: (), "src long")
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan


def signatures(seed):
    rng = np.random.default_rng(seed)
    out = [int(x) for x in rng.integers(-2**63, 2**63 - 1, size=120)]
    for center in out[:3]:  # dense balls: their members share most band values
        for _ in range(150):
            x = center & (2**64 - 1)
            for bit in rng.choice(64, rng.integers(0, 6), replace=False):
                x ^= 1 << int(bit)
            out.append(x - 2**64 if x >= 2**63 else x)
    return list(dict.fromkeys(out))


@pytest.mark.parametrize("hot,bands", [(4000, None), (40, None), (6, None), (4000, 10)])
def test_hamming_pairs_are_exact_and_unique(spark, hot, bands):
    sigs = signatures(1)
    df = spark.createDataFrame(list(enumerate(sigs)), "id long, signature long")
    expected = sorted(
        (i, j) for i in range(len(sigs)) for j in range(i + 1, len(sigs))
        if bin((sigs[i] ^ sigs[j]) & (2**64 - 1)).count("1") <= 6)
    got = sorted((r.src, r.dst) for r in hamming_pairs(df, 6, bands, hot).collect())
    assert got == expected


def test_signatures_meet_without_a_shuffle(spark):
    # All agree on most bands, as signatures of texts do: 28 copies of each were shuffled.
    rows = spark.range(600).select("id", F.xxhash64("id").bitwiseAND(F.lit(0x3FF)).alias("signature"))
    lone = rows.groupBy("signature").agg(F.min("id").alias("id")).select("id", "signature")
    found = hamming_pairs(lone, block=100)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan and "Generate" not in plan
    sigs = {r.id: r.signature for r in lone.collect()}
    expected = {(a, b, bin(sigs[a] ^ sigs[b]).count("1")) for a in sigs for b in sigs
                if a < b and bin(sigs[a] ^ sigs[b]).count("1") <= 6}
    got = found.collect()
    assert len(got) == len(expected) and {(r.src, r.dst, r.bits) for r in got} == expected
    assert {r.node: r.component for r in connected_components(hamming_edges(rows)).collect()} == \
        brute_components([*((a, b) for a, b, _ in expected), *(
            (min(i for i, s in sigs.items() if s == r.signature), r.id) for r in rows.collect())])


def test_both_ways_to_meet_find_the_same_rows():
    rng = np.random.default_rng(3)
    masks = [np.uint64(m) for m in band_masks(6, 8)]
    left = rng.integers(0, 2**64, size=5000, dtype=np.uint64)
    right = np.concatenate([left[:900] ^ np.uint64(0b111 << 30), left[:700] ^ np.uint64(0xFE),
                            left[:1], rng.integers(0, 2**64, size=999, dtype=np.uint64)])
    assert hamming._few_candidates(left, right, masks)
    ways = [sorted((int(a), int(b)) for at, to in way for a, b in zip(at, to)) for way in (
        hamming._by_bands(left, right, 6, masks), hamming._by_all(left, right, 6))]
    assert ways[0] == ways[1] and len(ways[0]) >= 901
    assert not hamming._few_candidates(left & masks[0], right & masks[0], masks)


def test_band_masks_cover_every_bit():
    masks = band_masks(6, 8)
    assert len(masks) == 28 and len(set(masks)) == 28
    assert all(bin(m).count("1") == 16 for m in masks)


def test_equal_signatures_form_a_star(spark):
    df = spark.createDataFrame([(i, 77) for i in range(100)] + [(200, 78)], "id long, signature long")
    edges = hamming_edges(df).collect()
    assert len(edges) == 100  # not 4,950
    got = {r.node: r.component for r in connected_components(hamming_edges(df)).collect()}
    assert set(got.values()) == {0} and len(got) == 101


def clustered(seed, copies=60):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, 8))
    rows = [(centers[i % 12] + rng.normal(scale=.35, size=8)) for i in range(240)]
    rows += [rows[0]] * copies + [rows[5]] * 2  # a hot vector
    ids = rng.permutation(len(rows))
    return {int(i): [float(x) for x in v] for i, v in zip(ids, np.float32(rows))}


def unit_sims(rows):
    order = sorted(rows)
    m = np.array([rows[i] for i in order])
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    return order, m @ m.T


def brute_clusters(rows, eps, least):
    order, sims = unit_sims(rows)
    near = sims >= 1 - eps
    core = near.sum(1) >= least
    label = {}
    for start in range(len(order)):
        if core[start] and start not in label:
            todo = [start]
            while todo:
                at = todo.pop()
                if at in label:
                    continue
                label[at] = start
                if core[at]:
                    todo += [j for j in np.flatnonzero(near[at]) if j not in label]
    return {order[i]: (order[label[i]] if i in label else None) for i in range(len(order))}


@pytest.mark.parametrize("eps,cells,block", [(.05, None, 2048), (.03, 9, 30)])
def test_density_clusters(spark, eps, cells, block):
    rows = clustered(2)
    df = spark.createDataFrame(list(rows.items()), "id long, vec array<float>").repartition(4)
    got = {r.id: r.cluster for r in density_clusters(df, eps, 3, cells, block).collect()}
    assert got == brute_clusters(rows, eps, 3)


@pytest.mark.parametrize("cells,block", [(None, 2048), (11, 25)])
def test_cosine_pairs(spark, cells, block):
    rows = clustered(4)
    df = spark.createDataFrame(list(rows.items()), "id long, vec array<float>")
    lone = distinct_vectors(df)
    ids = sorted(r.id for r in lone.collect())
    order, sims = unit_sims({i: rows[i] for i in ids})
    expected = sorted((order[i], order[j]) for i in range(len(order))
                      for j in range(i + 1, len(order)) if sims[i, j] >= .95)
    got = sorted((r.src, r.dst) for r in
                 cosine_pairs(lone.select("id", "vec"), .95, cells, block).collect())
    assert got == expected and got


def test_blocks_far_apart_are_not_compared(spark, monkeypatch):
    monkeypatch.setattr(cosine, "CHUNK_BLOCKS", 4)
    rng = np.random.default_rng(11)
    middles = rng.normal(size=(20, 24))
    raw = np.repeat(middles, 60, axis=0) + rng.normal(size=(1200, 24)) * .15
    raw[::97] = 0.0  # vectors without a direction are near to nothing
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(raw)],
                               "id long, vec array<double>, copies int")
    layout = cosine.Layout(df, .95, cells=12, block=16)
    few, all_ = layout.compared()
    assert few < all_ / 4, (few, all_)
    length = np.linalg.norm(raw, axis=1, keepdims=True)
    sims = (raw / np.where(length == 0, 1, length)) @ (raw / np.where(length == 0, 1, length)).T
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(sims >= .95, 1)))}
    got = [(r.src, r.dst) for r in cosine_pairs(df.select("id", "vec"), .95, 12, 16).collect()]
    assert len(got) == len(want) and set(got) == want
    # At a threshold that everything reaches, every pair of blocks is compared.
    assert len(set(cosine.Layout(df, -1.0, 12, 16).compared())) == 1


def test_blocks_hold_every_row_once():
    rows = np.random.default_rng(1).normal(size=(1000, 5))
    for unit in (rows, np.ones((300, 4)) / 2):
        blocks = cosine.cut_blocks(unit, 37)
        assert sorted(np.concatenate(blocks).tolist()) == list(range(len(unit)))
        assert max(map(len, blocks)) <= 37


def test_chain_and_noise(spark):
    angles = {0: 0, 1: 20, 2: 40, 3: 60, 4: 180}
    rows = [(i, [float(np.cos(np.radians(a))), float(np.sin(np.radians(a)))])
            for i, a in angles.items()]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    got = {r.id: r.cluster for r in density_clusters(df, 1 - np.cos(np.radians(21)), 2).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: None}


def test_duplicate_tiers_and_keepers(spark):
    catalog = spark.createDataFrame(
        [(0, "a", "S1", "10", "10", "2001"), (1, "b", "s1 ", "10", "10", "2009"),
         (2, "c", "s2", "10", "10", ""), (3, "d", "", "99", "99", ""), (4, "e", "", "1", "1", "2000"),
         (5, "f", "s9", "x", "5", "")],
        "pos long, path string, sha256 string, width string, height string, best_exif_date string")
    sigs = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, -1), (4, 1 << 40), (5, 255 << 20)],
                                 "pos long, signature long")
    vecs = spark.createDataFrame(
        [(0, [1., 0.]), (1, [1., 0.]), (2, [1., 0.]), (3, [0., 1.]), (4, [.01, 1.]), (5, [-1., 0.])],
        "pos long, vec array<double>")
    report = duplicate_report(catalog, sigs, vecs)
    rows = {(r.tier, r.group, r.pos): r.keep for r in report.collect()}
    assert rows == {
        ("EXACT", "exact-1", 0): False, ("EXACT", "exact-1", 1): True,
        # 0, 1, 2 and 4 are a bit apart; the undated row beats every date.
        ("NEAR", "near-1", 0): False, ("NEAR", "near-1", 1): False, ("NEAR", "near-1", 2): True,
        ("NEAR", "near-1", 4): False,
        ("SIMILAR", "similar-1", 3): True, ("SIMILAR", "similar-1", 4): False}
    totals = {r.tier: (r.groups, r.entries, r.redundant) for r in redundancy(report).collect()}
    assert totals == {"EXACT": (1, 2, 1), "NEAR": (1, 4, 3), "SIMILAR": (1, 2, 0)}
    pages = nested_groups(report, 3).filter("tier = 'NEAR'").orderBy("page").collect()
    assert [[m.path for m in p.members] for p in pages] == [["a", "b", "c"], ["e"]]


def test_a_report_shuffles_few_rows_a_row(spark):
    # Signatures agree on most bands, as those of texts do: some 130 rows were shuffled for each.
    rows = spark.range(1000).withColumnRenamed("id", "pos")
    signatures = rows.select(
        "pos", F.xxhash64("pos").bitwiseAND(F.lit(0x3FF0003F)).alias("signature"))
    catalog = rows.select("pos", F.lit("").alias("sha256"), F.lit(1).alias("width"),
                          F.lit(1).alias("height"))
    vectors = rows.select("pos", F.array(F.lit(1.0), F.lit(0.0)).alias("vec"))
    context = spark.sparkContext
    context.setJobGroup("report", "")
    totals = redundancy(duplicate_report(catalog, signatures, vectors)).collect()
    context.setLocalProperty("spark.jobGroup.id", None)
    assert [tuple(r) for r in totals] == [("NEAR", 1, 1000, 999)]
    tracker, store = context.statusTracker(), context._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup("report") for s in tracker.getJobInfo(j).stageIds}
    assert sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages) < 40_000


def test_signatures_of_whole_texts(spark):
    base = " ".join(f"word{i}" for i in range(400))
    rows = spark.createDataFrame(
        [("a", base), ("b", base + " extra"), ("c", base.upper()), ("d", "...")],
        "path string, text string")
    got = {r.path: r.signature for r in text_signatures(rows).collect()}
    assert got["a"] == got["c"] and "d" not in got
    assert bin((got["a"] ^ got["b"]) & (2**64 - 1)).count("1") <= 6
    assert rows.filter(F.col("path") == "a").count() == 1
