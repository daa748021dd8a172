import math

import numpy as np
import pytest

import shelfmark.plans.search as plan
from shelfmark.operators import matching, splits
from shelfmark.operators.ranking import gradient_cut, rank_within, salted_top, spread_trim
from shelfmark.plans.search import Corpus, Options, modality_ranks, search, shown_ranks
from pyspark.sql import functions as F

WALL = "a plain wall"


def corpus(spark, scores, captions=None):
    """An index whose score for the query (1, 0, 0) is the given number."""
    captions = captions or {}
    image = [(p, [s[0], 0.0, 0.0]) for p, s in scores.items()]
    words = [(p, captions.get(p, WALL), [s[1], 0.0, 0.0]) for p, s in scores.items()]
    return Corpus(
        spark.createDataFrame(image, "path string, vec array<double>").repartition(3),
        spark.createDataFrame(words, "path string, caption string, vec array<double>")
        .repartition(2))


def ask(spark, *rows):
    filled = [(r["query_id"], r.get("text", "zebra"), [1.0, 0.0, 0.0], [1.0, 0.0, 0.0],
               r.get("mode", "hybrid"), r.get("top_k", 0), r.get("trim", False),
               r.get("has_filter", False)) for r in rows]
    return spark.createDataFrame(
        filled, "query_id string, text string, image_query array<double>, "
        "caption_query array<double>, mode string, top_k int, trim boolean, has_filter boolean")


def order(outcome, query_id):
    rows = outcome.results.filter(F.col("query_id") == query_id).orderBy("rank").collect()
    assert [r.rank for r in rows] == list(range(1, len(rows) + 1))
    return [r.path for r in rows]


PLATEAU = {f"p{i}": (s, s) for i, s in enumerate([.90, .50, .49, .48, .47, .46], 1)}
DECLINE = {f"p{i}": (s, s) for i, s in enumerate([.90, .80, .70, .60, .50, .10], 1)}
BEYOND = {"p7": (.99, .99), "p8": (.98, .98)}


def test_cut_of_plateau_and_decline(spark):
    for scores, cut, plateau in ((PLATEAU, 2, True), (DECLINE, 6, False)):
        out = search(ask(spark, {"query_id": "q"}), corpus(spark, scores))
        row = out.summary.first()
        assert (row.img_cut, row.img_plateau, row.cap_cut) == (cut, plateau, cut)
        assert row.basis_kind == "gradient" and row.score_kind == "rrf_sum"
        assert row.low_confidence == (not plateau)
        assert order(out, "q") == [f"p{i}" for i in range(1, cut + 1)]


def test_rows_outside_the_pool_never_move_the_cut(spark):
    pool = spark.createDataFrame([("q", f"p{i}") for i in range(1, 7)],
                                 "query_id string, path string")
    out = search(ask(spark, {"query_id": "q", "has_filter": True}, {"query_id": "open"}),
                 corpus(spark, PLATEAU | BEYOND), pool)
    rows = {r.query_id: r for r in out.summary.collect()}
    assert (rows["q"].cap_cut, rows["q"].pool_size, rows["q"].corpus_size) == (2, 6, 8)
    assert order(out, "q") == ["p1", "p2"]
    assert order(out, "open")[0] == "p7"


def test_matched_order_follows_the_mode(spark):
    scores = {"m1": (.10, .90), "m2": (.20, .80), "m3": (.30, .70), "m4": (.40, .60),
              "filler": (.05, .10)}
    captions = {p: "a zebra here" for p in scores if p != "filler"}
    out = search(ask(spark, {"query_id": "h"}, {"query_id": "c", "mode": "caption"},
                     {"query_id": "i", "mode": "image"}), corpus(spark, scores, captions))
    assert order(out, "h") == order(out, "c") == ["m1", "m2", "m3", "m4"]
    assert order(out, "i") == ["m4", "m3", "m2", "m1"]
    kinds = {r.query_id: (r.basis_kind, r.score_kind) for r in out.summary.collect()}
    assert kinds == {"h": ("full_match", "caption_cosine"), "c": ("full_match", "caption_cosine"),
                     "i": ("full_match", "image_cosine")}
    assert all(r.matched and r.term_hits == 1 for r in out.results.collect())


def test_ties_go_to_the_path(spark):
    tied = {f"img{i:02d}": (1 - .01 * i, .01 * (i + 1)) for i in range(1, 17)}
    out = search(ask(spark, {"query_id": "q", "top_k": 16}), corpus(spark, tied))
    fused = {p: 1 / (60 + i) + 1 / (60 + 17 - i) for i, p in enumerate(sorted(tied), 1)}
    expected = sorted(fused, key=lambda p: (-fused[p], p))
    assert order(out, "q") == expected
    equal = {f"q{i}": (.77, .77) for i in range(1, 7)}
    out = search(ask(spark, {"query_id": "q"}),
                 corpus(spark, equal, {p: "a zebra here" for p in equal}))
    assert order(out, "q") == sorted(equal)


def test_top_k_beats_the_term_match(spark):
    out = search(ask(spark, {"query_id": "q", "top_k": 3, "text": "plain"}), corpus(spark, DECLINE))
    rows = out.results.collect()
    assert len(rows) == 3 and all(r.score < .05 and not r.matched for r in rows)
    row = out.summary.first()
    assert row.basis_kind == "top_k" and row.full_count == 6


def test_partial_and_text_free_branches(spark):
    captions = {"p1": "red car", "p2": "red bus", "p3": "blue car"}
    out = search(ask(spark, {"query_id": "part", "text": "red car zebra"},
                     {"query_id": "none", "text": "the photos"}), corpus(spark, DECLINE, captions))
    assert order(out, "part") == ["p1"]
    assert order(out, "none") == sorted(DECLINE)
    basis = {r.query_id: r.basis for r in out.summary.collect()}
    assert basis["part"].endswith("at least 2 of 3.")
    assert "whole collection" in basis["none"]


def test_empty_pool_is_not_an_absent_filter(spark):
    pool = spark.createDataFrame([], "query_id string, path string")
    out = search(ask(spark, {"query_id": "q", "has_filter": True}), corpus(spark, PLATEAU), pool)
    row = out.summary.first()
    assert (row.basis_kind, row.score_kind, row.pool_size) == ("empty_pool", "none", 0)
    assert (row.img_cut, row.img_plateau) == (1, False)
    assert out.results.count() == 0
    with pytest.raises(ValueError):
        search(ask(spark, {"query_id": "q", "has_filter": True}), corpus(spark, PLATEAU))


def test_trim(spark):
    scores = {f"m{i}": (.1, s) for i, s in enumerate([.9, .8, .7, .11, .10], 1)}
    out = search(ask(spark, {"query_id": "q", "trim": True}),
                 corpus(spark, scores, {p: "zebra" for p in scores}))
    assert order(out, "q") == ["m1", "m2", "m3"]
    assert "2 further images were trimmed by caption score." in out.summary.first().basis
    assert {r.path for r in out.trimmed.collect()} == {"m4", "m5"}


def brute_fused(scores, k=60):
    ranks = []
    for side in (0, 1):
        ordered = sorted(scores, key=lambda p: (-scores[p][side], p))
        ranks.append({p: i for i, p in enumerate(ordered, 1)})
    fused = {p: 1 / (k + ranks[0][p]) + 1 / (k + ranks[1][p]) for p in scores}
    return sorted(fused, key=lambda p: (-fused[p], p))


def test_counted_and_sorted_rankings_agree_with_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    # A third of the rows are copies of one vector; scores repeat elsewhere too.
    scores = {}
    for i in range(1500):
        scores[f"r{i:05d}"] = (.5, .5) if i % 3 == 0 else (
            round(float(rng.normal()), 2), round(float(rng.normal()), 2))
    index = corpus(spark, scores)
    expected = brute_fused(scores)
    out = search(ask(spark, {"query_id": "q", "top_k": 200}, {"query_id": "g"}), index)
    assert order(out, "q") == expected[:200]
    cut = out.summary.filter("query_id = 'g'").first()
    assert order(out, "g") == expected[:max(cut.img_cut, cut.cap_cut)]
    monkeypatch.setattr(plan, "COUNTED_TOP", 10)
    out = search(ask(spark, {"query_id": "q", "top_k": 200}), index)
    assert order(out, "q") == expected[:200]


def test_many_blocks_and_splits_equal_one(spark, monkeypatch):
    rows = [{"query_id": f"q{i}", "text": t, "has_filter": i == 5} for i, t in enumerate(
        ["plain", "zebra", "the", "wall", "zebra plain wall", "zebra", "a wall zebra"])]
    captions = {"p2": "a zebra", "p5": "the zebra wall"}
    pool = spark.createDataFrame([("q5", "p1"), ("q5", "p3"), ("q5", "p6"), ("q1", "p1")],
                                 "query_id string, path string")
    index = corpus(spark, DECLINE, captions)
    whole = sorted(map(tuple, search(ask(spark, *rows), index, pool).results.collect()))
    monkeypatch.setattr(splits, "BLOCK", 2)
    monkeypatch.setattr(splits, "SPLIT_ROWS", 2)
    monkeypatch.setattr(matching, "REQUESTS", 2)
    monkeypatch.setattr(matching, "CAPTIONS", 2)
    index = corpus(spark, DECLINE, captions)
    parts = sorted(map(tuple, search(ask(spark, *rows), index, pool).results.collect()))
    assert whole == parts and {r[0] for r in whole} == {f"q{i}" for i in range(7)}


def above_vectors(df):
    """Plan nodes over the scans of packed vectors."""
    lines = df._jdf.queryExecution().toString().split("== Physical Plan ==")[1].splitlines()
    found = []
    for i, line in enumerate(lines):
        if "FileScan" in line and "image_width" in line:
            depth = len(line) - len(line.lstrip(" :+-"))
            for upper in reversed(lines[:i]):
                d = len(upper) - len(upper.lstrip(" :+-"))
                if upper.strip() and d < depth:
                    found.append(upper.strip(" :+-"))
                    depth = d
    return found


def test_vectors_are_never_shuffled(spark):
    index = corpus(spark, DECLINE).stored()
    asked = plan.prepare_requests(ask(spark, {"query_id": "q", "has_filter": True})).withColumn(
        "depth", F.lit(9))
    blocks = splits.request_blocks(asked.select(
        "query_id", "image_query", "caption_query", "has_filter", "depth"), 1)
    pairs = spark.range(1000).select(
        F.lit("q").alias("query_id"), F.concat(F.lit("p"), "id").alias("path"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables too large for it
    try:
        marks = splits.pair_marks(pairs, index, blocks)
        for df in (splits.best_rows(index, blocks, marks), splits.score_all(index, blocks, marks),
                   splits.score_pairs(index, blocks, pairs)):
            nodes = above_vectors(df)
            assert any("ShuffledHashJoin" in n for n in nodes), nodes
            assert not any(n.startswith(("Exchange", "BroadcastExchange", "Sort")) for n in nodes)
        assert {r.path for r in splits.best_rows(index, blocks, marks).collect()} == set(DECLINE)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def jobs_of(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    run()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_jobs_do_not_grow_with_the_log(spark, monkeypatch):
    monkeypatch.setattr(splits, "BLOCK", 4)
    index = corpus(spark, DECLINE)
    index.stored()
    counts = [jobs_of(spark, f"log{n}", lambda: search(ask(spark, *(
        {"query_id": f"q{i}", "text": "plain" if i % 2 else "zebra"} for i in range(n))), index))
        for n in (2, 40)]
    assert abs(counts[0] - counts[1]) <= 3 and max(counts) < 80, counts


def test_hot_scores_keep_the_first_paths(spark, monkeypatch):
    monkeypatch.setattr(splits, "SPLIT_ROWS", 20)
    scores = {f"h{i:03d}": (.5, .5 if i % 2 else .25) for i in range(300)}
    index = corpus(spark, scores).stored()
    asked = plan.prepare_requests(ask(spark, {"query_id": "q"})).withColumn("depth", F.lit(9))
    blocks = splits.request_blocks(asked.select(
        "query_id", "image_query", "caption_query", "has_filter", "depth"), 1)
    heads = splits.best_rows(index, blocks)
    top = salted_top(heads.filter("side = 'image'"), ["query_id"],
                     [F.desc("image_score"), F.col("path")], 9)
    assert sorted(r.path for r in top.collect()) == [f"h{i:03d}" for i in range(9)]
    assert heads.count() < 300  # rows behind what a task has seen are left out


def test_shown_ranks_equal_whole_rankings(spark, monkeypatch):
    monkeypatch.setattr(splits, "TARGETS", 3)
    rng = np.random.default_rng(8)
    scores = {f"r{i:03d}": tuple(np.round(rng.normal(size=2), 1).tolist()) for i in range(200)}
    index = corpus(spark, scores)
    asked = ask(spark, {"query_id": "q"}, {"query_id": "f", "has_filter": True})
    pool = spark.createDataFrame([("f", f"r{i:03d}") for i in range(0, 200, 3)],
                                 "query_id string, path string")
    whole = {}
    for r in modality_ranks(asked, index, pool).collect():
        whole.setdefault((r.query_id, r.path), {})[r.side] = r["rank"]
    shown = spark.createDataFrame([(q, f"r{i:03d}") for q in "qf" for i in range(0, 200, 9)],
                                  "query_id string, path string")
    got = {(r.query_id, r.path): {"image": r.image_rank, "caption": r.caption_rank}
           for r in shown_ranks(shown, asked, index, pool).collect()}
    assert got == {k: v for k, v in whole.items() if int(k[1][1:]) % 9 == 0}


def test_rows_of_one_index_only(spark):
    image = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [.5, 0.0])], "path string, vec array<double>")
    caption = spark.createDataFrame([("b", "x", [.9, 0.0]), ("c", "y", [.8, 0.0]), ("d", "z", None)],
                                    "path string, caption string, vec array<double>")
    asked = spark.createDataFrame([("q", "zebra", [1.0, 0.0], [1.0, 0.0], 4)], "query_id string, "
                                  "text string, image_query array<double>, caption_query array<double>, top_k int")
    out = search(asked, Corpus(image, caption))
    got = {r.path: r.score for r in out.results.collect()}
    assert got == {"a": 1 / 61, "b": 1 / 62 + 1 / 61, "c": 1 / 62}


def test_modality_ranks(spark):
    rows = modality_ranks(ask(spark, {"query_id": "q"}), corpus(spark, DECLINE)).collect()
    assert {(r.side, r.path): r.rank for r in rows} == {
        (side, f"p{i}"): i for side in ("image", "caption") for i in range(1, 7)}


def test_options_reach_the_cut(spark):
    out = search(ask(spark, {"query_id": "q"}), corpus(spark, DECLINE),
                 options=Options(floor=2.0))
    assert out.summary.first().img_cut == 1


def test_rank_within_splits_a_hot_group(spark):
    rows = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(
            F.concat(F.lit("g"), F.col("id") % 50)).alias("g"),
        (F.col("id") * 7919 % 5003).alias("v"), "id").repartition(7)
    got = {r.id: r["rank"] for r in rank_within(rows, ["g"], [F.desc("v"), F.col("id")]).collect()}
    by_group = {}
    for r in rows.collect():
        by_group.setdefault(r.g, []).append((-r.v, r.id))
    for members in by_group.values():
        for i, (_, key) in enumerate(sorted(members), 1):
            assert got[key] == i


def test_gradient_cut_edges(spark):
    rows = [("two", 1, 1.0), ("two", 2, .5), ("flat", 1, .5), ("flat", 2, .5), ("flat", 3, .1)]
    top = spark.createDataFrame(rows, "g string, rank int, score double")
    got = {r.g: (r.cut, r.plateau) for r in gradient_cut(top, ["g"]).collect()}
    assert got == {"two": (2, False), "flat": (3, False)}


def test_spread_trim_needs_four_rows(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", .5), ("a", 0.0)], "g string, score double")
    assert spread_trim(rows, ["g"]).filter("trimmed").count() == 0
    assert not math.isnan(1.0)
