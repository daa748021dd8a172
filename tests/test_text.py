import math
import random

from pyspark.sql import functions as F

from shelfmark.functions.dates import capture_time, display_time
from shelfmark.functions.text import (
    caption_terms, clean_subject, comparable_words, content_terms, mentioned, normal_path,
    padded_id, singular, suffix,
)
from shelfmark.operators import matching
from shelfmark.operators.matching import (
    hits_among, index_captions, match_counts, matches_over, request_terms, term_hits, term_plans,
)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_singular_fold(spark):
    words = {"cats": "cat", "dress": "dress", "glass": "glass", "glasses": "glass",
             "horses": "hors", "horse": "horse", "boxes": "box", "parties": "party",
             "as": "as", "gas": "ga", "ies": "ie", "yes": "ye"}
    for word, expected in words.items():
        assert one(spark, singular(F.lit(word))) == expected, word


def test_terms(spark):
    assert one(spark, content_terms(F.lit("Café"))) == ["café"]
    assert one(spark, content_terms(F.lit("4th of July"))) == ["4th", "july"]
    assert one(spark, content_terms(F.lit("christmas tree"))) == ["christma", "tree"]
    assert one(spark, content_terms(F.lit("the photos of people"))) == []
    assert one(spark, content_terms(F.lit("dog dogs"))) == ["dog", "dog"]
    assert one(spark, caption_terms(F.lit("a_b cat cats"))) == ["a", "b", "cat"]
    assert one(spark, comparable_words(F.lit("The A x Bo bo"))) == ["bo"]
    assert one(spark, mentioned(F.lit("Ada Fixture"), F.lit("ada at sea"))) is True
    assert one(spark, mentioned(F.lit("_cartoon"), F.lit("people wearing sunglasses"))) is False


def test_hits(spark):
    captions = spark.createDataFrame(
        [("p1", "a cat sleeps"), ("p2", "two cats sleep"), ("p3", "a catalog on the table"),
         ("p4", "a carpet in the hall"), ("p5", "cat dog")], "path string, caption string")
    asked = spark.createDataFrame(
        [("cats", "cats"), ("car", "car"), ("twice", "cat cat dog")],
        "query_id string, text string")
    rows = term_hits(captions, request_terms(asked)).collect()
    assert {(r.query_id, r.path): r.hits for r in rows} == {
        ("cats", "p1"): 1, ("cats", "p2"): 1, ("cats", "p5"): 1,
        ("twice", "p1"): 2, ("twice", "p2"): 2, ("twice", "p5"): 3}


def test_matches_are_those_over_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(matching, "CAPTIONS", 16)
    rng = random.Random(2)
    words = [f"w{i}" for i in range(12)]
    captions = {f"p{i:03d}": set(rng.choices(words, weights=range(12, 0, -1), k=rng.randint(1, 6)))
                for i in range(150)}
    asked = {f"q{i}": rng.choices([*words, "absent"], k=rng.randint(1, 7)) for i in range(40)}
    terms = request_terms(spark.createDataFrame(
        [(q, " ".join(t)) for q, t in asked.items()], "query_id string, text string"))
    held = index_captions(spark.createDataFrame(
        [(p, " ".join(t)) for p, t in captions.items()], "path string, caption string"))
    plans = term_plans(terms, held)
    pool = {(q, p) for q in asked for p in captions if rng.random() < .4}
    for share in (0.01, 0.4, 1.0):
        needed = {q: max(1, math.ceil(len(t) * share)) for q, t in asked.items()}
        over = plans.withColumn("needed", F.greatest(F.lit(1), F.ceil(F.col("total") * share)))
        want = {(q, p): h for q, t in asked.items() for p, own in captions.items()
                if (h := sum(x in own for x in t)) >= needed[q]}
        got = matches_over(held, over, 40).collect()
        assert len(got) == len(want)
        assert {(r.query_id, r.path): r.hits for r in got} == want
        apart = over.withColumn("apart", F.col("query_id").endswith("3"))
        counts = match_counts(held, apart, 40, spark.createDataFrame(
            sorted(pool), "query_id string, path string")).collect()
        for r in counts:
            mine = [h for (q, p), h in want.items()
                    if q == r.query_id and (not q.endswith("3") or (q, p) in pool)]
            assert (r.full_count, r.partial_count) == (
                sum(h == len(asked[r.query_id]) for h in mine), len(mine))
    shown = spark.createDataFrame(sorted(pool), "query_id string, path string")
    assert {(r.query_id, r.path): r.hits for r in hits_among(held, plans, 40, shown).collect()} == {
        (q, p): h for q, p in pool if (h := sum(x in captions[p] for x in asked[q]))}


def test_subjects_paths_ids(spark):
    assert one(spark, clean_subject(F.lit(" Re: FWD : fw:  Hello re: x "))) == "Hello re: x"
    assert one(spark, normal_path(F.lit("/a//b/./c.jpg"))) == "/a/b/c.jpg"
    assert one(spark, suffix(F.lit("/a.b/C.JPG"))) == ".jpg"
    assert one(spark, suffix(F.lit("/a.b/.hidden"))) == ""
    assert one(spark, padded_id("event-", F.lit(7))) == "event-007"
    assert one(spark, padded_id("event-", F.lit(1234))) == "event-1234"


def test_capture_times(spark):
    cases = {"2002:08:31 20:01:57": "2002-08-31T20:01:57", "": None, "  ": None,
             "0000:00:00 00:00:00": None, "not a date": None, "1980:01:02 03:04:05":
             "1980-01-02T03:04:05", "2002-08-31 20:01:57": None}
    for text, shown in cases.items():
        assert one(spark, display_time(F.lit(text))) == shown, text
    assert one(spark, display_time(F.lit(None).cast("string"))) is None
    assert str(one(spark, capture_time(F.lit("2002-08-31 20:01:57")))) == "2002-08-31 20:01:57"
    assert one(spark, capture_time(F.lit("1980:01:02 03:04:05"))) is None
    assert one(spark, capture_time(F.lit("2030:01:02 03:04:05"), 2026)) is None
    assert one(spark, capture_time(F.lit("0000:00:00 00:00:00"))) is None
