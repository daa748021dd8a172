import random

import pytest
from pyspark.sql import functions as F

from shelfmark.operators.filters import (
    combine_pools, event_candidates, filter_pool, images_in_any, images_with_all, name_candidates,
    resolve_events, resolve_names,
)
from shelfmark.operators.understanding import understand
from shelfmark.plans.report import answer_requests, resolve_filters, search_payload
from shelfmark.plans.search import Corpus, search

CREW = ["Ines Okafor", "Marek Lindqvist", "Marta Okonjo", "Tomas van Dyk", "Yun Hee Park"]
REGATTAS = [("r-07", "Spring Regatta", "2019-04-13"), ("r-08", "Harbour Relay", "2019-09-02"),
            ("r-09", "Harbour Relay", "2019-09-21"), ("r-10", "Lantern Row", "2020-12-05")]
CLUB = "event_id string, name string, start string"


def column(spark, values, name):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def name_answer(reference, names):
    """The rule in plain Python: whole name, else word prefixes, else substrings."""
    q = reference.strip().lower()
    tiers = [[n for n in names if n.lower() == q],
             [n for n in names if any(w.startswith(q) for w in n.lower().split())],
             [n for n in names if q in n.lower()]]
    best = next((sorted(t) for t in tiers if t), [])
    if len(best) == 1 or tiers[0]:
        return "ok", best[0], 1
    return ("ambiguous" if best else "unknown"), None, len(best)


def test_names_equal_the_rule(spark):
    rng = random.Random(6)
    names = sorted({" ".join("".join(rng.choices("abC", k=rng.randint(1, 5)))
                             for _ in range(rng.randint(1, 3))) for _ in range(60)})
    asked = ["", " ", "zz", "b c", *CREW, "ok", "mar", "van d", "qvi", "PARK "]
    asked += ["".join(rng.choices("abc ", k=rng.randint(1, 6))) for _ in range(80)]
    asked += [n.upper() for n in names[:10]]
    names += CREW
    got = {r.reference: (r.status, r.resolved, r.candidates) for r in resolve_names(
        column(spark, asked, "reference"), column(spark, names, "name")).collect()}
    assert got == {a: name_answer(a, names) for a in asked}


def test_long_references_find_every_name(spark):
    names = ["Customer#000000123", "Customer#000001234", "customer#000000123 b", "Custom"]
    asked = ["customer#000000123", "#00000012", "0000123", "00012", "omer#0000001", "custom", "r#"]
    got = {(r.reference, r.name) for r in name_candidates(
        column(spark, asked, "reference"), column(spark, names, "name")).collect()}
    assert got == {(a, n) for a in asked for n in names if a in n.lower()}


def test_exploded_texts_are_not_broadcast(spark, tmp_path):
    asked = column(spark, CREW, "reference")
    for df, name in ((column(spark, CREW, "name"), "roster"), (asked, "asked"),
                     (spark.createDataFrame(REGATTAS, CLUB), "club")):
        df.write.parquet(f"{tmp_path}/{name}")  # files so small that any side may be broadcast
    roster, asked, club = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("roster", "asked", "club"))
    for found in (name_candidates(asked, roster), resolve_names(asked, roster),
                  event_candidates(asked, club)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        broadcast = plan.split("BroadcastExchange")[1:]
        assert not any("Generate explode" in part for part in broadcast)
        assert "SortMergeJoin" in plan


def test_events_by_id_name_or_part(spark):
    asked = ["R-09", "lantern row", "harbour relay", "2019-04", "2019-09", "r-1", "relay", "gala"]
    got = {r.reference: (r.status, r.resolved) for r in resolve_events(
        column(spark, asked, "reference"), spark.createDataFrame(REGATTAS, CLUB)).collect()}
    assert got == {
        "R-09": ("ok", "r-09"), "lantern row": ("ok", "r-10"), "harbour relay": ("ambiguous", None),
        "2019-04": ("ok", "r-07"), "2019-09": ("ambiguous", None), "r-1": ("ok", "r-10"),
        "relay": ("ambiguous", None), "gala": ("unknown", None)}


@pytest.fixture(scope="module")
def logbook(spark):
    """Who and which regatta is on which of 40 pictures, at random."""
    rng = random.Random(8)
    people = {n: set(rng.sample(range(40), 18)) for n in CREW}
    races = {e: set(rng.sample(range(40), 15)) for e, _, _ in REGATTAS}
    frame = lambda table, fields: spark.createDataFrame(
        [(k, f"p{i:02d}") for k, own in table.items() for i in own], fields)
    return (people, races, frame(people, "name string, path string"),
            frame(races, "event_id string, path string"))


def test_pools_are_all_people_and_any_event(spark, logbook):
    people, races, members, places = logbook
    rng = random.Random(9)
    wants = {f"q{i}": (rng.choices(CREW, k=rng.randint(0, 3)),
                       rng.choices(sorted(races), k=rng.randint(0, 2))) for i in range(30)}
    named = spark.createDataFrame([(q, n) for q, (ns, _) in wants.items() for n in ns],
                                  "query_id string, name string")
    raced = spark.createDataFrame([(q, e) for q, (_, es) in wants.items() for e in es],
                                  "query_id string, event_id string")
    pool = combine_pools(named, images_with_all(named, members), raced,
                         images_in_any(raced, places))
    got = {}
    for r in pool.collect():
        got.setdefault(r.query_id, set()).add(int(r.path[1:]))
    want = {}
    for q, (ns, es) in wants.items():
        sides = ([set.intersection(*(people[n] for n in ns))] if ns else []) + (
            [set.union(*(races[e] for e in es))] if es else [])
        if sides and (found := set.intersection(*sides)):
            want[q] = found
    assert got == want


CASES = [
    # text, answer, persons, events, remaining terms, dropped (text, as, why), source, note
    ("Ines rowing at dawn", '{"persons": ["Ines"]}', ["Ines Okafor"], [], "rowing at dawn", [],
     "model", None),
    ("Lantern Row by night", 'Here: {"events": ["Lantern Row"], "persons": []} done', [], ["r-10"],
     "by night", [], "model", None),
    ("a blue oar", '{"persons": ["Gustav Null"]}', [], [], None,
     [("Gustav Null", "person", "unknown")], "model", "nothing proposed survived validation"),
    ("Mar with a cox", '{"persons": ["Mar"]}', [], [], None, [("Mar", "person", "ambiguous")],
     "model", None),
    ("eight oars", '{"persons": ["Yun Hee Park"]}', [], [], None,
     [("Yun Hee Park", "person", "not named in the query")], "model", None),
    ("Harbour Relay finish", '{"events": ["Harbour Relay"]}', [], [], None,
     [("Harbour Relay", "event", "ambiguous")], "model", None),
    ("Tomas and Tomas van Dyk", '{"persons": ["Tomas", "Tomas van Dyk"]}', ["Tomas van Dyk"], [],
     "and", [], "model", None),
    ("boathouse", "{}", [], [], None, [], "fallback", "no person or event named"),
    ("boathouse", "[]", [], [], None, [], "fallback", "model returned no usable JSON"),
    ("boathouse", '{"persons": [', [], [], None, [], "fallback", "model returned no usable JSON"),
    ("boathouse", None, [], [], None, [], "fallback", "model unavailable"),
]


def test_answers_become_filters(spark):
    asked = spark.createDataFrame([(str(i), c[0], c[1]) for i, c in enumerate(CASES)],
                                  "query_id string, text string, answer string")
    out = understand(asked, column(spark, CREW, "name"), spark.createDataFrame(REGATTAS, CLUB))
    rows = {int(r.query_id): r for r in out.collect()}
    for i, (_, _, persons, events, terms, dropped, source, note) in enumerate(CASES):
        r = rows[i]
        assert (r.persons, r.events, r.source) == (persons, events, source), i
        assert [(d.text, getattr(d, "as"), d.why) for d in r.dropped] == dropped, i
        assert terms is None or r.terms == terms, i
        assert note is None or r.note == note, i


def test_more_events_than_a_filter_holds(spark):
    many = '{"events": [' + ", ".join(['"Spring Regatta"'] * 12) + "]}"
    asked = spark.createDataFrame([("q", "Spring Regatta", many)],
                                  "query_id string, text string, answer string")
    row = understand(asked, column(spark, CREW, "name"),
                     spark.createDataFrame(REGATTAS, CLUB)).first()
    assert [(d.text, d.why) for d in row.dropped] == [("12 events", "too many to be a filter")]


def test_requests_end_to_end(spark, logbook):
    people, races, members, places = logbook
    paths = [f"p{i:02d}" for i in range(40)]
    image = spark.createDataFrame([(p, [1.0 / (i + 1), 0.25]) for i, p in enumerate(paths)],
                                  "path string, vec array<double>")
    corpus = Corpus(image, image.withColumn("caption", F.lit("calm water")).select(
        "path", "caption", "vec"))
    known = spark.createDataFrame(REGATTAS, CLUB)
    asked = spark.createDataFrame(
        [("named", "Ines on calm water", '{"persons": ["Ines"]}', [], []),
         ("listed", "", None, ["Marek"], ["Lantern Row"]), ("blank", "", None, [], []),
         ("unclear", "water", None, ["Mar"], []), ("raced", "water", None, [], ["r-08"])],
        "query_id string, text string, answer string, persons array<string>, "
        "events array<string>").withColumns({
            "image_query": F.array(F.lit(1.0), F.lit(0.0)),
            "caption_query": F.array(F.lit(1.0), F.lit(0.0))})
    outcome, rejected = answer_requests(asked, corpus, members, known, places)
    assert {(r.query_id, r.status) for r in rejected.collect()} == {
        ("blank", "give q, person or event"), ("unclear", "ambiguous")}
    got = {}
    for r in outcome.results.orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(int(r.path[1:]))
    assert got["named"] == sorted(people["Ines Okafor"])
    assert sorted(got["listed"]) == sorted(people["Marek Lindqvist"] & races["r-10"])
    assert got["raced"] == sorted(races["r-08"])
    basis = {r.query_id: r.basis for r in outcome.summary.collect()}["listed"]
    assert "Marek Lindqvist" in basis and "Lantern Row" in basis


def test_payload_shows_ranks_and_placeholders(spark):
    image = spark.createDataFrame([("oar.jpg", [1.0]), ("hull.jpg", [.5])],
                                  "path string, vec array<double>")
    corpus = Corpus(image, image.withColumn("caption", F.lit("wood")).select(
        "path", "caption", "vec"))
    asked = spark.createDataFrame([("q", "wood", [1.0], [1.0])],
                                  "query_id string, text string, image_query array<double>, "
                                  "caption_query array<double>")
    items = spark.createDataFrame([(0, "oar.jpg", "d1", "oar.jpg", "wood")],
                                  "pos long, path string, sha256 string, filename string, "
                                  "caption string")
    rows = {r.path: r for r in search_payload(search(asked, corpus), asked, corpus, items).collect()}
    assert (rows["hull.jpg"].sha256, rows["hull.jpg"].filename, rows["hull.jpg"].image_rank) == (
        None, "hull.jpg", 2)
    assert rows["oar.jpg"].sha256 == "d1" and rows["oar.jpg"].caption_rank == 1


def test_resolve_filters_counts(spark, logbook):
    people, races, members, places = logbook
    asked = spark.createDataFrame([("q", ["Marta"], ["r-07"])],
                                  "query_id string, persons array<string>, events array<string>")
    ready, pool, problems = resolve_filters(
        asked, members, spark.createDataFrame(REGATTAS, CLUB), places)
    row = ready.first()
    assert row.person_counts == {"Marta Okonjo": 18}
    assert row.event_counts == {"Spring Regatta": 15}
    assert {int(r.path[1:]) for r in pool.collect()} == people["Marta Okonjo"] & races["r-07"]
    assert problems.count() == 0


def test_one_pool_equals_both_pools(spark):
    rng = random.Random(4)
    members = [(f"n{rng.randint(0, 4)}", f"p{rng.randint(0, 60)}") for _ in range(300)]
    members += [("hot", f"p{i}") for i in range(60)]
    trips = [(f"e{rng.randint(0, 5)}", f"p{i}") for i in range(60)]
    persons = [(f"q{rng.randint(0, 20)}", rng.choice(["n0", "n1", "n2", "hot", "nobody"]))
               for _ in range(30)]
    chosen = [(f"q{rng.randint(0, 20)}", f"e{rng.randint(0, 6)}") for _ in range(30)]
    has, lies = {}, {}
    for name, path in members:
        has.setdefault(path, set()).add(name)
    for event, path in trips:
        lies.setdefault(path, set()).add(event)
    want = set()
    for q in {q for q, _ in persons + chosen}:
        names, events = {n for k, n in persons if k == q}, {e for k, e in chosen if k == q}
        want |= {(q, f"p{i}") for i in range(61) if names <= has.get(f"p{i}", set())
                 and (not events or events & lies.get(f"p{i}", set()))}
    pool = filter_pool(
        spark.createDataFrame(persons, "query_id string, name string"),
        spark.createDataFrame(members, "name string, path string"),
        spark.createDataFrame(chosen, "query_id string, event_id string"),
        spark.createDataFrame(trips, "event_id string, path string"))
    got = [tuple(r) for r in pool.collect()]
    assert len(got) == len(want) and set(got) == want
