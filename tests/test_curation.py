import hashlib
import json
import os
import random
from collections import Counter
from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfmark.functions.vectors import norm, unit
from shelfmark.operators.audit import (
    coverage, coverage_report, failure_report, multiset_delta, order_fingerprint,
    regression_files, regression_report, source_state, verify_index,
)
from shelfmark.operators.catalog import (
    build_catalog, library, library_page, missing_files, orphan_files, with_records,
)
from shelfmark.operators.enrich import (
    acceptable, fit_longest, quality_counts, run_enricher, todo,
)
from shelfmark.operators.events import build_events, event_index, event_roster, gap_sessions
from shelfmark.operators.palette import nearest_anchor, palette, timeline
from shelfmark.operators.people import (
    forget_label, label_status, label_votes, labels_json, name_clusters, people_index,
    people_roster, read_label_map, set_label, unplaced_counts,
)
from shelfmark.plans.report import enrichment_by_chunks, enrichment_run
from shelfmark.sources.tables import (
    append_table, hash_files, list_files, publish_index, read_baseline, read_index, read_labels,
    read_manifest, read_optional, write_baseline, write_csv,
)
from shelfmark.streaming.landing import enrich_landed, live_events

T0 = datetime(2020, 6, 1, 10)


# -- events ------------------------------------------------------------------

def test_gap_is_inclusive(spark):
    hours = timedelta(hours=72)
    rows = [(T0,), (T0 + hours,), (T0 + 2 * hours + timedelta(seconds=1),)]
    got = gap_sessions(spark.createDataFrame(rows, "ts timestamp"), "ts").orderBy("ts").collect()
    assert [r.session for r in got] == [1, 1, 2]


def test_sessions_match_a_sorted_scan(spark):
    import random

    rng = random.Random(1)
    rows = [("hot" if i % 3 == 0 else f"k{i % 7}", T0 + timedelta(minutes=rng.randrange(40_000)), i)
            for i in range(1500)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, id int").repartition(6)
    got = {r.id: r.session for r in gap_sessions(df, "ts", 2.0, ["k"]).collect()}
    by_key = {}
    for k, ts, i in rows:
        by_key.setdefault(k, []).append((ts, i))
    for members in by_key.values():
        session, last = 0, None
        for ts, i in sorted(members):
            if last is None or ts - last > timedelta(hours=2):
                session += 1
            last = ts
            assert got[i] == session


def test_one_order_is_numbered_range_by_range(spark):
    rng = random.Random(6)
    times, now = [], 0
    for _ in range(3000):
        now += rng.choice([600, 3_000, 30_000, 90_000, 400_000])
        times += [now] * rng.choice([1, 1, 3])
    rows = [(i, t) for i, t in enumerate(times)] + [(-1, None)]
    df = spark.createDataFrame(rows, "id long, at long").repartition(9).select(
        "id", F.timestamp_seconds("at").alias("ts"))
    found = gap_sessions(df, "ts", 20.0)
    want, session, last = {}, 0, None
    for i, t in enumerate(times):
        session += last is None or t - last > 20 * 3600
        want[i], last = session, t
    assert {r.id: r.session for r in found.collect()} == want
    assert "SinglePartition" not in found._jdf.queryExecution().toString()
    roster = event_roster(spark.createDataFrame(
        [(f"e{i:03d}", str(2000 + i % 50)) for i in range(500)] + [("unassigned", None)],
        "event_id string, start string"))
    assert "SinglePartition" not in roster._jdf.queryExecution().toString()
    got = [r.event_id for r in roster.orderBy("place").collect()]
    assert got == ["unassigned", *sorted((f"e{i:03d}" for i in range(500)),
                                         key=lambda e: (-(int(e[1:]) % 50), e))]
    assert gap_sessions(df.filter("id < 0"), "ts").count() == 0


def test_event_build(spark):
    def row(pos, hours, subject, thread):
        ts = None if hours is None else T0 + timedelta(hours=hours)
        return (pos, f"p{pos}", f"p{pos}.jpg", ts, subject, thread)

    rows = [row(0, 0, "Re: Picnic", "x"), row(1, 1, "picnic ", "y"), row(2, 2, "Fwd: Picnic", ""),
            row(3, 3, "Picnic", "x"), row(4, 4, "other", ""), row(5, 24 * 60, "a", "y"),
            row(6, 24 * 61, "b", ""), row(7, None, "z", "x"), row(8, None, "z", "y"),
            row(9, None, "z", " ")]
    catalog = spark.createDataFrame(
        rows, "pos long, path string, filename string, ts timestamp, subject string, thread string")
    out = build_events(catalog).withColumn("pos", F.substring("path", 2, 3).cast("long"))
    got = {r.path: r for r in out.collect()}
    assert {got[f"p{i}"].event_name for i in (0, 1, 2, 3, 4, 7)} == {"Picnic (Jun 2020)"}
    assert (got["p7"].date_source, got["p7"].event_id, got["p7"].image_count) == (
        "thread", "event-001", 6)
    assert got["p5"].event_name == "Jul 2020 - Aug 2020" or got["p5"].event_name == "Jul 2020"
    assert {(got[p].event_id, got[p].image_count) for p in ("p8", "p9")} == {("unassigned", 2)}
    roster = event_roster(event_index(out)).orderBy("place").collect()
    assert [r.event_id for r in roster] == ["unassigned", "event-002", "event-001"]


# -- people ------------------------------------------------------------------

def faces(spark):
    rows = [(0, "f1", "A", "img1.jpg"), (1, "f2", "A", "img2.jpg"), (2, "f3", "A", "img2.jpg"),
            (3, "f4", "B", "img2.jpg"), (4, "f5", "B", "img3.jpg"), (5, "f6", "unassigned", "img3.jpg"),
            (6, "f7", None, "img3.jpg"), (7, "f8", "C", "img4.jpg")]
    return spark.createDataFrame(rows, "pos long, face_id string, cluster string, path string")


def labels(spark):
    return spark.createDataFrame([("f1", "Ada"), ("f3", "Ada"), ("f2", "Bo"), ("f4", "Bo")],
                                 "face_id string, name string")


def test_labels(spark):
    votes = {r.cluster: (r.name, r.votes) for r in label_votes(faces(spark), labels(spark)).collect()}
    assert votes == {"A": ("Ada", 2), "B": ("Bo", 1)}
    notes = {r.cluster: r.note for r in label_status(
        faces(spark).fillna("unassigned"), labels(spark)).collect()}
    assert notes == {"A": "Ada  (2/3 known)", "B": "Bo  (1/2 known)", "C": "-", "unassigned": "-"}
    index = people_index(faces(spark), labels(spark))
    assert {(r.name, r.images, r.faces) for r in people_roster(index).collect()} == {
        ("Ada", 2, 2), ("Bo", 1, 2)}
    assert {r.path: r.unplaced for r in unplaced_counts(faces(spark)).collect()} == {"img3.jpg": 2}
    moved = set_label(faces(spark), labels(spark), "A", "Bo")
    assert {(r.face_id, r.name) for r in moved.collect()} == {
        ("f1", "Bo"), ("f2", "Bo"), ("f3", "Bo"), ("f4", "Bo")}
    assert {r.name for r in forget_label(labels(spark), "Ada").collect()} == {"Bo"}


def test_label_map_round_trip(spark, tmp_path):
    text = '{"Ada": ["f1", "f2"], "Bo": ["f2", "f3"], "None": []}'
    path = tmp_path / "labels.json"
    path.write_text(text)
    got = {r.face_id: r.name for r in read_labels(spark, str(path)).collect()}
    assert got == {"f1": "Ada", "f2": "Bo", "f3": "Bo"}  # the later name wins
    lines = labels_json(spark.createDataFrame(list(got.items()), "face_id string, name string"), 1)
    assert lines.count() == 3
    back = {r.face_id: r.name for r in read_label_map(lines.select("value")).collect()}
    assert back == got


def test_cluster_names(spark):
    rows = [(1, 1), (2, 1), (3, 3), (4, 3), (5, 3), (6, None), (7, 7), (8, 7)]
    got = {r.id: r.person for r in name_clusters(
        spark.createDataFrame(rows, "id long, cluster long")).collect()}
    assert got[3] == "Person_001" and got[1] == "Person_002" and got[7] == "Person_003"
    assert got[6] == "unassigned"


# -- catalog -----------------------------------------------------------------

def test_provenance_and_reconciliation(spark):
    files = spark.createDataFrame(
        [("/a/2020/05/x.JPG", "2020/05/x.JPG", "h1"), ("/a/new/y.jpg", "new/y.jpg", "h2"),
         ("/a/z.jpg", "z.jpg", "h3")], "path string, relative_path string, sha256 string")
    manifest = spark.createDataFrame(
        [(0, "/a//2020/05/./x.JPG", " H1 ", "first"), (1, "/a/2020/05/x.JPG", "H1", "last"),
         (2, "/old/y.jpg", "H2", "moved"), (3, "/gone.jpg", "h9", "gone"), (4, "", "", "blank")],
        "row_no int, downloaded_path string, sha256 string, subject string")
    got = {r.filename: r for r in build_catalog(files, manifest).collect()}
    assert (got["x.JPG"].subject, got["x.JPG"].extension, got["x.JPG"].directory_year) == (
        "last", ".jpg", "2020")
    assert (got["y.jpg"].provenance_status, got["y.jpg"].sha256) == ("MANIFEST", "H2")
    assert got["z.jpg"].provenance_status == "UNTRACKED"
    assert [got[n].pos for n in ("x.JPG", "y.jpg", "z.jpg")] == [0, 1, 2]
    orphans = {r.path: r.status for r in orphan_files(files, manifest).collect()}
    assert orphans == {"/a/new/y.jpg": "HASH_EXISTS_IN_MANIFEST", "/a/z.jpg": "NO_MANIFEST_RECORD"}
    assert [r.row_no for r in missing_files(files, manifest).collect()] == [3]


def test_library(spark):
    catalog = spark.createDataFrame(
        [(0, "/p/a.jpg", "s1", "a.jpg", "2002:08:31 20:01:57"), (1, "/p/b.jpg", "s2", "b.jpg", ""),
         (2, "/p/c.jpg", "s3", "c.jpg", None)],
        "pos long, path string, sha256 string, filename string, best_exif_date string")
    captions = spark.createDataFrame([(0, "/p/a.jpg", "old"), (1, "/p/a.jpg", "new")],
                                     "row_no int, path string, caption string")
    thumbs = spark.createDataFrame(
        [(0, "/p/a.jpg", 400, 300, 1600, 1200), (1, "/p/c.jpg", None, None, None, None)],
        "row_no int, path string, grid_width int, grid_height int, lightbox_width int, "
        "lightbox_height int")
    items = library(catalog, captions, thumbs)
    got = {r.sha256: r for r in items.collect()}
    assert (got["s1"].caption, got["s1"].grid.width) == ("new", 400)
    assert got["s1"].captured == "2002-08-31T20:01:57" and got["s2"].captured is None
    assert got["s3"].grid is None and got["s3"].lightbox is None
    page = library_page(items, 1, 5)
    assert page.count() == 2 and page.first().total == 3
    assert library_page(items, 9, 5).count() == 0
    stray = spark.createDataFrame([("/q/x.jpg", 1)], "path string, rank int")
    row = with_records(stray, items).first()
    assert (row.sha256, row.filename, row.caption) == (None, "x.jpg", "")


# -- audit -------------------------------------------------------------------

def fingerprint(paths, chunk):
    """The rule in plain Python: chunk digests, bound to their number, summed in two parts."""
    low = high = 0
    for at in range(0, len(paths), chunk):
        body = "".join(p + "\n" for p in paths[at:at + chunk])
        digest = hashlib.sha256(body.encode()).hexdigest()
        bound = hashlib.sha256(f"{at // chunk}|{digest}".encode()).hexdigest()
        low, high = low + int(bound[:15], 16), high + int(bound[15:30], 16)
    return hashlib.sha256(f"{len(paths)}|{low}|{high}".encode()).hexdigest()


def test_fingerprint_has_one_rule_at_every_size(spark):
    def digest(paths, chunk=2):
        return order_fingerprint(spark.createDataFrame(
            list(enumerate(paths)), "pos long, path string"), chunk)

    for n in (0, 1, 2, 3, 9):  # none, one, one full, two and five chunks
        paths = [f"row/{i}" for i in range(n)]
        assert digest(paths).first() == (n, fingerprint(paths, 2))
    straight, turned = digest(["x", "y", "z"]), digest(["x", "z", "y"])
    assert straight.first() != turned.first()
    kept = straight.select(F.col("fingerprint").alias("lookup_fingerprint"))
    assert verify_index(3, straight, kept).first() == (True, "")
    assert verify_index(4, straight, kept).first().reason == "row counts differ"
    assert verify_index(3, turned, kept).first().reason == "rows added, removed or reordered"
    assert verify_index(3, straight, kept.limit(0)).first().reason == "manifest missing"


def test_coverage_equals_sets(spark):
    rng = random.Random(11)
    wanted = {f"k{i}" for i in range(30)}
    held = {name: {f"k{rng.randrange(40)}" for _ in range(25)} for name in ("wide", "narrow", "odd")}
    held["full"] = set(wanted)
    base = spark.createDataFrame([(k,) for k in wanted], "key string")
    rows = spark.createDataFrame([(n, k) for n, own in held.items() for k in own for _ in range(2)],
                                 "artifact string, key string")
    got = {r.artifact: (r.covers, r.missing, r.orphaned)
           for r in coverage(base, rows, sorted(held)).collect()}
    assert got == {n: (len(own), len(wanted - own), len(own - wanted)) for n, own in held.items()}

    states = ["ok", "", "broken", "locked"]
    seen = [(n, i, f"/d/{n}{i}.png", rng.choice(states)) for n in ("wide", "full") for i in range(50)]
    noted = spark.createDataFrame(seen, "artifact string, pos int, path string, status string")
    stamp = spark.createDataFrame(
        [("narrow", "info.json", '{"hash": "b1"}', "hash", "rows.csv", "b2"),
         ("full", "info.json", '{"hash": "b2"}', "hash", "rows.csv", "b2")],
        "artifact string, manifest_name string, manifest_text string, field string, "
        "source_name string, source_sha256 string")
    built = spark.createDataFrame(
        [(n, True, True, "rows.csv") for n in held]
        + [("absent", False, True, "rows.csv"), ("baseless", True, False, "lost.csv")],
        "artifact string, built boolean, base_built boolean, base_name string")
    report = {r.artifact: r for r in coverage_report(
        built, coverage(base, rows, sorted(held)), source_state(stamp),
        failure_report(noted)).collect()}
    for n, own in held.items():
        why = [f"{len(wanted - own)} not covered"] * bool(wanted - own)
        why += [f"{len(own - wanted)} no longer in catalog"] * bool(own - wanted)
        why += ["built from superseded rows.csv"] * (n == "narrow")
        bad = Counter(s for a, _, _, s in seen if a == n and s not in ("ok", ""))
        note = ", ".join(f"{c} {s}" for s, c in sorted(bad.items()))
        assert report[n].status == ", ".join(
            ["STALE - " + ", ".join(why) if why else "OK"] + [note] * bool(note))
        assert report[n].stale == bool(why) and report[n].source_stale == (n == "narrow")
        first = [p.rsplit("/", 1)[1] for a, _, p, s in seen if a == n and s in bad][:5]
        assert (report[n].examples or []) == first
    assert (report["absent"].status, report["absent"].covers) == ("MISSING", None)
    assert report["baseless"].status == "UNMEASURABLE - lost.csv missing"


def test_event_index_gathers_no_event(spark):
    # Nearly all rows are of one event: its rows were sorted together, in one task.
    rows = spark.range(2000).select(
        F.when(F.col("id") % 500 == 499, "rare").when(F.col("id") > 0, "big").alias("event_id"),
        F.concat(F.lit("n"), F.col("id") % 7).alias("event_name"),
        F.timestamp_seconds("id").alias("event_start"), F.timestamp_seconds("id").alias("event_end"),
        F.when(F.col("id") % 10 != 3, F.concat(F.lit("p"), F.col("id") % 100)).alias("path"),
        (-F.col("id")).alias("pos"))
    index = event_index(rows)
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert "min_by" not in plan and "distinct" not in plan
    got = {r.event_id: (r.name, r.start, r.images) for r in index.collect()}
    start = {r.pos: r.event_start for r in rows.collect()}
    assert got == {None: ("n0", start[0], 1), "rare": ("n4", start[-1999], 1),
                   "big": ("n3", start[-1998], 90)}


def test_regression_equals_multisets(spark):
    rng = random.Random(12)

    def run(suite):
        return [(q, f"f{rng.randrange(5)}") for q in suite for _ in range(rng.randrange(1, 6))]

    was, now = run(["oar", "hull", "keel", "gone"]), run(["oar", "hull", "keel", "added"])
    frame = lambda rows: spark.createDataFrame(rows, "query string, filename string")
    old, new = Counter(was), Counter(now)
    delta = {(r.query, r.filename): (r.gained, r.lost)
             for r in multiset_delta(frame(was), frame(now), ["query", "filename"]).collect()}
    assert delta == {k: (max(0, new[k] - old[k]), max(0, old[k] - new[k])) for k in old | new}
    want = {}
    for q in ("oar", "hull", "keel"):
        up = sum(n for k, n in (new - old).items() if k[0] == q)
        down = sum(n for k, n in (old - new).items() if k[0] == q)
        if up or down:
            want[q] = ("moved", sum(k == q for k, _ in was), sum(k == q for k, _ in now), up, down)
    want["gone"] = ("dropped", sum(k == "gone" for k, _ in was), None, 0,
                    sum(k == "gone" for k, _ in was))
    want["added"] = ("new", None, sum(k == "added" for k, _ in now),
                     sum(k == "added" for k, _ in now), 0)
    assert want == {r.query: (r.kind, r.was, r.now, r.gained, r.lost)
                    for r in regression_report(frame(was), frame(now)).collect()}
    assert regression_files(frame(was), frame(was)).count() == 0
    assert regression_report(frame(now), frame(now)).count() == 0


def test_regression_reads_each_side_once(spark):
    frame = lambda rows: spark.createDataFrame(rows, "query string, filename string")
    old, new = frame([("a", "x"), (None, "x"), ("b", "x")]), frame([("a", "y"), (None, "x")])
    report = regression_report(old, new)
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 2
    assert {tuple(r) for r in report.collect()} == {
        ("a", "moved", 1, 1, 1, 1), ("b", "dropped", 1, None, 0, 1)}
    suites = [spark.createDataFrame([(q,) for q in given], "query string")
              for given in (["a", "empty"], ["a", "other"])]
    assert {tuple(r) for r in regression_report(old, new, *suites).collect()} == {
        ("a", "moved", 1, 1, 1, 1), ("empty", "dropped", 0, None, 0, 0),
        ("other", "new", None, 0, 0, 0)}


# -- colour ------------------------------------------------------------------

def test_palette(spark):
    flat = {"red": (255, 0, 0, 0), "yellow": (255, 255, 0, 60), "green": (0, 255, 0, 120),
            "cyan": (0, 255, 255, 180), "blue": (0, 0, 255, 240), "pink": (255, 0, 255, 300)}
    rows = [(k, r, g, b) for k, (r, g, b, _) in flat.items() for _ in range(5)]
    rows += [("black", 0, 0, 0), ("grey", 128, 128, 128), ("white", 255, 255, 255)]
    rows += [("wrap", 255, 0, 6)] * 8 + [("wrap", 255, 6, 0)] * 8
    rows += [("mostly", 90, 90, 90)] * 9 + [("mostly", 0, 0, 255)]
    df = spark.createDataFrame(rows, "id string, r int, g int, b int")
    got = {r.id: r for r in palette(df).collect()}
    for name, (*_, hue) in flat.items():
        off = abs((got[name].hue - hue + 180) % 360 - 180)
        assert off < 1e-6, name
    assert got["black"].hue is None and got["grey"].hue is None and got["white"].hue is None
    assert got["black"].lightness == 0 and got["white"].lightness == pytest.approx(1)
    assert abs((got["wrap"].hue + 180) % 360 - 180) < 10
    assert got["mostly"].hue == pytest.approx(240)


def test_a_hue_on_the_boundary_goes_by_its_rounded_distance(spark):
    """125.00000000000001 lies 10 from a centre of 115, as far as doubles tell."""
    pixels = [("over", 21, 252, 0)] * 3 + [("over", 0, 48, 4)]
    got = palette(spark.createDataFrame(pixels, "id string, r int, g int, b int")).first()
    assert got.hue == pytest.approx(117.49, abs=0.02)  # 115 without the boundary's pixel


def test_anchor_and_strip(spark):
    def anchor(hue):
        return spark.range(1).select(nearest_anchor(F.lit(hue).cast("double")).alias("a")).first().a
    assert anchor(12).anchor == "terracotta"  # halfway: the first wins
    assert anchor(350).anchor == "terracotta" and anchor(None).color == "#9a9086"
    marks = spark.createDataFrame(
        [(0, "a", 6.0, 1.0, "2020-01-01T00:00:00"), (1, "b", None, None, None),
         (2, "c", 6.0, 0.0, "2020-01-11T00:00:00"), (3, "d", 90.0, .5, None)],
        "pos long, sha256 string, hue double, lightness double, captured string")
    got = {r.sha256: r for r in timeline(marks, 243.0).collect()}
    assert (got["a"].x, got["c"].x, got["a"].height, got["c"].height) == (0, 100, 72, 5)
    assert (got["b"].x, got["d"].x, got["b"].width) == (140, 240, 1.6)
    assert got["d"].color == "#718162" and all(r.lit for r in got.values())


# -- enrichment, sources, streams ----------------------------------------------

def test_fit_and_quality(spark):
    cases = {(4000, 3000): (400, 300), (3000, 4000): (300, 400), (200, 150): (200, 150),
             (10000, 3): (400, 1), (0, 5): None, (1000, 125): (400, 50)}
    for (w, h), expected in cases.items():
        row = spark.range(1).select(fit_longest(F.lit(w), F.lit(h), F.lit(400)).alias("s")).first()
        assert (tuple(row.s) if row.s else None) == expected
    rows = spark.createDataFrame(
        [(.6, 40, 40, [1.0]), (.59, 40, 40, [1.0]), (.9, 39, 40, [1.0]), (.9, 40, 40, [0.0])],
        "s double, w int, h int, v array<double>")
    keep = acceptable(F.col("s"), F.col("w"), F.col("h"), F.col("v"))
    assert quality_counts(rows, keep).first() == (1, 3)
    row = rows.select(norm(unit(F.array(F.lit(3.0), F.lit(4.0)))).alias("n"),
                      unit(F.array(F.lit(0.0))).alias("z")).first()
    assert row.n == pytest.approx(1) and row.z is None


def test_enrichment_resumes(spark):
    catalog = spark.createDataFrame([(i, f"/p/{i}.jpg") for i in range(6)], "pos long, path string")
    done = spark.createDataFrame([("/p/1.jpg",)], "path string")
    assert [r.pos for r in todo(catalog, done, limit=2).collect()] == [0, 2]
    assert todo(catalog, done, force=True).count() == 6

    def enrich(row):
        if row["pos"] == 3:
            raise OSError("broken")
        return [{"score": float(i)} for i in range(row["pos"] % 3)]

    ledger, outputs = enrichment_run(catalog, done, enrich, "score: double", existing_outputs=7)
    got = {r.path: (r.filename, r.found, r.status) for r in ledger.collect()}
    assert got["/p/0.jpg"] == ("0.jpg", 0, "ok") and got["/p/3.jpg"] == ("3.jpg", 0, "unreadable")
    assert "/p/1.jpg" not in got and len(got) == 5
    assert {r.path: r.reason for r in ledger.collect()}["/p/3.jpg"] == "OSError: broken"

    def in_batches(frame):
        assert len(frame) <= 4
        return [enrich(row) for row in frame.to_dict("records")]

    batched = enrichment_run(catalog, done, in_batches, "score: double", existing_outputs=7,
                             batch_rows=4)
    for one, other in zip(batched, (ledger, outputs)):
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect()))
    rows = [(r.face_id, r.path, r.score) for r in outputs.collect()]
    assert sorted(rows) == [("10", "/p/5.jpg", 0.0), ("11", "/p/5.jpg", 1.0), ("7", "/p/2.jpg", 0.0),
                            ("8", "/p/2.jpg", 1.0), ("9", "/p/4.jpg", 0.0)]


def test_batches_go_by_their_bytes(spark, tmp_path):
    from shelfmark.registry import base

    spark.createDataFrame([("x",)], "text string").write.parquet(f"{tmp_path}/t.parquet")
    base.load(spark, str(tmp_path), "t")  # as every registered query does

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})

    rows = spark.range(0, 3_000, 1, 1).select(F.repeat(F.lit("12345678"), 1_250).alias("text"))
    assert rows.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0] < 9 << 20


def test_pieces_of_a_batch_are_whole(spark):
    rows = spark.range(0, 700, 1, 1).select(F.col("id").cast("string").alias("path"))
    for step in (None, 300):
        made = (lambda r: [{"n": r["path"]}]) if step is None else (
            lambda f: [[{"n": p}] for p in f["path"]])
        got = run_enricher(rows, made, "n string", step).collect()
        assert sorted(int(r.path) for r in got) == list(range(700))
        assert all(r.outputs[0].n == r.path and r.status == "ok" for r in got)


def test_a_run_that_breaks_off_loses_one_chunk(spark, tmp_path):
    calls, folder = tmp_path / "calls", str(tmp_path / "enriched")
    calls.mkdir()
    catalog = spark.createDataFrame(
        [(i, f"/p/{i:02d}.jpg") for i in range(11)], "pos long, path string")
    ready = str(tmp_path / "ready")

    def enrich(row):
        if row["pos"] == 7 and not os.path.exists(ready):
            os._exit(1)  # as when the machine goes
        with open(f"{calls}/{row['pos']}", "a") as file:
            file.write("x")
        return [{"score": float(i)} for i in range(row["pos"] % 3)]

    def run():
        return enrichment_by_chunks(catalog, folder, enrich, "score: double", chunk_rows=3)

    with pytest.raises(Exception):
        run()
    first = {r.path for r in spark.read.parquet(folder).collect()}
    assert first == {f"/p/{i:02d}.jpg" for i in range(6)}
    (tmp_path / "ready").touch()
    ledger, outputs = run()
    assert sorted(r.path for r in ledger.collect()) == [f"/p/{i:02d}.jpg" for i in range(11)]
    assert all((calls / str(i)).read_text() == "x" for i in range(6))
    whole, numbered = enrichment_run(
        catalog, ledger.limit(0), enrich, "score: double")
    assert sorted(map(tuple, ledger.collect())) == sorted(map(tuple, whole.collect()))
    assert sorted(map(tuple, outputs.collect())) == sorted(map(tuple, numbered.collect()))
    before = len((calls / "0").read_text())
    assert run()[0].count() == 11 and len((calls / "0").read_text()) == before


def test_files_and_tables(spark, tmp_path):
    import hashlib

    photos = tmp_path / "photos" / "2020" / "05"
    photos.mkdir(parents=True)
    (photos / "a.JPG").write_bytes(b"one")
    (photos / "b.txt").write_bytes(b"two")
    (photos / "c.png").write_bytes(b"three")
    root = str(tmp_path / "photos")
    listed = {r.relative_path: r.length for r in list_files(spark, root).collect()}
    assert listed == {"2020/05/a.JPG": 3, "2020/05/c.png": 5}
    hashed = {r.path.rsplit("/", 1)[1]: r.sha256 for r in hash_files(spark, root).collect()}
    assert hashed["a.JPG"] == hashlib.sha256(b"one").hexdigest()

    schema = "source_path STRING, filename STRING, caption STRING"
    odd = tmp_path / "captions.csv"
    odd.write_bytes(b'\xef\xbb\xbfsource_path,filename,caption\n/p/a,a,"two\nlines, ""quoted"""\n/p/b,b,\n')
    table, there = read_optional(spark, str(odd), schema)
    rows = {r.filename: r for r in table.collect()}
    assert there and rows["a"].source_path == "/p/a" and rows["a"].caption == 'two\nlines, "quoted"'
    assert rows["b"].caption is None
    table, there = read_optional(spark, str(tmp_path / "nothing.csv"), schema)
    assert not there and table.count() == 0
    write_csv(spark.createDataFrame([("/p/a", "a", 'x "y"')], schema), str(tmp_path / "out"))
    assert read_optional(spark, str(tmp_path / "out"), schema)[0].first().caption == 'x "y"'

    vectors = spark.createDataFrame([("b", [3.0, 4.0]), ("a", [0.0, 2.0])],
                                    "path string, vec array<float>")
    manifest = publish_index(vectors, str(tmp_path / "index")).first()
    assert (manifest.vectors, manifest.dimension, manifest.min_norm, manifest.max_norm) == (2, 2, 2, 5)
    stored = read_index(spark, str(tmp_path / "index"))
    now = order_fingerprint(stored.select("pos", "path"))
    assert verify_index(2, now, read_manifest(spark, str(tmp_path / "index"))).first().ok
    append_table(vectors, str(tmp_path / "log"))
    append_table(vectors, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4

    stored = tmp_path / "baseline.json"
    stored.write_text(json.dumps({"note": "by hand", "queries": {
        "keel": {"count": 3, "filenames": ["f", "f", "g"]}, "mast": {"count": 0, "filenames": []}}}))
    kept = [("keel", "f"), ("keel", "f"), ("keel", "g"), ("mast", None)]
    read = read_baseline(spark, str(stored))
    assert sorted(map(tuple, read.collect())) == kept
    write_baseline(read.filter("filename is not null"), str(tmp_path / "again"),
                   read.select("query").distinct(), "by hand")
    again = str(tmp_path / "again")
    assert sorted(map(tuple, read_baseline(spark, again).collect())) == kept


def test_streams(spark, tmp_path):
    landing = str(tmp_path / "landing")
    schema = "path string, size int"

    def land(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(landing)

    def run():
        enrich_landed(spark, landing, "path string, size int", str(tmp_path / "out"),
                      str(tmp_path / "ckpt"), lambda r: [{"twice": r["size"] * 2}], "twice: int"
                      ).awaitTermination()
        return {r.path: r.status for r in spark.read.parquet(str(tmp_path / "out/scanned")).collect()}

    land(("/p/a", 1))
    assert run() == {"/p/a": "ok"}
    land(("/p/b", 2))
    assert run() == {"/p/a": "ok", "/p/b": "ok"}

    rows = spark.createDataFrame(
        [("u", T0), ("u", T0 + timedelta(hours=72)), ("u", T0 + timedelta(hours=145)),
         ("v", T0)], "user string, ts timestamp")
    got = sorted((r.user, r.n) for r in live_events(rows, "user").collect())
    assert got == [("u", 1), ("u", 2), ("v", 1)]
