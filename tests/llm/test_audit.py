import itertools
import re

import tests_llm_odd as odd

from shelfmark.llm.filter_audit import audit, failure_counts, interactions, removal_intervals

LABELS = "doc_id long, quality int, toxic int, part string"


def brute(rows, marks):
    """Every order applied filter by filter to every document."""
    facts = []
    for doc_id, text, part in rows:
        t = text or ""
        words = re.findall("[^\x20\x09-\x0D]+", t)
        fails = set()
        if len(words) < 50:
            fails.add("A")
        if 100 * len(set(words)) < 65 * len(words):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t):
            fails.add("C")
        if re.search("[#$%&*|]", t):
            fails.add("D")
        if doc_id is not None and any(
                i is not None and i < doc_id and (u or "") == t for i, u, _ in rows):
            fails.add("E")
        facts.append((part or "", fails, *marks.get(doc_id, (False, False))))
    out = {}
    for part in {f[0] for f in facts}:
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = [f for f in facts if f[0] == part]
            whole = left
            for step, name in enumerate(order, 1):
                gone = [f for f in left if name in f[1]]
                failing = [f for f in whole if name in f[1]]
                left = [f for f in left if name not in f[1]]
                shapley[name] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), len(failing) - len(gone),
                    sum(f[1] == {name} for f in whole), sum(f[2] for f in gone),
                    sum(f[3] for f in gone), name]
        for key, row in out.items():
            if key[0] == part:
                row[-1] = shapley[row[-1]]
    return out


def test_audit_equals_brute_force(spark):
    rows = odd.rows(n=30)
    rows += [(200 + i, t, s) for i, (t, s) in enumerate([
        ("SHOUT " * 60, "s1"), ("a b | c", None), ("x" * 70_000 + " y", ""), (rows[0][1], "s2"),
        ("Ünïcode Ää " * 30, "s1"), (None, "s9"), ("100% of $5", "s9")])]
    marks = [(i, i % 2, i % 3, "x") for i in range(0, 210, 3)]
    marks += [(0, 0, 1, "x"), (None, 1, 1, "x"), (9, None, None, "x"), (1000, 1, 1, "x")]
    merged = {}
    for i, quality, toxic, _ in marks:
        if i is not None:
            good, bad = merged.get(i, (False, False))
            merged[i] = good or quality == 1, bad or toxic == 1
    want = brute([(i, t, s) for i, t, s in rows], merged)
    docs = odd.frame(spark, rows).withColumnRenamed("sig", "digest").withColumnRenamed(
        "_row", "mask")
    got = audit(docs, spark.createDataFrame(marks, LABELS)).collect()
    assert {tuple(r[:3]): list(r[3:]) for r in got} == want
    assert len(got) == len(want)


def test_empty_tables(spark):
    docs = odd.frame(spark, [])
    labels = spark.createDataFrame([], LABELS)
    assert audit(docs, labels).count() == 0
    one = audit(odd.frame(spark, [(1, None, None)]), labels)
    assert one.count() == 600 and {r.part for r in one.collect()} == {""}


def test_one_text_in_many_rows_is_counted_once_per_part(spark):
    rows = [(i, "same words again", f"s{i % 2}") for i in range(1000)]
    counts = failure_counts(odd.frame(spark, rows).select("doc_id", "text", "source").withColumnRenamed(
        "source", "part").select("doc_id", "part", "text"), spark.createDataFrame([], LABELS))
    got = {(r.part, r["mask"]): r.n for r in counts.collect()}
    assert got == {("s0", 1 | 16): 499, ("s0", 1): 1, ("s1", 1 | 16): 500}


def test_intervals_partition_the_ranks():
    for n in (1, 3, 5):
        for mask, spans in enumerate(removal_intervals(n)):
            covered = sorted(r for _, a, b in spans.tolist() for r in range(a, b))
            size = len(list(itertools.permutations(range(n))))
            assert covered == (list(range(size)) if mask else [])


def test_other_numbers_of_filters(spark):
    counts = spark.createDataFrame(
        [("p", 0b01, 5, 1, 0), ("p", 0b11, 2, 2, 1), ("p", 0, 3, 0, 0)],
        "part string, mask int, n long, good long, toxic long")
    got = {(r.filter_order, r.step): r for r in interactions(counts, "xy").collect()}
    assert (got["xy", 1].removed, got["xy", 2].removed, got["yx", 1].removed) == (7, 0, 2)
    assert got["xy", 2].redundant == 2 and got["yx", 2].good_lost == 1
    assert got["xy", 1].shapley == 7 + 5 and got["yx", 2].kept == 3
