import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from shelfmark.llm import queries
from shelfmark.llm.log_bilinear import LogBilinear, contexts, score_texts
from shelfmark.llm.sentence_spans import Sentences, remove_repeats
from shelfmark.llm.temperature_mix import mix, mix_order, mixture
from shelfmark.llm.toxic_automata import Lexicon, Matcher, features, keep_clean, quoted, toxicity, train
from tests_llm_odd import FIELDS, WORDS, frame, prose, rows


# -- toxicity ------------------------------------------------------------------

def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row


def test_trie_and_automaton_equal_edit_distance():
    rng = random.Random(2)
    for _ in range(100):
        terms = {("".join(rng.choices("abc", k=rng.randint(3, 8))), rng.random() < 0.4):
                 rng.random() for _ in range(rng.randint(1, 8))}
        lexicon = Lexicon(terms)
        for _ in range(40):
            word, best = "".join(rng.choices("abc", k=rng.randint(0, 10))), None
            for (term, stem), weight in terms.items():
                row = edits(term, word)
                d = min(row) if stem else row[-1]
                if d <= (len(term) >= 5 + stem) and (
                        best is None or (d, -weight) < (best[0], -best[1])):
                    best = (d, weight)
            assert lexicon.find(word) == best


def test_quotation_is_told_from_abuse():
    words = 'he wrote “you utter clown” and left'.split()
    assert quoted(words, words.index("clown”")) and not quoted(words, 0)
    matcher = Matcher(Lexicon({("clown", False): 3.0}, frozenset({"crown"})))
    assert features(matcher, " ".join(words))[0] == 0 < features(matcher, " ".join(words))[2]
    assert features(matcher, "you utter clwn")[1] > 0 == features(matcher, "a crown")[1]
    assert features(matcher, None) == features(matcher, "") == [0.0] * 4


@pytest.fixture(scope="module")
def judged(spark):
    rng, docs, labels = random.Random(5), [], []
    for i in range(300):
        words = rng.choices(WORDS, k=rng.randint(20, 60))
        if bad := i % 5 == 0:
            for term in rng.choices(["moronic", "dimwit", "loathsome"], k=3):
                words.insert(rng.randrange(len(words)), term)
        docs.append((i, " ".join(words), "s"))
        labels.append((i, int(bad)))
    docs += [r for r in rows() if r[0] is None or r[0] > 1000] + [
        (900, "moronic dimwit loathsome", "s"), (901, None, "s"), (902, "", "s"),
        (903, "dimwitt " * 3, "s"), (900, "alpha", "s"), (904, "alpha " * 60_000, "s")]
    labels += [(1, None), (None, 1), (5000, 1), (0, 0)]
    return docs, frame(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxic_texts_are_found(spark, judged):
    docs, table, labels = judged
    got = toxicity(table, labels).collect()
    assert len(got) == len(docs)
    for r in got:
        if r.doc_id is not None and r.doc_id < 300:
            assert r.predicted == (r.doc_id % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    assert sorted(r.predicted for r in got if r.doc_id == 900) == [0, 1]
    assert {r.predicted for r in got if r.doc_id in (901, 902, 904)} == {0}
    assert {r.predicted for r in got if r.doc_id == 903} == {1}
    assert toxicity(table.limit(0), labels).count() == 0
    none = toxicity(table, labels.limit(0)).select("predicted").distinct().collect()
    assert [r[0] for r in none] == [0]


def test_rejected_rows_go_and_all_columns_stay(spark, judged):
    docs, table, labels = judged
    named = table.select("doc_id", "text")
    kept = keep_clean(table, *train(named, labels.filter("toxic is not null").selectExpr(
        "doc_id", "toxic = 1 AS toxic")))
    assert kept.schema == table.schema
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert not {i for i in range(0, 300, 5)} & set(ids) and set(range(1, 5)) <= set(ids)


# -- repeated passages ---------------------------------------------------------

def sentences_of(text):
    """(words, first word of each sentence and the end, places that do not rest on a capital)."""
    words, sure, starts = [], {0}, {0}
    for line in (text or "").split("\n"):
        for word in line.split():
            if word[0].isupper():
                starts.add(len(words))
            words.append(word)
            if word[-1] in ".!?":
                sure.add(len(words))
        sure.add(len(words))
    return words, sorted(starts | sure), sure


def brute(data, sizes=(2, 30, 50, 3)):
    seen, out = set(), []
    for i, text, _ in data:
        words, starts, sure = sentences_of(text)
        m, spans = len(starts) - 1, set()
        enough = (lambda s, e: (starts[e] - starts[s] >= sizes[1] and e - s >= sizes[0])
                  or starts[e] - starts[s] > sizes[2])
        for s in range(m):
            spans |= {(s, e) for e in [next((e for e in range(s + 1, m + 1) if enough(s, e)), 0)]
                      if e}
        for e in range(1, m + 1):
            spans |= {(s, e) for s in [next((s for s in range(e - 1, -1, -1) if enough(s, e)), -1)]
                      if s >= 0}
        bounds = [k for k, start in enumerate(starts) if start in sure]
        if sizes[3]:
            spans |= set(zip(bounds, bounds[sizes[3]:]))
        gone = [False] * m
        for s, e in sorted(spans):
            key = " ".join(words[starts[s]:starts[e]]).lower()
            if key in seen:
                gone[s:e] = [True] * (e - s)
            seen.add(key)
        out.append((i, [w for k in range(m) if not gone[k]
                        for w in words[starts[k]:starts[k + 1]]], m, sum(gone)))
    return out


@pytest.mark.parametrize("whole", [3, 0, 2])
def test_repeats_equal_brute_force(spark, whole):
    rng = random.Random(7)
    shared = [prose(rng, 8) for _ in range(3)]
    data = [r for r in rows()[:44]]
    data = [(i, t, s) for i, t, s in data if t]
    for i in range(60, 90):
        data.append((i, f"{prose(rng, 4)} and then {shared[i % 3]} {prose(rng, 3)}", "s"))
        data.append((i + 100, f"{prose(rng, 2)}\nNo. Read on\nof Anna. {prose(rng, 1)}", "s"))
    data.sort()
    got = {r.doc_id: r for r in remove_repeats(frame(spark, data), whole=whole).collect()}
    for i, words, total, gone in brute(data, (2, 30, 50, whole)):
        assert ((got[i].text or "").split(), got[i].n_sentences, got[i].n_removed) == (
            words, total, gone)
    for i, text, _ in data:
        if not got[i].n_removed:
            assert got[i].text == text
    assert sum(r.n_removed > 0 for r in got.values()) > 25


def test_short_runs_of_whole_sentences_go_in_query_and_pipeline(spark, tmp_path):
    footer = "Read on. Sign up here. It is free."
    texts = [f"Text one of Anna ends so.\n{footer}", f"{footer}\nText two of Bob goes on.",
             f"Text three is new. {footer} More follows.", "See Anna. Sign up now. So it is.",
             "Met Anna. Sign off now. So it is.", "Yes. No. A new end.", "Yes. No. An old end."]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(
        f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for got in (queries.op7_sentence_spans(spark, str(tmp_path)),
                corpus_pipeline.passages(spark, docs, str(tmp_path))):
        assert {r.doc_id: (r.text or "").split() for r in got.collect()} == dict(enumerate(
            t.split() for t in [texts[0], "Text two of Bob goes on.",
                                "Text three is new. More follows.", *texts[3:]]))


def test_texts_that_share_an_id_count_as_documents(spark):
    rng = random.Random(9)
    shared, own = prose(rng, 8), [prose(rng, 3) for _ in range(6)]
    texts = [(1, f"{shared} {own[0]}"), (1, f"{own[1]} {shared}"), (1, f"{own[1]} {shared}"),
             (1, f"{shared} {own[2]} {shared}"), (2, f"{own[3]} {shared}"), (3, own[4]), (3, own[5])]
    got = remove_repeats(spark.createDataFrame(
        [(i, t, "s") for i, t in texts], "doc_id long, text string, source string")).collect()
    # Exactly one version of the smallest id keeps the passage, once; equal rows are alike.
    left = [r for r in got if shared in r.text]
    assert {r.doc_id for r in left} == {1} and len({r.text for r in left}) == 1
    assert all(r.text.count(shared) == 1 for r in left)
    assert sorted(r.text.replace(shared, "").strip() for r in got) == sorted(
        [own[0], own[1], own[1], own[2], own[3], own[4], own[5]])


def test_spans_that_come_again_in_their_text_are_not_shuffled(spark):
    # Each was shuffled three times: to be counted, to be joined, and to be told apart.
    again = " ".join(["Here is a line. It comes again. And once more."] * 400)
    docs = spark.createDataFrame([(i, f"Text {i}. {again}") for i in range(20)],
                                 "doc_id long, text string").repartition(4)
    context = spark.sparkContext
    context.setJobGroup("passages", "")
    got = remove_repeats(docs).collect()
    context.setLocalProperty("spark.jobGroup.id", None)
    assert sum(r.n_sentences for r in got) == 20 * 1201 and all(r.n_removed > 1000 for r in got)
    tracker, store = context.statusTracker(), context._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup("passages") for s in tracker.getJobInfo(j).stageIds}
    assert sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages) < 2_000


def test_odd_rows_keep_their_texts(spark):
    table = frame(spark, rows())
    got = remove_repeats(table)
    assert set(got.columns) == {*table.columns, "n_sentences"} and got.count() == table.count()
    for r in got.filter("doc_id IS NULL OR text IS NULL OR trim(text) = ''").collect():
        assert not r.n_removed or r.text == ""
    assert {r.text for r in got.filter("doc_id = 3").collect()} == {rows()[3][1]}
    assert remove_repeats(spark.createDataFrame([], FIELDS)).count() == 0


def test_any_other_column_name_may_occur(spark):
    names = ["_id", "_version", "_cuts", "version", "cuts", "total", "row", "new", "first", "count",
             "high", "low", "n_sentences", "n_removed"]
    again = " ".join(f"Word {i} of it." for i in range(20))
    data = [(i, f"Text {i} begins. {again}", *range(len(names))) for i in range(3)]
    got = remove_repeats(spark.createDataFrame(
        data, "doc_id long, text string, " + ", ".join(f"{n} long" for n in names))).collect()
    assert {r.doc_id: (r.text.strip(), r["_id"], r["new"], r["low"]) for r in got} == {
        0: (data[0][1], 0, 7, 11), 1: ("Text 1 begins.", 0, 7, 11), 2: ("Text 2 begins.", 0, 7, 11)}
    assert {r.n_removed for r in got} == {0, 20} and {r.n_sentences for r in got} == {21}


# -- mixing --------------------------------------------------------------------

def test_budgets_hold_and_nothing_is_dropped(spark):
    rng = random.Random(1)
    data = [(i, " ".join(rng.choices(WORDS, k=rng.randint(5, 50))),
             "big" if i % 10 else None if i % 20 else "tiny") for i in range(600)]
    data += [(700, None, "void"), (701, "", "void"), (None, "a b", "big")]
    table = frame(spark, data)
    got = mix_order(table).collect()
    tokens, taken, seen = Counter(), Counter(), Counter()
    for i, t, s in data:
        tokens[s] += len((t or "").split())
    for r in got:
        taken[r.source] += r.tokens
        seen[r.doc_id, r.source] += 1
    assert {(i, s) for i, _, s in data} == set(seen)
    most, least = max(tokens.values()), min(n for n in tokens.values() if n)
    alpha = 1 - math.log(2) / math.log(most / least)
    for s, n in tokens.items():
        want = most * (n / most) ** alpha if n else 0
        assert n <= taken[s] <= want + 1 and want - taken[s] < 51
    assert set(seen.values()) == {1, 2}
    copies = mix(table)
    assert copies.columns == table.columns and copies.count() == len(got)
    assert mix(table.limit(0)).count() == 0
    even = Counter()
    for r in mix_order(table.filter("source is not null"), max_repeats=1e9).collect():
        even[r.source] += r.tokens
    assert max(even["big"], even["tiny"]) - min(even["big"], even["tiny"]) < 51


def test_entropy_bound_keeps_weights_apart(spark):
    data = [(i, "a b c", "big" if i % 10 else "tiny") for i in range(200)]
    free = mix_order(frame(spark, data), max_repeats=4.0).count()
    bound = mix_order(frame(spark, data), max_repeats=4.0, max_entropy=0.4).count()
    assert len(data) <= bound < free


# -- language model ------------------------------------------------------------

def test_exponent_does_not_gather_the_sources(spark):
    light = spark.range(600).selectExpr("concat('=', id) AS source_key",
                                        "CASE WHEN id < 500 THEN 7 ELSE id END AS tokens")
    totals, limit = [7] * 500 + list(range(500, 600)), 6.0

    def bisected(fits):
        lo, hi = 0.0, 1.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if fits(mid) else (mid, hi)
        return hi

    def entropy(a):
        total = sum(t ** a for t in totals)
        return -sum(t ** a / total * math.log(t ** a / total) for t in totals)

    plain = mixture(light, max_repeats=2.0)
    assert "collect_list" not in plain._jdf.queryExecution().toString()
    repeats = lambda a, most: (7 / 599) ** (a - 1) <= most
    assert plain.first().exponent == pytest.approx(bisected(lambda a: repeats(a, 2.0)), abs=1e-9)
    bound = mixture(light, max_repeats=1e9, max_entropy=limit).first().exponent
    assert 0 < bound == pytest.approx(bisected(lambda a: entropy(a) <= limit), abs=1e-9)


def test_scores_and_counts(spark):
    rng = random.Random(3)
    data = rows()
    for i in range(100, 2600):
        words = []
        for _ in range(rng.randint(5, 40)):
            words.append(WORDS[(WORDS.index(words[-1]) + 1) % len(WORDS)] if words
                         and rng.random() < 0.9 else rng.choice(WORDS))
        data.append((i, " ".join(words), "s"))
    words_of = lambda t: (t or "").encode().lower().split() + [None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, t, _ in data if not held(i) for w in words_of(t))
    size, distinct = sum(counts.values()), len(counts)
    want = sorted((held(i), len(words_of(t)), sum(w in counts for w in words_of(t)), size,
                   round(sum(math.log10((counts[w] + 1) / (size + distinct + 1))
                             for w in words_of(t)), 6)) for i, t, _ in data)
    got = score_texts(frame(spark, data).coalesce(1), classes=12, head_words=14).collect()
    assert sorted((r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))
                  for r in got) == want
    chained = [r for r in got if r.doc_id and r.doc_id >= 100 and r.held_out]
    assert sum(r.score for r in chained) > sum(r.base_score for r in chained)
    empty = score_texts(frame(spark, [(1, "a", "s")]).limit(0))
    assert empty.count() == 0


def base_scores(data, counts):
    size, distinct = sum(counts.values()), len(counts)
    out = []
    for i, text, _ in data:
        words = (text or "").encode().lower().split() + [None]
        out.append((len(words), sum(counts[w] > 0 for w in words), round(sum(
            math.log10((counts[w] + 1) / (size + distinct + 1)) for w in words), 6)))
    return sorted(out)


@pytest.mark.parametrize("ids", [[0, 3, 4], [2]], ids=["rare end", "nothing to learn from"])
def test_counts_where_the_end_is_rare_or_unknown(spark, ids):
    held = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 7 == 2]
    free = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 7 != 2]
    if len(ids) == 1:
        data = [(held[0], "beta beta gamma", "s")]
    else:
        data = [(free[k], "alpha beta gamma delta " * 50, "s") for k in ids]
        data.append((held[0], "omega beta", "s"))
    counts = Counter(w for i, t, _ in data if i not in held for w in t.encode().split() + [None])
    got = score_texts(frame(spark, data), classes=3, head_words=4).collect()
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == base_scores(
        data, counts)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    model = LogBilinear(np.array([5.0, 3, 2, 1, 4]), 2)
    targets, before = contexts([rng.integers(0, 5, 400), rng.integers(0, 5, 3)], 2, 4)
    assert before[0].tolist() == [4, 4] and before[401].tolist() == [targets[400], 4]
    model.train(targets, before, rng, 0.1)
    total = sum(np.exp(model.log_probabilities(before, np.full(len(targets), k)))
                for k in range(5))
    assert np.allclose(total, 1, atol=1e-5)
