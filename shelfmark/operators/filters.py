"""Person and event filters: lenient reference resolution and pools of paths.

Absent and empty are different answers throughout: a request without a filter
has no row in the filter tables and its pool is "everything"; a request whose
filter matched nothing has a filter row and no pool row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNASSIGNED = "unassigned"
GRAMS = (1, 2, 3, 4, 8, 12)  # gram lengths of the substring index


def _pieces(lowered: Column, n: int) -> Column:
    """Every substring of length ``n``."""
    size = F.length(lowered)
    starts = F.when(size >= n, F.sequence(F.lit(1), size - (n - 1))).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(starts, lambda i: F.substring(lowered, i, F.lit(n)))


def _grams(text: Column) -> Column:
    """Every distinct gram of a lower-cased text, the empty one included."""
    lowered = F.lower(text)
    pieces = [_pieces(lowered, n) for n in GRAMS]
    return F.array_distinct(F.concat(F.array(F.lit("")), *pieces))


def _longest_grams(lowered: Column) -> Column:
    """A reference's grams of the greatest indexed length that it reaches."""
    own = F.array(lowered)
    for n in GRAMS:
        own = F.when(F.length(lowered) >= n, _pieces(lowered, n)).otherwise(own)
    return own


def _probes(references: DataFrame, grams: DataFrame) -> DataFrame:
    """(reference, _q, _gram): each reference with its rarest gram in the index.

    A text that contains the reference contains all of its grams, so any one
    finds every match; the rarest meets the fewest texts. The optimiser does
    not see how many grams a text has, so whatever is exploded is merged: taken
    for small, it would be broadcast.
    """
    asked = references.select("reference").distinct().withColumn(
        "_q", F.lower(F.trim("reference")))
    seen = grams.groupBy("_gram").agg(F.count("*").alias("_n"))
    return (
        asked.select("reference", "_q", F.explode(_longest_grams(F.col("_q"))).alias("_gram"))
        .join(seen.hint("merge"), "_gram", "left")
        .groupBy("reference", "_q")
        .agg(F.min_by("_gram", F.struct(F.coalesce("_n", F.lit(0)), "_gram")).alias("_gram"))
    )


def name_candidates(references: DataFrame, roster: DataFrame) -> DataFrame:
    """(reference, name, tier): roster names a typed person reference may mean.

    Tier 1 is the whole name, 2 a word prefix, 3 any substring, case folded.
    All three contain the reference, so the lookup is an equi-join on grams of
    the roster instead of comparing every pair.
    """
    names = roster.select("name").distinct().withColumn(
        "_gram", F.explode(_grams(F.col("name")))
    )
    lowered = F.lower("name")
    tier = (
        F.when(lowered == F.col("_q"), 1)
        .when(F.exists(F.filter(F.split("name", r"\s+"), lambda w: w != ""),
                       lambda w: F.startswith(F.lower(w), F.col("_q"))), 2)
        .when(F.contains(lowered, F.col("_q")), 3)
    )
    return (
        _probes(references, names).join(names.hint("merge"), "_gram")
        .select("reference", "name", tier.alias("tier"))
        .filter("tier IS NOT NULL")
    )


def resolve_names(references: DataFrame, roster: DataFrame) -> DataFrame:
    """(reference, status, resolved, candidates) per distinct person reference.

    Whole names and word prefixes are counted before the join, so a reference
    meets one row of each however many names fit it; grams are only needed for
    references that neither of the two knows. ``candidates`` counts the names
    of the best tier; the names themselves are rows of ``name_candidates``.
    """
    names = roster.select("name", F.lower("name").alias("_l")).distinct()
    whole = names.groupBy(F.col("_l").alias("_q")).agg(F.min("name").alias("_name1"))
    words = F.filter(F.split("_l", r"\s+"), lambda w: w != "")
    starts = F.flatten(F.transform(words, lambda w: F.transform(
        F.sequence(F.lit(0), F.length(w)), lambda n: F.substring(w, F.lit(1), n))))
    begun = names.select("name", F.explode(F.array_distinct(starts)).alias("_q")).groupBy("_q").agg(
        F.count("*").alias("_n2"), F.min("name").alias("_name2"))
    asked = references.select("reference").distinct().withColumn(
        "_q", F.lower(F.trim("reference")))
    known = asked.join(whole.hint("merge"), "_q", "left").join(begun.hint("merge"), "_q", "left")
    inside = name_candidates(
        known.filter("_name1 IS NULL AND _n2 IS NULL").select("reference"), roster
    ).groupBy("reference").agg(F.count("*").alias("_n3"), F.min("name").alias("_name3"))
    found = known.join(inside, "reference", "left")
    exact = F.col("_name1").isNotNull()
    count = F.when(exact, F.lit(1)).otherwise(
        F.coalesce("_n2", "_n3", F.lit(0))).cast("int")
    return _resolution(found, count, F.coalesce("_name1", "_name2", "_name3"))


def _resolution(found: DataFrame, count: Column, value: Column) -> DataFrame:
    return found.select(
        "reference",
        F.when(count == 0, "unknown").when(count > 1, "ambiguous").otherwise("ok")
        .alias("status"),
        F.when(count == 1, value).alias("resolved"),
        count.alias("candidates"),
    )


def event_candidates(references: DataFrame, events: DataFrame) -> DataFrame:
    """(reference, event_id, name, tier) a typed event reference may mean.

    Tier 1 is the id, 2 the whole name, 3 a substring of the name or id or a
    prefix of the start text. ``events`` is (event_id, name, start).
    """
    events = events.select("event_id", "name", F.coalesce("start", F.lit("")).alias("start"))
    known = events.select(
        "event_id", "name", "start",
        F.explode(F.array_distinct(F.concat(
            _grams(F.col("name")), _grams(F.col("event_id")), _grams(F.col("start"))
        ))).alias("_gram"),
    )
    lowered = F.lower("name")
    tier = (
        F.when(F.col("event_id") == F.col("_q"), 1)
        .when(lowered == F.col("_q"), 2)
        .when(F.contains(lowered, F.col("_q")) | F.startswith(F.col("start"), F.col("_q"))
              | F.contains(F.col("event_id"), F.col("_q")), 3)
    )
    return (
        _probes(references, known).join(known.hint("merge"), "_gram")
        .select("reference", "event_id", "name", tier.alias("tier"))
        .filter("tier IS NOT NULL")
    )


def resolve_events(references: DataFrame, events: DataFrame) -> DataFrame:
    """(reference, status, resolved, candidates) per distinct event reference.

    An id wins, then a name held by exactly one event; otherwise every match
    counts, so a month holding several events is ambiguous.
    """
    tiers = event_candidates(references, events).groupBy("reference").agg(
        F.count_if(F.col("tier") == 1).alias("_n1"),
        F.count_if(F.col("tier") == 2).alias("_n2"),
        F.count("*").alias("_n"),
        F.min(F.when(F.col("tier") == 1, F.col("event_id"))).alias("_id1"),
        F.min(F.when(F.col("tier") == 2, F.col("event_id"))).alias("_id2"),
        F.min("event_id").alias("_id3"),
    )
    found = references.select("reference").distinct().join(tiers, "reference", "left")
    by_id, by_name = F.col("_n1") > 0, F.col("_n2") == 1
    count = F.when(by_id | by_name, F.lit(1)).otherwise(
        F.coalesce(F.col("_n"), F.lit(0))).cast("int")
    value = F.when(by_id, F.col("_id1")).when(by_name, F.col("_id2")).otherwise(F.col("_id3"))
    return _resolution(found, count, value)


def images_with_all(wanted: DataFrame, members: DataFrame) -> DataFrame:
    """(query_id, path) holding every wanted name (relational division).

    ``wanted`` is (query_id, name), ``members`` (name, path). Asking for one
    name twice asks for it once.
    """
    asked = _with_need(wanted.select("query_id", "name").distinct())
    return (
        asked.join(members.select("name", "path").distinct(), "name")
        .groupBy("query_id", "path")
        .agg(F.count("*").alias("_have"), F.max("_need").alias("_need"))
        .filter(F.col("_have") == F.col("_need"))
        .select("query_id", "path")
    )


def _with_need(asked: DataFrame) -> DataFrame:
    """``asked`` with the number of its rows per request, which then travels with them.

    Only request rows meet here; whoever is in most paths meets them by name.
    """
    needed = asked.groupBy("query_id").agg(F.count("*").alias("_need"))
    return asked.join(needed, "query_id")


def filter_pool(
    persons: DataFrame, members: DataFrame, chosen: DataFrame, event_members: DataFrame
) -> DataFrame:
    """(query_id, path) that hold all of a request's persons and lie in any of its events.

    ``persons`` is (query_id, name), ``chosen`` (query_id, event_id). What a
    request needs (each person, and one of its events) is counted on the
    request rows and carried through the matches into one aggregate, so no
    pool is joined by its request.
    """
    person = persons.select("query_id", "name", F.lit(None).cast("string").alias("event_id"))
    event = chosen.select("query_id", F.lit(None).cast("string").alias("name"), "event_id")
    asked = person.unionByName(event).distinct()
    need = asked.groupBy("query_id").agg(
        (F.count("name") + F.max(F.col("event_id").isNotNull().cast("int"))).alias("_need"))
    asked = asked.join(need, "query_id")
    one, zero = F.lit(1), F.lit(0)
    found = asked.filter("name IS NOT NULL").join(
        members.select("name", "path").distinct(), "name").select(
        "query_id", "path", "_need", one.alias("_p"), zero.alias("_e")).unionByName(
        asked.filter("event_id IS NOT NULL").join(
            event_members.select("event_id", "path"), "event_id").select(
            "query_id", "path", "_need", zero.alias("_p"), one.alias("_e")))
    return found.groupBy("query_id", "path").agg(
        (F.sum("_p") + F.max("_e")).alias("_have"), F.max("_need").alias("_need")
    ).filter(F.col("_have") == F.col("_need")).select("query_id", "path")


def images_in_any(wanted: DataFrame, members: DataFrame) -> DataFrame:
    """(query_id, path) in any wanted event; ``members`` is (event_id, path)."""
    return (
        wanted.select("query_id", "event_id").distinct()
        .join(members.select("event_id", "path"), "event_id")
        .select("query_id", "path")
        .distinct()
    )


def combine_pools(
    person_filters: DataFrame, person_pool: DataFrame,
    event_filters: DataFrame, event_pool: DataFrame,
) -> DataFrame:
    """(query_id, path) allowed by both filters; an absent filter is neutral.

    The ``*_filters`` tables list the query ids that asked for that filter.
    """
    by_person = person_filters.select("query_id").distinct()
    by_event = event_filters.select("query_id").distinct()
    only_person = person_pool.join(by_event, "query_id", "left_anti")
    only_event = event_pool.join(by_person, "query_id", "left_anti")
    both = person_pool.join(event_pool, ["query_id", "path"], "left_semi")
    return only_person.unionByName(only_event).unionByName(both)


def filter_counts(
    wanted: DataFrame, members: DataFrame, key: str, label: Column | None = None
) -> DataFrame:
    """(query_id, counts): map of each wanted reference to its image count.

    Counts are keyed by ``label``; two events of one name share an entry.
    """
    sizes = members.groupBy(key).agg(F.count_distinct("path").alias("_images"))
    label = F.col(key) if label is None else label
    per_label = (
        wanted.select("query_id", key, label.alias("_label")).distinct()
        .join(sizes, key)
        .groupBy("query_id", "_label")
        .agg(F.max_by("_images", key).alias("_images"))
    )
    return per_label.groupBy("query_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("_label", "_images"))))
        .alias("counts")
    )
