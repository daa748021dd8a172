"""Report-level plans: search payloads, request handling, enrichment runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import base_name
from shelfmark.operators.audit import regression_report
from shelfmark.operators.catalog import with_records
from shelfmark.operators.enrich import (
    output_rows, run_enricher, scanned_rows, stored_schema, todo,
)
from shelfmark.operators.filters import (
    filter_counts, filter_pool, resolve_events, resolve_names,
)
from shelfmark.operators.ranking import rank_within, with_position
from shelfmark.operators.understanding import understand
from shelfmark.plans.search import Corpus, Options, Outcome, search, shown_ranks
from shelfmark.session import materialize
from shelfmark.sources.tables import append_table, read_optional_table


def ordered_union(first: Column, second: Column) -> Column:
    """Values of two lists in order, each once."""
    return F.array_union(first, second)


def resolve_filters(
    requests: DataFrame, members: DataFrame, events: DataFrame, event_members: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Resolve each request's ``persons`` and ``events`` lists.

    Returns (requests, pool, problems). ``requests`` gains has_filter, people,
    event_names, person_counts, event_counts; a request with an unknown or
    ambiguous reference is not among them but in ``problems`` (query_id, as,
    reference, status, candidates). ``members`` is (name, path), ``events``
    (event_id, name, start), ``event_members`` (event_id, path).
    """
    people = requests.select("query_id", F.posexplode("persons").alias("at", "reference"))
    happenings = requests.select("query_id", F.posexplode("events").alias("at", "reference"))
    found_people = people.join(
        resolve_names(people, members.select("name")), "reference")
    found_events = happenings.join(resolve_events(happenings, events), "reference")
    found = materialize(
        found_people.select("query_id", F.lit("person").alias("as"), "at", "reference",
                            "status", "resolved", "candidates")
        .unionByName(found_events.select(
            "query_id", F.lit("event").alias("as"), "at", "reference", "status", "resolved",
            "candidates")),
        "resolved",
    )
    problems = found.filter("status <> 'ok'").drop("resolved", "at")
    good = found.join(problems.select("query_id"), "query_id", "left_anti")
    persons = good.filter("`as` = 'person'").select(
        "query_id", "at", F.col("resolved").alias("name"))
    chosen = good.filter("`as` = 'event'").select(
        "query_id", "at", F.col("resolved").alias("event_id"))
    pool = filter_pool(persons, members, chosen, event_members)
    titled = chosen.join(events.select("event_id", F.col("name").alias("title")), "event_id")

    def listed(rows: DataFrame, value: str, name: str) -> DataFrame:
        # A request names a handful of filters.
        return rows.groupBy("query_id").agg(F.transform(
            F.array_sort(F.collect_list(F.struct("at", value))), lambda r: r[value]).alias(name))

    ready = (
        requests.join(problems.select("query_id"), "query_id", "left_anti")
        .withColumn("has_filter", (F.size("persons") > 0) | (F.size("events") > 0))
        .join(listed(persons, "name", "people"), "query_id", "left")
        .join(listed(titled, "title", "event_names"), "query_id", "left")
        .join(filter_counts(persons, members, "name").withColumnRenamed(
            "counts", "person_counts"), "query_id", "left")
        .join(filter_counts(titled, event_members, "event_id", F.col("title"))
              .withColumnRenamed("counts", "event_counts"), "query_id", "left")
    )
    none = F.array().cast("array<string>")
    ready = ready.withColumns({
        "people": F.coalesce("people", none), "event_names": F.coalesce("event_names", none)})
    return ready, pool, problems


def answer_requests(
    requests: DataFrame, corpus: Corpus, members: DataFrame, events: DataFrame,
    event_members: DataFrame, options: Options | None = None,
) -> tuple[Outcome, DataFrame]:
    """Read, filter and search a request log: (outcome, rejected).

    ``requests`` is (query_id, text, answer, persons, events, vectors and
    options). Filters read out of the text join the explicit ones, which come
    first. A request without text and filters, or with a filter that does not
    resolve, is a row of ``rejected`` (query_id, status) and fails nothing else.
    """
    empty = (F.coalesce("text", F.lit("")) == "") & (F.size("persons") == 0) & (
        F.size("events") == 0)
    refused = requests.filter(empty).select(
        "query_id", F.lit("give q, person or event").alias("status"))
    asked = requests.filter(~empty)
    roster = members.select("name").distinct()
    read = understand(asked.select("query_id", "text", "answer"), roster, events).select(
        "query_id", F.col("persons").alias("_p"), F.col("events").alias("_e"), "terms")
    merged = materialize(asked.join(read, "query_id").withColumns({
        "persons": ordered_union(F.col("persons"), F.col("_p")),
        "events": ordered_union(F.col("events"), F.col("_e")),
        "text": F.col("terms"),
    }).drop("_p", "_e", "terms", "answer"), "requests")
    ready, pool, problems = resolve_filters(merged, members, events, event_members)
    outcome = search(ready, corpus, materialize(pool, "pool"), options)
    failed = problems.groupBy("query_id").agg(F.min("status").alias("status"))
    return outcome, refused.unionByName(failed)


def search_payload(
    outcome: Outcome, requests: DataFrame, corpus: Corpus, items: DataFrame,
    pool: DataFrame | None = None,
) -> DataFrame:
    """Result rows with each row's ranks in both modalities and its record."""
    ranks = shown_ranks(outcome.results, requests, corpus, pool)
    return with_records(outcome.results.join(ranks, ["query_id", "path"], "left"), items)


def payload_heads(outcome: Outcome, requests: DataFrame) -> DataFrame:
    """One row per request: its summary, and how many images each of its filters holds.

    ``requests`` is what ``resolve_filters`` returns, or any table with
    query_id, person_counts and event_counts (maps).
    """
    return outcome.summary.join(
        requests.select("query_id", "person_counts", "event_counts"), "query_id", "left")


def payload_trimmed(outcome: Outcome, items: DataFrame) -> DataFrame:
    """(query_id, place, path, score, record ...) of the rows cut from a matched set, best first."""
    ranked = rank_within(materialize(outcome.trimmed, "trimmed"), ["query_id"],
                         [F.desc("score"), F.col("path")], "place")
    return with_records(ranked, items)


def result_captions(outcome: Outcome, captions: DataFrame) -> DataFrame:
    """Result rows with the caption they were matched by."""
    return outcome.results.join(captions.select("path", "caption"), "path", "left")


def regression_run(
    requests: DataFrame, corpus: Corpus, baseline: DataFrame, options: Options | None = None
) -> DataFrame:
    """Queries whose answer moved against a (query, filename) baseline."""
    outcome = search(requests, corpus, options=options)
    measured = outcome.results.select(
        F.col("query_id").alias("query"), base_name(F.col("path")).alias("filename"))
    return regression_report(
        baseline, measured, None,
        requests.select(F.col("query_id").cast("string").alias("query")))


def enrichment_run(
    catalog: DataFrame, done: DataFrame, enrich: Callable, schema: str,
    existing_outputs: int = 0, force: bool = False, limit: int | None = None,
    batch_rows: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(ledger, outputs) of one resumable run over what is not done yet.

    The enricher's output is materialised before the ledger and the numbered
    outputs are taken from it; ``batch_rows`` as in ``run_enricher``.
    """
    made = materialize(run_enricher(
        todo(catalog, done, force, limit), enrich, schema, batch_rows), "enriched")
    return scanned_rows(made), output_rows(made, existing_outputs)


def enrichment_by_chunks(
    catalog: DataFrame, folder: str, enrich: Callable, schema: str, chunk_rows: int = 100_000,
    existing_outputs: int = 0, limit: int | None = None, batch_rows: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(ledger, outputs) of everything in ``folder``, after adding what it lacks of ``catalog``.

    ``catalog`` is (pos, path, ...), one row per path. What is left is worked
    off in path order, ``chunk_rows`` at a time, and each chunk is committed
    before the next one begins. A stored row is an item's status together with
    its outputs, so a run that breaks off loses a chunk at most, no item is
    half done, and the same call again does the rest and nothing twice. Ids of
    outputs continue from ``existing_outputs`` in path order over the folder.
    Items that could not be read count as done, as in the ledger of a run.
    """
    spark = catalog.sparkSession
    stored = stored_schema(schema)
    done, _ = read_optional_table(spark, folder, stored)
    left = materialize(with_position(
        todo(catalog, done, limit=limit), [F.col("path")], "_at"), "left")
    # One job per chunk; the driver only knows how many rows are left.
    for start in range(0, left.count(), chunk_rows):
        chunk = left.filter(F.col("_at").between(start, start + chunk_rows - 1)).drop("_at")
        append_table(run_enricher(chunk, enrich, schema, batch_rows), folder)
    made, _ = read_optional_table(spark, folder, stored)
    return scanned_rows(made), output_rows(made, existing_outputs)
