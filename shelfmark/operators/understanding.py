"""From a model's answer about a query to validated filters and search terms.

The model call itself is the caller's; its answer is an input column. One bad
answer never fails the batch: it falls back to plain search terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import is_stopword, mentioned, remaining_text, tokens
from shelfmark.operators.filters import resolve_events, resolve_names
from shelfmark.session import materialize

MAX_FILTERS = 3

_DROPPED = "array<struct<text:string,as:string,why:string>>"


def answer_object(answer: Column) -> Column:
    """The JSON object in a free-text answer as a VARIANT, else NULL.

    The text from the first ``{`` to the last ``}`` must be one object: it is
    wrapped in an array first, so trailing text fails the parse instead of
    being ignored.
    """
    found = F.regexp_extract(F.coalesce(answer, F.lit("")), r"(?s)\{.*\}", 0)
    wrapped = F.when(
        found != "", F.try_parse_json(F.concat(F.lit("["), found, F.lit("]")))
    )
    return F.when(
        F.try_variant_get(wrapped, "$[1]", "variant").isNull(),
        F.try_variant_get(wrapped, "$[0]", "variant"),
    )


def proposals(parsed: Column, field: str) -> Column:
    """Non-empty strings of a field: a list of strings, or one string."""
    value = F.try_variant_get(parsed, f"$.{field}", "variant")
    kind = F.schema_of_variant(value)
    items = F.try_variant_get(parsed, f"$.{field}", "array<variant>")
    texts = F.transform(
        F.filter(items, lambda v: F.schema_of_variant(v) == "STRING"),
        lambda v: v.cast("string"),
    )
    one = F.array(F.try_variant_get(parsed, f"$.{field}", "string"))
    raw = F.when(kind == "STRING", one).when(kind.startswith("ARRAY"), texts)
    clean = F.transform(raw, lambda t: F.regexp_replace(t, r"^\s+|\s+$", ""))
    return F.coalesce(
        F.filter(clean, lambda t: t != ""), F.array().cast("array<string>")
    )


def _runaway(found: Column, kind: str) -> Column:
    """One report entry when a list is too long to be an answer."""
    # Fixed value: the reason of a list that is too long.
    report = F.struct(
        F.concat(F.size(found).cast("string"), F.lit(f" {kind}s")).alias("text"),
        F.lit(kind).alias("as"),
        F.lit("too many to be a filter").alias("why"),
    )
    return F.when(F.size(found) > MAX_FILTERS, F.array(report)).otherwise(
        F.array().cast(_DROPPED)
    )


def _validated(
    asked: DataFrame, resolved: DataFrame, kind: str, extra: DataFrame | None
) -> DataFrame:
    """(query_id, kept, dropped, names) of one kind, in proposal order.

    At most MAX_FILTERS proposals reach this point per query, so the collected
    lists are bounded.
    """
    rows = asked.join(resolved, "reference", "left")
    if extra is not None:
        rows = rows.join(extra, rows["resolved"] == extra["event_id"], "left")
        shown = F.when(F.col("name") != "", F.col("name")).otherwise(F.col("resolved"))
        probe = F.concat_ws(" ", F.coalesce("name", F.lit("")), F.col("resolved"))
        known = F.coalesce("name", F.lit(""))
    else:
        shown = probe = known = F.col("resolved")
    why = (
        F.when(F.col("status") == "ok",
               F.when((F.col("text") != "") & ~mentioned(probe, F.col("text")),
                      "not named in the query"))
        .otherwise(F.col("status"))
    )
    entry = F.struct(
        F.col("ordinal"),
        F.when(F.col("status") == "ok", shown).otherwise(F.col("reference")).alias("text"),
        F.lit(kind).alias("as"),
        why.alias("why"),
        F.col("resolved"),
        known.alias("known"),
    )
    listed = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("_all"))
    kept = F.filter("_all", lambda e: e["why"].isNull())
    return listed.select(
        "query_id",
        F.array_distinct(F.transform(kept, lambda e: e["resolved"])).alias("kept"),
        F.array_distinct(F.transform(kept, lambda e: e["known"])).alias("names"),
        F.transform(
            F.filter("_all", lambda e: e["why"].isNotNull()),
            lambda e: F.struct(e["text"].alias("text"), e["as"].alias("as"),
                               e["why"].alias("why")),
        ).alias("dropped"),
    )


def understand(answers: DataFrame, people: DataFrame, events: DataFrame) -> DataFrame:
    """Validated intent per query.

    ``answers`` is (query_id, text, answer), ``people`` (name), ``events``
    (event_id, name, start). Returns query_id, query, persons, events, terms,
    dropped, source, note.
    """
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")
    base = answers.select(
        "query_id", text.alias("text"), F.col("answer"),
        answer_object(F.col("answer")).alias("_object"),
    )
    base = base.select(
        "query_id", "text", "answer",
        F.schema_of_variant("_object").startswith("OBJECT").alias("_usable"),
        proposals(F.col("_object"), "persons").alias("_persons"),
        proposals(F.col("_object"), "events").alias("_events"),
    )
    usable = F.coalesce("_usable", F.lit(False)) & (F.col("text") != "")
    # Both kinds of proposals and the report read the parsed answers.
    base = materialize(base.withColumn("_usable", usable), "answers")

    def asked(column: str) -> DataFrame:
        return (
            base.filter(F.col("_usable") & (F.size(column) <= MAX_FILTERS))
            .select("query_id", "text", F.posexplode(column).alias("ordinal", "reference"))
        )

    wanted_people, wanted_events = asked("_persons"), asked("_events")
    people_out = _validated(
        wanted_people, resolve_names(wanted_people, people), "person", None
    ).select("query_id", F.col("kept").alias("_p"), F.col("names").alias("_pn"),
             F.col("dropped").alias("_pd"))
    events_out = _validated(
        wanted_events, resolve_events(wanted_events, events), "event",
        events.select("event_id", "name"),
    ).select("query_id", F.col("kept").alias("_e"), F.col("names").alias("_en"),
             F.col("dropped").alias("_ed"))

    rows = base.join(people_out, "query_id", "left").join(events_out, "query_id", "left")
    none = F.array().cast("array<string>")
    persons, event_ids = F.coalesce("_p", none), F.coalesce("_e", none)
    dropped = F.when(
        F.col("_usable"),
        F.concat(
            _runaway(F.col("_persons"), "person"), F.coalesce("_pd", F.array().cast(_DROPPED)),
            _runaway(F.col("_events"), "event"), F.coalesce("_ed", F.array().cast(_DROPPED)),
        ),
    ).otherwise(F.array().cast(_DROPPED))
    words = F.flatten(F.transform(
        F.concat(F.coalesce("_pn", none), F.coalesce("_en", none)), tokens
    ))
    taken = F.filter(
        F.concat(words, event_ids), lambda w: (F.length(w) > 1) & ~is_stopword(w)
    )
    nothing = (F.size(persons) == 0) & (F.size(event_ids) == 0)
    fallback = ~F.col("_usable") | (nothing & (F.size(dropped) == 0))
    # The notes of an answer.
    note = (
        F.when(F.col("text") == "", "no query text")
        .when(F.col("answer").isNull(), "model unavailable")
        .when(~F.col("_usable"), "model returned no usable JSON")
        .when(nothing & (F.size(dropped) == 0), "no person or event named")
        .when(nothing, "nothing proposed survived validation")
        .otherwise("")
    )
    return rows.select(
        "query_id",
        F.col("text").alias("query"),
        persons.alias("persons"),
        event_ids.alias("events"),
        F.when(fallback, F.col("text")).otherwise(remaining_text(F.col("text"), taken))
        .alias("terms"),
        dropped.alias("dropped"),
        F.when(fallback, "fallback").otherwise("model").alias("source"),
        note.alias("note"),
    )
