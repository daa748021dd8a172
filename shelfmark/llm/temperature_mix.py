"""Mixing sources to target weights by temperature, in column functions alone.

Source weights are token shares to the power of an exponent. The exponent is
bisected to the smallest one in [0, 1] at which no source is repeated more
than ``max_repeats`` times (and, if asked for, the entropy of the weights does
not exceed ``max_entropy`` nats): both fall as the exponent grows. Budgets are
the weights scaled so that the source with the least weight for its tokens is
taken exactly once; so nothing is dropped and the others are repeated.

A budget is whole passes over the source and a last partial one. In each pass
the source's documents lie in blocks by a hash of (seed, pass, document), in
hash order inside a block: a permutation of its own. The partial pass ends
where the budget does: that place is found from block totals and inside one
block per source, and each document's copies then follow from its own row and
its source's plan. No text is shuffled and no source is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import checked_broadcast
from shelfmark.session import materialize

STEPS = 60
BLOCK_DOCS = 4_096
HASHED = ("source_key", "tokens")


def token_count(text: Column) -> Column:
    """Words: runs of anything but 0x20 and 0x09-0x0D; none in a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _mix_key(epoch: Column, doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"),
                             F.coalesce(doc_id.cast("string"), F.lit("null"))))


def _block(key: Column, blocks: Column) -> Column:
    return F.pmod(F.conv(F.substring(key, 1, 8), 16, 10).cast("long"), blocks)


def _exponent(least: Column, most: Column, totals: Column | None, max_repeats: float,
              max_entropy: float | None) -> Column:
    """Bisects inside one expression over the fewest and most tokens of a source.

    t ** (alpha - 1) falls as t grows, so these two decide the repeats. Only the
    entropy needs ``totals``: each (tokens, sources that have as many) once.
    """

    def fits(alpha: Column) -> Column:
        ok = F.pow(least, alpha - 1) / F.pow(most, alpha - 1) <= max_repeats
        if max_entropy is None:
            return ok
        power = F.transform(totals, lambda t: F.struct(
            F.pow(t["t"], alpha).alias("x"), t["n"].alias("n")))
        total = F.aggregate(power, F.lit(0.0), lambda a, p: a + p["x"] * p["n"])
        entropy = F.log(total) - F.aggregate(
            power, F.lit(0.0), lambda a, p: a + p["x"] * F.log(p["x"]) * p["n"]) / total
        return ok & (entropy <= max_entropy)

    def step(state: Column, _: Column) -> Column:
        mid = (state["lo"] + state["hi"]) / 2
        ok = fits(mid)
        return F.struct(F.when(ok, state["lo"]).otherwise(mid).alias("lo"),
                        F.when(ok, mid).otherwise(state["hi"]).alias("hi"))

    ends = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), ends, step)["hi"]


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def mixture(light: DataFrame, *, max_repeats: float = 2.0,
            max_entropy: float | None = None) -> DataFrame:
    """(source_key, docs, tokens, exponent, weight, passes, rest) per source.

    ``passes`` are whole, ``rest`` is the tokens of the partial one. A source
    without tokens has weight 0 and one pass. ``light`` has source_key, tokens.
    """
    totals = materialize(light.groupBy("source_key").agg(
        F.count("*").alias("docs"), F.sum("tokens").alias("tokens")), "totals")
    filled = totals.filter("tokens > 0")
    tokens = F.col("tokens").cast("double")
    ends = [F.min(tokens).alias("least"), F.max(tokens).alias("most")]
    if max_entropy is None:
        known, listed = filled.agg(*ends), None
    else:  # different totals are at most the root of twice all tokens, whatever the sources
        known = filled.groupBy("tokens").agg(F.count("*").cast("double").alias("n")).agg(
            *ends, F.sort_array(F.collect_list(F.struct(tokens.alias("t"), "n"))).alias("all"))
        listed = F.col("all")
    exponent = known.select(
        F.when(F.col("least").isNotNull(), _exponent(
            F.col("least"), F.col("most"), listed, max_repeats, max_entropy))
        .otherwise(1.0).alias("exponent"))
    # One row; the sums below are over sources.
    named = totals.withColumn("exponent", exponent.scalar())
    power = F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.col("exponent")))
    sums = named.agg(F.sum(power).alias("total"), F.min(power / F.col("tokens")).alias("least"))
    budget = F.round(power / sums.select("least").scalar()).cast("long")
    named = named.select(
        "source_key", "docs", "tokens", "exponent",
        F.coalesce(power / sums.select("total").scalar(), F.lit(0.0)).alias("weight"),
        F.greatest(F.coalesce(budget, F.lit(0)), F.col("tokens")).alias("budget"))
    whole = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(1))
    return named.select(
        "source_key", "docs", "tokens", "exponent", "weight", whole.alias("passes"),
        (F.col("budget") - whole * F.col("tokens")).alias("rest"),
        F.ceil(F.col("docs") / BLOCK_DOCS).cast("long").alias("blocks"))


def plan(light: DataFrame, *, max_repeats: float = 2.0, max_entropy: float | None = None,
         seed: int = 1) -> DataFrame:
    """``mixture`` with the end of the partial pass: its block and the last key taken there."""
    table = materialize(
        mixture(light, max_repeats=max_repeats, max_entropy=max_entropy), "mixture")
    ends = table.filter("rest > 0").select("source_key", "passes", "rest", "blocks")
    key = _mix_key(F.col("passes"), F.col("doc_id"), seed)
    last = light.join(checked_broadcast(ends), "source_key").select(
        "source_key", "rest", "tokens", key.alias("key"), _block(key, F.col("blocks"))
        .alias("block"))
    by_block = last.groupBy("source_key", "rest", "block").agg(F.sum("tokens").alias("n"))
    run = Window.partitionBy("source_key").orderBy("block")
    edge = by_block.withColumn("upto", F.sum("n").over(run)).filter("upto > rest").groupBy(
        "source_key").agg(F.min(F.struct("block", (F.col("upto") - F.col("n")).alias("base")))
                          .alias("edge"))
    edge = materialize(edge.select("source_key", F.col("edge.block").alias("end_block"),
                                   F.col("edge.base").alias("base")), "edge")
    inside = last.join(checked_broadcast(edge), "source_key").filter("block = end_block")
    order = Window.partitionBy("source_key").orderBy("key", "tokens")  # one block of each source
    taken = inside.withColumn("upto", F.col("base") + F.sum("tokens").over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).filter(
        "upto <= rest").groupBy("source_key").agg(F.max("key").alias("end_key"))
    return materialize(
        table.join(edge.select("source_key", "end_block"), "source_key", "left")
        .join(taken, "source_key", "left").select(
            "source_key", "passes", "rest", "blocks", "weight", "exponent",
            F.coalesce("end_block", F.lit(-1)).alias("end_block"),
            F.coalesce("end_key", F.lit("")).alias("end_key")), "plan")


def light_rows(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, source, source_key, tokens): what the decisions are taken on."""
    return materialize(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        source_key(F.col(source_col)).alias("source_key"),
        token_count(F.col(text_col)).alias("tokens")), "light")


def _copies(rows: DataFrame, plans: DataFrame, doc_id: Column, seed: int) -> DataFrame:
    """``rows`` once per pass that takes them, with _epoch, _block and _key."""
    rows = rows.join(checked_broadcast(plans), F.col("_source") == plans["source_key"])
    last = _mix_key(F.col("passes"), doc_id, seed)
    at = _block(last, F.col("blocks"))
    more = (F.col("rest") > 0) & ((at < F.col("end_block")) | (
        (at == F.col("end_block")) & (last <= F.col("end_key"))))
    number = F.col("passes") - 1 + F.when(more, 1).otherwise(0)
    rows = rows.withColumn("_epoch", F.explode(F.sequence(F.lit(0).cast("long"), number)))
    key = _mix_key(F.col("_epoch"), doc_id, seed)
    return rows.withColumn("_key", key).withColumn("_block", _block(F.col("_key"), F.col("blocks")))


def mix(docs: DataFrame, *, max_repeats: float = 2.0, max_entropy: float | None = None,
        seed: int = 1, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source") -> DataFrame:
    """All columns of ``docs``, each row once per pass that takes it.

    Every row comes at least once. A null source is a source of its own, null
    and empty texts have no tokens, rows that share an id and source go
    together, and null ids are treated as one id. Column names of ``docs``
    may be any; an empty table gives no rows.
    """
    light = light_rows(docs, id_col, text_col, source_col)
    plans = plan(light, max_repeats=max_repeats, max_entropy=max_entropy, seed=seed)
    packed = docs.select(F.struct("*").alias("_row"),
                         source_key(F.col(source_col)).alias("_source"))
    return _copies(packed, plans, F.col("_row")[id_col], seed).select("_row.*")


def mix_order(docs: DataFrame, *, max_repeats: float = 2.0, max_entropy: float | None = None,
              seed: int = 1, id_col: str = "doc_id", text_col: str = "text",
              source_col: str = "source") -> DataFrame:
    """(doc_id, source, tokens, epoch, block, mix_key) of the same rows.

    Sorting a source by (epoch, block, mix_key) gives its permutations.
    """
    light = light_rows(docs, id_col, text_col, source_col)
    plans = plan(light, max_repeats=max_repeats, max_entropy=max_entropy, seed=seed)
    return _copies(light.withColumnRenamed("source_key", "_source"), plans, F.col("doc_id"),
                   seed).select(
        "doc_id", "source", "tokens", F.col("_epoch").alias("epoch"),
        F.col("_block").alias("block"), F.col("_key").alias("mix_key"))
