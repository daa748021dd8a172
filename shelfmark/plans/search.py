"""Hybrid retrieval over a table of requests.

A request is a row: query_id, text, image_query, caption_query (vectors),
mode (hybrid | image | caption), top_k (0 = derive the count), trim, and
has_filter. Requests with a filter see only their rows of ``pool``; a filter
that matched nothing is a flagged request without pool rows.

How a request log runs, in the same number of jobs whatever its length:

1. The log is packed into blocks and the indexes into splits
   (``operators.splits``); requests never pass the driver, only counts do.
2. Captions meet requests on their rarest terms; matches are counted.
3. Blocks meet splits once: the best rows of both sides, with both scores,
   give the cut of the score gradient and, for requests without a match, the
   candidates of the fusion.
4. One summary row per request picks its branch.
5. Fused branch: a row outside both lists' first ``rrf_k + 2n`` ranks cannot
   reach the first n of the fused order, so only those candidates are given
   exact ranks, by counting the rows ahead of them. Nothing is sorted whole.
   A fixed count above COUNTED_TOP is most of a ranking and is sorted.
6. Matched branch: only captions at the branch's threshold are written; they
   are scored where their splits are and ordered with a range-partitioned
   ordinal, as they may be a large part of the catalog.
7. Requests without text list their pool in catalog order.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from shelfmark.functions.text import content_terms
from shelfmark.operators import splits
from shelfmark.operators.matching import (
    hits_among, index_captions, match_counts, matches_over, term_plans,
)
from shelfmark.operators.ranking import (
    CUT_CEILING, CUT_FLOOR, RRF_K, gradient_cut, fuse_rankings, rank_within, reciprocal_rank,
    salted_top, spread_trim, top_within,
)
from shelfmark.session import materialize

COUNTED_TOP = 1_000  # largest top_k ranked by counting; above it, by sorting
MIN_PARTIAL_TERMS = 2
SEMANTIC_DROP = 0.80

RESULT_COLUMNS = ["query_id", "rank", "path", "score", "term_hits", "matched"]


@dataclass(frozen=True)
class Corpus:
    """The two indexes. ``image`` is (path, vec), ``caption`` (path, caption, vec).

    ``caption`` may carry ``pos``, the stored catalog position; without it the
    catalog order is the path order.
    """

    image: DataFrame
    caption: DataFrame
    _stored: dict = field(default_factory=dict, compare=False, repr=False)

    def stored(self) -> splits.StoredIndex:
        """Both indexes packed into splits, once for all searches of this corpus."""
        if "index" not in self._stored:
            self._stored["index"] = splits.store_index(self.image, self.caption)
        return self._stored["index"]

    def terms(self) -> DataFrame:
        """The captions by term, once for all searches of this corpus."""
        if "terms" not in self._stored:
            self._stored["terms"] = index_captions(self.caption)
        return self._stored["terms"]

    def catalog_order(self) -> list[Column]:
        named = "pos" in self.caption.columns
        return [F.col("pos"), F.col("path")] if named else [F.col("path")]


@dataclass(frozen=True)
class Options:
    rrf_k: int = RRF_K
    min_partial_terms: int = MIN_PARTIAL_TERMS
    ceiling: int = CUT_CEILING
    floor: float = CUT_FLOOR
    semantic_drop: float = SEMANTIC_DROP


@dataclass(frozen=True)
class Outcome:
    """``results`` one row per answer row, ``summary`` one per request.

    ``hits`` holds the matches of the requests answered by a match, ``trimmed``
    the rows cut from a matched set.
    """

    results: DataFrame
    summary: DataFrame
    hits: DataFrame
    trimmed: DataFrame


@dataclass(frozen=True)
class _State:
    """A log on its way: requests with their number of terms, blocks, marks, term tables."""

    corpus: Corpus
    options: Options
    requests: DataFrame
    known: Row  # counts over the requests
    blocks: DataFrame
    marks: DataFrame | None
    pool: DataFrame | None
    plans: DataFrame | None
    counts: DataFrame | None


def prepare_requests(requests: DataFrame) -> DataFrame:
    """Fill the optional request columns with their defaults."""
    defaults = {
        "mode": F.lit("hybrid"), "top_k": F.lit(0), "trim": F.lit(False),
        "has_filter": F.lit(False), "people": F.array().cast("array<string>"),
        "event_names": F.array().cast("array<string>"),
        "image_query": F.lit(None).cast("array<double>"),
        "caption_query": F.lit(None).cast("array<double>"),
        "text": F.lit(""),
    }
    for name, value in defaults.items():
        if name not in requests.columns:
            requests = requests.withColumn(name, value)
    return requests.select(
        F.col("query_id").cast("string"), F.coalesce("text", F.lit("")).alias("text"),
        F.col("image_query").cast("array<double>"),
        F.col("caption_query").cast("array<double>"),
        "mode", F.col("top_k").cast("int"), "trim", "has_filter", "people", "event_names",
    )


def _state(requests: DataFrame, corpus: Corpus, pool: DataFrame | None, options: Options,
           match: bool = True) -> _State:
    """Write the log with what every stage needs; ``match`` also reads the captions."""
    wanted = F.when((F.col("top_k") > 0) & (F.col("top_k") <= COUNTED_TOP), F.col("top_k")
                    ).otherwise(options.ceiling)
    most = F.greatest(wanted, F.lit(options.ceiling))
    read = prepare_requests(requests).withColumn("_terms", content_terms(F.col("text")))
    rows = materialize(read.withColumns({
        "total_terms": F.size("_terms"),
        # Rows of each list that can hold one of the first n fused rows.
        "depth": F.when(F.col("mode") != "hybrid", most).otherwise(
            F.lit(options.rrf_k) + 2 * most).cast("int"),
    }), "requests")
    known = rows.agg(
        F.count("*").alias("n"), F.count_if("has_filter").alias("filtered"),
        F.count_if(F.col("total_terms") > 0).alias("texts"), F.max("depth").alias("depth"),
        F.count_if((F.col("total_terms") > 0) & F.col("has_filter")).alias("filtered_texts"),
    ).first()
    if known["filtered"] and pool is None:
        raise ValueError("a request has a filter but no pool was given")
    inside = None
    if known["filtered"]:
        filtered = rows.filter("has_filter").select("query_id")
        inside = materialize(
            pool.select(F.col("query_id").cast("string"), "path").distinct()
            .join(filtered, "query_id", "left_semi"), "pool")
    texts = rows.filter("total_terms > 0") if match else rows
    terms = texts.select("query_id", F.explode("_terms").alias("term"))
    plans = counts = None
    if match and known["texts"]:
        plans, counts = _counted(rows, terms, corpus.terms(), inside, options, known["texts"])
        # A request that its matches answer needs no more rows than the gradient reads.
        found = counts.filter("partial_count > 0").select(
            "query_id", F.lit(options.ceiling).alias("_less"))
        texts = texts.join(found, "query_id", "left").withColumn("depth", F.when(
            F.col("top_k") == 0, F.coalesce("_less", "depth")).otherwise(F.col("depth")))
    blocks = splits.request_blocks(
        texts.select("query_id", "image_query", "caption_query", "has_filter", "depth"),
        known["texts"] if match else known["n"])
    marked = known["filtered_texts"] if match else known["filtered"]
    marks = splits.pair_marks(inside, corpus.stored(), blocks) if marked else None
    return _State(corpus, options, rows, known, blocks, marks, inside, plans, counts)


def search(
    requests: DataFrame, corpus: Corpus, pool: DataFrame | None = None,
    options: Options | None = None,
) -> Outcome:
    """Answer every request; see the module text for the stages."""
    state = _state(requests, corpus, pool, options or Options())
    if not state.known["n"]:
        raise ValueError("search needs at least one request")
    tops = _tops(state)
    summary = materialize(_summary(state, tops), "summary")
    kind, fixed = F.col("basis_kind"), F.col("top_k") > COUNTED_TOP
    fused, matched = kind.isin("top_k", "gradient"), kind.isin("full_match", "partial_match")
    branch = summary.agg(
        F.count_if(fused & ~fixed).alias("near"), F.count_if(fused & fixed).alias("deep"),
        F.count_if(matched).alias("matched"), F.count_if(matched & F.col("trim")).alias("trim"),
        F.count_if(kind.isin("filter_only", "no_query")).alias("listed"),
    ).first()
    parts = []
    if branch["near"]:
        parts.append(_near_results(state, summary.filter(fused & ~fixed), tops))
    if branch["deep"]:
        parts.append(_deep_results(state, summary.filter(fused & fixed)))
    spark = summary.sparkSession
    hits = spark.createDataFrame([], "query_id string, path string, hits int")
    trimmed = spark.createDataFrame([], "query_id string, path string, score double")
    if branch["matched"]:
        hits = _matches(state, summary.filter(matched))
        kept, cut = _matched_results(state, summary.filter(matched), hits, bool(branch["trim"]))
        parts.append(kept)
        trimmed = trimmed if cut is None else cut
    if branch["listed"]:
        parts.append(_listed_results(state, summary))
    if branch["trim"]:
        counted = trimmed.groupBy("query_id").agg(F.count("*").cast("int").alias("trimmed"))
        summary = summary.join(counted, "query_id", "left")
    else:
        summary = summary.withColumn("trimmed", F.lit(0))
    empty = spark.createDataFrame([], "query_id string, rank long, path string, score double, "
                                      "term_hits int, matched boolean")
    results = reduce(DataFrame.unionByName, parts or [empty])
    return Outcome(results.select(RESULT_COLUMNS), _with_basis(summary), hits, trimmed)


def _counted(rows: DataFrame, terms: DataFrame, index: DataFrame, pool: DataFrame | None,
             options: Options, texts: int) -> tuple[DataFrame, DataFrame]:
    """(term plans, match counts) of the requests with text."""
    copies = terms.groupBy("query_id", "term").agg(F.count("*").alias("copies"))
    plans = materialize(term_plans(copies, index), "plans")
    least = plans.join(rows.select("query_id", "has_filter"), "query_id").withColumns({
        "needed": F.least(F.lit(options.min_partial_terms), F.col("total")),
        "apart": F.col("has_filter")})
    return plans, materialize(match_counts(index, least, texts, pool), "counts")


def _inside(state: _State, rows: DataFrame) -> DataFrame:
    """Those of (query_id, path, ...) rows that the requests' filters let through."""
    if state.pool is None:
        return rows
    flags = state.requests.select("query_id", "has_filter")
    allowed = state.pool.withColumn("_in", F.lit(True))
    return rows.join(flags, "query_id").join(allowed, ["query_id", "path"], "left").filter(
        ~F.col("has_filter") | F.col("_in")).drop("has_filter", "_in")


def _tops(state: _State) -> DataFrame:
    """(side, query_id, path, image_score, caption_score, score, rank): heads of both rankings."""
    schema = ("side string, query_id string, path string, image_score double, "
              "caption_score double, score double, rank int")
    if not state.known["texts"]:
        return state.requests.sparkSession.createDataFrame([], schema)
    heads = splits.best_rows(state.corpus.stored(), state.blocks, state.marks)
    scored = heads.withColumn("score", F.when(
        F.col("side") == "image", F.col("image_score")).otherwise(F.col("caption_score")))
    return materialize(salted_top(
        scored, ["side", "query_id"], [F.desc("score"), F.col("path")], state.known["depth"]),
        "tops")


def _threshold(options: Options) -> Column:
    return F.least(F.lit(options.min_partial_terms), F.col("total_terms"))


def _summary(state: _State, tops: DataFrame) -> DataFrame:
    options, requests = state.options, state.requests
    facts = []  # rows of (query_id, one fact or more), brought together by one exchange
    if state.counts is not None:
        facts.append(state.counts)
    cut = gradient_cut(tops, ["side", "query_id"], options.floor, options.ceiling)
    facts.append(cut.select("query_id", *[
        F.when(F.col("side") == side, F.col(column)).alias(f"{short}_{column}")
        for side, short in (("image", "img"), ("caption", "cap"))
        for column in ("cut", "plateau")]))
    corpus_size = state.corpus.caption.agg(F.count("*")).scalar()
    pool_size: Column = corpus_size
    if state.pool is not None:
        inside = state.pool.join(state.corpus.caption.select("path"), "path", "left_semi")
        facts.append(inside.groupBy("query_id").agg(F.count("*").alias("_pool")))
        pool_size = F.when(F.col("has_filter"), F.coalesce("_pool", F.lit(0))).otherwise(
            corpus_size)
    own = [c for c in requests.columns if c not in (
        "query_id", "text", "image_query", "caption_query", "depth", "_terms")]
    rows = requests.select("query_id", F.struct(own).alias("_own"))
    for fact in facts:
        rows = rows.unionByName(fact, allowMissingColumns=True)
    found = [c for c in rows.columns if c not in ("query_id", "_own")]
    rows = rows.groupBy("query_id").agg(
        F.first("_own", ignorenulls=True).alias("_own"), *(F.max(c).alias(c) for c in found))
    rows = rows.select("query_id", "_own.*", *found, *(
        F.lit(None).cast("int").alias(c) for c in ("full_count", "partial_count")
        if c not in found))

    has_text = F.col("total_terms") > 0
    filtered = (F.size("people") > 0) | (F.size("event_names") > 0) | F.col("has_filter")
    # A ranked side always has a cut, so a missing cut is an empty side.
    empty = (
        F.when(F.col("mode") == "image", F.col("img_cut").isNull())
        .when(F.col("mode") == "caption", F.col("cap_cut").isNull())
        .otherwise(F.col("img_cut").isNull() & F.col("cap_cut").isNull())
    )
    full = F.coalesce("full_count", F.lit(0))
    partial = F.coalesce("partial_count", F.lit(0))
    kind = (
        F.when(~has_text & filtered, "filter_only")
        .when(~has_text, "no_query")
        .when(empty, "empty_pool")
        .when(F.col("top_k") > 0, "top_k")
        .when(full > 0, "full_match")
        .when(partial > 0, "partial_match")
        .otherwise("gradient")
    )
    img_plateau = F.coalesce("img_plateau", ~has_text)
    cap_plateau = F.coalesce("cap_plateau", ~has_text)
    return rows.select(
        "query_id", "mode", "top_k", "trim", "people", "event_names", "has_filter", "total_terms",
        full.alias("full_count"), partial.alias("partial_count"),
        F.coalesce("img_cut", has_text.cast("int")).alias("img_cut"),
        img_plateau.alias("img_plateau"),
        F.coalesce("cap_cut", has_text.cast("int")).alias("cap_cut"),
        cap_plateau.alias("cap_plateau"),
        corpus_size.cast("long").alias("corpus_size"),
        pool_size.cast("long").alias("pool_size"),
        kind.alias("basis_kind"),
        F.when(kind.isin("top_k", "gradient"), "rrf_sum")
        .when(kind.isin("full_match", "partial_match") & (F.col("mode") == "image"),
              "image_cosine")
        .when(kind.isin("full_match", "partial_match"), "caption_cosine")
        .otherwise("none").alias("score_kind"),
        ((kind == "gradient") & ~(img_plateau | cap_plateau)).alias("low_confidence"),
        _threshold(options).alias("_threshold"),
    )


def _with_hits(ranked: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, rank, path, score) rows with the number of terms their captions hold."""
    return ranked.join(hits, ["query_id", "path"], "left").select(
        "query_id", F.col("rank").cast("long").alias("rank"), "path", "score",
        F.coalesce("hits", F.lit(0)).alias("term_hits"), F.lit(False).alias("matched"))


def _limits(summary: DataFrame) -> DataFrame:
    return summary.select("query_id", "mode", F.when(
        F.col("top_k") > 0, F.col("top_k")).otherwise(
        F.greatest("img_cut", "cap_cut")).alias("_limit"))


def _near_results(state: _State, summary: DataFrame, tops: DataFrame) -> DataFrame:
    """The first rows of the fused order, from candidates whose ranks are counted."""
    limits, k = _limits(summary), state.options.rrf_k
    heads = tops.join(limits, "query_id")
    alone = heads.filter(F.col("side") == F.col("mode")).select(
        "query_id", "path", reciprocal_rank(F.col("rank"), k).alias("score"), "_limit")
    candidates = heads.filter("mode = 'hybrid'").select(
        "query_id", "path", "image_score", "caption_score").distinct()
    ranks = splits.counted_ranks(state.corpus.stored(), state.blocks, candidates, state.marks)
    both = ranks.select("query_id", "path", (
        F.coalesce(reciprocal_rank(F.col("image_rank"), k), F.lit(0.0))
        + F.coalesce(reciprocal_rank(F.col("caption_rank"), k), F.lit(0.0))).alias("score")
    ).join(limits.select("query_id", "_limit"), "query_id")
    # At most 2 x depth candidates per request, so a plain window.
    ranked = top_within(alone.unionByName(both), ["query_id"], [F.desc("score"), F.col("path")],
                        F.col("_limit"))
    ranked = materialize(ranked.select("query_id", "rank", "path", "score"), "fused")
    return _with_hits(ranked, hits_among(
        state.corpus.terms(), state.plans, state.known["texts"], ranked))


def _deep_results(state: _State, summary: DataFrame) -> DataFrame:
    limits = _limits(summary)
    ranks = _sorted_ranks(state, summary.select("query_id", F.col("mode").alias("_mode")))
    sides = [ranks.filter((F.col("side") == side) & F.col("_mode").isin("hybrid", side))
             for side in splits.SIDES]
    fused = fuse_rankings(sides[0], sides[1], state.options.rrf_k).select(
        "query_id", "path", "score")
    ranked = rank_within(fused, ["query_id"], [F.desc("score"), F.col("path")])
    ranked = ranked.join(limits, "query_id").filter("rank <= _limit").select(
        "query_id", "rank", "path", "score")
    # Most of a ranking is shown, so all captions with a term are counted.
    any_term = state.plans.join(limits.select("query_id"), "query_id", "left_semi").withColumn(
        "needed", F.lit(1))
    return _with_hits(ranked, matches_over(
        state.corpus.terms(), any_term, state.known["texts"]))


def _sorted_ranks(state: _State, only: DataFrame) -> DataFrame:
    """(side, query_id, path, score, rank, ...) of every row for the requests of ``only``."""
    rows = state.requests.join(only, "query_id", "left_semi").select(
        "query_id", "image_query", "caption_query", "has_filter", "depth")
    blocks = splits.request_blocks(rows, only.count())
    inside = state.pool
    marks = None if inside is None else splits.pair_marks(
        inside.join(only, "query_id", "left_semi"), state.corpus.stored(), blocks)
    scored = materialize(splits.score_all(state.corpus.stored(), blocks, marks), "scored")
    sides = [scored.filter(F.col(f"{side}_score").isNotNull()).select(
        F.lit(side).alias("side"), "query_id", "path", F.col(f"{side}_score").alias("score"))
        for side in splits.SIDES]
    return rank_within(
        sides[0].unionByName(sides[1]).join(only, "query_id"), ["side", "query_id"],
        [F.desc("score"), F.col("path")])


def modality_ranks(
    requests: DataFrame, corpus: Corpus, pool: DataFrame | None = None
) -> DataFrame:
    """(side, query_id, path, score, rank) of every row for every request.

    The complete rankings, for reports about whole indexes. They hold requests
    x catalog rows; ``search`` does not need them, nor does ``shown_ranks``.
    """
    state = _state(requests, corpus, pool, Options(), match=False)
    return _sorted_ranks(state, state.requests.select("query_id"))


def shown_ranks(
    rows: DataFrame, requests: DataFrame, corpus: Corpus, pool: DataFrame | None = None
) -> DataFrame:
    """(query_id, path, image_rank, caption_rank) of the shown (query_id, path) rows.

    Ranks are counted, one list of targets for some thousand shown rows; no
    other row of the catalog is written.
    """
    state = _state(requests, corpus, pool, Options(), match=False)
    index = corpus.stored()
    targets = materialize(splits.score_pairs(index, state.blocks, rows.select(
        "query_id", "path").distinct()), "shown")
    return splits.counted_ranks(index, state.blocks, targets, state.marks)


def _matches(state: _State, summary: DataFrame) -> DataFrame:
    """(query_id, path, hits) at or over the threshold of each request's branch, written once."""
    needed = F.when(F.col("basis_kind") == "full_match", F.col("total_terms")).otherwise(
        F.col("_threshold"))
    chosen = state.plans.join(summary.select("query_id", needed.alias("needed")), "query_id")
    return materialize(_inside(state, matches_over(
        state.corpus.terms(), chosen, state.known["texts"])), "matches")


def _matched_results(
    state: _State, summary: DataFrame, hits: DataFrame, trim: bool
) -> tuple[DataFrame, DataFrame | None]:
    scores = splits.score_pairs(state.corpus.stored(), state.blocks, hits)
    asked = summary.select("query_id", "mode", "trim")
    # A matched row absent from the index keeps its place, last.
    rows = hits.join(asked, "query_id").join(scores, ["query_id", "path"], "left").select(
        "query_id", "path", "hits", "trim", F.when(
            F.col("mode") == "image", F.col("image_score")).otherwise(
            F.col("caption_score")).alias("score"))
    trimmed = None
    if trim:
        rows = materialize(spread_trim(
            materialize(rows, "scored"), ["query_id"], drop_ratio=state.options.semantic_drop,
            when=F.col("trim")), "matched")
        trimmed = rows.filter("trimmed").select("query_id", "path", "score")
        rows = rows.filter(~F.col("trimmed"))
    else:
        rows = materialize(rows, "matched")
    kept = rank_within(
        rows.select("query_id", "path", "score", F.col("hits").alias("term_hits")),
        ["query_id"], [F.desc_nulls_last("score"), F.col("path")],
    ).withColumn("matched", F.lit(True))
    return kept, trimmed


def _listed_results(state: _State, summary: DataFrame) -> DataFrame:
    """Whole pools in catalog order: what a request without text asks for."""
    listed = summary.filter(F.col("basis_kind").isin("filter_only", "no_query")).select(
        "query_id", "has_filter")
    catalog = state.corpus.caption
    catalog = catalog.select(*(c for c in ("path", "pos") if c in catalog.columns))
    rows = catalog.crossJoin(listed.filter("NOT has_filter").select("query_id"))
    if state.pool is not None:
        own = state.pool.join(listed.filter("has_filter"), "query_id", "left_semi")
        rows = rows.unionByName(catalog.join(own, "path").select(rows.columns))
    return rank_within(rows, ["query_id"], state.corpus.catalog_order()).select(
        "query_id", "rank", "path", F.lit(0.0).alias("score"), F.lit(0).alias("term_hits"),
        F.lit(False).alias("matched"))


def _with_basis(summary: DataFrame) -> DataFrame:
    """Add the sentence that explains a request's answer."""
    people = F.array_join("people", " and ")
    within = F.array_join("event_names", " or ")
    scope = F.concat_ws(
        ", within ", F.when(people != "", people), F.when(within != "", within)
    )
    terms, cut = F.col("total_terms").cast("string"), F.coalesce("trimmed", F.lit(0))
    kind = F.col("basis_kind")
    # One sentence per branch.
    sentence = (
        F.when(kind == "filter_only", F.concat(
            F.lit("There is no query text, so this is everything matching "), scope,
            F.lit(", in catalog order.")))
        .when(kind == "no_query", F.lit(
            "Nothing was asked for, so this is the whole collection in catalog order."))
        .when(kind == "empty_pool", F.lit(
            "Nothing matches this filter, so there was nothing to search."))
        .when(kind == "top_k", F.lit(
            "A fixed number of results was asked for, so the ranking was cut at that "
            "number rather than where the evidence ran out."))
        .when((kind == "full_match") & (F.col("total_terms") == 1), F.lit(
            "Every caption here mentions the query term."))
        .when(kind == "full_match", F.concat(
            F.lit("Every caption here mentions all "), terms, F.lit(" query terms.")))
        .when(kind == "partial_match", F.concat(
            F.lit("No caption mentions every query term, so these are the captions "
                  "mentioning at least "),
            F.col("_threshold").cast("string"), F.lit(" of "), terms, F.lit(".")))
        .otherwise(F.lit(
            "No caption mentions these terms, so these are the closest images by score, "
            "cut where the similarity gradient flattens."))
    )
    label = F.when(F.col("mode") == "image", "image score").otherwise("caption score")
    tail = (
        F.when(cut == 1, F.concat(F.lit(" One further image was trimmed by "), label,
                                  F.lit(".")))
        .when(cut > 1, F.concat(F.lit(" "), cut.cast("string"),
                                F.lit(" further images were trimmed by "), label,
                                F.lit(".")))
        .otherwise("")
    )
    return summary.withColumn("basis", F.concat(sentence, tail)).withColumn(
        "trimmed", cut.cast("int")
    ).drop("_threshold", "top_k", "trim", "has_filter")
