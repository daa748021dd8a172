"""URL rules in a cascade of Bloom filters, exact over the corpus's own keys.

A rule is a host and a path prefix. Every url is turned into the few keys a
rule could have (host suffix + path prefix, for the label counts and lengths
that occur among the rules), and the distinct keys of the whole corpus are the
universe. Level 1 encodes the listed keys, level 2 the universe's keys that
pass level 1 wrongly, level 3 the listed keys that pass level 2, and so on
until a level lets nothing wrong through. Over that universe the first level
that rejects a key decides, so urls are judged by arithmetic on their own row:
no join and no shuffle. Everything is built-in column functions.

Sizes: with level 1's rate set to listed / universe, the whole cascade takes
about 1.44 * log2(universe / listed) + 5 bits per *listed* key, whatever the
corpus holds. The bit arrays are literals of the judging plan and bounded by
``max_filter_bytes``; a longer list is looked up by an equi-join instead,
with the same results.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Level:
    words: str  # comma-separated 64-bit words of the bit array
    bits: int
    hashes: int
    seed: int

    def hit(self, key: Column) -> Column:
        words = F.split(F.lit(self.words), ",").cast("array<bigint>")
        found = F.lit(True)
        for pos in _positions(key, self.bits, self.hashes, self.seed):
            word = F.element_at(words, (F.floor(pos / 64) + 1).cast("int"))
            found = found & (F.call_function("getbit", word, (pos % 64).cast("int")) == 1)
        return found


def _positions(key: Column, bits: int, hashes: int, seed: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(seed * 64 + i)), F.lit(bits)) for i in range(hashes)]


def _level(keys: DataFrame, count: int, rate: float, seed: int) -> Level:
    """A Bloom filter of ``keys`` (column key); its words are OR-ed map-side first."""
    bits = max(64, 64 * math.ceil(-count * math.log(rate) / math.log(2) ** 2 / 64))
    hashes = max(1, round(-math.log2(rate)))
    spots = keys.select(F.explode(F.array(*_positions(F.col("key"), bits, hashes, seed)))
                        .alias("pos"))
    rows = (
        spots.groupBy(F.floor(F.col("pos") / 64).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(pos % 64 as int))")).alias("value"))
        .collect()  # at most bits / 64 rows, bounded by max_filter_bytes
    )
    words = [0] * (bits // 64)
    for row in rows:
        words[row["word"]] = row["value"]
    return Level(",".join(map(str, words)), bits, hashes, seed)


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def member(self, key: Column) -> Column:
        """Whether ``key`` is listed; exact for every key of the universe."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for depth in range(len(self.levels), 0, -1):
            answer = F.when(self.levels[depth - 1].hit(key), answer).otherwise(
                F.lit(depth % 2 == 0))
        return answer


def build_cascade(listed: DataFrame, universe: DataFrame,
                  max_filter_bytes: int = 64 << 20) -> Cascade | None:
    """The cascade for ``listed`` over ``universe`` (both: distinct key column).

    None when level 1 would exceed ``max_filter_bytes``. An empty list gives a
    cascade without levels, of which nothing is a member.
    """
    ours = listed.count()
    if not ours:
        return Cascade(())
    rate = min(0.5, math.sqrt(0.5) * ours / max(1, universe.count()))
    if ours * -math.log(rate) / math.log(2) ** 2 / 8 > max_filter_bytes:
        return None
    levels = [_level(listed, ours, rate, 1)]
    wrong = materialize(
        universe.filter(levels[0].hit(F.col("key"))).join(listed, "key", "left_anti"), "cascade")
    encode, other = wrong, listed
    while count := encode.count():
        levels.append(_level(encode, count, 0.5, len(levels) + 1))
        passed = materialize(other.filter(levels[-1].hit(F.col("key"))), "cascade")
        encode, other = passed, encode
    return Cascade(tuple(levels))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _key(host: Column, path: Column) -> Column:
    """Host and path with a slash between them, which no host holds, so that each pair is its own."""
    return F.concat(host, F.lit("/"), path)


def _rule(key: Column) -> Column:
    """Host and path of a key as the rule's string."""
    return F.regexp_replace(key, "^([^/]*)/", "$1")


def _candidates(forms: list[tuple[int, int]]) -> Column:
    """(length, key) of every key a rule of one of ``forms`` could have in common."""
    keys = [
        F.when(
            (F.col("host") != "") & (F.length("path") >= length),
            F.struct(
                (F.length(F.substring_index("host", ".", -labels)) + length).alias("length"),
                F.length(F.substring_index("host", ".", -labels)).alias("host_length"),
                _key(F.substring_index("host", ".", -labels),
                     F.substring("path", 1, length)).alias("key")),
        )
        for labels, length in forms
    ]
    return F.array_compact(F.array_distinct(F.array(*keys)))


def judge_urls(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id",
               url_col: str = "url", default: str = "allow",
               max_filter_bytes: int = 64 << 20) -> DataFrame:
    """(id, host, path, rule, verdict) of every row of ``pages``.

    ``rules`` has host, path and verdict (allow or block). A rule fits its host
    and all subdomains where the url's path starts with the rule's; the longest
    fitting rule wins (of equally long ones the longer host), and block wins
    over allow for one and the same rule. Urls no rule fits get ``default``
    and a null rule. Null urls, and those without ``://``, have an empty host
    and path. Rules with a null or empty host, or one that holds ``/``, ``?``
    or ``#``, fit nothing, nor does a path without its slash; a null path is
    empty, and other columns of either table are ignored. Repeated ids stay
    repeated; empty tables give no rows, or ``default`` for all.
    """
    host, path = url_parts(F.col(url_col))
    parsed = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    listed = materialize(
        rules.filter("host <> '' AND NOT host RLIKE '[/?#]'").select(
            F.translate("host", UPPER, LOWER).alias("host"),
            F.coalesce("path", F.lit("")).alias("path"),
            (F.col("verdict") == "block").alias("block"))
        .groupBy(_key(F.col("host"), F.col("path")).alias("key"),
                 F.expr("size(split(host, '[.]'))").alias("labels"),
                 F.length("path").alias("length"))
        .agg(F.max("block").alias("block")), "rules")
    forms = [tuple(r) for r in listed.select("labels", "length").distinct().collect()]
    if not forms:
        return parsed.select(id_col, "host", "path", F.lit(None).cast("string").alias("rule"),
                             F.lit(default).alias("verdict"))
    keys = _candidates(sorted(forms))
    # Only keys a url could share with a rule are in the universe; distinct
    # values are merged map-side, so one host with most urls is a few rows a task.
    universe = materialize(
        parsed.select("host", "path").select(F.explode(keys).alias("k"))
        .select("k.key").distinct(), "universe")
    any_rule = build_cascade(listed.select("key"), universe, max_filter_bytes)
    block = build_cascade(listed.filter("block").select("key"),
                          listed.select("key"), max_filter_bytes)
    if any_rule is None or block is None:
        return _judge_by_join(parsed, keys, listed, id_col, default)
    best = F.array_max(F.filter(keys, lambda k: any_rule.member(k["key"])))["key"]
    judged = parsed.select(id_col, "host", "path", best.alias("best"))
    return judged.select(
        id_col, "host", "path", _rule(F.col("best")).alias("rule"),
        F.when(F.col("best").isNull(), F.lit(default))
        .when(block.member(F.col("best")), F.lit("block"))
        .otherwise(F.lit("allow")).alias("verdict"))


def _judge_by_join(parsed: DataFrame, keys: Column, listed: DataFrame, id_col: str,
                   default: str) -> DataFrame:
    """The same verdicts for a list too long for literals: distinct (host, path) against it."""
    places = parsed.select("host", "path").distinct()
    found = (
        places.select("host", "path", F.explode(keys).alias("k"))
        .select("host", "path", "k.*").join(listed.select("key", "block"), "key")
        .groupBy("host", "path")
        .agg(F.max(F.struct("length", "host_length", "key", "block")).alias("best"))
    )
    return parsed.join(found, ["host", "path"], "left").select(
        id_col, "host", "path", _rule(F.col("best.key")).alias("rule"),
        F.when(F.col("best").isNull(), F.lit(default))
        .when(F.col("best.block"), F.lit("block")).otherwise(F.lit("allow")).alias("verdict"))
