"""Text expressions: tokens, singular fold, content terms, cleaned subjects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in a query.
STOPWORDS = [
    "a", "an", "the", "of", "in", "on", "at", "with", "and", "or",
    "someone", "somebody", "something", "anyone", "people", "person",
    "photo", "photos", "picture", "pictures", "image", "images",
    "is", "are", "was", "were", "being", "be",
]

# Fixed value: a token is a run of letters and digits, underscore excluded.
TOKEN_PATTERN = r"[\p{L}\p{N}]+"


def is_stopword(token: Column) -> Column:
    """Whether a token is a stopword; the list is one constant array."""
    listed = ", ".join(f"'{word}'" for word in STOPWORDS)
    return F.array_contains(F.expr(f"array({listed})"), token)


def tokens(text: Column) -> Column:
    """Lower-cased alphanumeric runs, in order, repeats kept."""
    return F.regexp_extract_all(
        F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN_PATTERN), F.lit(0)
    )


def singular(token: Column) -> Column:
    """Fold a token towards its singular; applied to both sides of a match.

    The fold is deliberately one-way: ``horses`` becomes ``hors`` while
    ``horse`` stays, so those two do not meet.
    """
    size = F.length(token)
    before_es = F.substring(token, -3, 1)
    return (
        F.when((size > 3) & token.endswith("ies"),
               F.concat(F.left(token, size - 3), F.lit("y")))
        .when((size > 3) & token.endswith("es") & before_es.isin("s", "x", "z", "h"),
              F.left(token, size - 2))
        .when((size > 2) & token.endswith("s") & ~token.endswith("ss"),
              F.left(token, size - 1))
        .otherwise(token)
    )


def content_terms(text: Column) -> Column:
    """Folded query tokens without stopwords; a repeated term stays repeated."""
    kept = F.filter(
        tokens(text),
        lambda t: ~is_stopword(t) & ~is_stopword(singular(t)),
    )
    return F.transform(kept, singular)


def caption_terms(text: Column) -> Column:
    """The distinct folded tokens of one caption."""
    return F.array_distinct(F.transform(F.array_distinct(tokens(text)), singular))


def comparable_words(text: Column) -> Column:
    """Distinct tokens longer than one character, stopwords removed, no fold."""
    return F.filter(
        F.array_distinct(tokens(text)),
        lambda t: (F.length(t) > 1) & ~is_stopword(t),
    )


def mentioned(name: Column, text: Column) -> Column:
    """Whether the text holds at least one comparable word of the name."""
    return F.arrays_overlap(comparable_words(name), comparable_words(text))


def remaining_text(text: Column, taken: Column) -> Column:
    """The text without the whitespace words found in ``taken``.

    Words are compared with everything but letters, digits and underscores
    stripped, so a typed id such as ``event-001`` never equals itself.
    """
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.array_join(
        F.filter(
            words,
            lambda w: ~F.array_contains(
                taken, F.lower(F.regexp_replace(w, r"[^\p{L}\p{N}_]", ""))
            ),
        ),
        " ",
    )


def clean_subject(subject: Column) -> Column:
    """A subject line without its leading reply and forward marks."""
    bare = F.regexp_replace(
        F.trim(F.coalesce(subject, F.lit(""))), r"(?i)^((re|fwd|fw)\s*:\s*)+", ""
    )
    return F.trim(bare)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """Lower-cased extension with its dot; a leading-dot name has none."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1))


def normal_path(path: Column, fold_case: bool = False) -> Column:
    """A path as a join key: repeated and ``/./`` separators collapsed."""
    clean = F.regexp_replace(F.trim(path), r"/(\./)+", "/")
    clean = F.regexp_replace(clean, r"/{2,}", "/")
    return F.lower(clean) if fold_case else clean


def padded_id(prefix: str, number: Column) -> Column:
    """``prefix-007``: padded to three digits, never truncated."""
    return F.format_string(prefix + "%03d", number)
