"""Similarities of two strings, as columns, and the registry by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import STOP_WORDS

Similarity = Callable[[Column, Column], Column]


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 1 for two empty strings."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)


def _words(c: Column, stop_words: list[str] | None) -> Column:
    found = F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    stop = F.array(*map(F.lit, stop_words or ["\x00"]))
    return F.filter(found, lambda w: ~F.array_contains(stop, w))


def similarity_words(c: Column, kind: str) -> Column:
    """The words that a word measure compares, repeats included."""
    return _words(c, STOP_WORDS if kind == "cos" else None)


def _cosine(a: Column, b: Column, unshared: float) -> Column:
    """Cosine of word counts, where a word of one side alone weighs `unshared` times one of both. Words are bound once for the lambdas."""
    return F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), lambda s: _bound_cosine(s["a"], s["b"], unshared))[0]


def _bound_cosine(a: Column, b: Column, unshared: float) -> Column:
    count = lambda words, w: F.size(F.filter(words, lambda x: x == w)).cast("double")
    dot = F.aggregate(F.array_intersect(a, b), F.lit(0.0), lambda s, w: s + count(a, w) * count(b, w))
    square = lambda own, other: F.aggregate(F.array_distinct(own), F.lit(0.0), lambda s, w: s + F.pow(count(own, w) * F.when(F.array_contains(other, w), 1.0).otherwise(unshared), F.lit(2.0)))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(dot / F.sqrt(square(a, b) * square(b, a)))


def tfidf_cosine(a: Column, b: Column, stop_words: list[str] | None = None) -> Column:
    """TF-IDF cosine fitted on the two strings alone, smoothed: a word of both weighs 1, one of either ln(3/2) + 1.

    No word on a side: 0. Stop words are a parameter.
    """
    stop = STOP_WORDS if stop_words is None else stop_words
    return _cosine(_words(a, stop), _words(b, stop), 1.4054651081081644)


def count_cosine(a: Column, b: Column) -> Column:
    return _cosine(_words(a, None), _words(b, None), 1.0)


def longest_common_substring(a: Column, b: Column) -> Column:
    """Length of the longest common substring: one row of the table after another, as nested higher-order functions."""
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    right = chars(b)
    start = F.struct(F.array_repeat(F.lit(0), F.length(b)).alias("row"), F.lit(0).alias("best"))

    def step(state, x):
        row = F.transform(right, lambda y, j: F.when(x == y, F.when(j == 0, 1).otherwise(F.coalesce(F.get(state["row"], j - 1), F.lit(0)) + 1)).otherwise(0))
        return F.transform(F.array(row), lambda r: F.struct(r.alias("row"), F.greatest(state["best"], F.coalesce(F.array_max(r), F.lit(0))).alias("best")))[0]

    return F.aggregate(chars(a), start, step, lambda s: s["best"])


def substring_similarity(a: Column, b: Column) -> Column:
    """Twice the longest common substring over both lengths; 1 for two empty strings."""
    both = F.length(a) + F.length(b)
    return F.when(both == 0, 1.0).otherwise(2.0 * longest_common_substring(a, b) / both)


def weighted_distance(a: Column, b: Column, insert: int = 1, delete: int = 2, substitute: int = 2) -> Column:
    """Edit distance from a to b with a weight for each kind of step."""
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    right = chars(b)
    first = F.transform(F.sequence(F.lit(0), F.length(b)), lambda j: (j * insert).cast("int"))

    def step(row, x):
        begin = F.array((row[0] + delete).cast("int"))
        cell = lambda made, y: F.least(F.element_at(made, -1) + insert, F.get(row, F.size(made)) + delete, F.get(row, F.size(made) - 1) + F.when(x == y, 0).otherwise(substitute))
        return F.aggregate(right, begin, lambda made, y: F.concat(made, F.array(cell(made, y).cast("int"))))

    return F.element_at(F.aggregate(chars(a), first, step), -1)


def weighted_similarity(query: Column, other: Column) -> Column:
    """(2 n - distance) / 2 n for a query of n characters; may be negative, null for an empty query."""
    most = 2 * F.length(query)
    return F.when(most > 0, (most - weighted_distance(query, other)) / most)


#: By the names that strategies use.
SIMILARITIES: dict[str, Similarity] = {"lev": levenshtein_similarity, "cos": tfidf_cosine, "sco": count_cosine, "lcs": substring_similarity}
