"""Column functions over text. All stay in the JVM; null text counts as empty unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column | str) -> Column:
    """Lower-case runs of letters, digits and ``_ . - /`` with at least two characters."""
    value = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(F.coalesce(value, F.lit(""))), r"[^a-z0-9_.\-/]+"), lambda t: F.length(t) >= 2)


def term_counts(words: Column) -> Column:
    """array<struct<term, tf>> of an array of words, sorted; runs of equal words are measured in place."""
    w = F.array_sort(words)
    starts = lambda a: F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: (i == 0) | (F.get(a, i) != F.get(a, i - 1)))
    runs = lambda a, s: F.transform(s, lambda at, k: F.struct(F.get(a, at).alias("term"), (F.coalesce(F.get(s, k + 1), F.size(a)) - at).alias("tf")))
    one = F.transform(F.array(w), lambda a: F.when(F.size(a) > 0, F.get(F.transform(F.array(starts(a)), lambda s: runs(a, s)), F.lit(0))))
    return F.get(one, F.lit(0))


def tokens_with_parts(text: Column | str) -> Column:
    """``tokens`` with the parts (of two characters or more) of those that have at least two."""

    def spread(t: Column) -> Column:
        parts = F.filter(F.split(t, r"[_/.\-]+"), lambda p: F.length(p) >= 2)
        return F.when(F.size(parts) >= 2, F.concat(F.array(t), parts)).otherwise(F.array(t))

    return F.flatten(F.transform(tokens(text), spread))


def flat(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clip(text: Column, limit: int) -> Column:
    """At most ``limit`` characters; a cut text ends in an ellipsis."""
    return F.when(F.length(text) > limit, F.concat(F.rtrim(F.substring(text, 1, limit - 1)), F.lit("…"))).otherwise(text)


#: (pattern, replacement) in the order they are applied; each also runs in RE2.
MASKS = (
    (r"(://[^:@/?#\s]+):[^@\s]+@", r"$1:***@"),
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "<email>"),
    (r"(?i)\b(api[_-]?key|token|password|secret)(\s*[=:]\s*)[^\s,;]+", r"$1$2***"),
    (r"\b([0-9]{1,3}\.){3}[0-9]{1,3}\b", "<ip>"),
)


def mask_secrets(text: Column) -> Column:
    for pattern, to in MASKS:
        text = F.regexp_replace(text, pattern, to)
    return text


def label_list(raw: Column) -> Column:
    """A JSON list of labels as a sorted array of distinct, trimmed, lower-case names; bad JSON is empty."""
    got = F.coalesce(F.from_json(raw, "array<string>"), F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.filter(F.transform(got, lambda x: F.lower(F.trim(x))), lambda x: x.isNotNull() & (x != ""))))
