"""Column expressions over source text; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .registry import Registry

# ``\w`` is ASCII only here, and several times faster than the spelled-out class.
TOKEN_PATTERN = r"\w++|[^ \t\r\n\w]"
COMMENT_PATTERN = r"(?s)/\*.*?\*/|//[^\n]*"
# Keywords are bounded by ASCII word characters only, so that accented letters
# next to a keyword count as a boundary.
DECISION_PATTERN = r"(?<!\w)(?:if|for|while|case|catch)(?!\w)|&&|[|][|]|[?]"
PAD_TOKEN = "<pad>"
# Fixed value: the task prefix of the text-to-text classifier.
TASK_PREFIX = "defect_detection: "


def char_length(text: Column) -> Column:
    return F.length(text)


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN_PATTERN))


def complexity(text: Column) -> Column:
    """One plus the decision points outside comments; null for text with no body."""
    code = F.regexp_replace(text, COMMENT_PATTERN, " ")
    return F.when(F.contains(text, F.lit("{")), F.lit(1) + F.regexp_count(code, F.lit(DECISION_PATTERN)))


def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))


def truncate(items: Column, length: int) -> Column:
    return F.slice(items, 1, length)


def pad(items: Column, length: int, filler: Column | str = PAD_TOKEN) -> Column:
    """Cut to ``length``, then fill up to exactly ``length``."""
    filler = filler if isinstance(filler, Column) else F.lit(filler)
    kept = truncate(items, length)
    return F.concat(kept, F.array_repeat(filler, F.lit(length) - F.size(kept)))


def task_prefix(text: Column) -> Column:
    return F.concat(F.lit(TASK_PREFIX), text)


def normalise_whitespace(text: Column) -> Column:
    """LF line ends, four blanks per tab, no trailing blanks, one empty line at most in a row."""
    unix = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    spaced = F.replace(unix, F.lit("\t"), F.lit("    "))
    trimmed = F.regexp_replace(spaced, "(?<! ) +(\n|\\z)", "$1")
    return F.regexp_replace(trimmed, "\n{3,}", "\n\n")


def mean_of_parts(parts: Column, measure) -> Column:
    """Mean of ``measure(part)`` over the list in one row; null for an empty list."""
    total = F.aggregate(parts, F.lit(0).cast("double"), lambda acc, part: acc + measure(part).cast("double"))
    return F.try_divide(total, F.size(parts).cast("double"))


TOKENISERS = Registry("tokeniser")
TOKENISERS.register("code", tokenize)
TOKENISERS.register("whitespace", lambda text: F.filter(F.split(text, r"\s+"), lambda t: t != ""))

REWRITES = Registry("rewrite")
REWRITES.register("whitespace", normalise_whitespace)
REWRITES.register("task_prefix", task_prefix)
REWRITES.register("lower", F.lower)
