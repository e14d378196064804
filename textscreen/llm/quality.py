"""Quality rules as a ledger: every rule is evaluated once, its verdict is a bit, and policies are masks over the bits.

A ledger row holds the measurements and ``fail_bits``; bit *i* is set when rule
*i* of ``RULES`` rejects the text. A policy is a named mask: a text passes if
none of its bits is set. Trying another policy, or leaving out one rule, is an
AND on the stored bits and never reads a text again. Rules are only ever
appended, so that stored bits keep their meaning.

Null and empty texts have zero words and fail ``few_words``. Measurements are
exact; two word windows are equal when their 64-bit hashes within one text are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .blocks import Block, free, mix, per_row, repeated, running

MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, "
    "n_upper_words long, n_plain_words long, n_distinct_words long, n_adjacent_words long"
)
WINDOW = 5

#: (name, whether the text fails). Shares are compared without division, so no rule meets a zero divisor.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("shouting", "10 * n_upper_words > 3 * n_words"),
    ("few_letters", "2 * n_plain_words > n_words"),
    ("few_distinct", "10 * n_distinct_words < n_words"),
    ("stuttering", "10 * n_adjacent_words > 2 * n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
]


def mask(*names: str) -> int:
    """The bits of the named rules."""
    places = {name: i for i, (name, _) in enumerate(RULES)}
    return sum(1 << places[name] for name in names)


#: Versioned policies; a published version never changes.
POLICIES: dict[str, int] = {
    "base-1": mask("few_words", "repeated_windows"),
    "strict-1": mask(*(name for name, _ in RULES)),
}


def _measure(texts: pa.Array) -> pa.StructArray:
    block = Block(texts)
    starts, ends, at = block.words()
    n, data, count = np.diff(at), block.data, len(starts)
    owner = np.repeat(np.arange(block.size), n)
    h = block.hashes(starts, ends)
    salt = mix(owner.astype(np.uint64) + np.uint64(1))

    def over_words(marks: np.ndarray) -> np.ndarray:
        return np.diff(running(marks)[at])

    def in_words(marks: np.ndarray) -> np.ndarray:
        sums = running(marks)
        return sums[ends] - sums[starts]

    covered = np.zeros(count + 1, np.int64)
    if count >= WINDOW:
        with np.errstate(over="ignore"):
            windows = salt[: count - WINDOW + 1].copy()
            for i in range(WINDOW):
                windows = mix(windows * np.uint64(31) + h[i : count - WINDOW + 1 + i])
        whole = owner[: count - WINDOW + 1] == owner[WINDOW - 1 :]
        found = np.flatnonzero(whole)[repeated(windows[whole])]
        np.add.at(covered, found, 1)
        np.add.at(covered, found + WINDOW, -1)
    upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
    letters, n_upper = in_words(upper | lower | (data >= 0xC3)), in_words(upper)
    same = np.zeros(count, bool)
    same[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(owner[order], kind="stable")]
    fresh = np.ones(count, bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (owner[1:] != owner[:-1])
    lines, dup = np.zeros(block.size, np.int64), np.zeros(block.size, np.int64)
    raw = data.tobytes()
    for i, (a, b) in enumerate(zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist())):
        filled = [x for x in raw[a:b].split(b"\n") if x and not x.isspace()]
        lines[i], dup[i] = len(filled), len(filled) - len(set(filled))
    made = [
        n,
        block.per_text(((data & 0xC0) != 0x80)) - block.per_text(np.isin(data, [0x20, *range(0x09, 0x0E)])),
        block.per_text(np.isin(data, list(b"#*$%&|<>"))),
        dup,
        over_words(np.cumsum(covered[:-1]) > 0),
        lines,
        over_words((n_upper >= 2) & (in_words(lower) == 0)),
        over_words(letters == 0),
        np.diff(running(fresh)[at]),
        over_words(same),
    ]
    names = [x.split()[0] for x in MEASURES.split(", ")]
    return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in made], names)


def ledger(docs: DataFrame, text: str = "text", out: str = "ledger") -> DataFrame:
    """``docs`` with the struct ``out``: all measurements and ``fail_bits``. Rows are neither lost nor merged."""
    measured = per_row(docs, text, _measure, MEASURES, out)
    names = [x.split()[0] for x in MEASURES.split(", ")]
    bits = "CAST(" + " | ".join(
        f"(CASE WHEN {_inside(rule, names, out)} THEN {1 << i} ELSE 0 END)" for i, (_, rule) in enumerate(RULES)
    ) + " AS BIGINT)"
    return measured.withColumn(out, F.struct(*[F.col(f"`{out}`.{m}").alias(m) for m in names], F.expr(bits).alias("fail_bits")))


def _inside(rule: str, names: list[str], out: str) -> str:
    return " ".join(f"`{out}`.{token}" if token in names else token for token in rule.split())


def passes(bits: Column, policy: str) -> Column:
    """Whether a text with these failure bits passes a policy."""
    return bits.bitwiseAND(F.lit(POLICIES[policy])) == 0


def accepted(docs: DataFrame, policy: str, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns, whatever their names."""
    name = free(docs, "_ledger")
    judged = ledger(docs, text, name)
    return judged.where(passes(F.col(f"`{name}`.fail_bits"), policy)).select(*[F.col(f"`{c}`") for c in docs.columns])


def ablation(bits: DataFrame, policy: str, column: str = "fail_bits") -> DataFrame:
    """Per rule of a policy: texts failing it, failing it alone, and kept if it were left out.

    Rows are first counted per distinct bit pattern; there are at most
    ``2 ** len(RULES)`` of those, whatever the corpus.
    """
    wanted = POLICIES[policy]
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, (name, _) in enumerate(RULES) if wanted >> i & 1])
    patterns = bits.groupBy((F.coalesce(F.col(column), F.lit(0)).bitwiseAND(F.lit(wanted))).alias("bits")).agg(F.count("*").alias("n"))
    each = patterns.select("bits", "n", F.inline(rules))
    hit, rest = F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("bits").bitwiseAND(F.bitwise_not("bit"))
    return each.groupBy("rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(hit & (rest == 0), F.col("n")).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when(rest == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
        F.sum(F.when(F.col("bits") == 0, F.col("n")).otherwise(0)).alias("n_kept"),
    )
