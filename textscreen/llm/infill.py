"""Fill-in-middle rewriting of texts by one counted-quantifier match per row.

A text is a sequence of units, by default code points. ``regexp_count`` gives their
number n, a hash of the row's key the two cuts ``a <= b``. The row's own pattern
``(unit{a}+)(unit{b-a}+)(rest)``, with possessive groups, captures prefix, middle
and suffix in one match, and the replacement puts them in the order of the form:

* ``psm``: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle
* ``spm``: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle
* ``plain``: the text as it is

A text that is empty or holds one of the three marks stays plain, so that the marks
in an output are the ones put there and ``restore`` finds the exact text again.

Everything is a row's own expression: no shuffle, no Python. A null text counts as
empty, a null key as the empty string; rows repeating a key are cut alike. Keys may
be of any type that casts to a string. A table without rows gives none. Columns of
the caller stay; a column that has the name of the result is replaced.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from .blocks import once

MARKS = ("<P>", "<S>", "<M>")
#: One code point, line ends included.
UNIT = r"(?s:.)"
#: Units that are counted as one match, so that counting a long text keeps few matches.
STEP = 1024


def count_units(text: Column, unit: str = UNIT) -> Column:
    """How many units a text holds: whole steps of ``STEP`` units, then the units of what is left."""
    step = f"(?:{unit}){{{STEP}}}+"
    left = F.regexp_replace(text, f"^(?:{step})*+", "")
    return (F.regexp_count(text, F.lit(step)).cast("long") * STEP + F.regexp_count(left, F.lit(unit))).cast("long")


def _hashes(key: Column, seed: str) -> Column:
    """Four unsigned 32-bit numbers of the key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])


def _group(unit: str, count: Column) -> Column:
    """A group of exactly ``count`` units that never gives any back; no unit is the empty group."""
    return F.concat(F.lit(f"((?:{unit}){{"), count.cast("string"), F.lit("}+)"))


def _replacement(*parts: str | int) -> str:
    return "".join(f"${p}" if isinstance(p, int) else re.sub(r"([\\$])", r"\\\1", p) for p in parts)


def transform(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    rate: int = 90,
    spm: int = 20,
    seed: str = "1",
    marks: tuple[str, str, str] = MARKS,
    unit: str = UNIT,
    out: str = "infill",
) -> DataFrame:
    """``docs`` with the struct ``out`` of ``(n, form, prefix_units, middle_units, output)``.

    Of 100 texts ``rate`` are rearranged, and ``spm`` of 100 of those as ``spm``.
    The cuts are two hashes of the key modulo n + 1, so every cut is possible,
    also an empty prefix, middle or suffix. The lengths are null for plain texts.
    ``unit`` must match every part of a text, one non-empty piece at a time.
    """
    first, second, third = marks
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() != out.lower()]

    def cut(v: Column) -> Column:
        body, n, h = v["body"], v["n"], v["h"]
        a = F.least(F.get(h, 0) % (n + 1), F.get(h, 1) % (n + 1))
        b = F.greatest(F.get(h, 0) % (n + 1), F.get(h, 1) % (n + 1))
        marked = F.contains(body, F.lit(first)) | F.contains(body, F.lit(second)) | F.contains(body, F.lit(third))
        plain = (n == 0) | marked | (F.get(h, 2) % 100 >= rate)
        form = F.when(plain, "plain").when(F.get(h, 3) % 100 < spm, "spm").otherwise("psm")
        return F.struct(body.alias("body"), n.alias("n"), form.alias("form"), a.alias("a"), (b - a).alias("m"))

    def put(v: Column) -> Column:
        pattern = F.concat(F.lit("^"), _group(unit, v["a"]), _group(unit, v["m"]), F.lit(r"((?s:.*))\z"))
        order = F.when(v["form"] == "psm", _replacement(first, 1, second, 3, third, 2)).otherwise(_replacement(second, 3, first, 1, third, 2))
        plain = v["form"] == "plain"
        return F.struct(
            v["n"].alias("n"),
            v["form"].alias("form"),
            F.when(~plain, v["a"]).alias("prefix_units"),
            F.when(~plain, v["m"]).alias("middle_units"),
            F.when(plain, v["body"]).otherwise(F.regexp_replace(v["body"], pattern, order)).alias("output"),
        )

    def count(body: Column) -> Column:
        measured = F.struct(body.alias("body"), count_units(body, unit).alias("n"), _hashes(F.col(f"`{key}`"), seed).alias("h"))
        return once(measured, lambda v: once(cut(v), put))

    return docs.select(*kept, once(F.coalesce(F.col(f"`{text}`"), F.lit("")), count).alias(out))


def restore(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output of ``transform`` was made of; null if either is null or the form's marks are not there."""
    first, second, third = (re.escape(m) for m in marks)
    psm = rf"^{first}((?s:.*?)){second}((?s:.*?)){third}((?s:.*))\z"
    spm = rf"^{second}((?s:.*?)){first}((?s:.*?)){third}((?s:.*))\z"
    return (
        F.when(form == "plain", output)
        .when((form == "psm") & F.rlike(output, F.lit(psm)), F.regexp_replace(output, psm, "$1$3$2"))
        .when((form == "spm") & F.rlike(output, F.lit(spm)), F.regexp_replace(output, spm, "$2$3$1"))
    )
