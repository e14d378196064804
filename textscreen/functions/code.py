"""Measures of the functions inside C-like source text, as column expressions.

A text is cut into lexemes by one pattern, in which a comment, a string and a
character literal are one lexeme each, so that braces and keywords inside them
count for nothing. One fold over the lexemes then follows the nesting of braces
and parentheses and adds up the functions it passes. All of it runs in the JVM.

A function is a block in braces that follows a name and parentheses, with anything
but ``;``, ``=`` or another block between them; a block after a control keyword is
none. Functions inside a function belong to it; blocks around functions, such as
name spaces and classes, do not count. A function whose end is missing is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Comment, string, character, word, two-character operator, any other character.
LEXEMES = (
    r"(?s)/\*.*?(?:\*/|\z)|//[^\n]*+"
    r'|"(?:[^"\\\n]++|\\.)*+"?+'
    r"|'(?:[^'\\\n]++|\\.)*+'?+"
    r"|\w++|&&|[|][|]|[^ \t\r\n\f\x0B]"
)
DECISIONS = ("if", "for", "while", "case", "catch", "&&", "||", "?")
# Words that may stand before parentheses without naming a function.
CONTROL = ("if", "for", "while", "switch", "catch", "return", "sizeof", "else", "do", "case")

_NO_NAME, _NAMED, _CONTROLLED = 0, 1, 2


def lexemes(text: Column) -> Column:
    """The text's lexemes without its comments."""
    return F.filter(F.regexp_extract_all(text, F.lit(LEXEMES), F.lit(0)), lambda t: ~(t.startswith("/*") | t.startswith("//")))


def _whole(value) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast("int")


def _next(s: Column, t: Column) -> Column:
    inside = s["body"] > 0
    opens, closes, left, right = t == "{", t == "}", t == "(", t == ")"
    ends = inside & closes & (s["depth"] == s["body"])
    starts = ~inside & opens & (s["paren"] == 0) & (s["head"] == _NAMED)
    outer = left & (s["paren"] == 0) & (s["head"] == _NO_NAME)
    decides = t.isin(*DECISIONS).cast("int")
    closed = F.greatest(s["depth"] - 1, F.lit(0))
    fields = {
        "depth": F.when(opens, s["depth"] + 1).when(closes, closed).otherwise(s["depth"]),
        "paren": F.when(inside | opens | closes, 0).when(left, s["paren"] + 1).when(right, F.greatest(s["paren"] - 1, F.lit(0))).otherwise(s["paren"]),
        "head": F.when(inside | opens | closes | ((s["paren"] == 0) & t.isin(";", "=")), _NO_NAME)
        .when(outer, F.when(s["word"], _NAMED).otherwise(_CONTROLLED))
        .otherwise(s["head"]),
        "word": t.rlike(r"^[A-Za-z_]\w*+$") & ~t.isin(*CONTROL),
        "body": F.when(starts, s["depth"] + 1).when(ends, 0).otherwise(s["body"]),
        # Lexemes since the name, then of the whole function.
        "size": F.when(~inside & outer, 2).otherwise(s["size"] + 1),
        "cc": F.when(starts, 1).otherwise(s["cc"] + decides),
        "n": s["n"] + ends.cast("int"),
        "complexity": s["complexity"] + F.when(ends, s["cc"]).otherwise(0),
        "lexemes": s["lexemes"] + F.when(ends, s["size"] + 1).otherwise(0),
    }
    return F.struct(*[(v if k == "word" else _whole(v)).alias(k) for k, v in fields.items()])


def function_totals(text: Column) -> Column:
    """``(n, complexity, lexemes)``: how many functions a text has, and the sums of their measures; null for a null text.

    A function's complexity is one and its decisions; its lexemes run from its name
    to its closing brace.
    """
    start = F.struct(*[(F.lit(False) if k == "word" else _whole(0)).alias(k) for k in ("depth", "paren", "head", "word", "body", "size", "cc", "n", "complexity", "lexemes")])
    return F.aggregate(lexemes(text), start, _next, lambda s: F.struct(s["n"].alias("n"), s["complexity"].alias("complexity"), s["lexemes"].alias("lexemes")))


def mean_complexity(text: Column) -> Column:
    """Mean complexity of a text's functions; null for a text without any."""
    return F.get(F.transform(F.array(function_totals(text)), lambda s: F.try_divide(s["complexity"].cast("double"), s["n"])), 0)


def mean_lexemes(text: Column) -> Column:
    """Mean number of lexemes of a text's functions; null for a text without any."""
    return F.get(F.transform(F.array(function_totals(text)), lambda s: F.try_divide(s["lexemes"].cast("double"), s["n"])), 0)
