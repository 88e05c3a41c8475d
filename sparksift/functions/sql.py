"""Small helpers that write SQL expressions.

The token facts are some hundred expressions. Handing Spark each one as a text
costs one call per column instead of one call per operator and literal, which
is most of the time a plan over small inputs takes to build.
"""

from __future__ import annotations

import re
from string import Formatter

from pyspark.sql import DataFrame

from .lexicon import KEYWORDS

# A file is one part unless it is long. Where the text is hashed by path alone, parts change nothing about how it is dealt.
READ = "PARTITION BY path, part ORDER BY pos"
LEVEL = "PARTITION BY path, part, lvl ORDER BY pos"
UP_TO = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
EARLIER = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def add(df: DataFrame, **columns: str) -> DataFrame:
    """All columns of ``df`` and the named expressions."""
    return df.selectExpr("*", *[f"{expression} AS {name}" for name, expression in columns.items()])


# Words that token facts are compared with, the frequent ones first. Their places from 1 on are their codes; any other text has code 0.
CODED = """( ) ; . { } , = < > + - && || == [ ] @ : ? -> :: ++ -- != <= >= ! ~ * / % & | ^ += -= *= /= %= &= |= ^= <<= ... yield permits record sealed""".split() + KEYWORDS
CODES = {word: n for n, word in enumerate(CODED, 1)}
KIND_CODES = {kind: n for n, kind in enumerate("iokscn", 1)}
# Columns that have a column of codes beside them; p1 is the token before, n1 the next, pk1 and nk1 are their kinds.
TOKENS_AROUND = ["tok", "p1", "p2", "p3", "n1", "n2", "n3", "n4", "head"]
KINDS_AROUND = ["kind", "pk1", "pk2", "nk1", "nk2", "nk3"]
# What a bracket belongs to. Kinds of parentheses begin with "(". The codes are in the order of the texts, so that a maximum is the same of both.
ROUND_KINDS = ["(annot", "(catch", "(dowhile", "(for", "(if", "(method", "(new", "(par", "(switch", "(synchronized", "(try", "(while", "["]
BLOCK_KINDS = sorted(ROUND_KINDS + """annot annotation anon arr bare case catch class ctor do else enum file finally if init interface lambda loop method other
    record switch switchx sync try tryres""".split())
BLOCK_CODES = {kind: n for n, kind in enumerate(BLOCK_KINDS, 1)}
# These columns are held as codes and written as text in the end, if at all.
BLOCKS_AROUND = ["inner_bk", "closed_bk", "encl_bk", "decl_owner_kind"]
CODE_COLUMNS = [f"c_{c}" for c in TOKENS_AROUND + KINDS_AROUND + BLOCKS_AROUND]
_CODES_OF = {c: CODES for c in [*TOKENS_AROUND, "sib_p2", "sib_block_p1"]} | {c: KIND_CODES for c in KINDS_AROUND}
_CODES_OF |= {c: BLOCK_CODES for c in [*BLOCKS_AROUND, "bk", "sib_paren", "class_kw_kind"]}
_NAME = rf"\b({'|'.join(_CODES_OF)})"
_COMPARED = re.compile(rf"{_NAME} (IS NULL|IS NOT NULL)|{_NAME} (=|<>) '([^']*)'|{_NAME} (IN|NOT IN) \(('[^']*'(?:, ?'[^']*')*)\)")


def coded(expression: str) -> str:
    """The expression with tokens and kinds compared as codes.

    A row passes through a dozen windows and sorts, where a number costs a fraction of a text. What is compared
    with words that have no code, or taken as a value, stays text.
    """

    def swapped(found: re.Match) -> str:
        if found[1]:
            return f"c_{found[0]}"
        name, sign, values = (found[3], found[4], [found[5]]) if found[3] else (found[6], found[7], re.findall("'([^']*)'", found[8]))
        codes = _CODES_OF[name]
        if not set(values) <= set(codes):
            return found[0]
        numbers = ", ".join(str(codes[v]) for v in values)
        return f"c_{name} {sign} {numbers}" if found[3] else f"c_{name} {sign} ({numbers})"

    return _COMPARED.sub(swapped, expression)


def block_text(code: str) -> str:
    """SQL: the kind of bracket that a code stands for; null for null, which ``element_at`` alone takes for a place if the array has no nulls."""
    return f"CASE WHEN {code} IS NOT NULL THEN element_at(array({words(*BLOCK_KINDS)}), {code}) END"


def add_coded(df: DataFrame, **columns: str) -> DataFrame:
    """``add`` with ``coded`` expressions."""
    return add(df, **{name: coded(expression) for name, expression in columns.items()})


def words(*values: str) -> str:
    return ", ".join(f"'{v}'" for v in values)


def yes(condition: str) -> str:
    """The condition, with null as false."""
    return f"coalesce({condition}, false)"


def among(column: str, *values: str) -> str:
    return yes(f"{column} IN ({words(*values)})")


def last_when(condition: str, value: str, order: str, frame: str = UP_TO) -> str:
    return f"last(CASE WHEN {condition} THEN {value} END, true) OVER ({order} {frame})"


def max_when(condition: str, value: str, order: str = READ, frame: str = UP_TO) -> str:
    return f"max(CASE WHEN {condition} THEN {value} END) OVER ({order} {frame})"


def level(opening: str, closing: str, inside: str = "true") -> str:
    """Constructs open at the token; the closing token counts as outside."""
    change = f"CASE WHEN {opening} AND {inside} THEN 1 WHEN {closing} AND {inside} THEN -1 ELSE 0 END"
    return f"CAST(sum({change}) OVER ({READ} {UP_TO}) AS INT)"


def either(*conditions: str) -> str:
    return "(" + " OR ".join(f"({c})" for c in conditions) + ")"


def both(*conditions: str) -> str:
    return "(" + " AND ".join(f"({c})" for c in conditions) + ")"


def quote(text: str) -> str:
    """A string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def say(template: str) -> str:
    """A text with expressions in braces, as in ``say("Empty method body -> {name}")``."""
    parts = []
    for fixed, expression, _, _ in Formatter().parse(template):
        if fixed:
            parts.append(quote(fixed))
        if expression:
            parts.append(f"CAST({expression} AS STRING)")
    return "concat(" + ", ".join(parts) + ")"


def contains_any(column: str, values: list[str]) -> str:
    return either(*[f"contains({column}, {quote(v)})" for v in values])
