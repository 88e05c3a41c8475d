"""Text measures: line profile, normalised form, clone hash, token count, escaping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Every character up to U+0020.
CONTROL = "".join(map(chr, range(33)))
WORD_MARKS = " \t\n\x0b\f\r;{}()[],."


def trim_control(column: Column) -> Column:
    """Strip every character up to U+0020 from both ends, not only blanks."""
    return F.trim(column, F.lit(CONTROL))


def split_count(column: Column, delimiter: str, marks: str) -> Column:
    """Number of pieces between delimiters, pieces after the last text not counted.

    ``marks`` are the characters that delimiters are made of.
    """
    body = F.rtrim(column, F.lit(marks))
    return F.when(column == "", 1).when(body == "", 0).otherwise(F.size(F.split(body, delimiter)))


def line_profile(content: Column, line_mark: str = "//", block_open: str = "/*", block_close: str = "*/") -> Column:
    """Struct of total, code, comment and blank lines.

    A fold over the lines of one text: the state is four counters and a flag,
    so nothing is exploded and nothing is shuffled.
    """
    text = F.when(content.contains("\r"), F.regexp_replace(content, r"\r\n?", "\n")).otherwise(content)
    body = F.rtrim(text, F.lit("\n"))
    nothing = F.array().cast("array<string>")
    lines = F.when((body == "") & (text != ""), nothing).otherwise(F.split(body, "\n"))
    zero = F.struct(
        F.lit(0).alias("code"), F.lit(0).alias("comment"), F.lit(0).alias("blank"), F.lit(False).alias("open")
    )

    def step(state: Column, line: Column) -> Column:
        closes = line.contains(block_close)
        blank = line == ""
        opens = ~state["open"] & line.startswith(block_open)
        comment = ~blank & (state["open"] | opens | line.startswith(line_mark))
        one = lambda c: F.when(c, 1).otherwise(0)
        still_open = F.when(blank, state["open"]).when(state["open"] | opens, ~closes).otherwise(F.lit(False))
        return F.struct(
            (state["code"] + one(~blank & ~comment)).alias("code"),
            (state["comment"] + one(comment)).alias("comment"),
            (state["blank"] + one(blank)).alias("blank"),
            still_open.alias("open"),
        )

    def finish(state: Column) -> Column:
        return F.struct(
            (state["code"] + state["comment"] + state["blank"]).alias("total"), state["code"].alias("code"),
            state["comment"].alias("comment"), state["blank"].alias("blank"),
        )

    return F.aggregate(F.transform(lines, trim_control), zero, step, finish)


def comment_ratio(profile: Column) -> Column:
    code = profile["code"]
    return F.when(code > 0, profile["comment"].cast("double") / code).otherwise(F.lit(0.0))


def normalise_code(column: Column) -> Column:
    """Each comment and each run of white space becomes one blank; then trimmed."""
    # a single blank stays as it is, so it is not matched at all
    return trim_control(F.regexp_replace(column, r"//[^\n]*|/\*[^*]*+\*++(?:[^/*][^*]*+\*++)*+/| \s+|[^\S ]\s*", " "))


def content_hash(column: Column) -> Column:
    """SHA-256 of the normalised text; null for a text that is null."""
    return F.sha2(normalise_code(column), 256)


def code_words(column: Column) -> Column:
    return split_count(column, r"\s+|[;{}()\[\],.]", WORD_MARKS)


def code_lines(column: Column) -> Column:
    return split_count(column, r"\n", "\n")


# The coefficients of the index, the marks that words are split at, the limits of the grades.
def maintainability(words: Column, complexity: Column, lines: Column) -> Column:
    """Maintainability index on a scale of 0 to 100, from a simplified Halstead volume."""
    volume = F.when(words > 0, words * F.log(words.cast("double")) / F.log(F.lit(2.0))).otherwise(F.lit(1.0))
    volume = F.greatest(volume, F.lit(1.0))
    raw = 171.0 - 5.2 * F.log(volume) - 0.23 * complexity - 16.2 * F.log(F.greatest(lines, F.lit(1)).cast("double"))
    return F.greatest(F.lit(0.0), F.least(F.lit(171.0), raw)) / 171.0 * 100.0


def maintainability_grade(index: Column, grade_a: int = 85, grade_b: int = 65) -> Column:
    return F.when(index >= grade_a, "A").when(index >= grade_b, "B").otherwise("C")


def truncate_text(column: Column, size: int) -> Column:
    return F.when(F.length(column) > size, F.concat(F.substring(column, 1, size), F.lit("..."))).otherwise(column)


def escape_html(column: Column) -> Column:
    # The four entities, the ampersand first.
    out = F.coalesce(column, F.lit(""))
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return out


def null_to_dash(column: Column) -> Column:
    return F.coalesce(column, F.lit("-"))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)
