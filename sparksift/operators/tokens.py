"""Lexing job: source text to one row per token, with its place in the bracket structure.

The raw text is hash-partitioned by ``path`` once, before it is exploded.
Every window, aggregate and expansion further on is keyed by ``path`` plus
something, so none of them shuffles again; Spark only re-sorts inside a task.
All columns are lazy: a rule that needs three of them pays for those alone,
because unused window expressions are pruned from the plan.

Two window orders are used: reading order ``(path, part, pos)`` and, for bracket
matching, ``(path, part, lvl, pos)``. On one level an opener and its closer are
neighbours among the brackets, so "last opener so far" is the innermost open
bracket for an inside token and the matching one for a closer.

A file is part 0 of itself. ``long_files`` cuts longer ones between members; each
part then begins with "ghosts", the tokens of the class header around it, so that
the same windows give the same facts. Broken files are mended by ``mending``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import COMMENT, KEYWORDS, MODIFIERS, PRIMITIVES, TOKEN, TRIVIA
from ..functions.sql import (
    BLOCK_CODES, BLOCKS_AROUND, CODE_COLUMNS, CODED, CODES, EARLIER, KIND_CODES, LEVEL, READ, ROUND_KINDS, UP_TO, add, add_coded, among, block_text, both, coded,
    either, last_when, level, max_when, words, yes,
)

BOUNDARY = ["{", "}", ";"]
CLASS_KINDS = ["class", "interface", "enum", "record", "annotation"]
BODY_KINDS = CLASS_KINDS + ["anon", "other"]
# Blocks after whose "}" a new statement or member begins.
CLOSING_KINDS = CLASS_KINDS + [
    "method", "ctor", "init", "bare", "if", "else", "loop", "do", "try", "tryres",
    "catch", "finally", "sync", "switch", "case", "other",
]

OPENS = "tok IN ('(', '[', '{')"
CLOSES = "tok IN (')', ']', '}')"
BRACE_STEP = "CASE WHEN tok IN ('(', '[', '{') THEN 1 WHEN tok IN (')', ']', '}') THEN -1 ELSE 0 END"
IS_TERNARY = "(tok = '?' AND NOT " + among("p1", "<", ",") + ")"
# Tokens that add a path, other than "?"; the "while" that closes a do loop stands for the loop.
IS_BRANCH = (
    "(tok IN ('if', 'for', 'while', 'case', 'catch', '&&', '||') OR (tok = 'default' AND " + among("n1", ":", "->") + "))"
)
# Tokens that bind less than "+", so a sum ends there.
SUM_ENDS = either(
    OPENS, CLOSES,
    "tok IN (';', ':', '->', '==', '!=', '<=', '>=', '&&', '||', '&', '|', '^')",
    "tok IN ('=', '+=', '-=', '*=', '/=', '%=', '&=', '|=', '^=', '<<=')",
    "tok IN ('return', 'throw', 'case', 'else', 'do', 'assert', 'instanceof', 'default')",
    "tok = ',' AND gd = 0",
    IS_TERNARY,
    "tok IN ('<', '>') AND NOT g_open AND NOT g_close",
    "tok = 'yield' AND " + among("p1", *BOUNDARY),
)
# Binary "+" and "-".
SUM_ADDS = "(tok IN ('+', '-') AND (" + among("pk1", "i", "n", "s", "c") + " OR " + among(
    "p1", ")", "]", "}", "this", "null", "true", "false", "++", "--"
) + "))"


def since_decl(position: str) -> str:
    """Whether the position lies in the current member or statement."""
    return yes(f"{position} >= decl_pos")


def newlines(column: Column) -> Column:
    return F.when(column.contains("\n"), F.length(column) - F.length(F.replace(column, F.lit("\n"), F.lit("")))).otherwise(0)


# Spark's own limit on the buckets of a table.
MOST_PARTS = 100_000
# Bytes of text in a part at most, if the text divides: its tokens are sorted five times on their way, some 300 bytes for each byte of text, in the memory of one task.
PART_TEXT = 1 << 20


def text_parts(files: DataFrame) -> int:
    """Least number of parts to hash the text into: ``spark.sql.shuffle.partitions``, as far as a table may have buckets."""
    return min(MOST_PARTS, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def sized_parts(files: DataFrame) -> int:
    """Parts to hash the text into: as many as keep each to ``PART_TEXT`` bytes. Counts the bytes in a pass of its own."""
    size = files.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    return min(MOST_PARTS, max(text_parts(files), -(-size // PART_TEXT)))


def by_path(files: DataFrame, parts: int | None = None) -> DataFrame:
    """The text, hash-partitioned by path.

    The number of parts is given, so that adaptive execution does not merge
    them by their size as text.
    """
    return files.select("path", "content").repartition(parts or sized_parts(files), "path")


def unix_lines(column: Column) -> Column:
    return F.when(column.contains("\r"), F.regexp_replace(column, r"\r\n?", "\n")).otherwise(column)


def cut(texts: DataFrame, *keys: str) -> DataFrame:
    """``texts(*keys, content)`` to one row per token, numbered from 0 in ``pos``; ``comments`` are those in front of it."""
    raw = F.col("raw")
    pieces = texts.select(
        *keys, F.posexplode(F.regexp_extract_all(unix_lines(F.col("content")), F.lit(TOKEN), F.lit(0))).alias("pos", "raw")
    )
    stripped = F.ltrim(raw, F.lit(" \t\n\r\f\x0b"))
    commented = stripped.startswith("//") | stripped.startswith("/*")
    token = F.when(commented, F.regexp_replace("raw", "^" + TRIVIA, "")).otherwise(stripped)
    found = pieces.withColumn("tok", token).filter("length(tok) > 0")
    before = F.substring("raw", F.lit(1), F.length(raw) - F.length("tok"))
    maybe = (F.length(raw) - F.length("tok") >= 2) & (before.contains("//") | before.contains("/*"))
    measured = found.withColumns(
        {"raw_nl": newlines(raw), "comments": F.when(maybe, F.regexp_extract_all(before, F.lit(COMMENT), F.lit(0)))}
    )
    first = "substring(tok, 1, 1)"
    kind = f"""CASE WHEN {first} = '"' THEN 's' WHEN {first} = "'" THEN 'c'
        WHEN {first} BETWEEN '0' AND '9' OR ({first} = '.' AND substring(tok, 2, 1) BETWEEN '0' AND '9') THEN 'n'
        WHEN tok IN ({words(*KEYWORDS)}) THEN 'k'
        WHEN lower({first}) <> upper({first}) OR {first} IN ('_', '$') OR {first} RLIKE r'^\\p{{L}}' THEN 'i' ELSE 'o' END"""
    return measured.selectExpr(*keys, "pos", "tok", f"{kind} AS kind", "length(raw) AS raw_len", "raw_nl", "comments")


def lex(files: DataFrame, parts: int | None = None) -> DataFrame:
    """``files(path, content)`` to one row per token."""
    return add(cut(by_path(files, parts), "path"), part="0", ghost="false")


def _reading_columns(tokens: DataFrame) -> DataFrame:
    """Neighbours, line, offset and bracket level."""
    columns = {}
    for c in ("", "c_"):
        columns |= {f"{c}p{i}": f"lag({c}tok, {i}) OVER ({READ})" for i in (1, 2, 3)}
        columns |= {f"{c}n{i}": f"lead({c}tok, {i}) OVER ({READ})" for i in (1, 2, 3, 4)}
        columns |= {f"{c}pk{i}": f"lag({c}kind, {i}) OVER ({READ})" for i in (1, 2)}
        columns |= {f"{c}nk{i}": f"lead({c}kind, {i}) OVER ({READ})" for i in (1, 2, 3)}
    n_signs = sum(not w.isalpha() for w in CODED)
    signs, known = words(*CODED[:n_signs]), words(*CODED[n_signs:])
    contextual = words(*[w for w in CODED[n_signs:] if w not in KEYWORDS])
    kinds = " ".join(f"WHEN '{k}' THEN {n}" for k, n in KIND_CODES.items())
    out = add(
        tokens,
        # signs come first in the list, words behind them
        c_tok=f"""CAST(CASE WHEN kind = 'o' THEN array_position(array({signs}), tok)
            WHEN kind = 'k' OR tok IN ({contextual}) THEN {n_signs} + array_position(array({known}), tok) ELSE 0 END AS INT)""",
        c_kind=f"CASE kind {kinds} END",
    )
    out = add_coded(
        out,
        **columns,
        level_after=f"CAST(sum({BRACE_STEP}) OVER ({READ} {UP_TO}) AS INT)",
        nl_total=f"sum(raw_nl) OVER ({READ} {UP_TO})",
        boundary_pos=max_when(f"tok IN ({words(*BOUNDARY)})", "pos", READ, EARLIER),
    )
    own_lines = "CASE WHEN contains(tok, '\n') THEN length(tok) - length(replace(tok, '\n', '')) ELSE 0 END"
    return add_coded(
        out,
        line=f"CAST(nl_total - {own_lines} + 1 AS INT)",
        lvl=f"level_after + CASE WHEN {CLOSES} THEN 1 ELSE 0 END",
        # the texts that later stages compare with each other, where they do: a row that is sorted and copied a dozen times carries few of them
        after_word="CASE WHEN tok IN ('class', 'interface', 'enum', 'record') THEN n1 END",
        before_bracket="CASE WHEN tok = '{' OR (tok = '(' AND p2 = '{') THEN p1 END",
    )


# Over all tokens of a file, which is one part wherever this is asked: brackets left open, and the lowest level reached.
WHOLE = f"{READ} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
SURPLUS = f"sum({BRACE_STEP}) OVER ({WHOLE})"
LOWEST = f"min(level_after) OVER ({WHOLE})"
BROKEN = """CASE WHEN lowest < 0 THEN 'closing bracket without an opening one' WHEN surplus <> 0 THEN 'bracket left open' END"""


def _balanced_files(tokens: DataFrame) -> DataFrame:
    return tokens.filter("surplus = 0 AND lowest >= 0")


def _marked_files(tokens: DataFrame) -> DataFrame:
    """Of a file whose brackets don't balance one ghost row stays, with the reason in ``reject``."""
    marked = tokens.filter("(surplus = 0 AND lowest >= 0) OR pos = 0")
    named = add(marked.withColumnRenamed("ghost", "was_ghost"), reject=BROKEN)
    return add(named, ghost="was_ghost OR reject IS NOT NULL")


def _generic_columns(tokens: DataFrame) -> DataFrame:
    """``gd``: how many type-argument lists are open after the token; ``gd1`` the same before it.

    An opening "<" is told from a comparison by its neighbours. Closers need no
    such test: the running count, floored at zero, drops stray ">" signs. The sums for
    the check of the brackets are taken in the same windows.
    """
    pascal = r"p1 RLIKE r'^\p{Lu}(?:[\p{L}\p{Nd}_$]*\p{Ll}.*)?$'"
    opens = both(
        "tok = '<'",
        either(
            "p1 IS NULL",
            among("p1", ".", *BOUNDARY, *MODIFIERS),
            among("n1", ">", "?", "@", *PRIMITIVES),
            both(
                "pk1 = 'i' AND nk1 = 'i'",
                either(
                    among("n2", "extends", "super", "<"),
                    f"n2 = '>' AND (n3 <> '>' OR {pascal})",
                    f"n2 IN (',', '.', '[', '&') AND {pascal}",
                ),
            ),
        ),
    )
    out = add_coded(tokens, g_open=yes(opens))
    out = add_coded(out, g_step="CASE WHEN g_open THEN 1 WHEN tok = '>' THEN -1 ELSE 0 END")
    out = add_coded(out, walk=f"sum(g_step) OVER ({READ} {UP_TO})", surplus=SURPLUS, lowest=LOWEST)
    # the lowest count before the token; that after it follows from the token's own step
    out = add_coded(out, floor=f"least(0, min(walk) OVER ({READ} {EARLIER}))")
    out = add_coded(out, gd="walk - least(floor, walk)", gd1="walk - g_step - floor")
    return add_coded(out, g_close="(tok = '>' AND gd1 > 0)")


def _type_end(tok: str, kind: str, before: str, depth: str) -> str:
    """Whether a name may follow the token as the declared name of a type ending there."""
    return yes(
        either(
            both(f"{kind} = 'i'", "NOT " + among(tok, "record", "yield", "permits"), "NOT " + among(before, "@")),
            among(tok, *PRIMITIVES, "..."),
            f"{tok} = '>' AND {depth} > 0",
            f"{tok} = ']' AND {before} = '['",
        )
    )


def _head_columns(tokens: DataFrame) -> DataFrame:
    """``head``: the last earlier token that cannot be part of a type or a modifier."""
    type_part = yes(
        either(
            "kind = 'i'", "g_open", "g_close",
            f"tok IN ({words(*PRIMITIVES, *MODIFIERS, '.', ',', '@', '...')})",
            "gd > 0 AND tok IN ('extends', 'super', '?', '&')",
            "tok = '[' AND n1 = ']'",
            "tok = ']' AND p1 = '['",
        )
    )
    record = yes("tok = 'record' AND nk1 = 'i' AND n2 IN ('(', '<')")
    class_word = either("tok IN ('class', 'interface', 'enum') AND NOT " + among("p1", "."), record)
    of_words = " ".join(f"WHEN tok = '{word}' THEN {BLOCK_CODES[word]}" for word in ("class", "interface", "enum", "record"))
    case_word = either("tok = 'case'", "tok = 'default' AND n1 IN (':', '->')")
    out = add_coded(
        tokens,
        # that of the tokens before
        gd2=f"coalesce(lag(gd1, 1) OVER ({READ}), 0)",
        gd3=f"coalesce(lag(gd1, 2) OVER ({READ}), 0)",
        n_g_open=f"lead(g_open) OVER ({READ})",
        next_line=f"lead(line) OVER ({READ})",
        head=last_when(f"NOT {type_part}", "tok", READ, EARLIER),
        c_head=last_when(f"NOT {type_part}", "c_tok", READ, EARLIER),
        class_kw_pos=max_when(class_word, "pos", READ, EARLIER),
        c_class_kw_kind=last_when(class_word, f"CASE WHEN p1 = '@' THEN {BLOCK_CODES['annotation']} {of_words} END", READ, EARLIER),
        class_name=last_when(class_word, "after_word", READ, EARLIER),
        record_pos=max_when(record, "pos"),
        is_array="(tok = '{' AND " + yes(
            last_when("tok = '{' AND NOT " + among("p1", "{"), among("p1", "=", "]", ",", "(", "default"), READ)
        ) + ")",
        case_pos=max_when(case_word, "pos", READ, EARLIER),
        arrow_pos=max_when("tok = '->'", "pos", READ, "ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING"),
    )
    at_start = either("head IS NULL", among("head", *BOUNDARY, ")"))
    out = add_coded(out, p1_type_end=_type_end("p1", "pk1", "p2", "gd2"))
    out = add_coded(
        out,
        is_mname=yes(f"kind = 'i' AND n1 = '(' AND p1_type_end AND {at_start}"),
        # The same seen from the parenthesis; both have the same head.
        p1_mname=yes(f"tok = '(' AND pk1 = 'i' AND {_type_end('p2', 'pk2', 'p3', 'gd3')} AND {at_start}"),
    )
    return add_coded(out, mname=last_when("is_mname", "tok", READ), mname_pos=max_when("is_mname", "pos"))


def _chain_columns() -> dict[str, str]:
    """Where the operand chain and the sum around a token begin, on its own bracket level.

    ``operand_*``: first token of a call chain such as ``a.b(c).d``.
    ``sum_*``: the token just before a sum ``a + b - c``, and ``sum_op`` the last
    "+", "-" or ending token seen before this one on the level.
    """
    begins = yes(
        "(kind IN ('i', 's', 'n', 'c') OR tok IN ('this', 'super', 'new')) AND gd = 0 AND NOT " + among("p1", ".", "new", "::")
    )
    return {
        "operand_pos": max_when(begins, "pos", LEVEL),
        "operand_line": last_when(begins, "line", LEVEL),
        "sum_pos": max_when(SUM_ENDS, "pos", LEVEL, EARLIER),
        "sum_line": last_when(SUM_ENDS, "next_line", LEVEL, EARLIER),
        "sum_op": last_when(either(SUM_ENDS, SUM_ADDS), "tok", LEVEL, EARLIER),
    }


def _bracket_columns(tokens: DataFrame) -> DataFrame:
    """``inner_pos`` and ``inner_bk``: the innermost open bracket and what it belongs to, as a code.

    Kinds of parentheses begin with "(", so that "(if" is the condition and
    "if" the block of an if statement.
    """
    kind = BLOCK_CODES
    # a word before a parenthesis or block, by its code
    by_word = lambda column, mark, *given: f"CASE c_{column} " + " ".join(f"WHEN {CODES[w]} THEN {kind[mark + w]}" for w in given) + " END"
    headed = ("if", "for", "while", "switch", "catch", "synchronized", "try")
    out = add_coded(
        tokens,
        direct=either("p2 IS NULL", among("p2", *BOUNDARY)),
        c_paren=f"""CASE WHEN tok <> '(' THEN NULL
            WHEN p1 IN ({words(*headed)}) THEN {by_word('p1', '(', *headed)}
            WHEN p1_mname THEN {kind['(method']} WHEN head = 'new' THEN {kind['(new']} WHEN pk1 = 'i' AND p2 = '@' THEN {kind['(annot']} ELSE {kind['(par']} END""",
        names_class="before_bracket = class_name",
        class_here="CASE WHEN tok = '{' THEN class_name END",
    )
    out = add_coded(
        out,
        c_sib_paren=last_when("tok = '('", "c_paren", LEVEL),
        sib_direct=last_when("tok = '('", "direct", LEVEL),
        # the word before it, if that follows an opening brace
        sib_name=last_when("tok = '('", "coalesce(before_bracket, '')", LEVEL),
        c_sib_p2=last_when("tok = '('", "c_p2", LEVEL),
        sib_line=last_when("tok = '('", "line", LEVEL),
        sib_if_direct=last_when("tok = '(' AND p1 = 'if'", "direct", LEVEL),
        prior_if_direct=last_when("tok = '(' AND p1 = 'if'", "direct", LEVEL, EARLIER),
        sib_try_direct=last_when("tok IN ('(', '{') AND p1 = 'try'", "direct", LEVEL),
        c_sib_block_p1=last_when("tok = '{'", "c_p1", LEVEL, EARLIER),
        **_chain_columns(),
    )
    of_paren = {"for": "loop", "while": "loop", "try": "tryres", "synchronized": "sync", "new": "anon", "if": "if", "catch": "catch", "method": "method", "annot": "annot"}
    of_parens = " ".join(f"WHEN {kind['(' + paren]} THEN {kind[block]}" for paren, block in of_paren.items())
    block = f"""CASE WHEN is_array THEN {kind['arr']}
        WHEN class_kw_pos > coalesce(boundary_pos, -1) THEN c_class_kw_kind
        WHEN p1 = '->' THEN CASE WHEN case_pos > coalesce(boundary_pos, -1) AND (arrow_pos IS NULL OR arrow_pos < case_pos)
            THEN {kind['case']} ELSE {kind['lambda']} END
        WHEN p1 = ')' OR head = 'throws' THEN CASE c_sib_paren {of_parens}
            WHEN {kind['(par']} THEN CASE WHEN sib_p2 = ',' OR (sib_p2 = '{{' AND sib_name <> class_here) THEN {kind['anon']} ELSE {kind['ctor']} END
            WHEN {kind['(switch']} THEN CASE WHEN sib_direct OR sib_p2 IN (')', 'else', 'do', ':') THEN {kind['switch']} ELSE {kind['switchx']} END END
        WHEN p1 IN ('else', 'do', 'try', 'finally') THEN {by_word('p1', '', 'else', 'do', 'try', 'finally')}
        WHEN p1 = 'static' THEN {kind['init']}
        WHEN p1 IS NULL OR p1 IN ('{{', '}}', ';', ':') THEN {kind['bare']}
        WHEN class_kw_kind = 'record' AND names_class THEN {kind['ctor']}
        ELSE {kind['other']} END"""
    do_tail = "tok = '(' AND p1 = 'while' AND p2 = '}' AND sib_block_p1 = 'do'"
    out = add_coded(
        out,
        c_bk=f"CASE WHEN tok = '{{' THEN {block} WHEN {do_tail} THEN {kind['(dowhile']} WHEN tok = '(' THEN c_paren WHEN tok = '[' THEN {kind['[']} END",
    )
    entered = """coalesce(tok = '{' AND CASE WHEN bk IN ('if', 'loop', 'tryres') THEN sib_direct
        WHEN bk = 'else' THEN sib_if_direct WHEN bk IN ('do', 'try') THEN direct ELSE false END, false)"""
    caught = yes("tok = '{' AND bk = 'catch' AND sib_try_direct")
    return add_coded(
        out,
        inner_pos=max_when(OPENS, "pos", LEVEL),
        c_inner_bk=last_when(OPENS, "c_bk", LEVEL),
        inner_ent=last_when(OPENS, entered, LEVEL),
        inner_entc=last_when(OPENS, f"({entered} OR {caught})", LEVEL),
        inner_direct=last_when(OPENS, "direct", LEVEL),
    )


def _statement_columns(tokens: DataFrame) -> DataFrame:
    """Statement and member starts, and running levels of enclosing constructs."""
    opens, closes = "tok = '{'", "tok = '}'"
    round_ = ("tok = '('", "tok = ')'")
    counted = "NOT " + among("inner_bk", "method", "arr")
    loop_paren = among("inner_bk", "(for", "(while")

    def with_closer(*kinds: str) -> str:
        inside = among("inner_bk", *kinds)
        return f"{level(opens, closes, inside)} + CASE WHEN {closes} AND {inside} THEN 1 ELSE 0 END"

    out = add_coded(
        tokens,
        c_closed_bk=f"lag(c_inner_bk) OVER ({READ})",
        closed_pos=f"lag(inner_pos) OVER ({READ})",
        eq_pos=max_when("tok = '=' AND NOT " + among("inner_bk", "(annot"), "pos"),
        bare_loop_pos=max_when(f"tok = ')' AND {loop_paren} AND NOT {among('n1', '{', ';')}", "pos"),
        method_level=with_closer("method"),
        class_level=with_closer("class", "interface"),
        loop_level=f"{level(opens, closes, among('inner_bk', 'loop'))} + {level(*round_, loop_paren)}",
        try_level=level(opens, closes, among("inner_bk", "try")),
        ent_level=level(opens, closes, f"inner_ent AND {counted}"),
        blk_level=level(opens, closes, f"NOT inner_ent AND {counted}"),
        entc_level=level(opens, closes, f"inner_entc AND {counted}"),
        blkc_level=level(opens, closes, f"NOT inner_entc AND {counted}"),
        if_paren_level=level(*round_, "inner_bk = '(if' AND inner_direct"),
        **{f"{m}_pos": max_when(f"tok = '{m}'", "pos") for m in ("private", "static", "final")},
    )
    starts = both(
        either(
            "p1 IS NULL",
            "p1 = '{' AND closed_bk <> 'arr'",
            f"p1 = ';' AND (closed_bk IS NULL OR closed_bk NOT IN ({words(*ROUND_KINDS, 'arr')}))",
            f"p1 = '}}' AND closed_bk IN ({words(*CLOSING_KINDS)})",
        ),
        "tok NOT IN ('}', 'else', 'catch', 'finally')",
        "NOT " + yes("tok = 'while' AND closed_bk = 'do'"),
    )
    out = add_coded(
        out,
        starts=yes(starts),
        encl_pos=f"CASE WHEN p1 IN ('{{', ';') THEN closed_pos WHEN NOT {OPENS} THEN inner_pos END",
        c_encl_bk=f"CASE WHEN p1 IN ('{{', ';') THEN c_closed_bk WHEN NOT {OPENS} THEN c_inner_bk END",
    )
    documented = yes(r"try_element_at(comments, -1) RLIKE r'^/\*\*[^/]'")
    return add_coded(
        out,
        decl_pos=max_when("starts", "pos"),
        decl_line=last_when("starts", "line", READ),
        # Owner -1: no block around the member.
        decl_owner=last_when("starts", "coalesce(encl_pos, -1)", READ),
        c_decl_owner_kind=last_when("starts", f"coalesce(c_encl_bk, {BLOCK_CODES['file']})", READ),
        decl_doc=last_when("starts", documented, READ),
    )


def _roles(tokens: DataFrame) -> DataFrame:
    """What an identifier is used as; at most one of the flags is true."""
    in_class = either("inner_bk IS NULL", among("inner_bk", *BODY_KINDS))
    in_init = yes("eq_pos > decl_pos")
    plain_block = yes(f"inner_bk NOT IN ({words(*ROUND_KINDS, 'arr')})")
    place = either(plain_block, among("inner_bk", "(for", "(try"))
    first_var = both(
        "kind = 'i' AND p1_type_end AND gd = 0 AND p1 <> '...'",
        "n1 IN ('=', ';', ',', '[') OR (n1 = ':' AND inner_bk = '(for')",
        place,
        either("head IS NULL", among("head", *BOUNDARY, "(", ")", ":")),
    )
    out = add_coded(tokens, is_first_var=yes(first_var))
    out = add_coded(out, first_var_pos=max_when("is_first_var", "pos", READ, EARLIER))
    more_vars = f"kind = 'i' AND p1 = ',' AND n1 IN ('=', ',', ';', '[') AND gd = 0 AND first_var_pos >= decl_pos AND {place}"
    param = "kind = 'i' AND inner_bk = '(method' AND gd = 0 AND p1_type_end AND n1 IN (',', ')', '[')"
    out = add_coded(out, is_var=f"(is_first_var OR {yes(more_vars)})", is_param=yes(param))

    after_new = yes("head = 'new'")
    bare_class_level = f"({in_class} AND NOT {in_init})"
    called = f"kind = 'i' AND n1 = '(' AND NOT is_mname AND NOT {after_new}"
    created = yes(f"kind = 'i' AND n1 IN ('(', '<', '[') AND {after_new} AND p1 IN ('.', 'new')")
    cast = yes(
        "p1 = '(' AND n1 = ')' AND inner_bk = '(par' AND "
        "(nk2 IN ('i', 's', 'n', 'c') OR n2 IN ('(', 'this', 'new', 'super', '!', '~', 'switch'))"
    )
    headed = ["extends", "implements", "throws", "permits", "instanceof"]
    out = add_coded(
        out,
        is_call=yes(f"{called} AND NOT {among('p1', '@', 'record', 'case', 'instanceof')} AND (p1 = '.' OR NOT {bare_class_level})"),
        is_scoped_call=yes(f"{called} AND p1 = '.'"),
        is_new=created,
        type_place=yes(
            either(
                f"nk1 = 'i' AND NOT {among('p1', '@')}",
                "gd > 0", "n1 = '<' AND n_g_open", "n1 = '[' AND n2 = ']'", among("n1", "...", "::"),
                among("p1", *headed), among("head", *headed, "class", "interface"), among("inner_bk", "(catch"),
                cast, created, f"{after_new} AND n1 <> '('",
                "n1 = '.' AND (n2 = 'class' OR (nk2 = 'i' AND nk3 = 'i'))", r"n1 = '.' AND n3 = '<' AND n2 RLIKE r'^\p{Lu}'",
            )
        ),
        free="kind = 'i' AND NOT " + either(
            "p1_type_end", "is_var", "is_mname", among("p1", "class", "interface", "enum", "record", "@", "break", "continue"),
            yes("starts AND (n1 = ':' OR tok = 'yield')"), among("head", "import", "package"), yes("record_pos = pos"),
            yes("inner_bk = '(annot' AND n1 = '='"),
            yes("n1 = '->' OR (p1 = '(' AND n1 = ')' AND n2 = '->')"),
        ),
    )
    dotted = among("p1", ".")
    return add_coded(
        out,
        is_type_use=f"(free AND type_place AND (NOT {dotted} OR gd > 0 OR is_new OR {among('nk1', 'i')}))",
        is_name_use=f"(free AND NOT type_place AND NOT {dotted} AND NOT {among('n1', '(')} AND NOT {bare_class_level})",
    )


# The columns that rules read; everything else is scaffolding.
FACTS = """path part ghost pos tok kind raw_len comments p1 p2 p3 n1 n2 n3 n4 pk1 nk1 nk2 boundary_pos line lvl gd gd1 gd2 g_open g_close
    head class_name mname mname_pos is_mname case_pos sib_direct sib_line prior_if_direct operand_pos operand_line sum_pos
    sum_line sum_op inner_pos inner_bk inner_ent inner_entc closed_bk eq_pos bare_loop_pos method_level class_level loop_level try_level
    ent_level blk_level entc_level blkc_level if_paren_level private_pos static_pos final_pos starts encl_pos encl_bk decl_pos decl_line
    decl_owner decl_owner_kind decl_doc is_first_var is_var is_param is_call is_scoped_call is_new is_type_use is_name_use""".split() + CODE_COLUMNS


STAGES = [_head_columns, _bracket_columns, _statement_columns, _roles]


def facts_of(lexed: DataFrame, *checks: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The facts of lexed files, of those that pass the checks."""
    facts = reduce(lambda df, stage: stage(df), [_reading_columns, _generic_columns, *checks, *STAGES], lexed)
    return add(facts, **{name: block_text(f"c_{name}") for name in BLOCKS_AROUND})


def tokens(files: DataFrame, parts: int | None = None) -> DataFrame:
    """The token facts every rule reads; files with unbalanced brackets are left to ``rejects`` and ``mending``."""
    return facts_of(lex(files, parts), _balanced_files).select(*FACTS)


def marked_tokens(files: DataFrame, parts: int | None = None) -> DataFrame:
    """The same facts, and one ghost row with its reason for each file with unbalanced brackets."""
    return facts_of(lex(files, parts), _marked_files).select(*FACTS, "reject")


def rejects(files: DataFrame) -> DataFrame:
    """Files whose brackets do not balance, with the reason."""
    level_now = add(lex(files), level_after=f"sum({BRACE_STEP}) OVER ({READ} {UP_TO})")
    per_file = level_now.groupBy("path").agg(F.expr(f"sum({BRACE_STEP}) AS surplus"), F.min("level_after").alias("lowest"))
    return per_file.selectExpr("path", f"{BROKEN} AS reason").filter("reason IS NOT NULL")
