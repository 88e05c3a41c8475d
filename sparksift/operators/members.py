"""Declared members (classes, methods, fields) with their measures, one row each.

A token counts for every method it lies in: a method inside an anonymous class
also belongs to the method around it. ``method_tokens`` expands a token once per
enclosing method, so the cost is the summed nesting depth and no range join is
needed. Header tokens get one extra row on level 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.lexicon import MODIFIERS
from ..functions.sql import UP_TO, add, add_coded, among, block_text, coded, either, last_when, words, yes
from .tokens import BODY_KINDS, CLASS_KINDS, IS_BRANCH, IS_TERNARY, since_decl

PLAIN_CLASSES = ["class", "interface"]
OPENS_BLOCK = "tok = '{'"


def _gap() -> str:
    """White space in front of a token that does not begin a line."""
    signs = ["(", "[", "{", ",", ";", "=", "+", "-", "*", "/", "<", ">", "?", ":", "->", "return", "&&", "||", "==", "!="]
    tight = either(
        among("p1", "(", "[", ".", "::", "!", "~", "@"),
        yes("p1 = '<' AND gd1 > 0"),
        among("p1", "+", "-", "++", "--") + " AND " + among("p2", *signs),
        f"tok IN ({words(';', ',', ')', ']', '.', '::', '[', '...')})",
        "tok = '(' AND " + either(yes("pk1 = 'i'"), among("p1", "this", "super", "switch"), yes("p1 = '>' AND gd2 > 0")),
        "g_open", "g_close",
        "tok IN ('++', '--') AND " + either(among("pk1", "i", "s", "n", "c"), among("p1", ")", "]")),
        "tok = ':' AND " + either(among("p1", "default"), among("p2", "case")),
    )
    return f"CASE WHEN {tight} THEN '' ELSE ' ' END"


# Tokens that begin a line in the printed layout.
BEGINS_LINE = either(
    "starts", "tok = 'case'", "tok = 'default' AND " + among("n1", ":", "->"),
    yes("p1 = ':' AND case_pos > coalesce(boundary_pos, -1)"),
    yes("p1 = ')' AND closed_bk = '(if' AND tok <> '{'"),
    yes("p1 = 'else' AND tok NOT IN ('{', 'if')"),
    "tok = '}' AND NOT " + among("inner_bk", "arr"),
    yes("tok = 'else' AND p1 = ';'"),
)


def printed_piece() -> str:
    """The token with the white space a pretty printer puts in front of it.

    Line counts, token counts and clone hashes are taken from code in one
    layout, so that the author's line breaks do not change them.
    """
    member = among("encl_bk", "anon", *CLASS_KINDS)
    gap = f"CASE WHEN {BEGINS_LINE} THEN CASE WHEN {member} THEN '\\n\\n' ELSE '\\n' END ELSE {_gap()} END"
    return f"concat({gap}, coalesce(concat(array_join(comments, '\\n'), '\\n'), ''), tok)"


# Lines of the comments in front of a token; a comment's own empty lines are none.
_COMMENT_LINES = r"size(filter(flatten(transform(comments, c -> split(c, '\n'))), x -> x RLIKE r'[^\x00-\x20]'))"


def printed_lines(tokens: DataFrame) -> DataFrame:
    """(path, code, comment): lines of each file in the printed layout, where every comment stands on lines of its own.

    A sum over tokens: no text is put together, and a long file's lines are added up from all its parts. Comments
    behind the last token belong to no token and are left out.
    """
    first = "p1 IS NULL"
    # a comment inside a statement goes on in the line begun, and what follows it begins a new one
    code = f"CASE WHEN {BEGINS_LINE} OR {first} OR size(comments) > 0 THEN 1 ELSE 0 END + CASE WHEN kind = 's' THEN length(tok) - length(replace(tok, '\n', '')) ELSE 0 END"
    comment = f"CASE WHEN size(comments) > 0 THEN {_COMMENT_LINES} - CASE WHEN {BEGINS_LINE} OR {first} THEN 0 ELSE 1 END ELSE 0 END"
    return tokens.filter("NOT ghost").groupBy("path").agg(F.expr(f"CAST(sum({coded(code)}) AS INT) AS code"), F.expr(f"CAST(sum({coded(comment)}) AS INT) AS comment"))


# What a token row knows about the method around it.
METHOD = {
    "member": "decl_pos", "line": "decl_line", "name": "mname", "open": "pos", "owner": "decl_owner",
    "owner_kind": "decl_owner_kind", "ent": "ent_level", "blk": "blk_level", "entc": "entc_level", "blkc": "blkc_level",
}
AT_CLASS = either("inner_bk IS NULL", among("inner_bk", *BODY_KINDS))
NOT_IN_INIT = "NOT " + yes("eq_pos > decl_pos")
# Tokens of a member's header: before "=", in the parameter list, and the opening brace.
IN_HEADER = either(
    f"{AT_CLASS} AND {NOT_IN_INIT} AND tok NOT IN ('}}', ';')",
    "tok = '{' AND " + among("inner_bk", "method", "ctor"),
    "tok = '(' AND " + among("inner_bk", "(par"),
    among("inner_bk", "(method"),
    yes("inner_bk = '[' AND ((tok = '[' AND n1 = ']') OR (tok = ']' AND p1 = '['))")
    + f" AND {NOT_IN_INIT} AND " + among("decl_owner_kind", "file", *BODY_KINDS),
)


def method_tokens(tokens: DataFrame, keep: str | None = None) -> DataFrame:
    """One row per token and enclosing method (``depth`` 1..n), plus header rows (``depth`` 0).

    With ``keep``, other tokens are dropped before they are expanded and sorted;
    braces that open blocks of methods always stay.
    """
    opens = f"{OPENS_BLOCK} AND " + among("inner_bk", "method")
    inside = f"({IN_HEADER} OR method_level > 0)"
    kept = inside if keep is None else f"{inside} AND {either(keep, opens, OPENS_BLOCK)}"
    depths = f"explode(sequence(CASE WHEN {IN_HEADER} THEN 0 ELSE 1 END, method_level))"
    rows = add_coded(tokens.filter(coded(f"NOT ghost AND {kept}")), depth=depths)
    order = "PARTITION BY path, part, depth ORDER BY pos"
    own = f"{opens} AND method_level = depth AND depth > 0"
    rows = add_coded(rows, **{f"m_{name}": last_when(own, source, order) for name, source in METHOD.items()})
    blocked = "tok = '{' AND NOT " + among("inner_bk", "method", "arr") + " AND NOT inner_entc AND blkc_level = m_blkc + 1"
    return add_coded(
        rows,
        in_header="depth = 0",
        member="CASE WHEN depth > 0 THEN m_member ELSE decl_pos END",
        stop_level=last_when(blocked, "entc_level", order),
    )


# Share of a token in the cognitive complexity of a method around it.
COGNITIVE = f"""CASE
    WHEN {IS_TERNARY} THEN CAST((CASE WHEN blkc_level = m_blkc THEN entc_level ELSE stop_level END - m_entc + 1)
        * (CASE WHEN blkc_level = m_blkc THEN entc_level ELSE stop_level END - m_entc + 2) / 2 AS INT)
    WHEN blkc_level <> m_blkc THEN 0
    WHEN starts AND tok IN ('if', 'for', 'while', 'do', 'switch') THEN 1 + entc_level - m_entc
    WHEN tok = '(' AND inner_bk = '(if' AND p2 = 'else' AND prior_if_direct THEN 1
    WHEN tok = '{{' AND inner_bk = 'else' AND inner_ent THEN 1
    WHEN tok = '{{' AND inner_bk = 'catch' AND inner_entc THEN entc_level - m_entc
    WHEN starts AND tok IN ('break', 'continue') AND nk1 = 'i' THEN 1
    WHEN tok IN ('&&', '||') AND if_paren_level > 0 THEN 1
    ELSE 0 END"""

# Depth reached at the brace of a block that is walked into, or at a switch, which is not.
NESTING = """CASE
    WHEN tok = '{' AND inner_ent AND blk_level = m_blk THEN ent_level - m_ent
    WHEN tok = '{' AND inner_bk = 'switch' AND sib_direct AND blk_level = m_blk + 1 THEN ent_level - m_ent + 1 END"""

# A parameter's type is the word before its name, unless qualified or an array.
PARAM = """named_struct('pos', pos, 'name', tok, 'line', line, 'type', CASE WHEN p1 = '...' THEN p2 ELSE p1 END,
    'simple', CASE WHEN p1 = '...' THEN p3 ELSE p2 END <> '.' AND n1 <> '[')"""


def declared_members(tokens: DataFrame, with_text: bool = True) -> DataFrame:
    """One row per member: identity, header, and for methods every measure the rules need.

    Without the printed text, only structural tokens are expanded.
    """
    structural = either(IN_HEADER, "starts", IS_BRANCH, "tok IN ('?', 'return')", yes("tok = '(' AND p2 = 'else'"))
    rows = method_tokens(tokens, None if with_text else structural)
    named = f"{since_decl('mname_pos')} AND pos >= mname_pos"
    at_class = either("inner_bk IS NULL", among("inner_bk", "[", *BODY_KINDS))
    header_word = f"in_header AND {at_class} AND tok NOT IN ('(', '{{') AND NOT ({named})"

    def first(condition: str, value: str) -> str:
        return f"max(CASE WHEN in_header AND {condition} THEN {value} END)"

    def count(condition: str) -> str:
        return f"count(CASE WHEN {condition} THEN 1 END)"

    def joined(condition: str, value: str, glue: str) -> str:
        rows_ = f"sort_array(collect_list(CASE WHEN {condition} THEN named_struct('pos', pos, 'v', {value}) END))"
        return f"array_join(transform({rows_}, x -> x.v), '{glue}')"

    measures = {
        "line": first("true", "decl_line"),
        "owner": first("true", "decl_owner"),
        "owner_kind": block_text(first("true", "c_decl_owner_kind")),
        "has_doc": "max(in_header AND decl_doc)",
        "class_kind": block_text(first("tok = '{' AND " + among("inner_bk", *CLASS_KINDS), "c_inner_bk")),
        "class_name": first("kind = 'i' AND " + among("p1", "class", "interface", "enum", "record"), "tok"),
        "method_name": first("is_mname", "tok"),
        "open_pos": first("tok = '{'", "pos"),
        "open_kind": block_text(first("tok = '{'", "c_inner_bk")),
        "is_field": "max(in_header AND is_first_var)",
        "header": joined(header_word, "tok", " "),
        # the same without type arguments, however deep
        "flat_header": joined(f"{header_word} AND gd = 0 AND NOT g_close", "tok", " "),
        "params": f"sort_array(collect_list(CASE WHEN in_header AND is_param THEN {PARAM} END))",
        "null_returns": "sort_array(collect_list(CASE WHEN NOT in_header AND tok = 'return' AND n1 = 'null' AND n2 = ';' "
        "THEN named_struct('pos', pos, 'line', line) END))",
        "n_params": count("in_header AND is_param"),
        "n_stmts": count("NOT in_header AND starts AND encl_pos = m_open"),
        "cc_no_ternary": "1 + " + count(f"NOT in_header AND {IS_BRANCH}"),
        "cc": "1 + " + count(f"NOT in_header AND ({IS_BRANCH} OR {IS_TERNARY})"),
        "cognitive": f"coalesce(sum(CASE WHEN NOT in_header THEN {COGNITIVE} END), 0)",
        "nesting": f"coalesce(max(CASE WHEN NOT in_header THEN {NESTING} END), 0)",
        "close_pos": "max(CASE WHEN NOT in_header THEN pos END)",
        "printed": f"ltrim({joined('NOT in_header', printed_piece(), '')})" if with_text else "''",
    }
    return rows.groupBy("path", "member").agg(*[F.expr(f"{coded(value)} AS {name}") for name, value in measures.items()])


def members(tokens: DataFrame, with_text: bool = True) -> DataFrame:
    """``declared_members`` with the lines, words and hash of the printed body in place of its text: narrow rows, worth storing."""
    found = declared_members(tokens, with_text)
    printed = F.col("printed")
    text = {"body_lines": tx.code_lines(printed), "body_words": tx.code_words(printed), "body_hash": tx.content_hash(printed)}
    if not with_text:
        text = {"body_lines": F.lit(1), "body_words": F.lit(0), "body_hash": F.lit(None).cast("string")}
    return found.withColumns(text).drop("printed")


def methods(tokens: DataFrame, with_text: bool = True) -> DataFrame:
    return methods_of(members(tokens, with_text))


def methods_of(declared: DataFrame) -> DataFrame:
    """Declared methods, without constructors and annotation members."""
    found = declared.filter("method_name IS NOT NULL AND owner_kind <> 'annotation'")
    no_annotations = r"regexp_replace(header, r'@ [^ ]+(?: \. [^ ]+)* ?', '')"
    modifiers = "|".join(MODIFIERS)
    no_modifiers = f"trim(regexp_replace({no_annotations}, r'(?:(?<=^| )(?:{modifiers}) ?)+', ''))"
    # type parameters are the brackets in front; a fold over the words counts how deep they go
    no_type_params = f"""aggregate(split({no_modifiers}, ' '), named_struct('depth', 0, 'ahead', true, 'text', ''), (s, w) -> CASE
        WHEN s.ahead AND (s.depth > 0 OR w = '<') THEN named_struct(
            'depth', s.depth + CASE w WHEN '<' THEN 1 WHEN '>' THEN -1 ELSE 0 END, 'ahead', s.depth > 1 OR w <> '>', 'text', s.text)
        ELSE named_struct('depth', 0, 'ahead', false, 'text', concat(s.text, ' ', w)) END, s -> trim(s.text))"""
    tidy = rf"trim(regexp_replace(regexp_replace({no_type_params}, r' ?([<>.\[\]]) ?', '$1'), ' ,', ','))"
    return add(
        found,
        name="method_name",
        has_body=yes("open_kind = 'method'"),
        return_type=tidy,
        visibility="""CASE WHEN array_contains(split(header, ' '), 'public') THEN 'public'
            WHEN array_contains(split(header, ' '), 'protected') THEN 'protected'
            WHEN array_contains(split(header, ' '), 'private') THEN 'private' ELSE '' END""",
        is_abstract="array_contains(split(header, ' '), 'abstract')",
    )


def _names_after(word: str) -> Column:
    """Simple names listed after ``extends`` or ``implements``, type arguments left out."""
    clause = F.regexp_extract("flat_header", rf"(?:^| ){word} (.*?)(?: implements .*| extends .*| permits .*)?$", 1)
    simple = F.transform(F.split(clause, " ?, ?"), lambda x: F.trim(F.regexp_replace(x, r"^.*\. ?", "")))
    return F.when(clause == "", F.array().cast("array<string>")).otherwise(simple)


def class_rollup(tokens: DataFrame) -> DataFrame:
    return classes_of(members(tokens, with_text=False))


def classes_of(declared: DataFrame) -> DataFrame:
    """Classes and interfaces with counts over their direct members, in one aggregation."""
    own = among("class_kind", *PLAIN_CLASSES)
    method = "method_name IS NOT NULL"
    accessor = f"{method} AND method_name RLIKE '^(?:get|set|is)' AND open_kind = 'method' AND n_stmts <= 1"
    count = lambda c: f"CAST(count(CASE WHEN NOT {own} AND {c} THEN 1 END) AS INT)"
    measures = {c: f"max(CASE WHEN {own} THEN {c} END)" for c in ("class_name", "class_kind", "line", "flat_header", "member")}
    # A nested class is a row of its own block only, not of the class around it.
    measures |= {
        "n_methods": count(method),
        "n_fields": count("is_field AND method_name IS NULL AND class_kind IS NULL"),
        "n_constructors": count("open_kind = 'ctor' AND method_name IS NULL AND class_kind IS NULL"),
        "n_accessors": count(accessor),
    }
    blocks = add(declared, block=f"CASE WHEN {own} THEN open_pos ELSE owner END")
    rolled = blocks.filter("block >= 0").groupBy("path", "block").agg(
        *[F.expr(f"{value} AS {name}") for name, value in measures.items()]
    )
    return rolled.filter("class_name IS NOT NULL").withColumns(
        {"extended": _names_after("extends"), "implemented": _names_after("implements")}
    )
