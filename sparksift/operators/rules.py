"""The rules, grouped by grain: one pass over the rows of a grain yields all its findings.

Every function takes the token facts, or the members made from them, the settings and an optional set of rule
ids. Only the wanted rules enter the plan, so a single rule reads and computes
no more than its own columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import (
    CLOSEABLE_TYPES, IP_PATTERN, LDAP_WORDS, PATH_MARKS, RAW_TYPES, SENSITIVE_TERMS, SHORT_NAMES, SQL_WORDS,
    TEST_ANNOTATIONS, VAGUE_NAMES, WEAK_HASHES, advice,
)
from ..config import AuditConfig
from ..functions import text as tx
from ..functions.sql import (
    EARLIER, LEVEL, READ, UP_TO, add, among, both, contains_any, either, last_when, max_when, quote, say, words, yes,
)
from .findings import emit, findings_union, hit
from .members import classes_of, method_tokens, methods_of, printed_lines
from .tokens import BODY_KINDS, SUM_ADDS, SUM_ENDS, since_decl

Only = set[str] | None


def wanted(only: Only, hits: dict[str, str | list[str]]) -> list[str]:
    out: list[str] = []
    for rule_id, found in hits.items():
        if only is None or rule_id in only:
            out.extend(found if isinstance(found, list) else [found])
    return out


def is_camel(name: str) -> str:
    return rf"({name} RLIKE r'^\p{{javaLowerCase}}' AND NOT contains({name}, '_'))"


def is_pascal(name: str) -> str:
    return rf"({name} RLIKE r'^\p{{javaUpperCase}}' AND NOT contains({name}, '_') AND {name} <> upper({name}))"


# Classes -----------------------------------------------------------------


def class_rules(members: DataFrame, cfg: AuditConfig, only: Only = None) -> DataFrame:
    many_methods, many_fields = f"n_methods > {cfg.max_class_methods}", f"n_fields > {cfg.max_class_fields}"
    is_error = "exists(extended, p -> endswith(p, 'Exception') OR p = 'Error')"
    at = ("line", "block")
    hits = {
        "SMELL-001": hit(
            "SMELL-001", many_methods, "MAJOR", "Large class detected -> {class_name} ({n_methods} methods)", *at,
            suggestion=advice("SMELL-001", str(cfg.max_class_methods)),
        ),
        "SMELL-006": hit("SMELL-006", many_fields, "MAJOR", "Too many fields in class -> {class_name} ({n_fields} fields)", *at),
        "SMELL-007": hit(
            "SMELL-007", both(many_methods, many_fields), "CRITICAL",
            "God Class detected -> {class_name} ({n_methods} methods, {n_fields} fields)", *at,
        ),
        "SMELL-008": hit(
            "SMELL-008", "n_methods >= 4 AND n_accessors = n_methods", "MINOR",
            "Data Class detected -> {class_name} (only getters/setters)", *at,
        ),
        "NAME-001": hit(
            "NAME-001", "NOT " + is_pascal("class_name"), "MINOR",
            "Class name '{class_name}' does not follow PascalCase convention", *at,
        ),
        "NAME-008": hit(
            "NAME-008", f"{is_error} AND NOT (endswith(class_name, 'Exception') OR endswith(class_name, 'Error'))", "MINOR",
            "Exception class '{class_name}' does not end with 'Exception'", *at, suggestion=advice("NAME-008", "class_name"),
        ),
    }
    return emit(cfg.limited(classes_of(members)), wanted(only, hits))


# Methods -----------------------------------------------------------------


def with_maintainability(found: DataFrame) -> DataFrame:
    """Methods with the index of their body."""
    return found.withColumn("mi", tx.maintainability(F.col("body_words"), F.col("cc_no_ternary"), F.col("body_lines")))


def by_band(value: str, bands: list[tuple[int | str, str]]) -> str:
    """The text of the first band whose bound the value passes."""
    return "CASE " + " ".join(f"WHEN {value} > {bound} THEN {text}" for bound, text in bands) + " END"


def method_rules(members: DataFrame, cfg: AuditConfig, only: Only = None) -> DataFrame:
    at = ("line", "node")
    minor, major, critical = cfg.complexity_minor, cfg.complexity_major, cfg.complexity_critical
    limit = cfg.cognitive_threshold
    grade = f"CASE WHEN mi >= {cfg.maintainability_grade_a} THEN 'A' WHEN mi >= {cfg.maintainability_grade_b} THEN 'B' ELSE 'C' END"
    tests = "|".join(TEST_ANNOTATIONS)
    cc_advice = by_band(
        "cc",
        [
            (critical, say(f"Refactor this method into smaller, focused sub-methods. Complexity: {{cc}} (threshold: {{{critical}}})")),
            (major, say(f"Consider breaking this method into smaller methods. Complexity: {{cc}} (threshold: {{{major}}})")),
            (minor, say(f"Method is becoming complex. Complexity: {{cc}} (threshold: {{{minor}}})")),
        ],
    )
    hits = {
        "SMELL-002": hit(
            "SMELL-002", f"n_params > {cfg.max_parameters}", "MINOR", "Too many parameters in method -> {name} ({n_params} params)", *at,
            suggestion=advice("SMELL-002", str(cfg.max_parameters)),
        ),
        "SMELL-010": hit("SMELL-010", "flag IS NOT NULL", "MINOR", "Boolean parameter '{flag.name}' in method -> {name}", *at),
        "SMELL-003": hit(
            "SMELL-003", f"has_body AND body_lines > {cfg.max_method_lines}", "MAJOR",
            "Long method detected -> {name} ({body_lines} lines)", *at, suggestion=advice("SMELL-003", str(cfg.max_method_lines)),
        ),
        "SMELL-017": hit(
            "SMELL-017", "has_body AND n_stmts = 0 AND NOT is_abstract", "MINOR", "Empty method body -> {name}", *at
        ),
        "SMELL-005": hit(
            "SMELL-005", f"has_body AND nesting > {cfg.max_nesting_depth}", "MAJOR",
            "Deeply nested code in method -> {name} (depth: {nesting})", *at,
            suggestion=advice("SMELL-005", str(cfg.max_nesting_depth)),
        ),
        "NAME-002": hit(
            "NAME-002", "NOT " + is_camel("name"), "MINOR", "Method name '{name}' does not follow camelCase convention", *at
        ),
        "NAME-009": hit(
            "NAME-009",
            rf"header RLIKE r'@ (?:{tests})(?: (?!\.)|$)' AND NOT name RLIKE '^(?:test|should|given|when)|_should|_when'", "MINOR",
            "Test method '{name}' does not follow a descriptive naming convention", *at,
        ),
        # Several such parameters share the method's line, so only the first can be kept.
        "NAME-004": hit(
            "NAME-004", "odd_param IS NOT NULL", "MINOR", "Parameter '{odd_param.name}' in method '{name}' does not follow camelCase", *at
        ),
        "MET-001": hit(
            "MET-001", f"cc > {minor}", by_band("cc", [(critical, "'CRITICAL'"), (major, "'MAJOR'"), (minor, "'MINOR'")]),
            "{cc_word} cyclomatic complexity ({cc}) in method -> {name}", *at, suggestion=cc_advice,
        ),
        "MET-002": hit(
            "MET-002", f"has_body AND cognitive > {limit}",
            by_band("cognitive", [(f"{limit} * 3", "'CRITICAL'"), (f"{limit} * 2", "'MAJOR'"), (limit, "'MINOR'")]),
            "High cognitive complexity ({cognitive}) in method -> {name}", *at, suggestion=advice("MET-002", str(limit)),
        ),
        "MET-005": hit(
            "MET-005", "has_body AND grade <> 'A'", "CASE WHEN grade = 'B' THEN 'MINOR' ELSE 'MAJOR' END",
            "Low Maintainability Index (MI={mi_shown}, Grade={grade}) in method -> {name}", *at,
        ),
        "DOC-001": hit(
            "DOC-001", "visibility = 'public' AND NOT has_doc", "MINOR", "Missing Javadoc on public method -> {name}", *at
        ),
    }
    found = add(
        cfg.limited(with_maintainability(methods_of(members))),
        node="coalesce(close_pos, open_pos, member)",
        flag="get(filter(params, p -> p.simple AND p.type IN ('boolean', 'Boolean')), 0)",
        odd_param=f"get(filter(params, p -> length(p.name) > 1 AND NOT {is_camel('p.name')}), 0)",
        cc_word=by_band("cc", [(critical, "'Very high'"), (major, "'High'"), (minor, "'Moderate'")]),
        grade=grade,
        mi_shown="format_string('%.1f', mi)",
    )
    many = []
    if only is None or "SMELL-016" in only:
        typed = "has_body AND return_type NOT IN ('void', 'Void')"
        message = "Returning null from method -> '{name}' (return type: {return_type})"
        null = hit("SMELL-016", typed, "MAJOR", message, "r.line", "node", "r.pos", advice("SMELL-016", "return_type"))
        many.append(f"array_compact(transform(null_returns, r -> {null}))")
    return emit(found, wanted(only, hits), many)


# Tokens inside methods ---------------------------------------------------


def innermost(tokens: DataFrame, keep: str) -> DataFrame:
    """Wanted tokens of method bodies with the method right around them."""
    return method_tokens(tokens, keep).filter(f"depth > 0 AND depth = method_level AND ({keep})")


# The text between the quotes, or the token itself.
LITERAL = """CASE WHEN startswith(tok, '\"\"\"') THEN substring(tok, 4, length(tok) - 6)
    WHEN kind IN ('s', 'c') THEN substring(tok, 2, length(tok) - 2) ELSE tok END"""

# A number other than 0, 1 and -1; infinity and not-a-number count in one spelling only.
IS_MAGIC = r"""CASE WHEN literal RLIKE r'(?i)^\s*[+-]?(?:nan|inf|infinity)\s*$' THEN literal RLIKE r'^\s*[+-]?(?:NaN|Infinity)\s*$'
    ELSE try_cast(literal AS DOUBLE) NOT IN (0.0D, 1.0D, -1.0D) END"""


def body_rules(tokens: DataFrame, cfg: AuditConfig, only: Only = None) -> DataFrame:
    in_loop = either("loop_level > 0", since_decl("bare_loop_pos"))
    ends = among("n2", "+", "-", ";", ")", ",", "]", "}", ":", "?", "==", "!=", "&&", "||")
    left = "pk1 = 's' AND sum_pos = pos - 2 AND NOT startswith(p1, '\"\"\"')"
    right = f"nk1 = 's' AND {ends} AND NOT startswith(n1, '\"\"\"')"
    joins = both("tok = '+'", SUM_ADDS, either(yes(left), yes(right)))
    hits = {
        "SMELL-011": hit(
            "SMELL-011", f"kind IN ('n', 's', 'c') AND {IS_MAGIC}", "MINOR", "Magic number '{literal}' in method -> {m_name}", "line", "pos"
        ),
        "SMELL-013": [
            hit(
                "SMELL-013", f"tok = '+=' AND {in_loop}", "MAJOR",
                "String concatenation with '+=' inside a loop in method -> {m_name}", "coalesce(operand_line, line)", "0", "0",
            ),
            hit(
                "SMELL-013", f"{joins} AND {in_loop}", "MINOR",
                "String literal concatenation with '+' inside a loop in method -> {m_name}", "coalesce(sum_line, line)", "0", "1",
                quote("Use StringBuilder.append() inside loops instead of String + literal."),
            ),
        ],
    }
    keep = []
    if only is None or "SMELL-011" in only:
        keep.append("kind IN ('n', 's', 'c')")
    if only is None or "SMELL-013" in only:
        keep.append("tok IN ('+', '+=')")
    return emit(add(innermost(tokens, either(*keep)), literal=LITERAL), wanted(only, hits))


def exit_rules(tokens: DataFrame, cfg: AuditConfig, only: Only = None) -> DataFrame:
    """Statements that follow a return or throw in the same block."""
    in_block = f"starts AND encl_pos IS NOT NULL AND encl_bk NOT IN ({words('switch', 'switchx', *BODY_KINDS)})"
    after = "lead(line) OVER (PARTITION BY path, encl_pos ORDER BY pos)"
    rows = add(innermost(tokens, in_block), after=after).filter("tok IN ('return', 'throw') AND after IS NOT NULL")
    step = "CASE WHEN tok = 'return' THEN 0 ELSE 1 END"
    message = "Unreachable statement after '{tok}' in method -> {m_name}"
    return emit(rows, [hit("DEAD-001", "true", "MAJOR", message, "after", "m_open", step)])


# Blocks ------------------------------------------------------------------


def block_rules(tokens: DataFrame, cfg: AuditConfig, only: Only = None) -> DataFrame:
    parts = []
    catch_hits = wanted(
        only,
        {
            "SMELL-004": hit("SMELL-004", "tok = '{' AND n1 = '}'", "MAJOR", "Empty catch block detected", "sib_line", "pos"),
            "SMELL-012": hit(
                "SMELL-012", "tok = '(' AND caught IN ('Exception', 'Throwable') AND caught_end = ')'", "MINOR",
                "Catching generic {caught} is too broad", "line", "pos",
            ),
        },
    )
    if catch_hits:
        opens = "NOT ghost AND ((inner_bk = 'catch' AND tok = '{') OR (inner_bk = '(catch' AND tok = '('))"
        rows = add(
            tokens.filter(opens),
            caught="CASE WHEN n1 = 'final' THEN n2 ELSE n1 END",
            caught_end="CASE WHEN n1 = 'final' THEN n4 ELSE n3 END",
        )
        parts.append(emit(rows, catch_hits))
    switch_hits = wanted(
        only,
        {"SMELL-014": hit("SMELL-014", "NOT has_default", "MINOR", "switch statement missing 'default' case", "at_line", "block")},
    )
    if switch_hits:
        default = yes("tok = 'default' AND n1 IN (':', '->') AND p1 <> ','")
        rows = tokens.filter(f"NOT ghost AND inner_bk = 'switch' AND (tok = '{{' OR {default})").groupBy("path", F.expr("inner_pos AS block")).agg(
            F.expr(f"max({default}) AS has_default"), F.expr("max(CASE WHEN tok = '{' THEN sib_line END) AS at_line")
        )
        parts.append(emit(rows, switch_hits))
    return findings_union(parts)


# Variables and fields ----------------------------------------------------


def variable_rules(tokens: DataFrame, cfg: AuditConfig, only: Only = None) -> DataFrame:
    is_field = among("inner_bk", *BODY_KINDS)
    constant = both(is_field, since_decl("static_pos"), since_decl("final_pos"))
    variable = both(either(is_field, "method_level > 0"), f"NOT {constant}")
    literal = "n1 = '=' AND nk2 = 's' AND NOT startswith(n2, '\"\"\"') AND n3 IN (';', ',', ')')"
    at = ("line", "pos")
    hits = {
        "SMELL-015": hit(
            "SMELL-015", f"{is_field} AND is_first_var AND p1 IN ({words(*RAW_TYPES)}) AND n1 <> '['", "MAJOR",
            "Raw type usage -> '{p1}' used without type parameter in field '{tok}'", "decl_line", "pos",
        ),
        "SEC-001": hit(
            "SEC-001", f"{literal} AND {contains_any('lower(tok)', SENSITIVE_TERMS)}", "CRITICAL",
            "Hardcoded sensitive value -> {tok}", *at,
        ),
        "NAME-003": hit(
            "NAME-003", f"{variable} AND length(tok) > 1 AND NOT {is_camel('tok')}", "MINOR",
            "Variable '{tok}' does not follow camelCase convention", *at,
        ),
        "NAME-005": hit(
            "NAME-005", f"{constant} AND NOT tok RLIKE '^[A-Z][A-Z0-9_]*$'", "MINOR",
            "Constant '{tok}' does not follow UPPER_SNAKE_CASE convention", *at,
        ),
        "NAME-006": hit(
            "NAME-006", f"{variable} AND length(tok) = 1 AND tok NOT IN ({words(*SHORT_NAMES)})", "MINOR",
            "Single-letter variable name '{tok}' is not descriptive", *at,
        ),
        "NAME-007": hit(
            "NAME-007", f"{variable} AND lower(tok) IN ({words(*VAGUE_NAMES)})", "MINOR", "Non-descriptive variable name '{tok}'", *at
        ),
    }
    return emit(tokens.filter("is_var AND NOT ghost"), wanted(only, hits))


# Calls, creations, literals ----------------------------------------------


def expression_rules(tokens: DataFrame, cfg: AuditConfig, only: Only = None) -> DataFrame:
    def scoped(name: str, scope: str) -> str:
        return f"tok = '{name}' AND is_scoped_call AND p2 = '{scope}' AND NOT {among('p3', '.')}"

    def made(*types: str) -> str:
        return f"is_new AND p1 = 'new' AND n1 = '(' AND tok IN ({words(*types)})"

    begin = "coalesce(operand_line, line)"
    string = "kind = 's' AND NOT startswith(tok, '\"\"\"')"
    here, at_begin = ("line", "pos"), (begin, "pos")
    hits = {
        "SEC-003": hit("SEC-003", scoped("exit", "System"), "MAJOR", "System.exit() usage detected", *at_begin),
        "SEC-004": hit("SEC-004", made("Random"), "MAJOR", "Insecure random number generator -> java.util.Random", *here),
        "SEC-005": hit(
            "SEC-005", made(*CLOSEABLE_TYPES) + " AND try_level > 0", "MAJOR",
            "Potential resource leak -> {tok} not in try-with-resources", *here, suggestion=advice("SEC-005", "tok"),
        ),
        "SEC-006": hit(
            "SEC-006", f"is_call AND tok = 'getInstance' AND argument IN ({words(*WEAK_HASHES)})", "CRITICAL",
            "Weak cryptographic algorithm used -> {argument}", *at_begin, suggestion=advice("SEC-006", "argument"),
        ),
        "SEC-009": hit(
            "SEC-009", "is_scoped_call AND tok = 'exec' AND runtime_pos >= operand_pos", "CRITICAL",
            "Runtime.exec() usage - potential command injection", *at_begin,
        ),
        "SEC-010": hit(
            "SEC-010", "is_call AND tok = 'printStackTrace'", "MAJOR",
            "printStackTrace() detected - stack trace may be exposed", *at_begin,
        ),
        "SEC-011": hit("SEC-011", scoped("sleep", "Thread"), "MAJOR", "Thread.sleep() detected in production code", *at_begin),
        "SEC-012": hit(
            "SEC-012", f"{string} AND address RLIKE r'{IP_PATTERN}'", "MAJOR", 'Hardcoded IP address -> "{address}"', *here
        ),
        "SEC-013": hit(
            "SEC-013", made("ObjectInputStream"), "CRITICAL", "Unsafe deserialization -> ObjectInputStream usage detected", *here
        ),
    }
    rows = add(
        tokens,
        runtime_pos=max_when(
            "contains(tok, 'Runtime') OR contains(tok, 'runtime')", "pos", READ, "ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING"
        ),
        argument="CASE WHEN nk2 IN ('s', 'i') AND n3 IN (',', ')') THEN replace(n2, '\"', '') END",
        address=rf"CASE WHEN kind = 's' THEN regexp_replace({LITERAL}, r'^[\x00-\x20]+|[\x00-\x20]+$', '') END",
    )
    kinds = []
    if only is None or "SEC-012" in only:
        kinds.append(string)
    if only is None or only - {"SEC-012"}:
        kinds.append("kind = 'i' AND n1 = '('")
    return emit(rows.filter(f"NOT ghost AND {either(*kinds)}"), wanted(only, hits))


# Characters of an expression that are shown.
SHOWN = 80


def sum_rules(tokens: DataFrame, cfg: AuditConfig, only: Only = None) -> DataFrame:
    """Injection rules on "+" expressions, quoted from their tokens.

    A sum of n terms has n-1 candidates, all with one beginning; a word occurs in it
    if the word's last position before the end lies after the beginning. To quote
    it, tokens are kept from the beginning of a flagged sum to its end: going
    backwards, a token lies in one if the least beginning of the flagged ends so far is
    not after it. Of these few, each beginning looks ahead as many tokens as there are
    characters to show, and the end finds them on its bracket level. Nothing is shuffled.
    """
    wordy = "kind IN ('i', 's', 'c', 'k')"
    seen = {
        "sql_pos": f"{wordy} AND {contains_any('lower(tok)', SQL_WORDS)}",
        "ldap_pos": f"{wordy} AND {contains_any('lower(tok)', LDAP_WORDS)}",
        "file_pos": f"{wordy} AND contains(lower(tok), 'file')",
        "mark_pos": contains_any("tok", PATH_MARKS),
    }
    kinds = {
        "SEC-002": ("sql_pos > sum_pos", "Possible SQL Injection -> {expr}"),
        "SEC-007": ("ldap_pos > sum_pos", "Possible LDAP Injection -> {expr}"),
        "SEC-008": ("file_pos > sum_pos AND mark_pos > sum_pos", "Possible Path Traversal -> {expr}"),
    }
    chosen = {r: k for r, k in kinds.items() if only is None or r in only}
    ends = both(either(SUM_ENDS, SUM_ADDS), "sum_op = '+'")
    flagged = yes(both(ends, either(*[flag for flag, _ in chosen.values()])))
    rows = add(tokens.filter("NOT ghost"), **{name: max_when(found, "pos", READ, EARLIER) for name, found in seen.items()})
    rows = add(rows, flagged=flagged, sum_ends=yes(SUM_ENDS))
    backwards = f"PARTITION BY path, part ORDER BY pos DESC {UP_TO}"
    inside = add(rows, since=f"min(CASE WHEN flagged THEN sum_pos END) OVER ({backwards})").filter("since <= pos")
    piece = "named_struct('pos', pos, 'text', concat(CASE WHEN raw_len > length(tok) THEN ' ' ELSE '' END, tok))"
    ahead = add(inside, ahead=f"collect_list({piece}) OVER ({READ} ROWS BETWEEN 1 FOLLOWING AND {SHOWN + 1} FOLLOWING)")
    quoted = add(ahead, quote=last_when("sum_ends", "ahead", LEVEL, EARLIER)).filter("flagged")
    text = "trim(array_join(transform(filter(quote, x -> x.pos < pos), x -> x.text), ''))"
    shown = add(quoted, whole=text).withColumn("expr", tx.truncate_text(F.col("whole"), SHOWN))
    return emit(shown, [hit(r, flag, "CRITICAL", message, "sum_line", "pos") for r, (flag, message) in chosen.items()])


# Names: declared against used --------------------------------------------


def local_rules(tokens: DataFrame, cfg: AuditConfig, only: Only = None) -> DataFrame:
    """Locals and parameters no expression of the method body names, in one aggregation per method.

    The lists hold the declared and the used names of one method.
    """
    named = either("is_var", "is_param", "is_name_use")
    rows = add(
        method_tokens(tokens, named),
        declares="depth > 0 AND is_var",
        param="depth = 0 AND is_param",
        uses="depth > 0 AND is_name_use",
        opens=yes("depth > 0 AND pos = m_open"),
        own_start=yes("p1 = '=' AND p2 = tok AND n1 IN (';', ',')"),
    ).filter("declares OR param OR uses OR opens")
    per_method = rows.groupBy("path", "member").agg(
        F.expr("collect_list(CASE WHEN declares THEN named_struct('pos', pos, 'tok', tok) END) AS vars"),
        F.expr("collect_list(CASE WHEN param THEN named_struct('pos', pos, 'tok', tok, 'line', line) END) AS pars"),
        F.expr("collect_set(CASE WHEN uses THEN tok END) AS used"),
        F.expr("collect_set(CASE WHEN uses AND NOT own_start THEN tok END) AS used_elsewhere"),
        F.expr("max(opens) AS has_body"),
        F.expr("max(CASE WHEN declares THEN m_name END) AS m_name"), F.expr("max(CASE WHEN declares THEN m_line END) AS m_line"),
        F.expr("max(CASE WHEN param THEN mname END) AS mname"),
    )
    unused = {
        "DEAD-002": "filter(vars, v -> NOT array_contains(used_elsewhere, v.tok))",
        "DEAD-006": "CASE WHEN has_body THEN filter(pars, v -> v.tok NOT IN ('arg', 'args') AND NOT array_contains(used, v.tok)) ELSE slice(pars, 1, 0) END",
    }
    found = {
        "DEAD-002": hit("DEAD-002", "true", "MINOR", "Unused variable -> {v.tok} in method -> {m_name}", "m_line", "v.pos"),
        "DEAD-006": hit("DEAD-006", "true", "MINOR", "Unused parameter '{v.tok}' in method -> {mname}", "v.line", "v.pos"),
    }
    return emit(per_method, many=[f"transform({unused[r]}, v -> {found[r]})" for r in unused if only is None or r in only])


def class_tokens(tokens: DataFrame, keep: str) -> DataFrame:
    """Rows to keep, once per enclosing class or interface, with that class."""
    opens = "tok = '{' AND " + among("inner_bk", "class", "interface")
    rows = tokens.filter(f"class_level > 0 AND {either(keep, opens)}")
    rows = add(rows, depth="explode(sequence(1, class_level))")
    order, own = "PARTITION BY path, part, depth ORDER BY pos", f"{opens} AND class_level = depth"
    return add(rows, c_block=max_when(own, "pos", order), c_name=last_when(own, "class_name", order)).filter(f"NOT ghost AND {keep}")


def private_rules(tokens: DataFrame, cfg: AuditConfig, only: Only = None) -> DataFrame:
    """Private fields and methods no expression inside the class names or calls."""
    private = both(among("inner_bk", "class", "interface"), since_decl("private_pos"))
    field, method = both("is_var", private), both("is_mname", private)
    rows = class_tokens(tokens, either(field, method, "is_name_use", "is_call"))
    rows = add(
        rows,
        named="max(is_name_use) OVER (PARTITION BY path, c_block, tok)",
        called="max(is_call) OVER (PARTITION BY path, c_block, tok)",
        own="inner_pos = c_block",
    )
    hits = {
        "DEAD-004": hit(
            "DEAD-004", f"{method} AND own AND NOT called", "MAJOR", "Unused private method -> {tok} in class -> {c_name}",
            "decl_line", "pos", "1",
        ),
        "DEAD-005": hit(
            "DEAD-005", f"{field} AND own AND NOT named", "MINOR", "Unused private field -> {tok} in class -> {c_name}",
            "decl_line", "pos", "0",
        ),
    }
    return emit(rows, wanted(only, hits))


def envy_rules(tokens: DataFrame, cfg: AuditConfig, only: Only = None) -> DataFrame:
    """Methods that call through other objects far more than they use their own class's fields."""
    rows = add(
        method_tokens(tokens, either("is_scoped_call", "is_name_use", "is_var")),
        body="depth > 0 AND " + among("m_owner_kind", "class", "interface"),
        field="depth = 0 AND is_var AND " + among("inner_bk", "class", "interface"),
        class_="CASE WHEN depth > 0 THEN m_owner ELSE inner_pos END",
    ).filter("field OR (body AND (is_scoped_call OR is_name_use))")
    rows = add(rows, own="max(field) OVER (PARTITION BY path, class_, tok)")
    per_method = rows.filter("NOT field").groupBy("path", "member").agg(
        F.expr("count(CASE WHEN is_scoped_call THEN 1 END) AS outside"),
        F.expr("count(CASE WHEN is_name_use AND own THEN 1 END) AS inside"),
        F.expr("max(m_name) AS name"), F.expr("max(m_line) AS line"),
    )
    message = "Feature Envy in method -> {name} (uses external data more than own)"
    return emit(per_method, [hit("SMELL-009", "outside > 5 AND outside > inside * 2", "MINOR", message, "line", "member")])


def import_rules(tokens: DataFrame, cfg: AuditConfig, only: Only = None) -> DataFrame:
    """Single imports whose last name occurs neither as an expression nor as a type."""
    imported = yes("head = 'import' AND (kind = 'i' OR tok = '.')")
    rows = add(tokens.filter("NOT ghost"), imported=imported).filter("imported OR is_name_use OR is_type_use").selectExpr(
        "path", "pos", "tok", "n1", "imported", "decl_line", "decl_pos"
    )
    parts = f"collect_list(CASE WHEN imported THEN tok END) OVER (PARTITION BY path, decl_pos ORDER BY pos {UP_TO})"
    rows = add(rows, full=f"concat_ws('', {parts})", used="max(NOT imported) OVER (PARTITION BY path, tok)")
    unused = rows.filter("imported AND n1 = ';' AND NOT used")
    return emit(unused, [hit("DEAD-003", "true", "MINOR", "Unused import -> {full}", "decl_line", "pos")])


# Files -------------------------------------------------------------------


def named_files(measured: DataFrame) -> DataFrame:
    """Files with (code, ratio), and what the messages show."""
    return add(measured, name="substring_index(path, '/', -1)", percent="format_string('%.1f%%', ratio * 100)")


def measured_files(files: DataFrame) -> DataFrame:
    """Texts with code lines and comment share as they stand; a projection, no shuffle."""
    profiled = files.withColumn("profile", tx.line_profile(F.col("content")))
    return named_files(
        profiled.select(*files.columns, F.col("profile.code").alias("code"), tx.comment_ratio(F.col("profile")).alias("ratio"))
    )


def measured_layouts(tokens: DataFrame) -> DataFrame:
    """Source files with code lines and comment share of the printed layout."""
    return named_files(add(printed_lines(tokens), ratio="CASE WHEN code > 0 THEN CAST(comment AS DOUBLE) / code ELSE 0.0D END"))


def file_hits(cfg: AuditConfig) -> dict[str, str]:
    least = f"concat(format_string('%.0f', CAST({cfg.min_comment_ratio} AS DOUBLE) * 100), '%')"
    return {
        "MET-003": hit(
            "MET-003", f"code > {cfg.max_file_loc}", "MAJOR", "Large file -> {name} ({code} code lines)", "1", "0",
            suggestion=advice("MET-003", str(cfg.max_file_loc)),
        ),
        "MET-004": hit(
            "MET-004", f"ratio < {cfg.min_comment_ratio} AND code > {cfg.min_commented_loc}", "MINOR",
            "Low comment-to-code ratio in {name} ({percent})", "1", "0", suggestion=advice("MET-004", least),
        ),
    }


def file_rules(files: DataFrame, cfg: AuditConfig, only: Only = None) -> DataFrame:
    """On texts of any kind, as they stand."""
    return emit(cfg.limited(measured_files(files)), wanted(only, file_hits(cfg)))


def layout_rules(tokens: DataFrame, cfg: AuditConfig, only: Only = None) -> DataFrame:
    """On source files, in the printed layout."""
    return emit(cfg.limited(measured_layouts(tokens)), wanted(only, file_hits(cfg)))
