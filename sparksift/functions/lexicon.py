"""Lexical constants of Java source text, as plain regular expressions and word lists.

Every repeated group is possessive, so a 20,000-character literal or comment
is matched by iteration rather than by recursion inside the regex engine.
"""

# Whitespace and comments in front of a token.
COMMENT = r"//[^\n]*+|/\*[^*]*+\*++(?:[^/*][^*]*+\*++)*+/"
TRIVIA = r"(?:\s++|" + COMMENT + r")*+"

TEXT_BLOCK = r'"""(?:[^"\\]++|\\[\s\S]|"(?!""))*+"""'
STRING_LITERAL = r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"'
CHAR_LITERAL = r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"
_HEX = r"0[xX][0-9a-fA-F_]*+(?:\.[0-9a-fA-F_]*+)?(?:[pP][+-]?[0-9]++)?[lLfFdD]?"
_BIN = r"0[bB][01_]++[lL]?"
_DEC = r"(?:[0-9][0-9_]*+(?:\.[0-9_]*+)?|\.[0-9][0-9_]*+)(?:[eE][+-]?[0-9]++)?[lLfFdD]?"
_WORD = r"[\p{L}_$][\p{L}\p{Nd}_$]*+"
# ">" is always a token of its own, so "List<List<X>>" closes twice.
_OPERATOR = r"<<=|->|::|\+\+|--|&&|\|\||\.\.\.|[-+*/%&|^!=<>]="

# One match = trivia plus one token; the empty token at the end of the text
# swallows a trailing comment, so every character is covered exactly once.
TOKEN = (
    TRIVIA
    + "(?:"
    + "|".join([TEXT_BLOCK, STRING_LITERAL, CHAR_LITERAL, _HEX, _BIN, _DEC, _WORD, _OPERATOR, r"\S"])
    + r"|\z)"
)

# The reserved words of the Java language.
KEYWORDS = (
    "abstract assert boolean break byte case catch char class const continue default do double "
    "else enum extends final finally float for goto if implements import instanceof int interface "
    "long native new package private protected public return short static strictfp super switch "
    "synchronized this throw throws transient try void volatile while true false null"
).split()
PRIMITIVES = "boolean byte char double float int long short void".split()
MODIFIERS = (
    "public private protected static final abstract native synchronized transient volatile "
    "strictfp default sealed"
).split()
STATEMENT_WORDS = "yield permits record".split()
OPENERS = ["(", "[", "{"]
CLOSERS = [")", "]", "}"]
