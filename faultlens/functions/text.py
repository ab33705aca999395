"""Column functions over source text: clean-up, comment and string masking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultlens.functions.nfkc import nfkc

# A literal or comment is written as (first character, rest). One character
# class in front lets the engine skip ordinary text at its cheapest; a literal
# is only tried where it can start. Every quantifier over an alternation is
# possessive: the JVM engine would otherwise recurse per character.
_DOUBLE = ('"', r'(?:[^"\\\n]++|\\(?s:.))*+"')
_SINGLE = ("'", r"(?:[^'\\\n]++|\\(?s:.))*+'")
_TRIPLE_DOUBLE = ('"', r'""(?:[^"\\]++|\\(?s:.)|"(?!""))*+"""')
_TRIPLE_SINGLE = ("'", r"''(?:[^'\\]++|\\(?s:.)|'(?!''))*+'''")
_BACKTICK = ("`", r"(?:[^`\\]++|\\(?s:.))*+`")
_RAW_BACKTICK = ("`", r"[^`]*+`")
_VERBATIM = ("@", r'"(?:[^"]++|"")*+"')
_SCRIPT_REGEX = ("/", r"(?<=[=(,:!&|?;\[{]\s{0,2}/)(?![/*])"
                      r"(?:[^/\\\n\[]++|\\.|\[(?:[^\]\\\n]++|\\.)*+\])++/")
_SLASHES = ("/", r"/[^\n]*+")
_BLOCK = ("/", r"\*(?s:.*?)(?:\*/|\z)")
_HASH = ("#", r"[^\n]*+")
_RUBY_BLOCK = ("=", r"(?<=(?m:^)=)begin\b(?s:.*?)(?:(?m:^=end\b)[^\n]*+|\z)")

_STRINGS = {
    "python": (_TRIPLE_DOUBLE, _TRIPLE_SINGLE, _DOUBLE, _SINGLE),
    "java": (_TRIPLE_DOUBLE, _DOUBLE, _SINGLE),
    "javascript": (_DOUBLE, _SINGLE, _BACKTICK, _SCRIPT_REGEX),
    "typescript": (_DOUBLE, _SINGLE, _BACKTICK, _SCRIPT_REGEX),
    "go": (_DOUBLE, _RAW_BACKTICK, _SINGLE),
    "ruby": (_DOUBLE, _SINGLE),
    "csharp": (_TRIPLE_DOUBLE, _VERBATIM, _DOUBLE, _SINGLE),
    "kotlin": (_TRIPLE_DOUBLE, _DOUBLE, _SINGLE),
    "swift": (_TRIPLE_DOUBLE, _DOUBLE),
    "php": (_DOUBLE, _SINGLE),
}
_COMMENTS = {
    "python": (_HASH,),
    "ruby": (_RUBY_BLOCK, _HASH),
    "php": (_SLASHES, _HASH, _BLOCK),
}
_C_COMMENTS = (_SLASHES, _BLOCK)


def _pieces(pieces) -> str:
    starts = "".join(dict.fromkeys(first for first, _ in pieces))
    rest = "|".join(f"(?<={first}){rest}" for first, rest in pieces)
    return f"[{starts}](?:{rest})"


def _strings(language: str) -> str:
    return _pieces(_STRINGS[language])


def _both(language: str) -> str:
    return _pieces(_STRINGS[language] + _COMMENTS.get(language, _C_COMMENTS))


def _kept_strings(language: str) -> str:
    """Like ``_both``, with a string literal captured as group 1. The start
    class is looked at first and consumed by whichever alternative applies."""
    comments = _COMMENTS.get(language, _C_COMMENTS)
    starts = "".join(dict.fromkeys(first for first, _ in _STRINGS[language] + comments))
    return f"(?=[{starts}])(?:({_strings(language)})|{_pieces(comments)})"


def sql_text(value: str) -> str:
    """SQL literal of any text: raw pieces, so backslashes need no care,
    between single quotes, which are written in double quotes."""
    return " \"'\" ".join(f"r'{piece}'" for piece in value.split("'"))


def strip_comments_sql(source: str, language: str) -> str:
    """Comments become a blank; string literals are recognised and kept, so a
    comment marker inside one is left alone."""
    return f"regexp_replace({source}, {sql_text(_kept_strings(language))}, '$1 ')"


def mask_strings_sql(source: str, language: str, by: str = " ") -> str:
    """String literals of comment-free text become a blank."""
    return f"regexp_replace({source}, {sql_text(_strings(language))}, '{by}')"


def mask_code_sql(source: str, language: str) -> str:
    """Comments and string literals become blanks, in one pass."""
    return f"regexp_replace({source}, {sql_text(_both(language))}, ' ')"


def strip_comments(text: Column, language: str) -> Column:
    return F.regexp_replace(text, _kept_strings(language), "$1 ")


def mask_code(text: Column, language: str) -> Column:
    return F.regexp_replace(text, _both(language), " ")


def unify_newlines(text: Column) -> Column:
    """CRLF and CR to LF; the common case is a substring test, not a rewrite."""
    return F.when(text.contains("\r"), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)


# Typographic characters and their plain forms.
_TYPOGRAPHIC = "\u2028\u2029\u2019\u201c\u201d"
_PLAIN = "\n\n'\"\""


def normalise_source(text: Column) -> Column:
    """Compatibility forms, byte-order mark, line ends, control characters, typographic quotes."""
    def bound(value: Column, function) -> Column:
        """``function`` of a value that it names more than once, which is then computed once."""
        return F.element_at(F.transform(F.array(value), function), 1)

    cleaned = bound(bound(F.replace(text, F.lit("\ufeff"), F.lit("")), nfkc), unify_newlines)
    cleaned = F.translate(cleaned, _TYPOGRAPHIC, _PLAIN)
    return F.regexp_replace(cleaned, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]", "")


def find_all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
