"""Python files that no parser accepts, found without one.

A balance automaton over code in which comments are gone and every string literal is a
``0``: quotes that are left over belong to no literal; brackets are folded over a stack;
and logical lines are folded over the stack of indentations, by the rules of the
language's reference (a line ending in a colon opens a block, which must be deeper; other
lines must stand at a level that is open; tabs must compare alike at both tab sizes).
Statements that only Python 2 knows are looked for by pattern. Errors inside a line,
such as a missing operand, are not seen.

Both stacks are bounded, as the language bounds them, so time is linear in the text.
"""

from __future__ import annotations

from faultlens.functions.text import sql_text

#: How deep brackets and indentation may go (fixed values of the language).
BRACKETS, LEVELS = 200, 100
#: Levels of brackets that are gone before the fold, from the inside.
NEAR = 4

_FLAT = r"[^()\[\]{}]"


def _balanced(depth: int) -> str:
    """Bracketed text with up to ``depth`` further levels inside."""
    inner = f"{_FLAT}*+" if not depth else f"(?:{_FLAT}++|{_balanced(depth - 1)})*+"
    return rf"(?:\({inner}\)|\[{inner}\]|\{{{inner}\}})"


#: Statements that only Python 2 accepts, at the start of a line or anywhere.
_ONLY_PYTHON_2 = (
    r"\n[ \t]*+(?:print|exec)[ \t]++(?!(?:in|is|and|or|if|not|else)\b)[\w~]"
    r"|\n[ \t]*+except[ \t]++[\w.]++[ \t]*+,[^\n:(]*+:"
    r"|\n[ \t]*+raise[ \t]++[\w.]++[ \t]*+,"
    r"|`|<>"
)
#: A line's end (with the colon that opens a block), blank lines, and the next line's indentation.
_LINE = r"(?::[ \t\f]*+)?\n[ \t\f\n]*+"
_FEED = "'\f'"  # as it is: SQL has no escape for it


def unparsable_sql(solid: str) -> str:
    """Whether code is no Python; ``solid`` is SQL for it without comments, literals as ``0``."""
    joined = f"replace({solid}, '\\\\\\n', ' ')"  # a line goes on after a backslash
    # Brackets that close near by are gone first, with the line ends between them.
    flat = (f"regexp_replace(concat('\\n', rtrim(concat(' \\t\\n', {_FEED}), {joined})), "
            f"{sql_text(_balanced(NEAR - 1))}, '0')")
    tabs = ("aggregate(split(i, ''), 0, (c, x) -> CASE x WHEN ' ' THEN c + 1 "
            f"WHEN '\\t' THEN CAST((c div 8 + 1) * 8 AS int) WHEN {_FEED} THEN 0 ELSE c END)")
    plain = f"length(substring_index(i, {_FEED}, -1))"
    indent = "substring_index(m, '\\n', -1)"
    marks = (f"transform(regexp_extract_all(f, {sql_text('(?d)' + _LINE + r'|[()\[\]{}]')}, 0), "
             f"m -> named_struct('m', m, 'i', {indent}))")
    marks = (f"transform({marks}, x -> named_struct('mark', x.m, 'wide', element_at(transform(array(x.i), "
             f"i -> CASE WHEN contains(i, '\\t') THEN {tabs} ELSE {plain} END), 1), "
             f"'narrow', element_at(transform(array(x.i), i -> {plain}), 1)))")

    def state(open_: str, levels: str, bad: str) -> str:
        return f"named_struct('open', {open_}, 'levels', {levels}, 'bad', {bad})"

    level = "named_struct('wide', t.wide, 'narrow', t.narrow)"
    top = "element_at(s.levels, -1)"
    kept = "filter(s.levels, l -> l.wide <= t.wide)"
    closes = "CASE t.mark WHEN ')' THEN '(' WHEN ']' THEN '[' ELSE '{' END"
    step = " ".join((
        "WHEN s.bad THEN s",
        "WHEN t.mark IN ('(', '[', '{') THEN " + state(
            "concat(s.open, t.mark)", "s.levels", f"length(s.open) >= {BRACKETS - NEAR}"),
        "WHEN t.mark IN (')', ']', '}') THEN " + state(
            "left(s.open, length(s.open) - 1)", "s.levels", f"right(s.open, 1) <> {closes}"),
        "WHEN s.open <> '' THEN s",
        "WHEN startswith(t.mark, ':') THEN " + state(
            "s.open", f"array_append(s.levels, {level})",
            f"t.wide <= {top}.wide OR t.narrow <= {top}.narrow OR size(s.levels) >= {LEVELS}"),
        f"WHEN t.wide = {top}.wide THEN " + state("s.open", "s.levels", f"t.narrow <> {top}.narrow"),
        f"WHEN t.wide > {top}.wide THEN " + state("s.open", "s.levels", "true"),
    ))
    dedent = state("s.open", kept, f"element_at({kept}, -1) <> {level}")
    start = state("''", "array(named_struct('wide', 0, 'narrow', 0))", "false")
    balance = (f"element_at(transform(array({flat}), f -> aggregate({marks}, {start}, "
               f"(s, t) -> CASE {step} ELSE {dedent} END, s -> s.bad OR s.open <> '')), 1)")
    return (f"(contains({solid}, '\"') OR contains({solid}, \"'\") OR contains({solid}, '\\0') "
            f"OR endswith(rtrim(concat(' \\t\\n', {_FEED}), {solid}), ':') "
            f"OR concat('\\n', {solid}) RLIKE {sql_text('(?d)' + _ONLY_PYTHON_2)} OR {balance})")
