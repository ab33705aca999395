"""What stands inside what: a scan of masked code that keeps the open blocks.

One pattern lifts the block marks out of the text in order: headings (``for (...)``,
``catch (...)``), braces and the words that are looked for. A fold over the marks keeps,
for every open block, the kinds of all blocks around it as a bit set, and collects pairs
(kind of an enclosing block, thing inside) in one ``bigint``. A pair is written
``loop>catch`` in a rule. A block inside another has the other's kinds, so the kinds change
a few times on the way down and the state stays small however deep the code is nested.
"""

from __future__ import annotations

from faultlens.catalogs.blocks import BLOCKS, EVENTS, KINDS, Blocks
from faultlens.functions.text import sql_text

INSIDE = (*KINDS[:-1], *EVENTS)
_OPEN, _CLOSE, _RESCUE, _ENSURE, _WITH_BRACE = 100, 101, 102, 103, 200
_LOOP, _CATCH, _CAUGHT = (KINDS.index(k) for k in ("loop", "catch", "caught_loop"))
_CATCHES = 1 << _CATCH | 1 << _CAUGHT


def pair_mask(pair: str) -> int:
    """The bit of ``outer>inner``."""
    outer, inner = pair.split(">")
    return 1 << len(KINDS) * INSIDE.index(inner) + KINDS.index(outer)


def pairs_test(bits: str, pattern: str) -> str:
    """``a>b``, alternatives with ``|``, all of several with ``&`` (which binds closer)."""
    return "(" + " OR ".join(
        " AND ".join(f"{bits} & {pair_mask(p)}L <> 0L" for p in each.split("&"))
        for each in pattern.split("|")) + ")"


def _marks(spec: Blocks) -> str:
    patterns = [p for _, p, _ in (*spec.headings, *spec.events)]
    patterns += [spec.opens, spec.ends, r"(?<![\w.:@$])(?:rescue|ensure)\b"] if spec.opens else []
    return "[{}]|" + "|".join(f"(?:{p})" for p in patterns)


def _codes(spec: Blocks) -> str:
    """A mark as a number: its place in ``INSIDE``, or one of the codes above."""
    whens = [f"WHEN m = '{{' THEN {_OPEN}", f"WHEN m = '}}' THEN {_CLOSE}"]
    if spec.opens:
        whens += [f"WHEN m RLIKE {sql_text(spec.ends)} THEN {_CLOSE}", f"WHEN m = 'rescue' THEN {_RESCUE}",
                  f"WHEN m = 'ensure' THEN {_ENSURE}"]
    with_brace = _WITH_BRACE if spec.opens else 0
    whens += [f"WHEN m RLIKE {sql_text(start)} THEN {INSIDE.index(kind)}" for kind, _, start in spec.events]
    whens += [f"WHEN m RLIKE {sql_text(start)} THEN {INSIDE.index(kind) + with_brace}"
              for kind, _, start in spec.headings]
    return f"CASE {' '.join(whens)} ELSE {_OPEN} END"


def block_pairs_sql(source: str, language: str) -> str:
    """Pairs found in masked code, or 0 where the words that any pair needs are missing."""
    spec = BLOCKS[language]

    def some(words) -> str:
        return "(" + " OR ".join(f"contains({source}, {sql_text(w)})" for w in words) + ")"

    gate = " OR ".join("(" + " AND ".join(map(some, groups)) + ")" for groups in spec.needs)
    marks = (f"transform(regexp_extract_all({source}, {sql_text('(?d)' + _marks(spec))}, 0), "
             f"m -> {_codes(spec)})")
    top, below = "element_at(s.open, -1)", "element_at(s.open, -2)"
    around = f"({top}.kinds | s.next)"

    # A catch inside a loop is a kind of its own.
    def added(kind: str) -> str:
        caught = f"CASE WHEN {kind} = {_CATCH} AND {around} & {1 << _LOOP} <> 0 THEN {1 << _CAUGHT} ELSE 0 END"
        return f"(shiftleft(1, {kind}) | {caught})"

    def state(open_: str, depth: str, next_: str, seen: str) -> str:
        return f"named_struct('open', {open_}, 'depth', {depth}, 'next', {next_}, 'seen', {seen})"

    def seen(kind: str) -> str:
        return f"s.seen | shiftleft(CAST({around} AS bigint), {len(KINDS)} * ({kind}))"

    def block(kinds: str, depth: str) -> str:
        return f"named_struct('kinds', {kinds}, 'depth', {depth})"

    def pushed(kinds: str) -> str:
        """A block like the one around it needs no entry, so there are few."""
        return (f"CASE WHEN {kinds} = {top}.kinds THEN s.open "
                f"ELSE array_append(s.open, {block(kinds, 's.depth + 1')}) END")

    popped = "slice(s.open, 1, size(s.open) - 1)"
    # Whether the last entry is of the innermost block, and not of one around it.
    own = f"({top}.depth = s.depth AND size(s.open) > 1)"
    rescued = block(f"{top}.kinds | {added(str(_CATCH))}", "s.depth")
    ensured = block(f"{top}.kinds & {~_CATCHES} | {below}.kinds & {_CATCHES}", "s.depth")
    last = len(KINDS) - 2
    step = " ".join((
        f"WHEN t = {_OPEN} THEN " + state(pushed(around), "s.depth + 1", "0", "s.seen"),
        f"WHEN t = {_CLOSE} THEN " + state(
            f"CASE WHEN {own} THEN {popped} ELSE s.open END", "greatest(s.depth - 1, 0)", "0", "s.seen"),
        # The rest of a block is a catch block from its ``rescue`` to its end or ``ensure``.
        f"WHEN t = {_RESCUE} THEN " + state(
            f"array_append(CASE WHEN {own} THEN {popped} ELSE s.open END, {rescued})", "s.depth", "0",
            seen(str(_CATCH))),
        f"WHEN t = {_ENSURE} THEN " + state(
            f"CASE WHEN {own} THEN array_append({popped}, {ensured}) ELSE s.open END", "s.depth", "0", "s.seen"),
        f"WHEN t >= {_WITH_BRACE} THEN " + state(
            pushed(f"({around} | {added(f't - {_WITH_BRACE}')})"), "s.depth + 1", "0", seen(f"t - {_WITH_BRACE}")),
        f"WHEN t <= {last} THEN " + state("s.open", "s.depth", f"s.next | {added('t')}", seen("t")),
    ))
    start = state(f"array({block('0', '0')})", "0", "0", "0L")
    fold = (f"aggregate({marks}, {start}, (s, t) -> CASE {step} "
            f"ELSE {state('s.open', 's.depth', 's.next', seen('t'))} END, s -> s.seen)")
    return f"CASE WHEN {gate} THEN {fold} ELSE 0L END"
