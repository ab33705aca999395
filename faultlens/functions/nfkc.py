"""Compatibility normalisation (NFKC) as a Column expression.

The tables are data: full decompositions, combining classes and primary composites, taken
from the character database when the expression is built and put into the plan as
arrays that are read by code point. Characters that stand for one other are replaced in a
single pass. Then a text is cut into stretches that nothing can change and short runs around
characters that may. A run of one character is looked up; only others are worked on:
characters are decomposed, marks are put in order of their class, and starters are joined
with what follows them. Hangul syllables are taken apart and joined by arithmetic.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hangul syllables and their letters (fixed values of the standard).
_SYLLABLES, _LEADING, _VOWELS, _TRAILING = 0xAC00, 0x1100, 0x1161, 0x11A7
_N_VOWELS, _N_TRAILING, _N_SYLLABLES = 21, 28, 11172
#: Code points of a page of a table, and what stands between entries (no character of a text).
_PAGE_BITS, _BETWEEN = 6, "\x01"
_PAGE = 1 << _PAGE_BITS
#: Stands before each entry of the characters that a mark is joined to.
_ENTRY = "\x02"


def _is_syllable(point: int) -> bool:
    return _SYLLABLES <= point < _SYLLABLES + _N_SYLLABLES


@functools.cache
def _database() -> tuple[dict[int, str], dict[int, int]]:
    """Characters with a decomposition, as the database has it, and those with a combining class."""
    parts, classes = {}, {}
    for point in range(sys.maxunicode + 1):
        c = chr(point)
        if given := unicodedata.decomposition(c):
            parts[point] = given
        if kind := unicodedata.combining(c):
            classes[point] = kind
    return parts, classes


@functools.cache
def _decompositions() -> dict[int, str]:
    """Full compatibility decompositions, but for Hangul syllables."""
    return {p: unicodedata.normalize("NFKD", chr(p)) for p in _database()[0] if not _is_syllable(p)}


def _classes() -> dict[int, int]:
    return _database()[1]


@functools.cache
def _composites() -> dict[str, str]:
    """Pairs of characters that are joined to one: canonical decompositions into two that
    come back when composed."""
    found = {}
    for point, parts in _database()[0].items():
        if not parts.startswith("<") and " " in parts:
            pair = "".join(chr(int(x, 16)) for x in parts.split())
            if unicodedata.normalize("NFC", pair) == chr(point):
                found[pair] = chr(point)
    return found


@functools.cache
def _joining() -> frozenset[int]:
    """Characters that may be joined to what stands before them."""
    return frozenset(
        {ord(pair[1]) for pair in _composites()} | set(range(_VOWELS, _VOWELS + _N_VOWELS))
        | set(range(_TRAILING + 1, _TRAILING + _N_TRAILING)))


@functools.cache
def _changing() -> frozenset[int]:
    """Characters that may change or be joined to what stands before."""
    return _joining() | _classes().keys() | {
        p for p in _database()[0] if unicodedata.normalize("NFKC", chr(p)) != chr(p)}


@functools.cache
def _replaced() -> tuple[str, str]:
    """Characters whose normal form is one other character, and those. What a text decomposes
    to stays the same if they are replaced, and so does its normal form."""
    forms = {p: unicodedata.normalize("NFKC", chr(p)) for p in _database()[0] if not _is_syllable(p)}
    one = {p: form for p, form in forms.items() if len(form) == 1 and form != chr(p)}
    return "".join(map(chr, one)), "".join(one.values())


@functools.cache
def _joined_to() -> dict[int, str]:
    """For each mark: entries of a character it is joined to and what they become."""
    found = {}
    for pair, whole in _composites().items():
        found[ord(pair[1])] = found.get(ord(pair[1]), "") + _ENTRY + pair[0] + whole
    return found


@functools.cache
def _alone() -> dict[int, str]:
    """What becomes of a character between settled ones: its normal form, or for a mark the
    entries of what it is joined to. Letters of Hangul, and what decomposes to marks, are left out."""
    found, inner = {}, _joining() | _classes().keys()
    for p in _unsettled():
        form = unicodedata.normalize("NFKC", chr(p))
        if p not in inner:
            if ord(form[0]) not in inner:
                found[p] = form
        elif p not in _database()[0] and not _VOWELS <= p < _TRAILING + _N_TRAILING:
            found[p] = _joined_to().get(p, _ENTRY)
    return found


def _class_of(given) -> str:
    """Characters as the inside of a regex class."""
    points = sorted(given)
    out, low = [], None
    for p, after in zip(points, [*points[1:], None]):
        low = p if low is None else low
        if after != p + 1:
            out.append(rf"\x{{{low:X}}}" + (rf"-\x{{{p:X}}}" if p > low else ""))
            low = None
    return "".join(out)


def _table(entries: dict[int, str], default: str):
    """A function from code points to entries: pages that hold any, one after the other."""
    pages = sorted({p // _PAGE for p in entries})
    number = {page: k for k, page in enumerate(pages, start=1)}
    cells = [entries.get(page * _PAGE + i, default) for page in pages for i in range(_PAGE)]
    # Strings that are split when the plan is made: two literals, not thousands.
    index = F.split(F.lit(",".join(str(number.get(k, 0)) for k in range(pages[-1] + 1))), ",").cast("array<int>")
    values = F.split(F.lit(_BETWEEN.join(cells)), _BETWEEN)

    def at(point: Column) -> Column:
        page = F.coalesce(F.try_element_at(index, F.shiftright(point, _PAGE_BITS) + 1), F.lit(0))
        place = (page - 1) * _PAGE + point.bitwiseAND(_PAGE - 1) + 1
        return F.when(page > 0, F.element_at(values, place)).otherwise(F.lit(default))

    return at


def _char(point: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(point.cast("long")), 8, "0")), "UTF-32")


def _split(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _whole(entries: Column, starter: Column) -> Column:
    """What a character becomes with a mark that has the entries; null if they are not joined."""
    at = F.instr(entries, F.concat(F.lit(_ENTRY), starter))
    return F.when((starter != "") & (at > 0), F.substr(entries, at + 2, F.lit(1)))


def _normalised_run(run: Column) -> Column:
    decomposition = _table(_decompositions(), "")
    combining = _table({p: str(c) for p, c in _classes().items()}, "0")
    joined_to = _table(_joined_to(), "")

    def apart(c: Column) -> Column:
        point = F.ascii(c)
        s = point - _SYLLABLES
        vowel = F.floor(s % (_N_VOWELS * _N_TRAILING) / _N_TRAILING)
        letters = F.concat(
            _char(F.floor(s / (_N_VOWELS * _N_TRAILING)) + _LEADING), _char(vowel + _VOWELS),
            F.when(s % _N_TRAILING > 0, _char(s % _N_TRAILING + _TRAILING)).otherwise(""))
        other = decomposition(point)
        return F.when((s >= 0) & (s < _N_SYLLABLES), letters).when(other != "", other).otherwise(c)

    letters = F.array_join(F.transform(_split(run), apart), "")

    def kinds(text: Column) -> Column:
        return F.transform(_split(text), lambda c, i: F.struct(
            combining(F.ascii(c)).cast("int").alias("kind"), i.alias("place"), c.alias("c")))

    def each(text: Column, several: str, some: str, function) -> Column:
        """``function`` of every character with the ``some`` behind it, where it has ``several``."""
        groups = F.regexp_extract_all(text, F.lit(f"[^{some}][{some}]*+|[{some}]++"), F.lit(0))
        return F.array_join(F.transform(groups, lambda g: F.when(g.rlike(several), function(g)).otherwise(g)), "")

    # Marks stand behind their character in order of class, and of place within a class.
    marks = _class_of(_classes())
    ordered = each(letters, f"[{marks}][{marks}]", marks,
                   lambda g: F.array_join(F.transform(F.array_sort(kinds(g)), lambda m: m["c"]), ""))

    # Joined: ``starter`` is the last one, ``behind`` what stands after it and could not be joined.
    none = F.lit(None).cast("string")
    begin = F.struct(F.lit("").alias("done"), none.alias("starter"), F.lit("").alias("behind"),
                     F.lit(0).alias("last"))

    def joined(s: Column, m: Column) -> Column:
        first, second = F.ascii(s["starter"]), F.ascii(m["c"])
        vowel = (first >= _LEADING) & (first < _LEADING + 19) & (second >= _VOWELS) & (second < _VOWELS + _N_VOWELS)
        syllable = first - _SYLLABLES
        trailing = (syllable >= 0) & (syllable < _N_SYLLABLES) & (syllable % _N_TRAILING == 0) & (
            second > _TRAILING) & (second < _TRAILING + _N_TRAILING)
        whole = (
            F.when(vowel, _char(((first - _LEADING) * _N_VOWELS + second - _VOWELS) * _N_TRAILING + _SYLLABLES))
            .when(trailing, _char(first + second - _TRAILING))
            .otherwise(_whole(joined_to(second), s["starter"])))
        # Blocked by a mark of the same or a higher class in between, or by any if this is a starter.
        free = (s["behind"] == "") | ((m["kind"] > s["last"]) & (m["kind"] > 0))
        joins = s["starter"].isNotNull() & free & whole.isNotNull()
        flushed = F.concat(s["done"], F.coalesce(s["starter"], F.lit("")), s["behind"])
        return (
            F.when(joins, F.struct(s["done"].alias("done"), whole.alias("starter"), s["behind"].alias("behind"),
                                   s["last"].alias("last")))
            .when(m["kind"] == 0, F.struct(flushed.alias("done"), m["c"].alias("starter"), F.lit("").alias("behind"),
                                           F.lit(0).alias("last")))
            .otherwise(F.struct(s["done"].alias("done"), s["starter"].alias("starter"),
                                F.concat(s["behind"], m["c"]).alias("behind"), m["kind"].alias("last"))))

    joining = _class_of(_joining() | set(_classes()))
    return each(ordered, f"[{joining}]", joining, lambda g: F.aggregate(
        kinds(g), begin, joined, lambda s: F.concat(s["done"], F.coalesce(s["starter"], F.lit("")), s["behind"])))


@functools.cache
def _gaps() -> tuple[tuple[int, int], ...]:
    """First and last of long stretches of code points without a character that may change."""
    changing = sorted(p for p in _changing() if p > 0x7F)
    ends = [0x7F, *changing, sys.maxunicode + 1]
    return tuple((a + 1, b - 1) for a, b in zip(ends, ends[1:]) if b - a > (1 if b < 0x300 else _PAGE))


def _settled() -> str:
    """These stretches as a regex class; what lies between them is looked at one by one."""
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in _gaps())


def _unsettled() -> list[int]:
    """The code points between those stretches, but for surrogates."""
    starts = [0x80, *(b + 1 for _, b in _gaps())]
    ends = [*(a for a, _ in _gaps()), sys.maxunicode + 1]
    return [p for a, b in zip(starts, ends) for p in range(a, b) if not 0xD800 <= p < 0xE000]


def nfkc(text: Column) -> Column:
    """The compatibility normal form of a text, which may be null."""
    settled = _settled()
    alone = _table(_alone(), "")
    # Alternately: characters that stay as they are, and others.
    pieces = F.regexp_extract_all(
        F.translate(text, *_replaced()), F.lit(rf"(?:[\x00-\x7F]++|[{settled}]++)++|[^\x00-\x7F{settled}]++"), F.lit(0))

    def in_place(all_: Column) -> Column:
        def one(piece: Column, i: Column) -> Column:
            # The last character before others goes with them: marks may be joined to it.
            before = F.when(i > 0, F.right(F.get(all_, i - 1), F.lit(1))).otherwise("")
            kept = F.when(i + 1 < F.size(all_), F.left(piece, F.length(piece) - 1)).otherwise(piece)
            form = alone(F.ascii(piece))
            single = F.length(piece) == 1
            return (
                F.when(F.ascii(piece) < 0x80, kept)
                # ASCII and a mark that it is not joined to stay; other letters may come apart before it.
                .when(single & form.startswith(_ENTRY) & (
                    (F.ascii(before) < 0x80) | _whole(form, before).isNotNull()),
                    F.coalesce(_whole(form, before), F.concat(before, piece)))
                .when(single & (form != "") & ~form.startswith(_ENTRY), F.concat(before, form))
                .when(piece.rlike(rf"^[{settled}]"), kept)
                .otherwise(_normalised_run(F.concat(before, piece))))

        return F.array_join(F.transform(all_, one), "")

    # Bound once: the pieces are looked at by their numbers.
    done = F.element_at(F.transform(F.array(pieces), in_place), 1)
    # Runs of ASCII are passed over by the cheapest test there is.
    return F.when(text.rlike(rf"\A(?:[\x00-\x7F]++|[{settled}]++)*+\z"), text).otherwise(done)
