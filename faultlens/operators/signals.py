"""Rules as Catalyst expressions: one narrow pass over the files, no shuffle.

Per file the text views are built once, names are lifted out per shape, and
every group of rules sets one bit of a ``bigint``, or of several bigints where a
language has many groups. Tiers, flags and library names are then read off the
bits. Rows are routed by ``CASE language``, so a single scan serves all languages
and only the row's own rules run.

The few hundred patterns are written as SQL text, one expression per step:
the driver hands Catalyst a handful of strings instead of thousands of calls.
"""

from __future__ import annotations

import dataclasses
import re
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.catalogs import domain, http_libraries, resilience_libraries
from faultlens.catalogs.signals import IMPORT_SHAPES, SHAPES, Rule, Shape, signal_rules
from faultlens.functions import scalars, text
from faultlens.functions.blocks import block_pairs_sql, pairs_test
from faultlens.functions.python_source import python_facts
from faultlens.functions.python_syntax import unparsable_sql
from faultlens.functions.text import sql_text

VIEWS = ("raw", "lower", "bare", "code")
#: Target of rules that ask what stands inside what.
BLOCK_PAIRS = "blocks"
_WORD_BITS = 62
_NO_NAMES = "CAST(array() AS array<string>)"

# How an import path is written, as the library detectors read it: per line,
# on the text as written (Python: on masked code, through its own shapes).
_IMPORT_FORMS = {
    "java": (r"\n[^\S\n]*+import[^\S\n]++(?:static[^\S\n]++)?"
             r"([a-zA-Z0-9_.]+(?:\.\*)?)[^\S\n]*+;",),
    "csharp": (r"\n[^\S\n]*+using[^\S\n]++(?:static[^\S\n]++)?([a-zA-Z0-9_.]+)[^\S\n]*+;",),
    "kotlin": (r"\n[^\S\n]*+import[^\S\n]++([a-zA-Z0-9_.]+(?:\.\*)?)",),
    "swift": (r"\n[^\S\n]*+import[^\S\n]++([a-zA-Z0-9_.]+)",),
    "ruby": (r"""require(?:_relative)?\s+['"]([^'"]+)['"]""",),
    # Three separate searches: on a long line one form may span another. The first
    # goes from an import word by word to the line's first ``from`` with a name. Where
    # there is none, no import before the line's end has one, so it passes over the
    # rest of the line (but for an import at its very end) and finds nothing: every
    # line is read twice at most.
    "javascript": (
        r"""import(?=\s)(?:(?:\s{2,}+from|\s++\S++(?:[^\S\n]++(?!from\s+['"][^'"]+['"])\S++)*+\s++from)"""
        r"""\s++['"]([^'"]+)['"]|(?:[^\ni]++|i(?!mport[^\S\n]*+\n))*+)""",
        r"""import\s+['"]([^'"]+)['"]""",
        r"""require\s*\(\s*['"]([^'"]+)['"]\s*\)""",
    ),
}
_IMPORT_FORMS["typescript"] = _IMPORT_FORMS["javascript"]
_GO_SINGLE = r'import\s+"([^"]+)"'
_GO_BLOCK = r"import\s*\(([^)]*\n)[^\S\n]*\)"
_GO_LINE = r'(?m)^[^"\n]*"([^"\n]+)"'


# ------------------------------------------------------------- SQL building
def _case(branches: dict[str, str], default: str = "NULL") -> str:
    """The branch of the row's language."""
    if not branches:
        return default
    whens = " ".join(f"WHEN {sql_text(name)} THEN {sql}" for name, sql in branches.items())
    return f"CASE language {whens} ELSE {default} END"


def _find_all(source: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract_all({source}, {sql_text('(?d)' + pattern)}, {group})"


def _lines(names: str) -> str:
    """Distinct names as one text, a name per line, for anchored tests."""
    return f"array_join(array_distinct({names}), '\\n')"


def _matches(source: str, pattern: str) -> str:
    return f"{source} RLIKE {sql_text(pattern)}"


def _bits(predicates: list[str]) -> str:
    """Predicate i sets bit i; each is evaluated exactly once.

    Folding an array, rather than chaining ORs, keeps hundreds of patterns out
    of one generated method, which would outgrow the JVM's method size limit.
    """
    if not predicates:
        return "0L"
    each = ", ".join(f"CASE WHEN {p} THEN {1 << i}L ELSE 0L END" for i, p in enumerate(predicates))
    return f"aggregate(array({each}), 0L, (bits, bit) -> bits | bit)"


def _lookup_bits(names: str, bits_of: dict[str, int]) -> str:
    """Bits of the names found in a fixed table: one lookup per name instead
    of one pattern per table entry."""
    table = ", ".join(f"{sql_text(name)}, {bits}L" for name, bits in sorted(bits_of.items()))
    return (f"aggregate({names}, 0L, (bits, name) -> "
            f"bits | coalesce(try_element_at(map({table}), name), 0L))")


# ---------------------------------------------------------------- shapes
def _slot(name: str) -> str:
    return f"_names_{name}"


def _shape_sql(shape: Shape) -> str:
    source = f"_{shape.view}"
    if shape.without:
        source = f"regexp_replace({source}, {sql_text('(?d)' + shape.without)}, '{{')"
    if shape.within:
        source = f"array_join({_find_all(source, shape.within, 0)}, '\\n')"
    if shape.pattern.startswith(r"\n"):
        source = f"concat('\\n', {source})"
    names = _find_all(source, shape.pattern)
    if shape.listed:
        first_word = sql_text(r"^\s*([A-Za-z_][\w.]*)")
        names = (f"transform(split(array_join({names}, ','), ','), "
                 f"n -> regexp_extract(n, {first_word}, 1))")
    if shape.prefix:
        names = f"transform({names}, n -> concat({sql_text(shape.prefix)}, n))"
    return f"lower({_lines(names)})" if shape.lower else _lines(names)


# ----------------------------------------------------------------- rules
class _Compiled:
    """One language's rules as bit positions and what each bit means."""

    def __init__(self, rules: list[Rule]):
        gates = {rule.requires for rule in rules if rule.requires}
        grouped: dict[tuple, list[Rule]] = defaultdict(list)
        for rule in rules:
            # Rules another rule depends on keep a bit of their own.
            opens = next((g for g in gates
                          if not rule.requires and rule.rule_id.startswith(g)), None)
            key = (rule.target, rule.tier, rule.flags, rule.requires, opens)
            grouped[key].append(rule)
        self.groups = list(grouped.values())

    def predicates(self) -> list[str]:
        return [self._predicate(group) for group in self.groups]

    @staticmethod
    def _predicate(group: list[Rule]) -> str:
        """Names are few: one alternation tests them all. Text is long: each
        pattern keeps its own literal start, behind its own substring test."""
        target = group[0].target
        if target == BLOCK_PAIRS:
            return "(" + " OR ".join(pairs_test("_blocks", rule.pattern) for rule in group) + ")"
        if target not in VIEWS:
            alternatives = "|".join(f"(?:{rule.pattern})" for rule in group)
            return _matches(_slot(target), "(?dm)" + alternatives)
        source = f"_{target}"

        def contains(stems) -> str:
            return "(" + " OR ".join(f"contains({source}, {sql_text(s)})" for s in stems) + ")"

        covered: dict[tuple[str, ...], list[str]] = defaultdict(list)
        for rule in group:
            text_of = f"concat('\\n', {source})" if rule.pattern.startswith(r"\n") else source
            test = _matches(text_of, "(?d)" + rule.pattern)
            if len(rule.stems) == 1 and rule.pattern == re.escape(rule.stems[0]):
                test = contains(rule.stems)
            elif rule.stems and rule.stems != rule.cover:
                test = f"({contains(rule.stems)} AND {test})"
            covered[rule.cover].append(test)
        tests = []
        for cover, inner in covered.items():
            either = "(" + " OR ".join(dict.fromkeys(inner)) + ")"
            tests.append(f"({contains(cover)} AND {either})" if cover else either)
        return "(" + " OR ".join(tests) + ")"

    def words(self) -> int:
        """How many bigints the bits of the groups take."""
        return -(-len(self.groups) // _WORD_BITS)

    def mask(self, wanted) -> int:
        """The groups wanted, over all words."""
        return sum(1 << i for i, group in enumerate(self.groups) if wanted(group[0]))

    def gated(self, words: list[str]) -> list[str]:
        """Dependent rules lose their bit where no opening rule is set."""
        out = list(words)
        for gate in sorted({g[0].requires for g in self.groups if g[0].requires}):
            dependent = self.mask(lambda r, g=gate: r.requires == g)
            opening = self.mask(lambda r, g=gate: not r.requires and r.rule_id.startswith(g))
            closed = " AND ".join(
                f"{word} & {mask}L = 0L" for word, mask in zip(words, _split(opening, len(words)))
                if mask) or "true"
            out = [f"CASE WHEN {closed} THEN {bits} & {~mask}L ELSE {bits} END" if mask else bits
                   for bits, mask in zip(out, _split(dependent, len(words)))]
        return out


def _split(mask: int, words: int) -> list[int]:
    """A mask word by word, the lowest first."""
    return [mask >> _WORD_BITS * w & (1 << _WORD_BITS) - 1 for w in range(words)]


def _any_bit(bits: str, masks: dict[str, int]) -> str:
    """Does the row have a bit of its own language's mask?"""
    masks = {name: f"{mask}L" for name, mask in masks.items() if mask}
    return f"({bits} & {_case(masks, '0L')} <> 0L)" if masks else "false"


def _any_word(words: list[str], masks: dict[str, int]) -> str:
    """``_any_bit`` over several words."""
    split = {name: _split(mask, len(words)) for name, mask in masks.items()}
    tests = [_any_bit(word, {name: parts[w] for name, parts in split.items()})
             for w, word in enumerate(words)]
    return "(" + (" OR ".join(t for t in tests if t != "false") or "false") + ")"


def _names_of(bits: str, names: dict[str, list[str]]) -> str:
    """Sorted distinct names whose bit is set."""
    own = _case({
        language: "array(" + ", ".join(map(sql_text, values)) + ")"
        for language, values in names.items() if values}, _NO_NAMES)
    return (f"CASE WHEN {bits} = 0L THEN {_NO_NAMES} ELSE array_sort(array_distinct("
            f"filter({own}, (name, i) -> getbit({bits}, i) = 1))) END")


# --------------------------------------------------------------- library rows
def _http_bits(language: str, rows: list) -> str:
    """Bits of the catalog rows a file's import paths select."""
    lines = "_import_paths"
    paths = f"split({lines}, '\\n')"
    separator = "/" if language in ("javascript", "typescript") else "."
    whole: dict[str, int] = defaultdict(int)
    root: dict[str, int] = defaultdict(int)
    patterns = []
    for i, row in enumerate(rows):
        if row.match == "prefix" or row.contains:
            ahead = f"(?=.*{re.escape(row.contains)})" if row.contains else ""
            patterns.append((i, f"(?dm)^{ahead}{re.escape(row.pattern)}"))
            continue
        whole[row.pattern] |= 1 << i
        if row.match == "exact" and separator not in row.pattern:
            root[row.pattern] |= 1 << i
    parts = []
    if whole:
        parts.append(_lookup_bits(paths, whole))
    if root:
        first = f"transform({paths}, p -> substring_index(p, '{separator}', 1))"
        parts.append(_lookup_bits(first, root))
    each = ", ".join(
        f"CASE WHEN {_matches(lines, p)} THEN {1 << i}L ELSE 0L END" for i, p in patterns)
    if each:
        parts.append(f"aggregate(array({each}), 0L, (bits, bit) -> bits | bit)")
    clients = [c for c in http_libraries.TEXT_CLIENTS if c[0] == language]
    found = f"CASE WHEN {lines} = '' THEN 0L ELSE {' | '.join(parts)} END"
    for k, (_, pattern, stem, _) in enumerate(clients, start=len(rows)):
        found += (f" | CASE WHEN contains(_raw, {sql_text(stem)}) AND "
                  f"{_matches('_raw', '(?d)' + pattern)} THEN {1 << k}L ELSE 0L END")
    return found


def _resilience_bits(language: str, lines: str, rows: list, builders: list) -> str:
    whole: dict[str, int] = defaultdict(int)
    patterns = []
    for i, row in enumerate(rows):
        if row.match == "full" and not row.contains and not row.unless:
            whole[row.pattern] |= 1 << i
            continue
        ahead = f"(?=.*{re.escape(row.contains)})" if row.contains else ""
        ahead += "".join(f"(?!.*{re.escape(word)})" for word in row.unless)
        inside = ".*" if row.match == "contains" else ""
        patterns.append((i, f"(?dm)^{ahead}{inside}{re.escape(row.pattern)}"))
    parts = []
    if whole:
        parts.append(_lookup_bits(f"split({lines}, '\\n')", whole))
    each = ", ".join(
        f"CASE WHEN {_matches(lines, p)} THEN {1 << i}L ELSE 0L END" for i, p in patterns)
    if each:
        parts.append(f"aggregate(array({each}), 0L, (bits, bit) -> bits | bit)")
    found = f"CASE WHEN {lines} = '' THEN 0L ELSE {' | '.join(parts)} END"
    for k, (_, pattern, stem, _) in enumerate(builders, start=len(rows)):
        found += (f" | CASE WHEN contains(_raw, {sql_text(stem)}) AND "
                  f"{_matches('_raw', '(?d)' + pattern)} THEN {1 << k}L ELSE 0L END")
    return found


def _import_paths(language: str) -> str:
    """Import paths of a file as the HTTP library detector sees them."""
    if language == "python":
        named = f"concat_ws('\\n', {_slot('imports')}, {_slot('from_imports')})"
        return f"regexp_replace({named}, '(?m)^(?:import|from) ', '')"
    if language == "go":
        block = f"array_join({_find_all('_raw', _GO_BLOCK)}, '\\n')"
        return _lines(f"concat({_find_all('_raw', _GO_SINGLE)}, {_find_all(block, _GO_LINE)})")
    found = [
        _find_all("concat('\\n', _raw)" if form.startswith(r"\n") else "_raw", form)
        for form in _IMPORT_FORMS[language]]
    return _lines(found[0] if len(found) == 1 else f"concat({', '.join(found)})")


# ------------------------------------------------------------------ assembly
def classify_files(
    files: DataFrame,
    *,
    mode: str = "fixed",
    languages=domain.LANGUAGES,
    rules: list[Rule] | None = None,
    shapes: list[Shape] | None = None,
    libraries: tuple[str, ...] = ("http", "resilience"),
    exact_python: bool = False,
    check_syntax: bool = True,
) -> DataFrame:
    """Detect libraries and signals of every file and label it.

    ``files`` needs ``language`` and ``content``; ``decode_ok`` is honoured if
    present. All other columns pass through. Added: ``parse_status``, ``basic``,
    ``advanced``, ``flags``, ``http_libraries``, ``resilience_libraries``,
    ``label``.

    ``rules`` and ``shapes`` replace the built-in ones; a rule with language
    ``*`` applies to each of ``languages``. ``libraries`` selects which kinds of
    library are looked for. ``check_syntax`` marks Python files whose strings, brackets
    or indentation don't fit together as ``parse_status = 'failed'``, with nothing found
    in them. ``exact_python`` parses Python instead of matching it, which finds every
    syntax error.
    """
    if mode not in ("fixed", "parity"):
        raise ValueError(f"mode must be 'fixed' or 'parity', not {mode!r}")
    rules = signal_rules(mode, languages) if rules is None else list(rules)
    shapes = SHAPES if shapes is None else list(shapes)
    keep = [c for c in files.columns if c != "content"]
    compiled = {
        name: _Compiled([r for r in rules if r.language in (name, "*")]) for name in languages}
    http: dict[str, list] = defaultdict(list)
    resilience: dict[str, list] = defaultdict(list)
    if "http" in libraries:
        for row in http_libraries.http_catalog(mode):
            http[row.language].append(row)
    if "resilience" in libraries:
        for row in resilience_libraries.resilience_catalog():
            resilience[row.language].append(row)

    # Which shapes and views does each language need?
    used_shapes: dict[str, dict[str, Shape]] = {}
    readers: dict[str, set[str]] = defaultdict(set)
    nested: dict[str, str] = {}
    for name in languages:
        targets = {group[0].target for group in compiled[name].groups}
        if resilience[name] or (http[name] and name == "python"):
            targets |= set(IMPORT_SHAPES[name])
        used_shapes[name] = {
            s.name: s for s in shapes if s.language == name and s.name in targets}
        missing = targets - {*VIEWS, BLOCK_PAIRS} - set(used_shapes[name])
        if missing:
            raise ValueError(f"{name}: no such shape: {', '.join(sorted(missing))}")
        for view in (targets & set(VIEWS)) | {s.view for s in used_shapes[name].values()}:
            readers[view].add(name)
        if BLOCK_PAIRS in targets:
            readers["code"].add(name)
            nested[name] = block_pairs_sql("_code", name)

    # The syntax check reads literals as names of their own, which no rule minds.
    check_syntax = check_syntax and not exact_python and "python" in languages and bool(
        readers["code"] & {"python"})
    if check_syntax:
        readers["bare"].add("python")

    # 1. Text views, each built once per file and only where something reads it.
    readable = (F.coalesce("decode_ok", F.lit(True)) if "decode_ok" in files.columns
                else F.col("content").isNotNull())
    out = files.select(
        *keep, text.unify_newlines(F.col("content")).alias("_raw"), readable.alias("_readable"))
    out = out.selectExpr("*", _case({
        name: text.strip_comments_sql("_raw", name) for name in sorted(readers["bare"])
    }, "CAST(NULL AS string)") + " AS _bare")
    out = out.selectExpr("*", _case({
        name: text.mask_strings_sql("_bare", name, "0" if check_syntax and name == "python" else " ")
        if name in readers["bare"]
        else text.mask_code_sql("_raw", name)
        for name in sorted(readers["code"])
    }, "CAST(NULL AS string)") + " AS _code")
    folded = _case({n: "lower(_raw)" for n in sorted(readers["lower"])}, "CAST(NULL AS string)")
    out = out.selectExpr("*", f"{folded} AS _lower")
    parse_ok = "_readable"
    exact_python = exact_python and "python" in languages
    if exact_python:
        out = out.withColumn("_facts", python_facts(
            F.when(F.col("language") == "python", F.col("_raw"))))
        parse_ok = "(_readable AND coalesce(_facts.ok, true))"
    broken = "false"
    if check_syntax:
        out = out.selectExpr(
            "*", f"(CASE WHEN language = 'python' THEN coalesce({unparsable_sql('_code')}, false) ELSE false END) "
            "AS _broken")
        parse_ok, broken = "(_readable AND NOT _broken)", "_broken"

    if nested:
        out = out.selectExpr("*", f"{_case(nested, '0L')} AS _blocks")

    # 2. Names per shape; a slot is shared by the languages that use its name.
    slots: dict[str, dict[str, str]] = defaultdict(dict)
    for name in languages:
        for shape in used_shapes[name].values():
            slots[shape.name][name] = (
                _lines(f"_facts.{shape.name}") if exact_python and name == "python"
                else _shape_sql(shape))
    out = out.selectExpr("*", *(f"{_case(b)} AS {_slot(slot)}" for slot, b in slots.items()))
    paths = {name: _import_paths(name) for name in languages if http[name]}
    out = out.selectExpr("*", f"{_case(paths, 'CAST(NULL AS string)')} AS _import_paths")

    # 3. One bit per rule group and per catalog row.
    words = [f"_signals_{w}" for w in range(max([c.words() for c in compiled.values()], default=0))]
    signal_bits: list[dict[str, str]] = [{} for _ in words]
    library_bits, http_bits = {}, {}
    library_names: dict[str, list[str]] = {}
    http_names: dict[str, list[str]] = {}
    for name in languages:
        predicates = compiled[name].predicates()
        if exact_python and name == "python":
            predicates = [
                "_facts.has_try" if group[0].rule_id == "python.try" else predicate
                for group, predicate in zip(compiled[name].groups, predicates)]
        for w in range(compiled[name].words()):
            signal_bits[w][name] = _bits(predicates[w * _WORD_BITS:(w + 1) * _WORD_BITS])
        if resilience[name]:
            builders = [b for b in resilience_libraries.BUILDER_LIBRARIES if b[0] == name]
            lines = _slot(IMPORT_SHAPES[name][0]) if len(IMPORT_SHAPES[name]) == 1 else (
                "concat_ws('\\n', " + ", ".join(map(_slot, IMPORT_SHAPES[name])) + ")")
            library_bits[name] = _resilience_bits(name, lines, resilience[name], builders)
            library_names[name] = [r.library for r in resilience[name]] + [b[3] for b in builders]
        if http[name]:
            http_bits[name] = _http_bits(name, http[name])
            http_names[name] = [r.canonical for r in http[name]] + [
                c[3] for c in http_libraries.TEXT_CLIENTS if c[0] == name]
    def bits_of(branches: dict[str, str]) -> str:
        found = f"coalesce({_case(branches, '0L')}, 0L)"
        return found if broken == "false" else f"CASE WHEN {broken} THEN 0L ELSE {found} END"

    out = out.selectExpr(
        *(f"`{c}`" for c in keep),
        f"CASE WHEN {parse_ok} THEN 'ok' ELSE 'failed' END AS parse_status",
        *(f"{bits_of(bits)} AS {word}" for word, bits in zip(words, signal_bits)),
        f"{bits_of(library_bits)} AS _libraries",
        f"{bits_of(http_bits)} AS _http",
    )
    # A filter on a label must not be pushed below this point, where it would
    # repeat every pattern. Filters do not move through a generated row.
    facts = ["parse_status", *words, "_libraries", "_http"]
    out = out.select(*keep, F.inline(F.array(F.struct(*facts))))

    # 4. Read tiers, flags and names off the bits.
    gated = {name: compiled[name].gated(words) for name in languages}
    gates = {word: {name: sqls[w] for name, sqls in gated.items() if sqls[w] != word}
             for w, word in enumerate(words)}
    if any(gates.values()):
        out = out.withColumns({
            word: F.expr(_case(by_name, word)) for word, by_name in gates.items() if by_name})

    def rule_mask(wanted) -> dict[str, int]:
        return {name: compiled[name].mask(wanted) for name in languages}

    def library_mask(wanted) -> dict[str, int]:
        return {name: sum(1 << i for i, row in enumerate(resilience[name]) if wanted(row))
                for name in library_names}

    known = list(domain.ALL_FLAGS)
    known += sorted({f for rule in rules for f in rule.flags} - set(known))
    flags = []
    for flag in known:
        by_rule = rule_mask(lambda rule, f=flag: f in rule.flags)
        by_library = library_mask(lambda row, f=flag: f in row.flags)
        if any(by_rule.values()) or any(by_library.values()):
            flags.append(
                f"CASE WHEN {_any_word(words, by_rule)} OR "
                f"{_any_bit('_libraries', by_library)} THEN {sql_text(flag)} END")
    found = f"array_compact(array({', '.join(flags)}))" if flags else _NO_NAMES
    # Importing a resilience library is itself an advanced signal.
    advanced = (f"{_any_word(words, rule_mask(lambda r: r.tier == 'advanced'))} OR "
                f"{_any_bit('_libraries', library_mask(lambda _: True))}")
    out = out.selectExpr(
        *(f"`{c}`" for c in keep), "parse_status",
        f"{_any_word(words, rule_mask(lambda r: r.tier == 'basic'))} AS basic",
        f"({advanced}) AS advanced",
        f"{found} AS flags",
        f"{_names_of('_http', http_names)} AS http_libraries",
        f"{_names_of('_libraries', library_names)} AS resilience_libraries",
    )
    return out.withColumn("label", scalars.file_label(F.col("basic"), F.col("advanced")))


def detect_signals(files: DataFrame, **options) -> DataFrame:
    """Signals and labels only."""
    out = classify_files(files, **{"libraries": ("resilience",), **options})
    return out.drop("http_libraries")


def detect_http_libraries(files: DataFrame, mode: str = "fixed",
                          languages=domain.LANGUAGES) -> DataFrame:
    """HTTP client libraries only: no signal rule runs, and a row whose
    language is unknown gets an empty list."""
    out = classify_files(files, mode=mode, languages=languages, rules=[], libraries=("http",))
    return out.drop("basic", "advanced", "label", "flags", "resilience_libraries").withColumn(
        "has_http_library", F.size("http_libraries") > 0)


def canonical_flags(flags: Column) -> Column:
    """Native error handling under its canonical name, next to the raw flag."""
    native = scalars.literal_map(domain.CANONICAL_FLAG)
    named = F.transform(flags, lambda f: F.try_element_at(native, f))
    return F.array_distinct(F.concat(flags, F.array_compact(named)))


def merge_flags(left: Column, right: Column) -> Column:
    """Flags of two detectors over one file: either one setting it suffices."""
    empty = F.array().cast("array<string>")
    return F.array_sort(F.array_union(F.coalesce(left, empty), F.coalesce(right, empty)))


def rules_from_table(table: DataFrame) -> list[Rule]:
    """Rules kept as a table: ``rule_id, language, target, pattern, tier, flags
    array<string>``, and any of a rule's other fields as columns. Rules are
    configuration that is compiled into the plan, so the table comes to the driver."""
    fields = {f.name: f for f in dataclasses.fields(Rule)}

    def rule(row: dict) -> Rule:
        given = {k: tuple(v) if isinstance(v, list) else v
                 for k, v in row.items() if k in fields and v is not None}
        return Rule(**{"flags": (), "tier": None, **given})

    return [rule(r.asDict()) for r in table.collect()]
