"""Signal rules as data. The names and patterns are fixed values: they decide
what counts.

A *shape* says how names of one syntactic kind (calls, imports, class names...)
are lifted out of a file. A *rule* tests the names of one shape, or the text
itself, and says which tier (``basic`` / ``advanced`` / none) and which flags
follow. ``faultlens.operators.signals`` compiles both into Column expressions.

Views of the text a shape or rule reads:

* ``raw``   - as written;
* ``lower`` - as written, in lower case, for rules that ignore case;
* ``bare``  - comments removed;
* ``code``  - comments removed and string literals blanked;
* ``blocks`` - pairs of what stands inside what, such as ``catch>status``, see ``blocks``.

Names reach a rule one per line, so ``^`` and ``$`` anchor a whole name.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from faultlens.catalogs.domain import LANGUAGES


@dataclass(frozen=True)
class Shape:
    language: str
    name: str
    view: str
    pattern: str
    lower: bool = False
    # Read names only inside matches of ``within`` / after removing ``without``.
    within: str | None = None
    without: str | None = None
    # Names come as a comma list: split, keep the first word of each item.
    listed: bool = False
    prefix: str = ""


@dataclass(frozen=True)
class Rule:
    rule_id: str
    language: str
    target: str  # a shape name, or "raw" / "lower" / "bare" / "code" for the text itself
    pattern: str
    tier: str | None = None
    flags: tuple[str, ...] = ()
    # Holds only where a rule whose id starts with this holds too.
    requires: str | None = None
    # One of these must occur in the text for the pattern to match; a plain
    # substring test is far cheaper than the pattern it saves.
    stems: tuple[str, ...] = ()
    # Shared by the patterns of one rule: every match of any of them contains
    # one of these, so text without them is dismissed in a test or two.
    cover: tuple[str, ...] = ()
    # "fixed": an addition over the published behaviour, absent in parity mode.
    only: str | None = None
    enabled: bool = True


B, A = "basic", "advanced"


def _is(*names: str) -> str:
    return "^(?:" + "|".join(names) + ")$"


def _has(*parts: str) -> str:
    return "(?:" + "|".join(parts) + ")"


# --------------------------------------------------------------------------
# Shapes
# --------------------------------------------------------------------------
# Patterns begin with a literal or one character class wherever they can, and
# look behind from there: the engine then skips text it cannot match quickly.
# A leading \n stands for a line start (the text gets one in front).
_NAME = r"[A-Za-z_]\w*+"
_IDENT = r"[A-Za-z_$][\w$]*+"

SHAPES: list[Shape] = [
    Shape("python", "imports", "code", r"\n[ \t]*+import[ \t]++([^\n;]++)",
          listed=True, prefix="import "),
    Shape("python", "from_imports", "code",
          r"\n[ \t]*+from[ \t]++\.*+([A-Za-z_][\w.]*+)[ \t]++import\b", prefix="from "),
    Shape("python", "calls", "code",
          rf"\b(?=[A-Za-z_])(?<!\.)(?<!\bdef\s{{1,4}})(?<!\bclass\s{{1,4}})({_NAME})\s*+\(",
          lower=True),
    Shape("python", "attribute_calls", "code", rf"\.\s*+({_NAME})\s*+\(", lower=True),
    Shape("python", "decorators", "code",
          rf"\n[ \t]*+@({_NAME})[ \t]*+(?=\n(?:[ \t]*@[^\n]*\n)*+[ \t]*def\b)", lower=True),

    Shape("java", "imports", "code", r"\n[^\S\n]*+import\s++(?:static\s++)?([A-Za-z_][\w.]*\w)"),
    Shape("java", "annotations", "code", rf"@({_NAME})"),
    Shape("java", "created", "code", r"new(?<=\bnew)\s++(?:\w++\s*+\.\s*+)*+(\w++)\s*+(?=[(<])"),
    Shape("java", "extended", "code", r"extends(?<=\bextends)\s++(?:\w++\s*+\.\s*+)*+(\w++)"),
    Shape("java", "calls", "code",
          r"[.;{}(,=!&|?:+*>n-](?:(?<=[^>n])|(?<=->)|(?<=\breturn)(?=\s))\s*+"
          rf"(?:(?<=\.)<[^<>()]*>\s*+)?(?!return\b|new\b)({_NAME})(?=\s*+\()", lower=True),

    Shape("go", "imports", "bare", r'"([^"\n]+)"',
          within=r"import(?<=\bimport)\s*+(?:\([^)]*\)|[^\n(]*)"),
    Shape("go", "selector_calls", "code",
          rf"\b(?=[A-Za-z_])(?<!\.)({_NAME}\s*+\.\s*+{_NAME})\s*+\("),
    Shape("go", "chained_calls", "code", rf"\.\s*+({_NAME})\s*+\("),
    Shape("go", "calls", "code",
          rf"\b(?=[A-Za-z_])(?<!\.)(?<!\bfunc\s{{1,4}})(?<!\)\s{{1,2}})({_NAME})\s*+\(",
          lower=True),
    Shape("go", "literals", "code", rf"\b(?=[A-Za-z_])(?<!\.)({_NAME}\.{_NAME})\s*+\{{",
          without=r"\b(?:if|for|switch|select|case)\b[^\n{]*\{"),

    Shape("ruby", "requires", "raw", r"""require\s+['"]([^'"]+)['"]"""),
    Shape("ruby", "sent", "code", r"\.(?<![&.]\.)\s*+([a-z_]\w*+)", lower=True),
    Shape("ruby", "called", "code",
          r"\b(?=[a-z_])(?<![.:@$])(?<!\bdef\s{1,4})(?<!\bdef self\.)([a-z_]\w*+[?!]?)"
          r"(?=\(|[ \t]+do\b|[ \t]*\{|[ \t]+[a-z_]\w*:[ \t])", lower=True),

    Shape("csharp", "usings", "code",
          r"\n[^\S\n]*+(?:global\s++)?using\s++(?:static\s++)?(?:\w++\s*+=\s*+)?"
          r"([A-Za-z_][\w.]*+)\s*+;"),
    Shape("csharp", "invoked", "code",
          r"(?=[.A-Za-z_])(?<![\w.])"
          r"(?:(?<![\w>\]?][ \t]{1,2})|(?<=\b(?:await|return)[ \t]{1,2}))"
          r"(\.?[A-Za-z_][\w.]*+)(?:<[^<>()\n]*>)?\s*+\(", lower=True),
    Shape("csharp", "created", "code",
          r"new(?<=\bnew)\s++([A-Za-z_][\w.]*+(?:<[^()\n]*?>)?)\s*+(?=[({\[])"),
    Shape("csharp", "classes", "code", rf"class(?<=\bclass)\s++({_NAME})"),

    Shape("kotlin", "imports", "raw", r"\n[^\S\n]*+import\s++([\w.]++)"),
    Shape("swift", "imports", "raw", r"\n[^\S\n]*+import\s++(\w++)"),
]

_SCRIPT_SHAPES = [
    Shape("javascript", "calls", "code",
          r"(?=[A-Za-z_$])(?<![\w$.])(?<!\b(?:function|new)\s{1,4})"
          rf"(?<!\bfunction\s{{0,2}}\*\s{{0,2}})({_IDENT})\s*+\((?![^()]*\)\s*\{{)", lower=True),
    Shape("javascript", "method_calls", "code",
          rf"(?=[A-Za-z_$])(?<![\w$.])({_IDENT}\s*+\.\s*+{_IDENT})\s*+\(", lower=True),
    Shape("javascript", "property_calls", "code",
          rf"\.(?<![.?]\.)\s*+({_IDENT})\s*+\(", lower=True),
    Shape("javascript", "classes", "code", rf"class(?<=\bclass)\s++({_IDENT})", lower=True),
    Shape("javascript", "created", "code",
          rf"new(?<=\bnew)\s++({_IDENT})(?!\s*+\.)", lower=True),
]
SHAPES += _SCRIPT_SHAPES
SHAPES += [replace(shape, language="typescript") for shape in _SCRIPT_SHAPES]
SHAPES += [
    Shape("javascript", "imports", "bare",
          r"[ir](?:(?<=\bi)mport\s*+(?:[\w$*\s{},]*\bfrom\s*+)?|(?<=\br)equire\s*+\(\s*+)"
          r"""['"]([^'"\n]+)['"]"""),
    Shape("javascript", "keys", "bare", rf"""[{{,]\s*+['"]?({_IDENT})['"]?\s*+:(?!:)""",
          lower=True),
    Shape("javascript", "short_keys", "code", rf"[{{,]\s*+({_IDENT})\s*+(?=[,}}])", lower=True,
          within=r"\{(?<!\b(?:import|export)\s{0,4}\{)[\w$\s,:.]*+\}(?!\s*+from\b)"),
    Shape("typescript", "imports", "bare",
          r"""import(?<=\bimport)\s*+(?:[\w$*\s{},]*\bfrom\s*+)?['"]([^'"\n]+)['"]"""),
    Shape("typescript", "keys", "bare", rf"""[{{,]\s*+['"]?({_IDENT})['"]?\s*+:(?!:)""",
          lower=True,
          without=r"(?=[it(])(?:\binterface\s+\w[^{]*\{[^}]*\}|\btype\s+\w+[^={;]*=\s*\{[^}]*\}"
                  r"|\([^()]*\)(?=\s*(?::[^=;{}()]*)?(?:\{|=>)))"),
    Shape("typescript", "decorators", "code",
          rf"@(?<![\w$.]@)({_IDENT})(?!\s*+\.)", lower=True),
    Shape("typescript", "types", "code",
          rf"[it](?:(?<=\bi)nterface|(?<=\bt)ype)\s++({_IDENT})(?=\s*[<={{]|\s+extends\b)",
          lower=True),
]

# Names that import rules test, per language.
IMPORT_SHAPES = {
    "python": ("imports", "from_imports"), "java": ("imports",), "javascript": ("imports",),
    "typescript": ("imports",), "go": ("imports",), "ruby": ("requires",),
    "csharp": ("usings",), "kotlin": ("imports",), "swift": ("imports",),
}

# --------------------------------------------------------------------------
# Rules
# --------------------------------------------------------------------------
RULES: list[Rule] = []


def _rules(language: str, *rows: tuple, **extra) -> None:
    """Rows of (id, target, pattern, tier, flags, options). Several patterns
    make several rules; a pattern may bring the stem it cannot match without."""
    for row in rows:
        rule_id, target, patterns, tier, *rest = row
        flags = tuple(rest[0]) if rest else ()
        options = {**extra, **(rest[1] if len(rest) > 1 else {})}
        for pattern in patterns if isinstance(patterns, list) else [patterns]:
            stem, pattern = pattern if isinstance(pattern, tuple) else (None, pattern)
            given = {"stems": (stem,)} if stem else {}
            RULES.append(Rule(f"{language}.{rule_id}", language, target, pattern, tier, flags,
                              **{**given, **options}))


def _word(word: str, after: str = "", stem: str | None = None) -> tuple[str, str]:
    """``\\bword`` and what follows, the word first: plain text in front is what
    the regex engine searches for fastest."""
    return stem or word, rf"{word}(?<=\b{word}){after}"


def _text(literal: str, after: str = "") -> tuple[str, str]:
    """A literal, at no particular boundary, and what follows."""
    return literal, re.escape(literal) + after


_rules(
    "python",
    ("try", "code", r"\n[ \t]*+(?:try|except)\b[^\n]*:", B, ["try_catch"],
     {"stems": ("try", "except")}),
    ("status_call", "attribute_calls", _is("status_code", "raise_for_status"), B, ["status_check"]),
    ("timeout_call", "calls", _is("timeout"), A, ["timeout"]),
    ("retry_call", "calls", _is("retry"), A, ["retry"]),
    ("breaker_call", "calls", _is("circuitbreaker", "circuit_breaker"), A, ["circuit_breaker"]),
    ("backoff_call", "calls", _is("backoff"), A, ["exponential_backoff"]),
    ("retry_method", "attribute_calls", _is("retry", "with_retry"), A, ["retry"]),
    ("timeout_method", "attribute_calls", _is("timeout", "with_timeout"), A, ["timeout"]),
    ("backoff_method", "attribute_calls", _is("with_backoff", "exponential_backoff"), A,
     ["exponential_backoff"]),
    ("retry_decorator", "decorators", _is("retry"), A, ["retry"]),
    ("timeout_decorator", "decorators", _is("timeout"), A, ["timeout"]),
    ("breaker_decorator", "decorators", _is("circuitbreaker", "circuit_breaker"), A,
     ["circuit_breaker"]),
)

#: A loop that goes on after a failure it has caught: its catch block waits or starts the next round.
_RETRIES = "caught_loop>wait|caught_loop>again"

# Java, read as written: annotations count inside comments too.
_CALL, _OF = r"\s*\(", r"\.of\("


def _annotations(*names: str) -> list[tuple[str, str]]:
    return [_text("@" + name, r"\b") for name in names]


_rules(
    "java",
    ("raw.retry", "raw",
     [*_annotations("Retryable", "Retry"),
      _word("Retry", r"(?:(?:Config|Registry|Template)\b|\.of\()"),
      _text(".retry("), _text(".withRetry("), _word("retryTemplate", r"\.execute\(")],
     A, ["retry"], {"cover": ("etry",)}),
    ("raw.breaker", "raw",
     [*_annotations("HystrixCommand", "CircuitBreaker"), _word("HystrixCommand", r"\b"),
      _word("CircuitBreaker", r"(?:(?:Config|Registry)\b|\.of\()"),
      _text(".circuitBreaker("), _text("withCircuitBreaker(")],
     A, ["circuit_breaker"], {"cover": ("HystrixCommand", "ircuitBreaker")}),
    ("raw.timeout", "raw",
     [*_annotations("TimeLimiter"), _word("TimeLimiter", r"(?:(?:Config|Registry)\b|\.of\()"),
      _text(".timeout("), _text("withTimeLimiter(")],
     A, ["timeout"], {"cover": ("TimeLimiter", ".timeout(")}),
    ("raw.backoff", "raw",
     [*_annotations("Backoff"), _word("ExponentialBackOff", r"\b"), _word("BackOffPolicy", r"\b")],
     A, ["exponential_backoff"], {"cover": ("Backoff", "BackOff")}),
    ("raw.advice", "raw", _annotations("ControllerAdvice", "RestControllerAdvice"), None,
     ["global_exception_handler"], {"cover": ("ControllerAdvice",)}),
    ("raw.handler", "raw", _annotations("ExceptionHandler"), None, ["exception_handler"]),
)

# Java, by shape. A call counts for the first family it belongs to.
_FAMILIES = ("retry", "timeout|timelimit", "breaker", "backoff|exponential|waitstrategy",
             "bulkhead", "ratelimit|throttle", "fallback")


def _family(k: int) -> str:
    earlier = "|".join(_FAMILIES[:k])
    return (rf"^(?!.*(?:{earlier}))" if earlier else "^") + rf".*(?:{_FAMILIES[k]})"


_rules(
    "java",
    ("try", "code", [_word("catch", r"\s*+\("), _word("try", r"\s*+[({]")], B, ["try_catch"]),
    ("throw", "code", [_word("throw", r"\s"), ("throws", r"\)\s*+throws\s")], B),
    ("status_call", "calls", _is("statuscode", "getstatuscode"), B, ["status_check"]),
    ("catch_status", "blocks", "catch>status", None, ["status_check"]),
    ("retry_loop", "blocks", _RETRIES, A, ["retry"], {"only": "fixed"}),
    ("retry_annotation", "annotations", _is("Retryable", "Retry"), A, ["retry"]),
    ("backoff_annotation", "annotations", _is("Backoff"), A, ["exponential_backoff"]),
    ("breaker_annotation", "annotations", _is("HystrixCommand", "CircuitBreaker"), A,
     ["circuit_breaker"]),
    ("timeout_annotation", "annotations", _is("TimeLimiter"), A, ["timeout"]),
    ("other_annotation", "annotations",
     _is("Recover", "HystrixCollapser", "RateLimiter", "Bulkhead"), A),
    ("retry_new", "created", r"^(?:RetryConfig|RetryTemplate)$|RetryRegistry", A, ["retry"]),
    ("breaker_new", "created",
     r"^CircuitBreakerConfig$|CircuitBreakerRegistry|HystrixCommand|HystrixObservableCommand",
     A, ["circuit_breaker"]),
    ("timeout_new", "created", r"^TimeLimiterConfig$|TimeLimiterRegistry", A, ["timeout"]),
    ("backoff_new", "created",
     r"BackOffPolicy|ExponentialBackOff|FixedBackOff|UniformRandomBackOff", A,
     ["exponential_backoff"]),
    ("other_new", "created",
     r"BulkheadConfig|BulkheadRegistry|RateLimiterConfig|RateLimiterRegistry"
     r"|^(?:RetryPolicy|CircuitBreaker|Timeout|Fallback)$", A),
    ("breaker_extends", "extended", r"HystrixCommand|HystrixObservableCommand", A,
     ["circuit_breaker"]),
    ("retry_call", "calls", _family(0), A, ["retry"]),
    ("timeout_call", "calls", _family(1), A, ["timeout"]),
    ("breaker_call", "calls", _family(2), A, ["circuit_breaker"]),
    ("backoff_call", "calls", _family(3), A, ["exponential_backoff"]),
    ("bulkhead_call", "calls", _family(4), A),
    ("limit_call", "calls", _family(5), A),
    ("fallback_call", "calls", _family(6), A),
)

# JavaScript and TypeScript share calls, classes and constructions.
for _language in ("javascript", "typescript"):
    _rules(
        _language,
        ("try", "code", _word("try", r"\s*+\{"), B, ["try_catch"]),
        ("timeout_call", "calls", _has("timeout"), A, ["timeout"]),
        ("retry_call", "calls", _has("retry"), A, ["retry"]),
        ("breaker_call", "calls", _has("breaker"), A, ["circuit_breaker"]),
        ("backoff_call", "calls", _has("backoff"), A, ["exponential_backoff"]),
        ("limit_call", "calls", _has("limit", "throttle"), A, ["rate_limiting"]),
        ("status_call", "property_calls", _is("status", "statuscode"), B, ["status_check"]),
        ("race", "method_calls", r"^promise\.race$", A, ["timeout"]),
        ("breaker_method", "method_calls",
         r"^[^.\n]*(?:breaker|circuit)[^.\n]*\.(?:fire|execute|call|run)$", A, ["circuit_breaker"]),
        ("retry_object", "method_calls", r"^[^.\n]*retry[^.\n]*\.", A, ["retry"]),
        ("limit_method", "method_calls",
         r"^(?:[^.\n]*(?:limit|throttle)[^.\n]*|bottleneck)\.(?:schedule|submit|wrap)$", A,
         ["rate_limiting"]),
        ("timeout_key", "keys", _is("timeout"), A, ["timeout"]),
        ("backoff_key", "keys", r"backoff|^retrydelay$", A, ["exponential_backoff"]),
        ("breaker_class", "classes", _has("breaker"), A, ["circuit_breaker"]),
        ("retry_class", "classes", _has("retry"), A, ["retry"]),
        ("limit_class", "classes", _has("limiter", "throttle"), A, ["rate_limiting"]),
        ("breaker_new", "created", _has("breaker"), A, ["circuit_breaker"]),
        ("limit_new", "created", _is("bottleneck"), A, ["rate_limiting"]),
        ("abort_new", "created", _is("abortcontroller"), A, ["timeout"]),
        ("retry_loop", "blocks", _RETRIES, A, ["retry"], {"only": "fixed"}),
    )

_rules(
    "javascript",
    ("status_member", "code", r"\.(?<![.?]\.)\s*+status(?:Code)?(?![\w$])", B,
     ["status_check"], {"stems": ("status",)}),
    ("catch_member", "code", r"\.(?<![.?]\.)\s*+catch(?![\w$])", B, ["promise_catch"],
     {"stems": ("catch",)}),
    ("axios_retry", "method_calls", r"^[^.\n]*axios[^.\n]*\..*retry", A, ["retry"]),
    ("retry_key", "keys", _is("retries", "retry", "maxretries"), A, ["retry"]),
    ("breaker_key", "keys", r"breaker|^threshold$", A, ["circuit_breaker"]),
    ("timeout_short_key", "short_keys", _is("timeout"), A, ["timeout"]),
    ("retry_short_key", "short_keys", _is("retries", "retry", "maxretries"), A, ["retry"]),
    ("backoff_short_key", "short_keys", r"backoff|^retrydelay$", A, ["exponential_backoff"]),
    ("breaker_short_key", "short_keys", r"breaker|^threshold$", A, ["circuit_breaker"]),
    ("response_ok", "code", [(".ok", r"\.ok\b(?<=\bres(?:p|ponse)?\.ok)")], B, ["status_check"],
     {"only": "fixed"}),
)
_rules(
    "typescript",
    ("catch_call", "property_calls", _is("catch"), B, ["promise_catch"]),
    ("retry_key", "keys", _is("retries", "retry", "maxretries", "maxattempts"), A, ["retry"]),
    ("breaker_key", "keys", r"breaker|^(?:threshold|errorthreshold)$", A, ["circuit_breaker"]),
    ("retry_method", "property_calls", _is("retry", "retrywhen"), A, ["retry"]),
    ("any_decorator", "decorators", r"^.", A, ["decorator"]),
    ("retry_decorator", "decorators", _has("retry"), A, ["retry"]),
    ("timeout_decorator", "decorators", _has("timeout"), A, ["timeout"]),
    ("breaker_decorator", "decorators", _has("breaker"), A, ["circuit_breaker"]),
    ("backoff_decorator", "decorators", _has("backoff"), A, ["exponential_backoff"]),
    ("limit_decorator", "decorators", _has("ratelimit", "throttle"), A, ["rate_limiting"]),
    ("response_ok", "code", [(".ok", r"\.ok\b(?<=\bres(?:p|ponse)?\.ok)")], B, ["status_check"],
     {"only": "fixed"}),
)
_rules(
    "typescript",
    ("retry_type", "types", _has("retry"), A, ["retry"]),
    ("breaker_type", "types", _has("breaker"), A, ["circuit_breaker"]),
    ("timeout_type", "types", _has("timeout"), A, ["timeout"]),
    ("backoff_type", "types", _has("backoff"), A, ["exponential_backoff"]),
)

_rules(
    "go",
    ("err_check", "code",
     r"\bif\s+(?:[^{};\n]*;\s*)?(?:err\s*[!=]=\s*nil|nil\s*[!=]=\s*err)\s*\{", B, ["error_check"],
     {"stems": ("err",)}),
    ("err_init", "code", r"\bif\s+(?:\w+\s*,\s*)*+err\s*(?:,\s*\w+\s*)*+:?=[^=]", B,
     ["error_check"], {"stems": ("err",)}),
    ("defer", "code", _word("defer", r"\s"), B),
    ("recover", "blocks", "literal>recover", B, ["defer_recover"]),
    ("defer_recover", "code", _word("defer", r"\s++recover\s*+\("), B, ["defer_recover"]),
    ("retry_loop", "blocks", _RETRIES, A, ["retry"], {"only": "fixed"}),
    ("wait_loop", "blocks", "caught_loop>wait", A, ["exponential_backoff"], {"only": "fixed"}),
    ("status_call", "chained_calls", _is("StatusCode", "Code", "Status"), B, ["status_check"]),
    ("context_timeout", "selector_calls", r"^context\.(?:WithTimeout|WithDeadline)$", A,
     ["timeout"]),
    ("context_cancel", "selector_calls", r"^context\.WithCancel$", A),
    ("timer", "selector_calls", r"^time\.(?:After|NewTimer)$", A, ["timeout"]),
    ("backoff_package", "selector_calls", r"^[^.\n]*backoff[^.\n]*\.", A, ["exponential_backoff"]),
    ("backoff_method", "chained_calls", r"(?i)backoff", A, ["exponential_backoff"]),
    ("retry_method", "chained_calls", r"(?i)retry", A, ["retry"]),
    ("breaker_method", "chained_calls", r"(?i)breaker", A, ["circuit_breaker"]),
    ("breaker_call", "selector_calls", r"^[^.\n]*breaker[^.\n]*\.Call$", A, ["circuit_breaker"]),
    ("timeout_method", "chained_calls", r"(?i)timeout|deadline", A, ["timeout"]),
    ("failover_method", "chained_calls", r"(?i)failover", A),
    ("retry_call", "calls", _has("retry"), A, ["retry"]),
    ("backoff_call", "calls", _has("backoff"), A, ["exponential_backoff"]),
    ("backoff_literal", "literals", r"(?i)\..*backoff", A, ["exponential_backoff"]),
    ("breaker_literal", "literals", r"(?i)^[^.\n]*breaker[^.\n]*\..*(?:breaker|settings)", A,
     ["circuit_breaker"]),
    ("retry_literal", "literals", r"(?i)\..*(?:retry|policy)", A, ["retry"]),
    ("client_timeout", "code", _text("http.Client", r"\s*+\{[^}]*\bTimeout\s*:"), A, ["timeout"],
     {"only": "fixed"}),
)

for _shape in ("sent", "called"):
    _rules(
        "ruby",
        (f"timeout_{_shape}", _shape, _has("timeout"), A, ["timeout"]),
        (f"retry_{_shape}", _shape, r"retry|^(?:retryable|retriable)$", A, ["retry"]),
        (f"breaker_{_shape}", _shape, _has("circuit", "breaker"), A, ["circuit_breaker"]),
        (f"backoff_{_shape}", _shape, _has("backoff", "exponential"), A, ["exponential_backoff"]),
        (f"limit_{_shape}", _shape, _has("throttle", "rate_limit"), A, ["rate_limiting"]),
        (f"status_{_shape}", _shape, _is("code", "status", "status_code", "response_code"), B,
         ["status_check"]),
    )
_rules(
    "ruby",
    ("rescue", "code", r"(?<![:.\w])rescue\b(?!:(?!:))", B, ["rescue"], {"stems": ("rescue",)}),
    ("ensure", "code", r"(?m)(?<![:.\w])ensure[ \t]*$", B, ["ensure"], {"stems": ("ensure",)}),
    ("httparty_call", "code", r"\bHTTParty\s*\.\s*[a-z_]", A, [], {"stems": ("HTTParty",)}),
    ("timeout_const", "code", r"(?<!\w)Timeout(?!\w)", A, ["timeout"], {"stems": ("Timeout",)}),
    ("breaker_const", "code", r"(?<!\w)(?:[A-Z]\w*)?Circuit\w*|(?<!\w)Semian(?!\w)", A,
     ["circuit_breaker"], {"stems": ("Circuit", "Semian")}),
    ("retry_const", "code", r"(?<!\w)(?:Retryable|Retriable)(?!\w)", A, ["retry"],
     {"stems": ("Retryable", "Retriable")}),
    ("backoff_option", "code",
     r"\b(?:retryable|retriable)\b[^\n]*?\w*(?:backoff|exponential)\w*:", A,
     ["exponential_backoff"], {"stems": ("backoff", "exponential")}),
    ("retry_loop", "blocks", "caught_loop>again|caught_loop>wait", A, ["retry"], {"only": "fixed"}),
    ("wait_retry", "blocks", "catch>wait&catch>again", A, ["exponential_backoff"], {"only": "fixed"}),
    ("retry_keyword", "code", r"(?m)^[ \t]*retry\b[ \t]*(?:$|if\b|unless\b)", A, ["retry"],
     {"only": "fixed", "stems": ("retry",)}),
)

_rules(
    "csharp",
    ("try", "code", _word("try", r"\s*+\{"), B, ["try_catch"]),
    ("status_call", "invoked", _has("statuscode"), B, ["status_check"]),
    ("timeout_call", "invoked", _has("timeout"), A, ["timeout"]),
    ("retry_call", "invoked", _has("retry"), A, ["retry"]),
    ("breaker_call", "invoked", _has("breaker"), A, ["circuit_breaker"]),
    ("backoff_call", "invoked", _has("backoff"), A, ["exponential_backoff"]),
    ("execute_call", "invoked", _has("executeasync", "executeandcapture"), A),
    ("fallback_call", "invoked", _has("fallback"), A),
    ("policy_new", "created", _has("Policy", "ResiliencePipeline"), A),
    ("breaker_new", "created", _has("CircuitBreaker"), A, ["circuit_breaker"]),
    ("retry_new", "created", _has("Retry"), A, ["retry"]),
    ("timeout_new", "created", _has("Timeout", "CancellationTokenSource"), A, ["timeout"]),
    ("breaker_class", "classes", _has("CircuitBreaker"), A, ["circuit_breaker"]),
    ("retry_class", "classes", _has("Retry"), A, ["retry"]),
    ("timeout_class", "classes", _has("Timeout"), A, ["timeout"]),
    ("retry_method", "blocks", "retry_method>loop|retry_method>bare_loop", A, ["retry"]),
    ("retry_loop", "blocks", _RETRIES, A, ["retry"], {"only": "fixed"}),
    ("timeout_token", "code",
     r"\w*(?i:timeout)\w*\s*(?:<[^<>()]*>\s*)?\([^)]*\bCancellationToken\b[^)]*\)\s*(?:\{|=>)",
     A, ["timeout"], {"stems": ("CancellationToken",)}),
    ("success_member", "code", ("IsSuccessStatusCode", r"\.\s*+IsSuccessStatusCode\b"), B,
     ["status_check"], {"only": "fixed"}),
)

_KOTLIN_STATUS = r"\s*+\.\s*+(?:code\s*+\(\s*+\)|status)"
_WITH_TIMEOUT = _word("withTimeout", r"(?:OrNull)?\s*+\(")
_rules(
    "kotlin",
    ("try", "raw", ("catch", r"try(?<=\btry)\s*+\{[^}]*+\}\s*+catch\b"), B, ["try_catch"]),
    ("status", "raw",
     [_word("response", _KOTLIN_STATUS), _word("result", _KOTLIN_STATUS),
      _word("code", r"\s*+==\s*+\d"), _word("status", r"(?:Code)?\s*+==\s*+\d"),
      _word("isSuccessful", r"\s*+\(\s*+\)"), _word("is2xxSuccessful"),
      _word("is4xxClientError"), _word("is5xxServerError")],
     B, ["status_check"], {"cover": ("code", "status", "Successful", "is4xx", "is5xx")}),
    ("timeout", "raw",
     [_WITH_TIMEOUT,
      *(_word(f"{part}Timeout", _CALL) for part in ("connect", "read", "write", "call")),
      _word("timeout", r"\s*+[(:=]"), _word("Timeout", r"\s*+\."),
      _word("requestTimeoutMillis", r"\s*+="),
      _word("install", r"\s*+\(\s*+HttpTimeout\s*+\)", stem="HttpTimeout")],
     A, ["timeout"], {"cover": ("imeout",)}),
    ("retry", "raw",
     [_word("retry", r"(?:Async)?\s*+\{"), _word("Retry", r"\.of"),
      _word("install", r"\s*+\(\s*+HttpRequestRetry\s*+\)", stem="HttpRequestRetry"),
      _word("fun", r"\s++\w*[Rr]etry\w*+\s*+\(", stem="etry"),
      *(_word(name, r"\s*+[:=]") for name in ("retries", "maxRetries", "retryCount")),
      _word("repeat", _CALL)],
     A, ["retry"], {"cover": ("etry", "etries", "repeat")}),
    ("retry_loop", "lower", _word("while", r"\s*+\([^)]*retry", stem="retry"), A, ["retry"]),
    ("backoff", "lower", [_text("exponential"), _text("backoff")], None,
     ["exponential_backoff"], {"requires": "kotlin.retry"}),
    ("breaker", "raw",
     [_word("circuitBreaker", r"\s*+\{"), _word("CircuitBreaker", r"\.of"),
      _word("val", r"\s++\w*[Cc]ircuit\w*+\s*+=", stem="ircuit"),
      _word("var", r"\s++\w*[Bb]reaker\w*+\s*+=", stem="reaker")],
     A, ["circuit_breaker"], {"cover": ("ircuit", "reaker")}),
    ("breaker_class", "lower", _word("class", r"\s++\w*circuitbreaker", stem="circuitbreaker"), A,
     ["circuit_breaker"]),
    ("coroutines", "raw",
     [_WITH_TIMEOUT, _word("SupervisorJob", _CALL), _word("supervisorScope", r"\s*+\{"),
      _word("CoroutineExceptionHandler", r"\s*+\{")],
     A, ["coroutine_timeout", "timeout"], {"cover": ("withTimeout", "upervisor", "CoroutineException")}),
    ("limit", "lower", [_word(name, _CALL) for name in ("ratelimit", "throttle", "semaphore")], A,
     ["rate_limiting"]),
)

_rules(
    "swift",
    ("do", "raw", ("catch", r"do(?<=\bdo)\s*+\{[^}]*+\}\s*+catch\b"), B, ["do_catch"]),
    ("result", "raw",
     [("Result", r"[>:](?<=->|:)\s*+Result\s*+<"), _word("Result", r"\s*+<\w++,\s*+\w*Error>")],
     B, ["result_type"]),
    ("async", "raw",
     [_word("async", r"(?:\s++throws\b|\s*+\{)"), _word("try", r"\s++await\b", stem="await"),
      ("async", r"func\s+\w+\([^)]*+\)\s++async\b")],
     B, ["async_throws"]),
    ("status", "raw",
     [_text(".statusCode", r"\s*+==\s*+\d"), _text("statusCode", r"\s*+[=>]=\s*+200"),
      _text("response.statusCode"), _text(".validate()"), _text(".validate(statusCode:"),
      _text("200...299"), ("guard", r"(?s)\A(?>.*?guard)(?>.*?statusCode).*?else")],
     B, ["status_check"], {"cover": ("statusCode", ".validate(", "200...299")}),
    ("timeout", "raw",
     [*(_text(f"timeoutIntervalFor{part}", r"\s*+=") for part in ("Request", "Resource")),
      _text(".timeoutInterval", r"\s*+="), _text("timeoutInterval:", r"\s*+\d"),
      _text(".timeout("), _text("withTimeout("), _word("timeout", r"\s*+:\s*+\d")],
     A, ["timeout"], {"cover": ("imeout",)}),
    ("retry", "raw",
     [_text(".retry("), _text(".retryPolicy("), _text("RetryPolicy("), _text(".retryWhen("),
      _text("withRetry("), ("firstly", r"(?s)\A(?>.*?firstly).*?\.retry"),
      ("etry", r"func\s++\w*[Rr]etry\w*+\s*+\("),
      *(_word(name, r"\s*+:\s*+\d") for name in ("retries", "maxRetries")),
      _word("retryCount", r"\s*+="),
      ("...retries", r"for\s++_\s++in\s++\d++\.\.\.retries")],
     A, ["retry"], {"cover": ("etry", "etries")}),
    ("backoff", "lower", [_text("exponential"), _text("backoff")], None,
     ["exponential_backoff"], {"requires": "swift.retry"}),
    ("breaker", "lower", _text("circuitbreaker"), A, ["circuit_breaker"]),
    ("breaker_state", "raw", ("CircuitState", r"enum\s++CircuitState"), A, ["circuit_breaker"]),
    ("optional_try", "raw", _word("try", r"[?!]"), B, [], {"only": "fixed"}),
)

# PHP is described but not routed: no extension maps to it.
_rules(
    "php",
    ("try", "code", r"\btry\s*\{", B),
    ("curl_info", "code", r"\bcurl_getinfo\s*\(", B),
    ("named_call", "code", r"(?<![\w>$])(?:timeout|retry|CircuitBreaker|backoff)\s*\(", A),
    enabled=False,
)


def signal_rules(mode: str = "fixed", languages=LANGUAGES) -> list[Rule]:
    """Rules in force: ``mode='parity'`` leaves out the additions."""
    return [
        rule for rule in RULES
        if rule.language in languages
        and (rule.enabled or "php" in languages)
        and (rule.only is None or rule.only == mode)
    ]


def shapes_of(language: str) -> dict[str, Shape]:
    return {shape.name: shape for shape in SHAPES if shape.language == language}
