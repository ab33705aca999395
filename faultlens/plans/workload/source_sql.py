"""DuckDB counterparts of the source-file detectors, for result checks.

Written as one existence test per (language, tier, flag), not as extraction
followed by rules, so a check compares two formulations. The dialect has no
look-around; where the library excludes declarations by looking behind, these
tests rely on the workload's code pieces not declaring such names.
"""

from __future__ import annotations

import re

from faultlens.catalogs import domain
from faultlens.catalogs.http_libraries import TEXT_CLIENTS, http_catalog
from faultlens.catalogs.resilience_libraries import BUILDER_LIBRARIES, resilience_catalog
from faultlens.plans.workload import tables
from faultlens.plans.workload.snippets import BODIES, HEADS


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(items) -> str:
    return "[" + ", ".join(items) + "]"


def source_cte(language: str | None = None) -> str:
    """``src``: the same files ``tables.source_files`` makes."""
    n = len(domain.LANGUAGES)
    number = f"(doc_id % {n})" if language is None else str(tables.WRITTEN.index(language))
    pick = lambda values: f"({_list(quoted(v) for v in values)})[num + 1]"
    pieces = lambda table, index: (
        "(" + _list(_list(quoted(p) for p in table[lang]) for lang in tables.WRITTEN)
        + f")[num + 1][({index}) + 1]")
    mark = pick([tables.COMMENT[lang] for lang in tables.WRITTEN])
    head = pieces(HEADS, f"n_chars % {tables.N_HEADS}")
    body = pieces(BODIES, f"(doc_id // 9) % {tables.N_BODIES}")
    return f"""
numbered AS (SELECT *, CAST({number} AS INTEGER) AS num FROM documents),
src AS (
  SELECT doc_id,
    'https://example.com/corpus/' || CASE WHEN lang = 'en' THEN source
      ELSE source || '-' || {pick(tables.WRITTEN)} END AS repo_url,
    'src/' || printf('%012d', doc_id)
      || {pick([tables.EXTENSION[lang] for lang in tables.WRITTEN])} AS path,
    {pick(tables.WRITTEN)} AS language,
    {head} || {mark} || ' ' || replace(text, chr(10), chr(10) || {mark})
      || chr(10) || {body} AS raw
  FROM numbered)"""


# ------------------------------------------------------------------- masking
_D = r'"(?:[^"\\\n]|\\(?s:.))*"'
_S = r"'(?:[^'\\\n]|\\(?s:.))*'"
_B = r"`[^`]*`"
_T = r'"""(?:[^"\\]|"[^"]|""[^"])*"""'
_C = r"//[^\n]*|/\*(?s:.*?)\*/"
_H = r"#[^\n]*"
_MASKS = {
    "python": (f"{_T}|{_D}|{_S}", _H), "ruby": (f"{_D}|{_S}", _H),
    "java": (f"{_D}|{_S}", _C), "csharp": (f"{_D}|{_S}", _C), "go": (f"{_D}|{_B}|{_S}", _C),
    "javascript": (f"{_D}|{_S}|{_B}", _C), "typescript": (f"{_D}|{_S}|{_B}", _C),
    "php": (f"{_D}|{_S}", f"{_C}|{_H}"),
}


def views_cte() -> str:
    """``views``: raw, comment-free and masked text of every file."""
    bare = " ".join(
        f"WHEN {quoted(lang)} THEN regexp_replace(raw, {quoted(f'({s})|{c}')}, '\\1 ', 'g')"
        for lang, (s, c) in _MASKS.items())
    code = " ".join(
        f"WHEN {quoted(lang)} THEN regexp_replace(bare, {quoted(s)}, ' ', 'g')"
        for lang, (s, _) in _MASKS.items())
    # Parameter lists and interface bodies hold types, not option keys.
    typed = (r"\binterface\s+\w[^{]*\{[^}]*\}", r"\([^()]*\)(\s*:[^=;{}()]*)?\s*(\{|=>)")
    keys = "bare"
    for pattern in typed:
        keys = f"regexp_replace({keys}, {quoted(pattern)}, '{{', 'g')"
    return f"""
bared AS (SELECT *, CASE language {bare} END AS bare FROM src),
views AS (
  SELECT *, CASE language {code} END AS code,
    CASE language WHEN 'javascript' THEN bare WHEN 'typescript' THEN {keys} END AS keys
  FROM bared)"""


# -------------------------------------------------------------------- rules
def _script(language: str) -> list[tuple]:
    call = r"(?i)(^|[^\w$.])[\w$]*(%s)[\w$]*\s*\("
    key = r"(?i)[{,]\s*['\"]?(%s)['\"]?\s*:"
    named = r"(?i)\b%s\s+[\w$]*(%s)"
    on = r"(?i)(^|[^\w$.])[\w$]*(%s)[\w$]*\s*\.\s*(%s)\s*\("
    typescript = language == "typescript"
    retry_keys = "retries|retry|maxretries" + ("|maxattempts" if typescript else "")
    breaker_keys = r"[\w$]*breaker[\w$]*|threshold" + ("|errorthreshold" if typescript else "")
    rows = [
        ("basic", "try_catch", "code", r"\btry\s*\{"),
        ("advanced", "timeout", "code", call % "timeout"),
        ("advanced", "retry", "code", call % "retry"),
        ("advanced", "circuit_breaker", "code", call % "breaker"),
        ("advanced", "exponential_backoff", "code", call % "backoff"),
        ("advanced", "rate_limiting", "code", call % "limit|throttle"),
        ("advanced", "timeout", "code", r"(?i)\bpromise\s*\.\s*race\s*\("),
        ("advanced", "circuit_breaker", "code", on % ("breaker|circuit", "fire|execute|call|run")),
        ("advanced", "retry", "code", on % ("retry", r"[\w$]+")),
        ("advanced", "rate_limiting", "code",
         on % ("limit|throttle|bottleneck", "schedule|submit|wrap")),
        ("advanced", "timeout", "keys", key % "timeout"),
        ("advanced", "retry", "keys", key % retry_keys),
        ("advanced", "exponential_backoff", "keys", key % r"[\w$]*backoff[\w$]*|retrydelay"),
        ("advanced", "circuit_breaker", "keys", key % breaker_keys),
        ("advanced", "circuit_breaker", "code", named % ("(class|new)", "breaker")),
        ("advanced", "retry", "code", named % ("class", "retry")),
        ("advanced", "rate_limiting", "code", named % ("class", "limiter|throttle")),
        ("advanced", "rate_limiting", "code", r"(?i)\bnew\s+bottleneck\b"),
        ("advanced", "timeout", "code", r"(?i)\bnew\s+abortcontroller\b"),
        ("basic", "status_check", "code", r"\b(response|res|resp)\s*\.\s*ok\b"),
        ("basic", "status_check", "code", r"(?i)[^.?]\.\s*(status|statuscode)\s*\("),
    ]
    if not typescript:
        return rows + [
            ("basic", "status_check", "code", r"[^.?]\.\s*(status|statusCode)\b"),
            ("basic", "promise_catch", "code", r"[^.?]\.\s*catch\b"),
        ]
    kinds = {"retry": "retry", "breaker": "circuit_breaker", "timeout": "timeout",
             "backoff": "exponential_backoff"}
    rows += [("advanced", flag, "code", named % ("(interface|type)", word))
             for word, flag in kinds.items()]
    rows += [("advanced", flag, "code", rf"(?i)@[\w$]*({word})")
             for word, flag in {**kinds, "ratelimit|throttle": "rate_limiting"}.items()]
    return rows + [
        ("basic", "promise_catch", "code", r"(?i)[^.?]\.\s*catch\s*\("),
        ("advanced", "retry", "code", r"(?i)[^.?]\.\s*(retry|retrywhen)\s*\("),
        ("advanced", "decorator", "code", r"(^|[^\w$.])@[A-Za-z_$]"),
    ]


_CALL = r"(^|[^\w.])(%s)\s*\("
_ANNOTATED = r"@(%s)\b|/\*\s*@(%s)\b(?s:.*?)\*/"
_RUBY_SENT = r"[^&.]\.\s*([a-z_]\w*)?(?i:%s)"
_RUBY_CALLED = r"(^|[^\w.:@$])[a-z_]\w*%s\w*(\(|[ \t]+do\b|[ \t]*\{|[ \t]+[a-z_]\w*:[ \t])"
_SHARP_CALL = r"(?i)[\w.]*(%s)[\w.]*(<[^<>()\n]*>)?\s*\("


def _ann(names: str) -> str:
    return _ANNOTATED % (names, names)


SIGNALS: dict[str, list[tuple]] = {
    "python": [
        ("basic", "try_catch", "code", r"(?m)^[ \t]*(try|except)\b[^\n]*:"),
        ("basic", "status_check", "code", r"(?i)\.\s*(status_code|raise_for_status)\s*\("),
        ("advanced", "timeout", "code", "(?i)" + _CALL % "timeout"),
        ("advanced", "retry", "code", "(?i)" + _CALL % "retry"),
        ("advanced", "circuit_breaker", "code", "(?i)" + _CALL % "circuit_?breaker"),
        ("advanced", "exponential_backoff", "code", "(?i)" + _CALL % "backoff"),
        ("advanced", "retry", "code", r"(?i)\.\s*(retry|with_retry)\s*\("),
        ("advanced", "timeout", "code", r"(?i)\.\s*(timeout|with_timeout)\s*\("),
        ("advanced", "exponential_backoff", "code",
         r"(?i)\.\s*(with_backoff|exponential_backoff)\s*\("),
        ("advanced", "retry", "code", r"(?m)^[ \t]*@retry[ \t]*\n[ \t]*def\b"),
        ("advanced", "timeout", "code", r"(?m)^[ \t]*@timeout[ \t]*\n[ \t]*def\b"),
    ],
    "java": [
        ("advanced", "retry", "raw", _ann("Retryable|Retry")),
        ("advanced", "retry", "raw", r"\b(RetryConfig|RetryRegistry|RetryTemplate)\b"),
        ("advanced", "retry", "raw",
         r"\bRetry\.of\(|\.(retry|withRetry)\(|\bretryTemplate\.execute\("),
        ("advanced", "circuit_breaker", "raw", _ann("HystrixCommand|CircuitBreaker")),
        ("advanced", "circuit_breaker", "raw",
         r"\b(CircuitBreakerConfig|CircuitBreakerRegistry|HystrixCommand)\b"),
        ("advanced", "circuit_breaker", "raw",
         r"\bCircuitBreaker\.of\(|\.circuitBreaker\(|withCircuitBreaker\("),
        ("advanced", "timeout", "raw", _ann("TimeLimiter")),
        ("advanced", "timeout", "raw", r"\b(TimeLimiterConfig|TimeLimiterRegistry)\b"),
        ("advanced", "timeout", "raw", r"\bTimeLimiter\.of\(|\.timeout\(|withTimeLimiter\("),
        ("advanced", "exponential_backoff", "raw", _ann("Backoff")),
        ("advanced", "exponential_backoff", "raw", r"\b(ExponentialBackOff|BackOffPolicy)\b"),
        (None, "global_exception_handler", "raw", _ann("ControllerAdvice|RestControllerAdvice")),
        (None, "exception_handler", "raw", _ann("ExceptionHandler")),
        ("basic", "try_catch", "code", r"\btry\s*[({]|\bcatch\s*\("),
        ("basic", None, "code", r"\bthrow\s|\)\s*throws\s"),
        (None, "status_check", "code", r"(?i)\bcatch\s*\([^)]*\)\s*\{[^}]*status_?code"),
        ("advanced", None, "code", r"@(Recover|HystrixCollapser|RateLimiter|Bulkhead)\b"),
        ("advanced", "retry", "code", r"\bnew\s+(RetryConfig|RetryTemplate|\w*RetryRegistry\w*)\s*[(<]"),
        ("advanced", "circuit_breaker", "code",
         r"\b(new|extends)\s+\w*Hystrix(Observable)?Command"),
    ],
    "javascript": _script("javascript"),
    "typescript": _script("typescript"),
    "go": [
        ("basic", "error_check", "code",
         r"\bif\s+([^{};\n]*;\s*)?(err\s*[!=]=\s*nil|nil\s*[!=]=\s*err)\s*\{"),
        ("basic", "error_check", "code", r"\bif\s+(\w+\s*,\s*)*err\s*(,\s*\w+\s*)*:?=[^=]"),
        ("basic", None, "code", r"\bdefer\s"),
        ("basic", "defer_recover", "code", r"(?s)(\bdefer\b|\bfunc\s*\().*\brecover\s*\(\s*\)"),
        ("basic", "status_check", "code", r"\.\s*(StatusCode|Code|Status)\s*\("),
        ("advanced", "timeout", "code", _CALL % r"context\.(WithTimeout|WithDeadline)"),
        ("advanced", None, "code", _CALL % r"context\.WithCancel"),
        ("advanced", "timeout", "code", _CALL % r"time\.(After|NewTimer)"),
        ("advanced", "timeout", "code", r"\.\s*\w*(?i:timeout|deadline)\w*\s*\("),
        ("advanced", "retry", "code", r"\.\s*\w*(?i:retry)\w*\s*\("),
        ("advanced", "circuit_breaker", "code", r"\.\s*\w*(?i:breaker)\w*\s*\("),
        ("advanced", "circuit_breaker", "code", _CALL % r"\w*breaker\w*\.Call"),
        ("advanced", "exponential_backoff", "code",
         r"\.\s*\w*(?i:backoff)\w*\s*\(|(^|[^\w.])\w*backoff\w*\.\w+\s*\("),
        ("advanced", None, "code", r"\.\s*\w*(?i:failover)\w*\s*\("),
        ("advanced", "retry", "code", "(?i)" + _CALL % r"\w*retry\w*"),
        ("advanced", "exponential_backoff", "code", "(?i)" + _CALL % r"\w*backoff\w*"),
        ("advanced", "circuit_breaker", "code",
         r"(?i)(^|[^\w.])\w*breaker\w*\.\w*(breaker|settings)\w*\s*\{"),
    ],
    "ruby": [
        ("basic", "rescue", "code", r"(^|[^:.\w])rescue\b"),
        ("basic", "ensure", "code", r"(?m)^[ \t]*ensure[ \t]*$"),
        ("advanced", None, "code", r"\bHTTParty\s*\.\s*[a-z_]"),
        ("advanced", "timeout", "code", r"\bTimeout\b"),
        ("advanced", "circuit_breaker", "code", r"\b[A-Z]?\w*Circuit\w*|\bSemian\b"),
        ("advanced", "retry", "code", r"\b(Retryable|Retriable)\b"),
        ("advanced", "retry", "code", r"(?m)^[ \t]*retry[ \t]*$"),
        ("advanced", "exponential_backoff", "code",
         r"\b(retryable|retriable)\b[^\n]*(backoff|exponential)\w*:"),
        ("basic", "status_check", "code",
         r"(?i)[^&.]\.\s*(code|status|status_code|response_code)\b"),
    ] + [
        ("advanced", flag, "code", pattern % word)
        for flag, word in (
            ("timeout", "(timeout)"), ("retry", "(retry|retryable|retriable)"),
            ("circuit_breaker", "(circuit|breaker)"),
            ("exponential_backoff", "(backoff|exponential)"),
            ("rate_limiting", "(throttle|rate_limit)"))
        for pattern in (_RUBY_SENT, _RUBY_CALLED.replace("[a-z_]\\w*%s", "\\w*%s"))
    ],
    "csharp": [
        ("basic", "try_catch", "code", r"\btry\s*\{"),
        ("basic", "status_check", "code", _SHARP_CALL % "statuscode"),
        ("basic", "status_check", "code", r"\.\s*IsSuccessStatusCode\b"),
        ("advanced", "timeout", "code", _SHARP_CALL % "timeout"),
        ("advanced", "retry", "code", _SHARP_CALL % "retry"),
        ("advanced", "circuit_breaker", "code", _SHARP_CALL % "breaker"),
        ("advanced", "exponential_backoff", "code", _SHARP_CALL % "backoff"),
        ("advanced", None, "code", _SHARP_CALL % "executeasync|executeandcapture|fallback"),
        ("advanced", None, "code", r"\bnew\s+[\w.]*(Policy|ResiliencePipeline)"),
        ("advanced", "circuit_breaker", "code", r"\b(new|class)\s+[\w.]*CircuitBreaker"),
        ("advanced", "retry", "code", r"\b(new|class)\s+[\w.]*Retry"),
        ("advanced", "timeout", "code", r"\b(new|class)\s+[\w.]*Timeout"),
        ("advanced", "timeout", "code", r"\bnew\s+[\w.]*CancellationTokenSource"),
    ],
    "kotlin": [
        ("basic", "try_catch", "raw", r"\btry\s*\{[^}]*\}\s*catch\b"),
        ("basic", "status_check", "raw",
         r"\b(response|result)\s*\.\s*(code\s*\(\s*\)|statusCode|status)"),
        ("basic", "status_check", "raw", r"\b(code|status|statusCode)\s*==\s*\d+"),
        ("basic", "status_check", "raw",
         r"\bisSuccessful\s*\(\s*\)|\b(is2xxSuccessful|is4xxClientError|is5xxServerError)"),
        ("advanced", "timeout", "raw", r"\b(withTimeout|withTimeoutOrNull)\s*\("),
        ("advanced", "timeout", "raw",
         r"\b(timeout|connectTimeout|readTimeout|writeTimeout|callTimeout)\s*\("),
        ("advanced", "timeout", "raw",
         r"\binstall\s*\(\s*HttpTimeout\s*\)|\brequestTimeoutMillis\s*=|\btimeout\s*[:=]"
         r"|\bTimeout\s*\."),
        ("advanced", "retry", "raw", r"\b(retry|retryAsync)\s*\{|\bRetry\.of"),
        ("advanced", "retry", "raw", r"\binstall\s*\(\s*HttpRequestRetry\s*\)"),
        ("advanced", "retry", "raw", r"\bfun\s+\w*[Rr]etry\w*\s*\(|\brepeat\s*\("),
        ("advanced", "retry", "raw", r"\b(retries|maxRetries|retryCount)\s*[:=]"),
        ("advanced", "retry", "raw", r"(?i)\bwhile\s*\([^)]*retry"),
        ("advanced", "circuit_breaker", "raw", r"\bcircuitBreaker\s*\{|\bCircuitBreaker\.of"),
        ("advanced", "circuit_breaker", "raw", r"(?i)\bclass\s+\w*CircuitBreaker"),
        ("advanced", "circuit_breaker", "raw",
         r"\bval\s+\w*[Cc]ircuit\w*\s*=|\bvar\s+\w*[Bb]reaker\w*\s*="),
        ("advanced", "coroutine_timeout", "raw",
         r"\b(withTimeout|withTimeoutOrNull|SupervisorJob)\s*\("
         r"|\b(supervisorScope|CoroutineExceptionHandler)\s*\{"),
        ("advanced", "timeout", "raw",
         r"\bSupervisorJob\s*\(|\b(supervisorScope|CoroutineExceptionHandler)\s*\{"),
        ("advanced", "rate_limiting", "raw", r"(?i)\b(rateLimit|throttle|semaphore)\s*\("),
    ],
    "swift": [
        ("basic", "do_catch", "raw", r"\bdo\s*\{[^}]*\}\s*catch\b"),
        ("basic", "result_type", "raw", r"->\s*Result\s*<|:\s*Result\s*<"),
        ("basic", "result_type", "raw", r"\bResult\s*<\w+,\s*\w*Error>"),
        ("basic", "async_throws", "raw",
         r"\basync\s+throws\b|\btry\s+await\b|\basync\s*\{|func\s+\w+\([^)]*\)\s+async\b"),
        ("advanced", "timeout", "raw", r"timeoutIntervalFor(Request|Resource)\s*="),
        ("advanced", "timeout", "raw",
         r"\.timeoutInterval\s*=|\.timeout\(|timeoutInterval:\s*\d+|\btimeout\s*:\s*\d+"
         r"|withTimeout\("),
        ("advanced", "retry", "raw", r"\.(retry|retryPolicy|retryWhen)\(|RetryPolicy\("),
        ("advanced", "retry", "raw", r"(?s)firstly.*\.retry"),
        ("advanced", "retry", "raw", r"func\s+\w*[Rr]etry\w*\s*\(|withRetry\(|\bretryCount\s*="),
        ("advanced", "retry", "raw",
         r"\b(retries|maxRetries)\s*:\s*\d+|for\s+_\s+in\s+\d+\.\.\.retries"),
        ("basic", "status_check", "raw", r"\.statusCode\s*==\s*\d+|statusCode\s*(==|>=)\s*200"),
        ("basic", "status_check", "raw",
         r"response\.statusCode|\.validate\(\)|\.validate\(statusCode:|200\.\.\.299"),
        ("basic", "status_check", "raw", r"(?s)guard.*statusCode.*else"),
        ("advanced", "circuit_breaker", "raw", r"(?i)CircuitBreaker|enum\s+CircuitState"),
        ("basic", None, "raw", r"\btry[?!]"),
    ],
    "php": [
        ("basic", None, "code", r"\btry\s*\{|\bcurl_getinfo\s*\("),
        ("advanced", None, "code", r"(^|[^\w>$])(timeout|retry|CircuitBreaker|backoff)\s*\("),
    ],
}

# Shown only where another flag is: (language, flag, opening flag, pattern).
GATED = (
    ("kotlin", "exponential_backoff", "retry", "(?i)exponential|backoff"),
    ("swift", "exponential_backoff", "retry", "(?i)exponential|backoff"),
)

# Java call names: the first family a name belongs to decides.
JAVA_CALLS = r"(?:\.\s*|[;{}(,=!&|?:+*-]\s*|return\s+)([A-Za-z_]\w*)\s*\("


# ----------------------------------------------------------- import patterns
def _re2(text: str) -> str:
    return re.escape(text).replace("\\ ", " ")


_IMPORT_FORMS = {
    "java": r"(?m)^[ \t]*import[ \t]+(static[ \t]+)?%s[ \t]*;",
    "csharp": r"(?m)^[ \t]*using[ \t]+(static[ \t]+)?%s[ \t]*;",
    "kotlin": r"(?m)^[ \t]*import[ \t]+%s",
    "swift": r"(?m)^[ \t]*import[ \t]+%s[ \t]*$",
    "ruby": r"require(_relative)?\s+['\"]%s['\"]",
    "javascript": r"(import\s+[^\n]*?\s+from\s+|import\s+|require\s*\(\s*)['\"]%s['\"]",
    "typescript": r"(import\s+[^\n]*?\s+from\s+|import\s+|require\s*\(\s*)['\"]%s['\"]",
    "go": r"""(import\s+|import\s*\([^)]*\n[^"\n]*)"%s\"""",
}


def _python_import(name: str, forms=("import", "from")) -> str:
    escaped = _re2(name) + (r"(\.[\w.]+)?" if "." not in name else "")
    plain = rf"^[ \t]*import[ \t]+([^\n;]*,[ \t]*)?{escaped}([ \t]+as\b|[ \t]*,|[ \t]*$)"
    whole = rf"^[ \t]*from[ \t]+\.*{escaped}[ \t]+import\b"
    return "(?m)" + "|".join({"import": plain, "from": whole}[f] for f in forms)


def http_rows() -> list[tuple[str, str, str, str]]:
    """(language, library, view, pattern)."""
    rows = []
    for row in http_catalog("fixed"):
        form, name = _IMPORT_FORMS.get(row.language), _re2(row.pattern)
        if row.language == "python":
            rows.append(("python", row.canonical, "code", _python_import(row.pattern)))
            continue
        tail = r"[\w.]*(\.\*)?"
        if row.match == "prefix" and row.language == "ruby":
            path = name + r"[^'\"]*"
        elif row.match == "prefix":
            # A required substring may lie inside the pattern or after it.
            inside = row.contains is None or row.contains in row.pattern
            path = name + (tail if inside else rf"[\w.]*{_re2(row.contains)}" + tail)
        elif row.match == "exact" and row.language in ("javascript", "typescript"):
            path = name + r"(/[^'\"]*)?"
        else:
            path = name
        rows.append((row.language, row.canonical, "raw", form % path))
    rows += [(lang, name, "raw", pattern) for lang, pattern, _, name in TEXT_CLIENTS]
    return rows


def resilience_rows() -> list[tuple[str, str, tuple[str, ...], str, str]]:
    """(language, library, flags, view, pattern)."""
    rows = []
    for row in resilience_catalog():
        name = _re2(row.pattern)
        if row.language == "python":
            form, _, module = row.pattern.partition(" ")
            escaped = _re2(module)
            pattern = (
                rf"(?m)^[ \t]*import[ \t]+([^\n;]*,[ \t]*)?{escaped}([ \t]+as\b|[ \t]*,|[ \t]*$)"
                if form == "import" else rf"(?m)^[ \t]*from[ \t]+\.*{escaped}[ \t]+import\b")
            rows.append(("python", row.library, row.flags, "code", pattern))
            continue
        form = _IMPORT_FORMS[row.language]
        view = "bare" if row.language in ("javascript", "typescript", "go") else "raw"
        if row.language == "ruby":
            form = r"require\s+['\"]%s['\"]"
        if row.language in ("java", "csharp"):
            view = "code"
            after = r"[\w.]*" if row.contains is None else rf"[\w.]*{_re2(row.contains)}[\w.]*"
            before = r"[\w.]*" if row.match == "contains" else ""
            path = before + name + after + r"(\.\*)?"
        elif row.match == "contains":
            path = r"[^\"\n]*" + name + r"[^\"\n]*"
        else:
            path = name
        rows.append((row.language, row.library, row.flags, view, form % path))
    rows += [(lang, lib, (), "raw", pattern) for lang, pattern, _, lib in BUILDER_LIBRARIES]
    return rows


# ---------------------------------------------------------------- statements
def _values(rows, names: str, alias: str) -> str:
    literal = lambda v: "CAST(NULL AS VARCHAR)" if v is None else quoted(v)
    body = ",\n    ".join("(" + ", ".join(map(literal, row)) + ")" for row in rows)
    return f"{alias} ({names}) AS (VALUES\n    {body})"


def _hit(view: str = "view", pattern: str = "pattern") -> str:
    return (f"regexp_matches(CASE {view} WHEN 'raw' THEN raw WHEN 'bare' THEN bare "
            f"WHEN 'keys' THEN keys ELSE code END, {pattern})")


def libraries_cte(language: str | None = None) -> str:
    rows = [r for r in http_rows() if language in (None, r[0])]
    return _values(rows, "language, library, view, pattern", "http_rule") + f""",
http AS (
  SELECT doc_id, string_agg(library, ';' ORDER BY library) AS http_libraries
  FROM (SELECT DISTINCT v.doc_id, r.library FROM views v JOIN http_rule r USING (language)
        WHERE {_hit()}) GROUP BY doc_id)"""


def signals_cte(language: str | None = None) -> str:
    """``signals``: basic, advanced, label, flags, resilience libraries per file."""
    chosen = domain.LANGUAGES if language is None else (language,)
    rules = [(lang, tier, flag, view, pattern)
             for lang in chosen for tier, flag, view, pattern in SIGNALS[lang]]
    imports = [r for r in resilience_rows() if r[0] in chosen]
    libraries = [(lang, lib, view, pattern) for lang, lib, _, view, pattern in imports]
    libraries = libraries or [("-", "-", "-", "-")]
    rules += [(lang, "advanced", flag, view, pattern)
              for lang, lib, flags, view, pattern in imports
              if view != "raw" or pattern not in {b[1] for b in BUILDER_LIBRARIES}
              for flag in (flags or (None,))]
    gated = [g for g in GATED if g[0] in chosen] or [("-", "-", "-", "-")]
    return _values(rules, "language, tier, flag, view, pattern", "rule") + ",\n" + _values(
        libraries, "language, library, view, pattern", "library_rule") + ",\n" + _values(
        gated, "language, flag, opening, pattern", "gated_rule") + f""",
plain_hits AS (
  SELECT v.doc_id, r.tier, r.flag FROM views v JOIN rule r USING (language) WHERE {_hit()}
  UNION ALL
  SELECT doc_id, CASE WHEN name IN ('statuscode', 'getstatuscode') AND family IS NULL
      THEN 'basic' ELSE 'advanced' END,
    CASE WHEN family IN ('retry', 'timeout', 'circuit_breaker', 'exponential_backoff') THEN family
      WHEN family IS NULL THEN 'status_check' END
  FROM (
    SELECT doc_id, name, CASE
      WHEN contains(name, 'retry') THEN 'retry'
      WHEN contains(name, 'timeout') OR contains(name, 'timelimit') THEN 'timeout'
      WHEN contains(name, 'breaker') THEN 'circuit_breaker'
      WHEN contains(name, 'backoff') OR contains(name, 'exponential')
        OR contains(name, 'waitstrategy') THEN 'exponential_backoff'
      WHEN contains(name, 'bulkhead') OR contains(name, 'ratelimit')
        OR contains(name, 'throttle') OR contains(name, 'fallback') THEN 'other' END AS family
    FROM (SELECT doc_id, lower(unnest(regexp_extract_all(code, {quoted(JAVA_CALLS)}, 1))) AS name
          FROM views WHERE language = 'java'))
  WHERE family IS NOT NULL OR name IN ('statuscode', 'getstatuscode')),
hits AS (
  SELECT * FROM plain_hits
  UNION ALL
  SELECT v.doc_id, NULL, g.flag FROM views v JOIN gated_rule g USING (language)
  WHERE regexp_matches(raw, g.pattern) AND EXISTS (
    SELECT 1 FROM plain_hits h, rule r WHERE h.doc_id = v.doc_id AND h.flag = g.opening
      AND r.language = v.language AND r.flag = g.opening AND r.view = 'raw'
      AND r.pattern NOT LIKE '%import%' AND regexp_matches(raw, r.pattern))),
found AS (
  SELECT doc_id, bool_or(tier = 'basic') AS basic, bool_or(tier = 'advanced') AS advanced,
    string_agg(DISTINCT flag, ';' ORDER BY flag) AS flags
  FROM hits GROUP BY doc_id),
resilient AS (
  SELECT doc_id, string_agg(library, ';' ORDER BY library) AS resilience_libraries
  FROM (SELECT DISTINCT v.doc_id, r.library FROM views v JOIN library_rule r USING (language)
        WHERE {_hit()}) GROUP BY doc_id),
signals AS (
  SELECT v.doc_id, v.repo_url, v.path, v.language,
    coalesce(f.basic, false) AS basic, coalesce(f.advanced, false) AS advanced,
    CASE WHEN f.basic AND f.advanced THEN 'Mixed' WHEN f.advanced THEN 'Advanced'
      WHEN f.basic THEN 'Basic' ELSE 'None' END AS label,
    coalesce(f.flags, '') AS flags,
    coalesce(r.resilience_libraries, '') AS resilience_libraries
  FROM views v LEFT JOIN found f USING (doc_id) LEFT JOIN resilient r USING (doc_id))"""


def libraries_sql(language: str) -> str:
    return f"""WITH {source_cte(language)}, {views_cte()}, {libraries_cte(language)}
SELECT v.doc_id, coalesce(h.http_libraries, '') AS http_libraries,
  h.http_libraries IS NOT NULL AS has_http_library
FROM views v LEFT JOIN http h USING (doc_id)"""


def signals_sql(language: str) -> str:
    return f"""WITH {source_cte(language)}, {views_cte()}, {signals_cte(language)}
SELECT doc_id, label, flags, resilience_libraries FROM signals"""


def scan_cte() -> str:
    """``files``: all languages, libraries and signals; then ``repos``."""
    flags = list(domain.ALL_FLAGS)
    native = {raw: flag for raw, flag in domain.CANONICAL_FLAG.items()}
    counts = []
    for flag in flags:
        names = [flag] + [raw for raw, canon in native.items() if canon == flag]
        test = " OR ".join(f"list_contains(flag_list, {quoted(n)})" for n in names)
        counts.append(f"CAST(count(*) FILTER ({test}) AS BIGINT) AS n_{flag}")
    return f"""{source_cte()}, {views_cte()}, {libraries_cte()}, {signals_cte()},
files AS (
  SELECT s.*, coalesce(h.http_libraries, '') AS http_libraries,
    CASE WHEN s.flags = '' THEN [] ELSE string_split(s.flags, ';') END AS flag_list
  FROM signals s LEFT JOIN http h USING (doc_id)),
folded AS (
  SELECT repo_url, count(*) AS total_files,
    count(*) FILTER (label <> 'None') AS handled_files,
    arg_min(label, path) FILTER (label <> 'None') AS first_label,
    bool_or(label = 'Basic') AS any_basic, bool_or(label = 'Advanced') AS any_advanced,
    string_agg(DISTINCT language, ';' ORDER BY language) AS languages,
    {', '.join(counts)}
  FROM files GROUP BY repo_url),
repo_http AS (
  SELECT repo_url, string_agg(DISTINCT lib, ';' ORDER BY lib) AS http_libraries
  FROM (SELECT repo_url, unnest(string_split(http_libraries, ';')) AS lib FROM files
        WHERE http_libraries <> '') GROUP BY repo_url),
repo_resilience AS (
  SELECT repo_url, string_agg(DISTINCT lib, ';' ORDER BY lib) AS resilience_libraries
  FROM (SELECT repo_url, unnest(string_split(resilience_libraries, ';')) AS lib FROM files
        WHERE resilience_libraries <> '') GROUP BY repo_url),
repos AS (
  SELECT f.*, CASE WHEN first_label IS NULL THEN 'None'
      WHEN any_basic AND any_advanced THEN 'Mixed' ELSE first_label END AS exception_type,
    coalesce(h.http_libraries, '') AS http_libraries,
    coalesce(r.resilience_libraries, '') AS resilience_libraries
  FROM folded f LEFT JOIN repo_http h USING (repo_url)
  LEFT JOIN repo_resilience r USING (repo_url))"""
