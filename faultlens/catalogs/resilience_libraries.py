"""Resilience libraries: import path -> reported library and flags it implies."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ResilienceLibrary:
    """``match``: ``full`` (equal path), ``prefix`` or ``contains``.

    ``contains`` narrows the match; ``unless`` lists substrings that rule it
    out (an earlier entry already spoke for that path).
    """

    language: str
    pattern: str
    match: str
    library: str
    kind: str
    flags: tuple[str, ...]
    contains: str | None = None
    unless: tuple[str, ...] = ()


# Library -> (type, implied flags).
_NODE = {
    "axios-retry": ("retry", ("retry",)),
    "p-retry": ("retry", ("retry",)),
    "async-retry": ("retry", ("retry",)),
    "retry": ("retry", ("retry",)),
    "node-retry": ("retry", ("retry",)),
    "opossum": ("circuit_breaker", ("circuit_breaker",)),
    "cockatiel": ("multi", ("retry", "circuit_breaker", "timeout")),
    "brakes": ("circuit_breaker", ("circuit_breaker",)),
    "bottleneck": ("rate_limiting", ("rate_limiting",)),
    "p-limit": ("rate_limiting", ("rate_limiting",)),
    "p-throttle": ("rate_limiting", ("rate_limiting",)),
    "limiter": ("rate_limiting", ("rate_limiting",)),
    "promise-timeout": ("timeout", ("timeout",)),
    "p-timeout": ("timeout", ("timeout",)),
    "timeout-abort-controller": ("timeout", ("timeout",)),
    "bluebird": ("multi", ("timeout", "retry")),
    "async": ("multi", ("retry",)),
    "got": ("http_client", ("retry", "timeout")),
    "axios": ("http_client", ("timeout",)),
}
_TYPESCRIPT_ONLY = {
    "ts-retry": ("retry", ("retry",)),
    "ts-retry-promise": ("retry", ("retry",)),
    "rxjs": ("reactive", ("retry", "timeout")),
    "rxjs/operators": ("reactive", ("retry", "timeout")),
}
_RUBY = {
    "retryable": ("retry", ("retry",)),
    "retriable": ("retry", ("retry",)),
    "circuitbox": ("circuit_breaker", ("circuit_breaker",)),
    "semian": ("circuit_breaker", ("circuit_breaker",)),
    "stoplight": ("circuit_breaker", ("circuit_breaker",)),
    "faraday-retry": ("retry", ("retry",)),
    "faraday": ("http_client", ("timeout", "retry")),
    "httparty": ("http_client", ("timeout",)),
    "typhoeus": ("http_client", ("timeout", "retry")),
    "rest-client": ("http_client", ("timeout",)),
    "net/http": ("http_client", ()),
    "timeout": ("timeout", ("timeout",)),
}
_SWIFT = {
    "Alamofire": ("http_client", ("timeout", "retry")),
    "Moya": ("http_client", ("timeout",)),
    "AFNetworking": ("http_client", ("timeout",)),
    "PromiseKit": ("async", ("retry", "timeout")),
    "Combine": ("async", ("retry", "timeout")),
    "RxSwift": ("async", ("retry", "timeout")),
    "Retry": ("retry", ("retry", "exponential_backoff")),
    "SwiftRetry": ("retry", ("retry",)),
    "AsyncHTTPClient": ("http_client", ("timeout",)),
    "URLSession": ("http_client", ("timeout",)),
    "SwiftyTimer": ("timeout", ("timeout",)),
}
# Import prefix -> (library, type, implied flags).
_KOTLIN = {
    "okhttp3": ("OkHttp", "http_client", ("timeout",)),
    "com.squareup.okhttp3": ("OkHttp", "http_client", ("timeout",)),
    "retrofit2": ("Retrofit", "http_client", ("timeout",)),
    "com.squareup.retrofit2": ("Retrofit", "http_client", ("timeout",)),
    "io.ktor.client": ("Ktor Client", "http_client", ("timeout", "retry")),
    "com.github.kittinunf.fuel": ("Fuel", "http_client", ("timeout",)),
    "io.github.resilience4j": ("Resilience4j", "multi", ("retry", "circuit_breaker", "timeout")),
    "java.net.http": ("java.net.http", "http_client", ("timeout",)),
    "kotlinx.coroutines": ("Kotlinx Coroutines", "async", ("timeout",)),
}
# Import fragment -> (library, implied flags).
_GO = {
    "cenkalti/backoff": ("backoff", ("exponential_backoff",)),
    "avast/retry-go": ("retry-go", ("retry",)),
    "hashicorp/go-retryablehttp": ("go-retryablehttp", ("retry",)),
    "sony/gobreaker": ("gobreaker", ("circuit_breaker",)),
    "rubyist/circuitbreaker": ("circuitbreaker", ("circuit_breaker",)),
    "eapache/go-resiliency": ("go-resiliency", ("retry", "circuit_breaker")),
}
# Plain import names that mark resilience without saying which kind.
_PYTHON_IMPORT = ("tenacity", "pybreaker", "backoff", "retry", "circuit_breaker")
_PYTHON_FROM = (
    "tenacity", "pybreaker", "backoff", "retry", "urllib3.util.retry", "requests.adapters",
)


def _java() -> list[ResilienceLibrary]:
    r4j = "io.github.resilience4j"
    spring = "org.springframework.retry"

    def row(pattern, library, flags, how="prefix", contains=None, unless=()):
        return ResilienceLibrary("java", pattern, how, library, "resilience", flags, contains, unless)

    return [
        row(r4j, "Resilience4j", ()),
        row(r4j, "Resilience4j", ("retry",), contains="retry"),
        row(r4j, "Resilience4j", ("circuit_breaker",), contains="circuitbreaker", unless=("retry",)),
        row(r4j, "Resilience4j", ("timeout",), contains="timelimiter",
            unless=("retry", "circuitbreaker")),
        row("com.netflix.hystrix", "Hystrix", ("circuit_breaker",)),
        row(spring, "Spring Retry", ("retry",)),
        row(spring, "Spring Retry", ("exponential_backoff",), contains="backoff"),
        row(spring, "Spring Retry", ("exponential_backoff",), contains="BackOff"),
        row("dev.failsafe", "Failsafe", ("retry", "circuit_breaker")),
        row("net.jodah.failsafe", "Failsafe", ("retry", "circuit_breaker")),
        row("guava.retrying", "Guava Retry", ("retry",), how="contains"),
        row("github.rholder.retry", "Guava Retry", ("retry",), how="contains"),
    ]


def _csharp() -> list[ResilienceLibrary]:
    def row(pattern, library, flags, how="contains", contains=None):
        return ResilienceLibrary("csharp", pattern, how, library, "resilience", flags, contains)

    microsoft = "Microsoft.Extensions.Http.Resilience"
    return [
        row("Polly", "Polly", (), how="prefix"),
        row("Polly", "Polly", ("retry",), how="prefix", contains="Retry"),
        row("Polly", "Polly", ("circuit_breaker",), how="prefix", contains="CircuitBreaker"),
        row("Polly", "Polly", ("timeout",), how="prefix", contains="Timeout"),
        row(microsoft, microsoft, ("retry", "circuit_breaker")),
        row("Microsoft.Extensions.Http.Polly", microsoft, ("retry", "circuit_breaker")),
        row("Steeltoe.CircuitBreaker", "Steeltoe.CircuitBreaker", ("circuit_breaker",)),
    ]


def resilience_catalog() -> list[ResilienceLibrary]:
    rows: list[ResilienceLibrary] = []
    for language, table in (
        ("javascript", _NODE),
        ("typescript", {**_NODE, **_TYPESCRIPT_ONLY}),
        ("ruby", _RUBY),
        ("swift", _SWIFT),
    ):
        rows += [
            ResilienceLibrary(language, name, "full", name, kind, flags)
            for name, (kind, flags) in table.items()
        ]
    rows += [
        ResilienceLibrary("kotlin", prefix, "prefix", library, kind, flags)
        for prefix, (library, kind, flags) in _KOTLIN.items()
    ]
    rows += [
        ResilienceLibrary("go", fragment, "contains", library, "resilience", flags)
        for fragment, (library, flags) in _GO.items()
    ]
    # Python imports are told apart as "import x" and "from x import" lines.
    rows += [
        ResilienceLibrary("python", f"import {name}", "full", name, "resilience", ())
        for name in _PYTHON_IMPORT
    ]
    rows += [
        ResilienceLibrary("python", f"from {name}", "full", name, "resilience", ())
        for name in _PYTHON_FROM
    ]
    return rows + _java() + _csharp()


# A client configured in code adds its library name without an import:
# (language, text pattern, substring any match contains, library).
BUILDER_LIBRARIES = (
    ("kotlin", r"\bOkHttpClient\.Builder\s*\(\s*\)", "OkHttpClient.Builder", "OkHttp"),
    ("kotlin", r"\bRetrofit\.Builder\s*\(\s*\)", "Retrofit.Builder", "Retrofit"),
    ("kotlin", r"\bHttpClient\s*\{", "HttpClient", "Ktor Client"),
)


def resilience_library_names() -> list[str]:
    names = {row.library for row in resilience_catalog()} | {b[3] for b in BUILDER_LIBRARIES}
    return sorted(names)
