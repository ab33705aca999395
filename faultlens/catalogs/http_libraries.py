"""HTTP client libraries per language and how an import names them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class HttpLibrary:
    """One catalog entry.

    ``match`` says how an import path selects the entry: ``exact`` (whole path
    or its root segment), ``full`` (whole path only), ``prefix`` or ``segment``
    (equal first segment). ``contains`` narrows a match further, ``canonical``
    is the reported name.
    """

    language: str
    pattern: str
    kind: str
    match: str
    canonical: str
    contains: str | None = None


# Import path -> class, per language.
HTTP_LIBRARIES = {
    "python": {
        "http.client": "standard",
        "urllib": "standard",
        "urllib.request": "standard",
        "urllib2": "standard",
        "urllib3": "third_party",
        "httplib": "standard",
        "httplib2": "third_party",
        "requests": "third_party",
        "httpx": "third_party",
        "aiohttp": "third_party",
        "tornado.httpclient": "third_party",
        "treq": "third_party",
    },
    "java": {
        "java.net.http.HttpClient": "standard",
        "java.net.HttpURLConnection": "standard",
        "org.apache.http": "apache_httpclient",
        "org.apache.httpcomponents": "apache_httpclient",
        "okhttp3.OkHttpClient": "okhttp",
        "com.squareup.okhttp": "okhttp",
        "org.springframework.web.client.RestTemplate": "spring",
        "org.springframework.web.reactive.function.client.WebClient": "spring",
        "feign.Client": "feign",
        "com.netflix.feign": "feign",
        "org.glassfish.jersey.client": "jersey",
        "com.ning.http.client": "async_http_client",
    },
    "javascript": {
        "axios": "axios",
        "fetch": "standard",
        "node-fetch": "node_fetch",
        "isomorphic-fetch": "isomorphic_fetch",
        "cross-fetch": "cross_fetch",
        "superagent": "superagent",
        "request": "request",
        "got": "got",
        "undici": "undici",
        "ky": "ky",
        "wretch": "wretch",
        "needle": "needle",
        "http": "standard",
        "https": "standard",
        "node:http": "standard",
        "node:https": "standard",
    },
    "go": {
        "net/http": "standard",
        "github.com/go-resty/resty": "resty",
        "github.com/valyala/fasthttp": "fasthttp",
        "github.com/dghubble/sling": "sling",
        "github.com/parnurzeal/gorequest": "gorequest",
        "gopkg.in/h2non/gentleman": "gentleman",
    },
    "csharp": {
        "System.Net.Http.HttpClient": "standard",
        "System.Net.WebClient": "standard",
        "System.Net.HttpWebRequest": "standard",
        "RestSharp": "restsharp",
        "Flurl.Http": "flurl",
        "Refit": "refit",
    },
    "ruby": {
        "net/http": "standard",
        "Net::HTTP": "standard",
        "httparty": "httparty",
        "rest-client": "rest_client",
        "faraday": "faraday",
        "typhoeus": "typhoeus",
        "open-uri": "standard",
        "curb": "curb",
        "excon": "excon",
        "http.rb": "http_rb",
    },
    "kotlin": {
        "okhttp3.OkHttpClient": "okhttp",
        "com.squareup.okhttp": "okhttp",
        "retrofit2": "retrofit",
        "com.squareup.retrofit2": "retrofit",
        "fuel": "fuel",
        "com.github.kittinunf.fuel": "fuel",
        "io.ktor.client": "ktor",
        "org.http4k": "http4k",
        "java.net.http.HttpClient": "standard",
    },
    "swift": {
        "URLSession": "standard",
        "Foundation.URLSession": "standard",
        "Alamofire": "alamofire",
        "Moya": "moya",
        "URLRequest": "standard",
        "NWConnection": "standard",
        "AsyncHTTPClient": "async_http_client",
    },
}
HTTP_LIBRARIES["typescript"] = {
    name: kind
    for name, kind in HTTP_LIBRARIES["javascript"].items()
    if name not in ("request", "needle")
}

# Class -> reported name, where a language reports one.
CANONICAL_NAME = {
    "java": {
        "okhttp": "OkHttp",
        "apache_httpclient": "Apache HttpClient",
        "feign": "Feign",
        "jersey": "Jersey",
        "async_http_client": "AsyncHttpClient",
    },
    "kotlin": {
        "okhttp": "OkHttp",
        "retrofit": "Retrofit",
        "fuel": "Fuel",
        "ktor": "ktor",
        "http4k": "http4k",
    },
    "swift": {
        "alamofire": "Alamofire",
        "moya": "Moya",
        "async_http_client": "AsyncHTTPClient",
    },
}

# Names that only count when the import path also contains them.
REQUIRED_SUBSTRING = {
    ("java", "standard"): {"HttpClient": "HttpClient", "HttpURLConnection": "HttpURLConnection"},
    ("java", "spring"): {"RestTemplate": "RestTemplate", "WebClient": "WebClient"},
    ("kotlin", "standard"): {"HttpClient": "java.net.http.HttpClient"},
    ("csharp", "standard"): {
        "HttpClient": "HttpClient",
        "WebClient": "WebClient",
        "HttpWebRequest": "HttpWebRequest",
    },
}

_MATCH = {
    "python": "exact", "javascript": "exact", "typescript": "exact", "go": "full",
    "ruby": "full", "java": "prefix", "kotlin": "prefix", "csharp": "prefix",
    "swift": "segment",
}

# A client used without an import of its own:
# (language, text pattern, substring any match contains, name).
TEXT_CLIENTS = (
    ("javascript", r"\bfetch\s*\(", "fetch", "fetch"),
    ("typescript", r"\bfetch\s*\(", "fetch", "fetch"),
    ("ruby", r"\bNet::HTTP\b", "Net::HTTP", "net/http"),
    ("swift", r"\bURLSession\b", "URLSession", "URLSession"),
    ("swift", r"\bURLRequest\b", "URLRequest", "URLRequest"),
)


def first_segment(pattern: str) -> str:
    return pattern.split(".")[0]


def http_catalog(mode: str = "fixed") -> list[HttpLibrary]:
    """Catalog rows. ``mode='parity'`` keeps two known over- and under-matches:
    Kotlin and C# compare only the first segment of a pattern, and the C#
    standard clients are only found when the ``using`` names the class."""
    rows: list[HttpLibrary] = []
    for language, entries in HTTP_LIBRARIES.items():
        how = _MATCH[language]
        for pattern, kind in entries.items():
            key = pattern
            if how == "segment" or (mode == "parity" and language in ("kotlin", "csharp")):
                key = first_segment(pattern)
            narrowed = REQUIRED_SUBSTRING.get((language, kind))
            if narrowed:
                rows += [
                    HttpLibrary(language, key, kind, how, name, needle)
                    for needle, name in narrowed.items()
                ]
            elif language == "swift" and kind == "standard":
                # Importing Foundation is what makes URLSession available.
                if key == "Foundation":
                    rows.append(HttpLibrary(language, key, kind, how, "URLSession"))
            else:
                name = CANONICAL_NAME.get(language, {}).get(kind, pattern)
                rows.append(HttpLibrary(language, key, kind, how, name))
            if language == "ruby":
                rows.append(
                    HttpLibrary(language, pattern.replace("-", "_"), kind, "prefix", pattern)
                )
    if mode != "parity":
        rows.append(HttpLibrary("csharp", "System.Net.Http", "standard", "full", "HttpClient"))
    return rows


def http_library_names(mode: str = "fixed") -> list[str]:
    """Every name a detector can report; the closed domain of a repository's
    library set, which is what makes its aggregation state constant-size."""
    names = {row.canonical for row in http_catalog(mode)} | {c[3] for c in TEXT_CLIENTS}
    return sorted(names)
