"""HTTP library detection and catalog joins."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import files_of
from faultlens.catalogs.http_libraries import HTTP_LIBRARIES, http_library_names
from faultlens.catalogs.resilience_libraries import resilience_library_names
from faultlens.operators import libraries as L
from faultlens.operators.signals import classify_files, detect_http_libraries

# (language, content, fixed result, parity result or None when equal)
CASES = [
    ("python", "import urllib.request as u, os\n", "urllib,urllib.request", None),
    ("python", "from tornado.httpclient import X\n", "tornado.httpclient", None),
    ("python", "import requests_mock\n", "", None),
    ("python", "def f():\n    import httpx\n", "httpx", None),
    ("python", "s = '''\nimport httpx\n'''\n", "", None),
    ("java", "import java.net.http.HttpClient;\nimport java.net.HttpURLConnection;",
     "HttpClient,HttpURLConnection", None),
    ("java", "import okhttp3.*;", "", None),
    ("java", "import com.squareup.okhttp.*;", "OkHttp", None),
    ("java", "import org.springframework.web.reactive.function.client.WebClient;", "WebClient",
     None),
    ("java", "// import feign.Client;", "", None),
    ("java", "import feign.Client", "", None),
    ("javascript", "import x from 'axios/lib'", "axios", None),
    ("javascript", "import {\n a\n} from 'axios'", "", None),
    ("javascript", "import 'ky'; const g = require('got')", "got,ky", None),
    ("javascript", "import a from 'x'; const b = require('needle')", "needle", None),
    ("javascript", "fetch ('/x')", "fetch", None),
    ("javascript", "prefetch('/x')", "", None),
    ("javascript", "import h from 'node:https'", "node:https", None),
    ("typescript", "import r from 'request'", "", None),
    ("typescript", "import r from 'undici'", "undici", None),
    ("go", "import \"net/http\"", "net/http", None),
    ("go", "import (\n\t\"fmt\"\n\th \"github.com/valyala/fasthttp\"\n)",
     "github.com/valyala/fasthttp", None),
    ("go", "import (\n\t\"github.com/go-resty/resty/v2\"\n)", "", None),
    ("go", "import \"net/http/httptest\"", "", None),
    ("csharp", "using System.Net.Http;", "HttpClient", ""),
    ("csharp", "using Flurl;", "", "Flurl.Http"),
    ("csharp", "using RestSharp.Extensions;", "RestSharp", None),
    ("ruby", "require 'rest-client'", "rest-client", None),
    ("ruby", "require_relative 'rest_client_x'", "rest-client", None),
    ("ruby", "Net::HTTP.get(u)", "net/http", None),
    ("kotlin", "import com.example.Thing", "", "Fuel,OkHttp,Retrofit"),
    ("kotlin", "import io.ktor.client.engine.*", "ktor", None),
    ("kotlin", "import java.net.http.HttpClient", "java.net.http.HttpClient", None),
    ("swift", "import Foundation", "URLSession", None),
    ("swift", "import Moya\nlet r = URLRequest(url: u)", "Moya,URLRequest", None),
    ("swift", "import Alamofire.Session", "", None),
    ("cobol", "import requests", "", None),
]


@pytest.mark.parametrize("mode", ["fixed", "parity"])
def test_detection(spark, mode):
    rows = detect_http_libraries(files_of(spark, [c[:2] for c in CASES]), mode=mode)
    found = {r["id"]: r for r in rows.collect()}
    wrong = []
    for i, (language, content, fixed, parity) in enumerate(CASES):
        want = fixed if mode == "fixed" or parity is None else parity
        if ",".join(found[i]["http_libraries"]) != want:
            wrong.append((language, content, want, found[i]["http_libraries"]))
        assert found[i]["has_http_library"] == bool(found[i]["http_libraries"])
    assert not wrong, "\n".join(map(str, wrong))


def test_catalog_size():
    sizes = {language: len(entries) for language, entries in HTTP_LIBRARIES.items()}
    assert sizes == {"python": 12, "java": 12, "javascript": 16, "typescript": 14, "go": 6,
                     "csharp": 6, "ruby": 10, "kotlin": 9, "swift": 7}
    assert sum(sizes.values()) == 92


def test_reported_names_are_in_the_domains(spark):
    files = files_of(spark, [c[:2] for c in CASES])
    for mode in ("fixed", "parity"):
        out = classify_files(files, mode=mode)
        names = {n for r in out.collect() for n in r["http_libraries"]}
        assert names <= set(http_library_names()) | set(http_library_names("parity"))
        names = {n for r in out.collect() for n in r["resilience_libraries"]}
        assert names <= set(resilience_library_names())


def test_builder_adds_a_library_without_import(spark):
    rows = [("kotlin", "val c = OkHttpClient.Builder()"), ("kotlin", "val c = HttpClient { }")]
    out = classify_files(files_of(spark, rows)).orderBy("id").collect()
    assert [r["resilience_libraries"] for r in out] == [["OkHttp"], ["Ktor Client"]]
    assert [r["label"] for r in out] == ["None", "None"]


@pytest.fixture(scope="module")
def joined(spark):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("ab.") for _ in range(n))
    paths = [word(rng.randint(0, 9)) for _ in range(300)]
    patterns = sorted({word(rng.randint(1, 4)) for _ in range(60)})
    imports = spark.createDataFrame(list(enumerate(paths)), "id int, path string")
    catalog = spark.createDataFrame([(p,) for p in patterns], "pattern string")
    return paths, patterns, imports, catalog


@pytest.mark.parametrize("match, test", [
    (lambda i, c: L.match_exact(i, c), lambda p, q: p == q),
    (lambda i, c: L.match_exact(i, c, "."), lambda p, q: q in (p, p.split(".")[0])),
    (L.match_prefix, lambda p, q: p.startswith(q)),
    (L.match_contains, lambda p, q: q in p),
    (lambda i, c: L.match_contains(i, c, 3), lambda p, q: q in p),
])
def test_joins_against_brute_force(joined, match, test):
    paths, patterns, imports, catalog = joined
    got = sorted((r["id"], r["pattern"]) for r in match(imports, catalog).collect())
    want = sorted((i, q) for i, p in enumerate(paths) for q in patterns if test(p, q))
    assert got == want


def test_first_segment_join(spark, joined):
    paths, patterns, imports, catalog = joined
    usable = [q for q in patterns if q.split(".")[0]]
    got = sorted((r["id"], r["pattern"])
                 for r in L.match_first_segment(imports, catalog.where(
                     F.substring_index("pattern", ".", 1) != "")).collect())
    want = sorted((i, q) for i, p in enumerate(paths) for q in usable
                  if p.startswith(q.split(".")[0]))
    assert got == want


def test_empty_catalog(spark, joined):
    _, _, imports, catalog = joined
    assert L.match_prefix(imports, catalog.limit(0)).count() == 0
    assert L.match_contains(imports, catalog.limit(0)).count() == 0


def test_catalog_rows_keep_their_columns(spark):
    imports = spark.createDataFrame([(1, "net.http"), (2, None), (3, ""), (4, "é.漢字"), (4, "é.漢字")],
                                    "id int, path string")
    catalog = spark.createDataFrame(
        [("net", 1, ["x"]), ("net", 2, None), ("", 3, []), (None, 4, []), ("漢", 5, []), ("é", 6, [])],
        "pattern string, n int, flags array<string>")
    for match, expected in ((L.match_prefix, [(1, 1), (1, 2), (4, 6), (4, 6)]),
                            (L.match_contains, [(1, 1), (1, 2), (4, 5), (4, 5), (4, 6), (4, 6)])):
        rows = match(imports, catalog).select("id", "n", "flags", "path").collect()
        assert sorted((r.id, r.n) for r in rows) == expected
        assert {(r.n, tuple(r.flags)) for r in rows if r.n == 1} == {(1, ("x",))}


def test_no_job_while_a_catalog_join_is_built(spark, joined):
    *_, imports, catalog = joined
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "")
    L.match_prefix(imports, catalog)
    L.match_contains(imports, catalog)
    assert not tracker.getJobIdsForGroup("building")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("patterns", [["a", "aa", "aaa", "aaaa"], ["a" * n for n in range(1, 400)], ["ab", "b"]])
def test_a_path_is_read_once(patterns):
    """Steps of the automaton grow with the path, not with the patterns that end along it."""
    import time

    automaton = L.Automaton(patterns)
    path = "a" * 300_000
    began = time.perf_counter()
    found = automaton.found(path)
    assert found == {k for k, p in enumerate(patterns) if p in path}
    assert time.perf_counter() - began < 2


def test_library_statistics(spark):
    results = spark.createDataFrame([
        ("a", ["axios", "fetch"], ["javascript", "python"]),
        ("b", ["axios"], ["javascript"]), ("c", [], ["go"]), ("d", ["Zeta"], ["go"]),
    ], "repo_url string, http_libraries array<string>, languages array<string>")
    catalog = L.catalog_order(L.library_catalog(results)).collect()
    assert [(r[0], r[1], r[2]) for r in catalog] == [
        ("axios", 2, 50.0), ("fetch", 1, 25.0), ("Zeta", 1, 25.0)]
    assert L.library_coverage(results).first().asDict() == {
        "n_repos": 4, "with_library": 3, "without_library": 1, "n_libraries": 3, "n_pairs": 4}
    top = {r[0]: r[1] for r in
           L.top_languages(L.language_cooccurrence(results), 1).collect()}
    assert top == {"axios": "javascript (2)", "fetch": "javascript (1)", "Zeta": "go (1)"}
