"""Signals per language: one row per rule or quirk, evaluated in one job."""

import pytest

from conftest import files_of
from faultlens.catalogs.signals import Rule, signal_rules
from faultlens.operators.signals import classify_files, merge_flags, rules_from_table

# (language, content, label, flags that must be found, exactly)
CASES = [
    # python
    ("python", "x = 1\n", "None", ""),
    ("python", "try:\n    f()\nexcept E:\n    pass\n", "Basic", "try_catch"),
    ("python", "def country(entry): return 1\n", "None", ""),
    ("python", "r.raise_for_status()\n", "Basic", "status_check"),
    ("python", "if r.status_code == 200: pass\n", "None", ""),
    ("python", "timeout(3)\n", "Advanced", "timeout"),
    ("python", "timeout = 3\n", "None", ""),
    ("python", "def retry(x): return x\n", "None", ""),
    ("python", "a = [Retry (3)]\n", "Advanced", "retry"),
    ("python", "s.circuit_breaker_state()\n", "None", ""),
    ("python", "circuit_breaker(f)\n", "Advanced", "circuit_breaker"),
    ("python", "backoff(f)\n", "Advanced", "exponential_backoff"),
    ("python", "c.with_retry().with_timeout().with_backoff()\n", "Advanced",
     "timeout,retry,exponential_backoff"),
    ("python", "@retry\ndef f(): pass\n", "Advanced", "retry"),
    ("python", "@retry\nasync def f(): pass\n", "None", ""),
    ("python", "@timeout\n@other\ndef f(): pass\n", "Advanced", "timeout"),
    ("python", "# timeout(3)\ns = 'retry(2)'\nd = \"\"\"try:\n backoff(1)\"\"\"\n", "None", ""),
    ("python", "import os, tenacity as t\n", "Advanced", ""),
    ("python", "from requests.adapters import HTTPAdapter\n", "Advanced", ""),
    ("python", "import tenacity_extras\n", "None", ""),
    # java
    ("java", "class A { int f() { return 1; } }", "None", ""),
    ("java", "class A { void f() { try { g(); } finally { } } }", "Basic", "try_catch"),
    ("java", "class A { void f() throws E { } }", "Basic", ""),
    ("java", "class A { void f() { throw new E(); } }", "Basic", ""),
    ("java", "class A { void f() { r.getStatusCode(); } }", "Basic", "status_check"),
    ("java", "try { a(); } catch (E e) { log(e.status_code); }", "Basic",
     "try_catch,status_check"),
    ("java", "// @Retryable\nclass A {}", "Advanced", "retry"),
    ("java", "@RestControllerAdvice class A {}", "None", "global_exception_handler"),
    ("java", "@ExceptionHandler class A {}", "None", "exception_handler"),
    ("java", "@RateLimiter class A {}", "Advanced", ""),
    ("java", "class A { Object o = new FixedBackOff(); }", "Advanced", "exponential_backoff"),
    ("java", "class A { Object o = new Bulkhead(); }", "None", ""),
    ("java", "class A extends HystrixObservableCommand<X> {}", "Advanced", "circuit_breaker"),
    ("java", "class A { void f() { x.retryTimeout(); } }", "Advanced", "retry"),
    ("java", "class A { void f() { x.setTimeout(1); } }", "Advanced", "timeout"),
    ("java", "class A { void f() { x.withWaitStrategy(w); } }", "Advanced", "exponential_backoff"),
    ("java", "class A { void f() { x.rateLimit(w); } }", "Advanced", ""),
    ("java", "class A { void retryLater() { } }", "None", ""),
    ("java", "import io.github.resilience4j.timelimiter.TimeLimiter;", "Advanced", "timeout"),
    ("java", "import org.springframework.retry.backoff.BackOffPolicy;", "Advanced",
     "retry,exponential_backoff"),
    ("java", "import net.jodah.failsafe.*;", "Advanced", "retry,circuit_breaker"),
    ("java", "class A { String s = \"x.setTimeout(1); try {\"; }", "None", ""),
    # javascript
    ("javascript", "function plain() { return 1; }", "None", ""),
    ("javascript", "try { f() } catch (e) {}", "Basic", "try_catch"),
    ("javascript", "p.catch(f)", "Basic", "promise_catch"),
    ("javascript", "if (res.status > 1) f()", "Basic", "status_check"),
    ("javascript", "f(...status)", "None", ""),
    ("javascript", "setTimeout(f, 1)", "Advanced", "timeout"),
    ("javascript", "function retryAll() {}", "None", ""),
    ("javascript", "retryAll(function () {})", "Advanced", "retry"),
    ("javascript", "class A { retry(x) { return x } }", "None", ""),
    ("javascript", "Promise.race([a])", "Advanced", "timeout"),
    ("javascript", "breaker.fire(1)", "Advanced", "circuit_breaker"),
    ("javascript", "breaker.open(1)", "None", ""),
    ("javascript", "retryClient.get(1)", "Advanced", "retry"),
    ("javascript", "limiter.schedule(f)", "Advanced", "rate_limiting"),
    ("javascript", "const o = { timeout: 1, 'retries': 2, threshold: 5, retryDelay: 1 }",
     "Advanced", "timeout,retry,circuit_breaker,exponential_backoff"),
    ("javascript", "const o = { timeout }", "Advanced", "timeout"),
    ("javascript", "import { timeout } from './x'", "None", ""),
    ("javascript", "class MyLimiter {}", "Advanced", "rate_limiting"),
    ("javascript", "new AbortController()", "Advanced", "timeout"),
    ("javascript", "new lib.Breaker()", "None", ""),
    ("javascript", "const r = require('async-retry')", "Advanced", "retry"),
    ("javascript", "import ax from 'axios'", "Advanced", "timeout"),
    ("javascript", "// setTimeout(f)\nconst s = `retry(${x})`; const t = 'p.catch(f)'", "None", ""),
    ("javascript", "const u = 'http://x'; setTimeout(f)", "Advanced", "timeout"),
    ("javascript", "const q = /['\"]/; setTimeout(f)", "Advanced", "timeout"),
    # typescript
    ("typescript", "const x: number = 1", "None", ""),
    ("typescript", "if (res.status > 1) f()", "None", ""),
    ("typescript", "res.status(200)", "Basic", "status_check"),
    ("typescript", "p.catch", "None", ""),
    ("typescript", "p.catch(f)", "Basic", "promise_catch"),
    ("typescript", "@Injectable() class A {}", "Advanced", "decorator"),
    ("typescript", "@RetryOn class A {}", "Advanced", "decorator,retry"),
    ("typescript", "interface RetryPolicy { timeout: number }", "Advanced", "retry"),
    ("typescript", "type BackoffKind = 'a'", "Advanced", "exponential_backoff"),
    ("typescript", "function f(a: string, timeout: number): void {}", "None", ""),
    ("typescript", "const o = { maxAttempts: 1 }", "Advanced", "retry"),
    ("typescript", "s.pipe(x).retryWhen(f)", "Advanced", "retry"),
    ("typescript", "import { of } from 'rxjs/operators'", "Advanced", "timeout,retry"),
    ("typescript", "const r = require('p-retry')", "None", ""),
    # go
    ("go", "func f() int { return 1 }", "None", ""),
    ("go", "func f() { if err != nil { return } }", "Basic", "error_check"),
    ("go", "func f() { if err := g(); err != nil { return } }", "Basic", "error_check"),
    ("go", "func f() { if err != nil && x { return } }", "None", ""),
    ("go", "func f() { defer g() }", "Basic", ""),
    ("go", "func f() { defer func() { recover() }() }", "Basic", "defer_recover"),
    ("go", "func f() { r.StatusCode() }", "Basic", "status_check"),
    ("go", "func f() { if r.StatusCode != 200 { g() } }", "None", ""),
    ("go", "func f() { context.WithDeadline(c, d) }", "Advanced", "timeout"),
    ("go", "func f() { context.WithCancel(c) }", "Advanced", ""),
    ("go", "func f() { <-time.After(3) }", "Advanced", "timeout"),
    ("go", "func f() { backoff.New() }", "Advanced", "exponential_backoff"),
    ("go", "func f() { retryIt() }", "Advanced", "retry"),
    ("go", "func retryIt() { }", "None", ""),
    ("go", "func (c *T) retryIt() { }", "None", ""),
    ("go", "func f() { cb := gobreaker.Settings{} }", "Advanced", "circuit_breaker"),
    ("go", "func f() { p := x.RetryPolicy{} }", "Advanced", "retry"),
    ("go", "func f() { if x.retry { g() } }", "None", ""),
    ("go", "import (\n\t\"github.com/avast/retry-go/v4\"\n)", "Advanced", "retry"),
    ("go", "func f() { s := \"context.WithTimeout(a)\" }", "None", ""),
    # ruby
    ("ruby", "def f\n  1\nend", "None", ""),
    ("ruby", "begin\n  f\nrescue E\nensure\n  g\nend", "Basic", "rescue,ensure"),
    ("ruby", "r.code", "Basic", "status_check"),
    ("ruby", "http.read_timeout = 5", "Advanced", "timeout"),
    ("ruby", "http&.read_timeout", "None", ""),
    ("ruby", "retryable(tries: 3) do\nend", "Advanced", "retry"),
    ("ruby", "retryable(tries: 3, exponential_backoff: true) do\nend", "Advanced",
     "retry,exponential_backoff"),
    ("ruby", "Timeout.other", "Advanced", "timeout"),
    ("ruby", "CircuitThing", "Advanced", "circuit_breaker"),
    ("ruby", "HTTParty.get(u)", "Advanced", ""),
    ("ruby", "limiter.throttle", "Advanced", "rate_limiting"),
    ("ruby", "require 'net/http'", "Advanced", ""),
    ("ruby", "require 'stoplight'", "Advanced", "circuit_breaker"),
    ("ruby", "# x.timeout\ns = 'x.retry'\n=begin\nx.circuit\n=end\n", "None", ""),
    # csharp
    ("csharp", "class A { int F() { return 1; } }", "None", ""),
    ("csharp", "try { F(); } catch { }", "Basic", "try_catch"),
    ("csharp", "r.EnsureSuccessStatusCode();", "Basic", "status_check"),
    ("csharp", "p.WaitAndRetryAsync(3);", "Advanced", "retry"),
    ("csharp", "class A { async Task RetryNow() { F(); } }", "None", ""),
    ("csharp", "class A { async Task RetryNow() { while (true) F(); } }", "Advanced", "retry"),
    ("csharp", "class A { Task TimeoutIt(CancellationToken t) { F(); } }", "Advanced", "timeout"),
    ("csharp", "await p.ExecuteAsync(f);", "Advanced", ""),
    ("csharp", "var p = new ResiliencePipelineBuilder();", "Advanced", ""),
    ("csharp", "var c = new CancellationTokenSource(5);", "Advanced", "timeout"),
    ("csharp", "class CircuitBreakerThing {}", "Advanced", "circuit_breaker"),
    ("csharp", "using Polly.CircuitBreaker;", "Advanced", "circuit_breaker"),
    ("csharp", "using Microsoft.Extensions.Http.Polly;", "Advanced", "retry,circuit_breaker"),
    ("csharp", "var s = @\"x.Retry(1)\"; // y.Timeout(2)", "None", ""),
    # kotlin: raw text, comments count
    ("kotlin", "fun f() = 1", "None", ""),
    ("kotlin", "try { f() } catch (e: E) { }", "Basic", "try_catch"),
    ("kotlin", "try { a { } } catch (e: E) { }", "None", ""),
    ("kotlin", "if (response.code() == 1) f()", "Basic", "status_check"),
    ("kotlin", "if (x.isSuccessful()) f()", "Basic", "status_check"),
    ("kotlin", "// timeout: 5", "Advanced", "timeout"),
    ("kotlin", "withTimeoutOrNull(5) { f() }", "Advanced", "timeout,coroutine_timeout"),
    ("kotlin", "retry { f() }", "Advanced", "retry"),
    ("kotlin", "repeat(3) { f() } // with Exponential wait", "Advanced", "retry,exponential_backoff"),
    ("kotlin", "val b = \"backoff\"", "None", ""),
    ("kotlin", "WHILE (x && RETRY) {}", "Advanced", "retry"),
    ("kotlin", "class mycircuitbreaker", "Advanced", "circuit_breaker"),
    ("kotlin", "val theCircuit = 1", "Advanced", "circuit_breaker"),
    ("kotlin", "SupervisorJob()", "Advanced", "timeout,coroutine_timeout"),
    ("kotlin", "Throttle(5)", "Advanced", "rate_limiting"),
    ("kotlin", "import okhttp3.OkHttpClient", "Advanced", "timeout"),
    ("kotlin", "import io.github.resilience4j.kotlin.x", "Advanced",
     "timeout,retry,circuit_breaker"),
    # swift: raw text
    ("swift", "func f() {}", "None", ""),
    ("swift", "do { try f() } catch { }", "Basic", "do_catch"),
    ("swift", "func f() -> Result<A, B> {}", "Basic", "result_type"),
    ("swift", "func f(a: A) async -> B {}", "Basic", "async_throws"),
    ("swift", "if r.statusCode == 404 {}", "Basic", "status_check"),
    ("swift", "guard let r = x,\n r.statusCode > 1 else {}", "Basic", "status_check"),
    ("swift", "x.timeoutInterval = 5", "Advanced", "timeout"),
    ("swift", "firstly { f() }\n.then { }\n.retry", "Advanced", "retry"),
    ("swift", "for _ in 0...retries { }", "Advanced", "retry"),
    ("swift", "x.retry(3) // BackOff", "Advanced", "retry,exponential_backoff"),
    ("swift", "enum CircuitState {}", "Advanced", "circuit_breaker"),
    ("swift", "import Retry", "Advanced", "retry,exponential_backoff"),
    ("swift", "import Foundation", "None", ""),
    # both tiers; unknown language
    ("python", "try:\n  timeout(1)\nexcept E: pass\n", "Mixed", "try_catch,timeout"),
    ("cobol", "try { retry() }", "None", ""),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = classify_files(files_of(spark, [c[:2] for c in CASES])).collect()
    return {r["id"]: r for r in rows}


def test_labels_and_flags(found):
    wrong = []
    for i, (language, content, label, flags) in enumerate(CASES):
        want = set(filter(None, flags.split(",")))
        if (found[i]["label"], set(found[i]["flags"])) != (label, want):
            wrong.append((language, content, label, sorted(want), found[i]["label"],
                          found[i]["flags"]))
    assert not wrong, "\n".join(map(str, wrong))


def test_every_row_kept(found):
    assert len(found) == len(CASES)
    assert {r["parse_status"] for r in found.values()} == {"ok"}


def test_parity_leaves_additions_out(spark):
    rows = [("ruby", "begin\n f\nrescue E\n retry\nend"), ("javascript", "if (!res.ok) f()"),
            ("csharp", "if (r.IsSuccessStatusCode) F();"), ("swift", "let x = try? f()")]
    fixed = [r["label"] for r in classify_files(files_of(spark, rows)).orderBy("id").collect()]
    parity = [r["label"] for r in
              classify_files(files_of(spark, rows), mode="parity").orderBy("id").collect()]
    assert fixed == ["Mixed", "Basic", "Basic", "Basic"]
    assert parity == ["Basic", "None", "None", "None"]
    assert {r.only for r in signal_rules("parity")} == {None}


def test_exact_python_agrees_and_sees_syntax_errors(spark):
    python = [c for c in CASES if c[0] == "python"]
    rows = [c[:2] for c in python] + [("python", "def broken(:\n  timeout(1)\n"),
                                      ("go", "func f() { retryIt() }")]
    out = classify_files(files_of(spark, rows), exact_python=True).orderBy("id").collect()
    for case, row in zip(python, out):
        assert row["label"] == case[2], case
        assert set(row["flags"]) == set(filter(None, case[3].split(","))), case
    assert (out[-2]["parse_status"], out[-2]["label"]) == ("failed", "None")
    assert (out[-1]["parse_status"], out[-1]["label"]) == ("ok", "Advanced")


def test_unreadable_file_fails(spark):
    rows = spark.createDataFrame(
        [("r", "a", "go", None, False), ("r", "b", "go", "func f() { retryIt() }", True)],
        "repo_url string, path string, language string, content string, decode_ok boolean")
    out = {r["path"]: r for r in classify_files(rows).collect()}
    assert (out["a"]["parse_status"], out["a"]["label"], out["a"]["flags"]) == ("failed", "None", [])
    assert out["b"]["label"] == "Advanced"


def test_crlf_is_a_line_end(spark):
    rows = [("python", "@retry\r\ndef f():\r\n    pass\r\n"), ("swift", "import Moya\r\n")]
    out = classify_files(files_of(spark, rows)).orderBy("id").collect()
    assert out[0]["flags"] == ["retry"]
    assert out[1]["resilience_libraries"] == ["Moya"]


def test_own_rules_replace_the_built_in_ones(spark):
    table = spark.createDataFrame(
        [("x.todo", "*", "raw", "TODO", "basic", ["todo"]),
         ("x.hack", "lua", "raw", "HACK", "advanced", None)],
        "rule_id string, language string, target string, pattern string, tier string, "
        "flags array<string>")
    rules = rules_from_table(table)
    files = files_of(spark, [("lua", "-- TODO HACK"), ("perl", "# TODO HACK"), ("lua", "")])
    out = classify_files(files, languages=("lua", "perl"), rules=rules, shapes=[], libraries=())
    assert [(r["label"], r["flags"]) for r in out.orderBy("id").collect()] == [
        ("Mixed", ["todo"]), ("Basic", ["todo"]), ("None", [])]
    with pytest.raises(ValueError, match="no such shape"):
        classify_files(files, languages=("lua",), shapes=[], libraries=(),
                       rules=[Rule("x", "lua", "calls", "a", "basic")])


def test_php_rules_exist_but_are_not_routed(spark):
    rows = [("php", "<?php try { timeout(1); } finally {}")]
    assert classify_files(files_of(spark, rows)).first()["label"] == "None"
    out = classify_files(files_of(spark, rows), languages=("php",), libraries=())
    assert out.first()["label"] == "Mixed"


def test_merge_flags(spark):
    rows = spark.createDataFrame([(["a", "c"], ["b", "c"]), ([], None)],
                                 "l array<string>, r array<string>")
    from pyspark.sql import functions as F
    assert [r[0] for r in rows.select(merge_flags(F.col("l"), F.col("r"))).collect()] == [
        ["a", "b", "c"], []]


def test_long_literals_do_not_overflow_the_stack(spark):
    body = "a\\n" * 100_000
    rows = [("java", f'class A {{ String s = "{body}"; }} x.setTimeout(1);'),
            ("javascript", f"const s = `{body}`; setTimeout(f)"),
            ("python", f'x = """{body}"""\ntimeout(1)\n'),
            ("swift", "firstly " + body), ("go", "defer x() " + body)]
    out = classify_files(files_of(spark, rows)).orderBy("id").collect()
    assert [r["label"] for r in out] == ["Advanced", "Advanced", "Advanced", "None", "Basic"]


def test_any_number_of_rule_groups(spark):
    """200 groups take several bigints; a gate opens and closes rules of another one."""
    rules = [Rule("gate.open", "lua", "raw", "open_sesame", "basic", flags=("gate",))]
    rules += [Rule(f"r{i}", "lua", "raw", f"word_{i}_", "basic", flags=(f"flag_{i}",))
              for i in range(198)]
    rules.append(Rule("late", "lua", "raw", "treasure", "advanced", flags=("late",),
                      requires="gate."))
    files = spark.createDataFrame([
        ("a", "lua", "word_0_ word_61_ word_62_ word_150_ treasure"),
        ("b", "lua", "open_sesame treasure word_197_"), ("c", "lua", "")],
        "path string, language string, content string")
    out = classify_files(files, languages=("lua",), rules=rules, shapes=[], libraries=())
    found = {r["path"]: (r["label"], sorted(r["flags"])) for r in out.collect()}
    assert found == {
        "a": ("Basic", ["flag_0", "flag_150", "flag_61", "flag_62"]),
        "b": ("Mixed", ["flag_197", "gate", "late"]),
        "c": ("None", []),
    }
