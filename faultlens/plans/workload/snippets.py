"""Small code pieces put around document text to make source files of it.

``HEADS`` are import sections, ``BODIES`` are code. Some bodies hold words that
must *not* count where comments and strings are masked.
"""

HEADS = {
    "python": (
        "import requests, tenacity as t\nfrom urllib.request import urlopen\n",
        "import os\nimport aiohttp\nfrom http.client import HTTPConnection\n",
        "from .retry import policy\nimport httpx as client\n",
        "import json\n",
    ),
    "java": (
        "import org.springframework.web.client.RestTemplate;\n"
        "import io.github.resilience4j.circuitbreaker.CircuitBreakerRegistry;\n",
        "import okhttp3.OkHttpClient;\nimport org.apache.http.impl.client.HttpClients;\n",
        "import static java.net.http.HttpClient.newHttpClient;\n"
        "import dev.failsafe.Failsafe;\n",
        "import java.util.List;\n",
    ),
    "javascript": (
        "import axios from 'axios';\nconst again = require('p-retry');\n",
        "import { request } from 'undici/lib';\nimport 'node-fetch';\n",
        "const http = require( \"http\" );\nconst { Bottleneck } = require('bottleneck');\n",
        "const path = require('path');\n",
    ),
    "typescript": (
        "import axios, { AxiosError } from 'axios';\nimport { of } from 'rxjs';\n",
        "import got from \"got\";\nimport * as CB from 'opossum';\n",
        "import 'cross-fetch/polyfill';\n",
        "import { x } from './local';\n",
    ),
    "go": (
        "package main\nimport (\n\t\"net/http\"\n\t\"github.com/sony/gobreaker\"\n)\n",
        "package main\nimport \"github.com/valyala/fasthttp\"\n",
        "package main\nimport (\n\tb \"github.com/cenkalti/backoff/v4\"\n\t\"time\"\n)\n",
        "package main\nimport \"fmt\"\n",
    ),
    "ruby": (
        "require 'net/http'\nrequire 'json'\n",
        "require 'faraday'\nrequire 'faraday-retry'\n",
        "require_relative 'rest_client_helper'\nrequire 'semian'\n",
        "require 'set'\n",
    ),
    "csharp": (
        "using System.Net.Http;\nusing Polly.Retry;\n",
        "using RestSharp;\nusing static System.Math;\n",
        "using Flurl.Http;\nusing Microsoft.Extensions.Http.Resilience;\n",
        "using System;\n",
    ),
    "kotlin": (
        "import okhttp3.OkHttpClient\nimport kotlinx.coroutines.*\n",
        "import io.ktor.client.HttpClient\n",
        "import retrofit2.Retrofit\nimport io.github.resilience4j.retry.Retry\n",
        "import kotlin.math.max\n",
    ),
    "swift": (
        "import Foundation\nimport Alamofire\n",
        "import Moya\nimport Combine\n",
        "import UIKit\n",
        "import Foundation\n",
    ),
    "php": (
        "<?php\nuse GuzzleHttp\\Client;\n", "<?php\n", "<?php\nrequire 'a.php';\n", "<?php\n",
    ),
}

BODIES = {
    "python": (
        "def plain(a):\n    return a + 1\n",
        "def guarded(r):\n    try:\n        r.raise_for_status()\n    except ValueError as e:\n"
        "        print('timeout(3) and retry(2)')\n",
        "@retry\ndef again():\n    return timeout(3)\n",
        "def policy(c):\n    # retry(5) is only talked about\n    return c.with_backoff(2)\n",
        "with circuit_breaker(name='x'):\n    pass\n",
        "async def quiet():\n    note = \"\"\"try: backoff(1)\"\"\"\n    return note\n",
    ),
    "java": (
        "class Plain { int one() { return 1; } }\n",
        "class Guard { void run() { try { call(); } catch (Exception e) { log(e); } } }\n",
        "class Remote { @Retryable void go() throws IOException { client.getStatusCode(); } }\n",
        "class Calls { void go() { x.retryTimeout(3); y.withBackoff(2); z.orFallback(); } }\n",
        "class Cmd extends HystrixCommand<String> { String s = \"x.setTimeout(1)\"; }\n",
        "class Build { Object o = new RetryTemplate(); /* @Backoff */ int n = 0; }\n",
    ),
    "javascript": (
        "function plain(a) { return a + 1; }\n",
        "async function load(u) { try { return await fetch(u); } catch (e) { return null; } }\n",
        "p.then(f).catch(g);\nif (res.status === 200) { done(); }\n",
        "const options = { timeout: 5, 'maxRetries': 2 };\nconst note = 'retryNow(1)';\n",
        "class RetryQueue {}\nPromise.race([a, b]);\n// withBackoff(3)\n",
        "const b = new CircuitBreaker(f);\nbreaker.fire(x);\nlimiter.schedule(y);\n",
    ),
    "typescript": (
        "export function plain(a: number): number { return a + 1; }\n",
        "async function load(u: string, timeout: number): Promise<void> {\n"
        "  try { await f(u); } catch (e) { g(e); }\n}\n",
        "interface RetryPolicy { delay: number }\nload().catch(h);\n",
        "const options = { maxAttempts: 3, 'errorThreshold': 5 };\nr.status(200);\n",
        "@Injectable()\nclass Service {}\nconst note = 'timeoutAfter(1)';\n",
        "stream.pipe(x).retryWhen(h);\nconst c = new AbortController();\n// throttle(1)\n",
    ),
    "go": (
        "func plain(a int) int { return a + 1 }\n",
        "func load() error { if err := call(); err != nil { return err }\n return nil }\n",
        "func run() { ctx, stop := context.WithTimeout(base, 3)\n defer stop()\n use(ctx) }\n",
        "func again() { client.RetryMax(3)\n note := \"x.Backoff(1)\"\n use(note) }\n",
        "func wrap() { defer func() { if r := recover(); r != nil { log(r) } }() }\n",
        "func open() { cb := gobreaker.NewCircuitBreaker(gobreaker.Settings{})\n use(cb) }\n"
        "// x.Failover(2)\n",
    ),
    "ruby": (
        "def plain(a)\n  a + 1\nend\n",
        "begin\n  call\nrescue Timeout::Error => e\n  log(e)\nensure\n  close\nend\n",
        "retryable(tries: 3) do\n  call\nend\n",
        "def status_of(res)\n  res.code\nend\n# backoff(2)\n",
        "HTTParty.get(url)\nnote = 'x.circuit(1)'\n",
        "Net::HTTP.start(host) { |h| h.read_timeout = 5 }\n",
    ),
    "csharp": (
        "class Plain { int One() { return 1; } }\n",
        "class Guard { void Run() { try { Call(); } catch { Log(); } } }\n",
        "class Loader { async Task Go() { await policy.ExecuteAsync(f); } }\n",
        "class CircuitBreakerState { string note = \"x.Retry(1)\"; }\n",
        "class Token { object o = new CancellationTokenSource(); }\n// x.Fallback(2)\n",
        "class Check { void Go() { response.EnsureSuccessStatusCode(); x.WaitAndRetry(3); } }\n",
    ),
    "kotlin": (
        "fun plain(a: Int) = a + 1\n",
        "fun load() { try { call() } catch (e: Exception) { log(e) } }\n",
        "val x = withTimeout(3) { call() }\n",
        "fun retryCall() { repeat(3) { call() } } // exponential wait\n",
        "class MyCircuitBreaker { var n = 0 }\nval ok = response.code() == 200\n",
        "val c = HttpClient { install(HttpTimeout) }\nval g = rateLimit(5)\n",
    ),
    "swift": (
        "func plain(a: Int) -> Int { return a + 1 }\n",
        "func load() { do { try call() } catch { log(error) } }\n",
        "func get() async throws -> Result<Data, NetError> { try await call() }\n",
        "request.validate()\nstream.retry(3) // backoff\n",
        "config.timeoutIntervalForRequest = 5\nif r.statusCode == 404 { stop() }\n",
        "let s = URLSession.shared\nlet b = circuitBreaker\n",
    ),
    "php": (
        "function plain($a) { return $a + 1; }\n",
        "try { call(); } catch (Exception $e) { log($e); }\n",
        "$info = curl_getinfo($h);\n",
        "retry(3, $f);\n",
        "$x->timeout(5); $note = 'backoff(1)';\n",
        "try { timeout(5); } finally { done(); }\n",
    ),
}

#: Nested code: what a rule asks for stands at several depths, or just outside.
NESTED = {
    "java": (
        "class A { void f() { while (more()) { try { call(); } catch (E e) { if (e.soft()) { log(e); }"
        " Thread.sleep(5); } } } }\n",
        "class A { void f() { try { a(); } catch (E e) { if (b) { c(); } log(e.getStatusCode()); } } }\n",
        "class A { void f() { for (int i = 0; i < 3; i++) { g(i); } try { a(); } catch (E e) { log(e); }"
        " Thread.sleep(1); } }\n",
        "class A { void f() { do { if (x) { try { a(); } catch (E e) { { continue; } } } } while (n(1)); } }\n",
        "class A { void f() { try { a(); } catch (E e) { log(e); } { int statusCode = 1; } } }\n",
        "class A { void f() { for (X x : xs) { String s = \"catch (E e) { sleep(1); }\"; } } }\n",
    ),
    "javascript": (
        "async function f() { for (let i = 0; i < 3; i++) { try { return await g(i); } catch (e)"
        " { await sleep(100 * i); } } }\n",
        "function f() { while (n) { if (a) { b(); } } try { g(); } catch (e) { sleep(1); } }\n",
        "function f() { while (n) { try { g(); } catch { if (soft) { continue; } } } }\n",
        "function f() { for (const x of xs) { try { g(x); } catch (e) { log(e); } } sleep(2); }\n",
        "function f() { try { xs.forEach(x => { g(x); }); } catch (e) { h(); } }\n",
        "function f() { do { try { g(); } catch (e) { setTimeout(h, 5); } } while (n); }\n",
    ),
    "go": (
        "func f() { for i := 0; i < 3; i++ { if err := g(); err != nil { time.Sleep(wait); continue } } }\n",
        "func f() { defer func() { if x { if r := recover(); r != nil { log(r) } } }() }\n",
        "func f() { func() { g() }(); recover() }\n",
        "func f() error { for i := range xs { if err := g(i); err != nil { return err } } return nil }\n",
        "func f() { go func(n int) { { recover() } }(3) }\n",
        "func f() { for { if err != nil { continue } } }\n",
    ),
    "ruby": (
        "def f\n  n = 0\n  begin\n    g\n  rescue E => e\n    if n < 3\n      sleep 2\n      retry\n    end\n"
        "  end\nend\n",
        "3.times do |i|\n  begin\n    g\n  rescue E\n    next\n  end\nend\n",
        "def f\n  begin\n    g\n  rescue E\n    log\n  ensure\n    sleep 1\n  end\nend\n",
        "while more\n  begin\n    g\n  rescue E\n    sleep 1\n  end\nend\n",
        "loop do\n  g\nend\nbegin\n  h\nrescue E\n  sleep 1\nend\n",
        "def f\n  g\nend\n",
    ),
    "csharp": (
        "class A { async Task RunRetries(int n) { if (n > 0) { while (true) { await G(); } } } }\n",
        "class A { void Run() { CallRetry(1); for (int i = 0; i < 3; i++) { G(); } } }\n",
        "class A { void Run() { foreach (var x in xs) { try { G(x); } catch (E e)"
        " { if (e.Soft) { Log(e); } Task.Delay(5); } } } }\n",
        "class A { void RetryOnce() { G(); } void Run() { while (n) { G(); } } }\n",
        "class A { void Run() { try { G(); } catch { Thread.Sleep(1); } } }\n",
        "class A { void Run() { while (n) { try { G(); } catch (E) { { continue; } } } } }\n",
    ),
}
NESTED["typescript"] = tuple(
    piece.replace("function f()", "function f(): Promise<void>") for piece in NESTED["javascript"])

#: Python that no parser accepts, and next to each piece one like it that is fine.
BROKEN_PYTHON = (
    "def f(:\n    pass\n", "def f():\n    pass\n",
    "try:\n    f(1, [2)\nexcept E:\n    pass\n", "try:\n    f(1, [2])\nexcept E:\n    pass\n",
    "x = 'retry(3)\n", "x = 'retry(3)'\n",
    "if a:\n    b()\n  c()\n", "if a:\n    b()\n    c()\n",
    "while a:\nb()\n", "while a: b()\n",
    'x = """timeout(1)\n', 'x = """timeout(1)\n"""\n',
)
