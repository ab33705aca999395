"""What stands inside what, and the signals that depend on it."""

import time

import pytest

from conftest import files_of
from faultlens.catalogs.blocks import BLOCKS, KINDS
from faultlens.functions import text
from faultlens.functions.blocks import INSIDE, block_pairs_sql, pair_mask
from faultlens.operators.signals import classify_files

PAIRS = [
    ("java", "while (g(x(1))) { try { h(); } catch (E e) { if (a) { log(); } Thread.sleep(1); } }",
     "loop>try loop>catch loop>wait catch>wait caught_loop>wait"),
    ("java", "for (;;) if (x) { try { } catch (E e) { continue; } }",
     "loop>try loop>catch loop>again catch>again caught_loop>again"),
    ("java", "try { a(); } catch (E e) { if (b) { c(); } log(e.getStatusCode()); }", "catch>status"),
    ("java", "try { a(); } catch (E e) { } { int statusCode; }", ""),
    ("java", "while (x) { a(); } try { b(); } catch (E e) { Thread.sleep(1); }", "catch>wait"),
    ("java", "try { a(); } catch (E e) { } } } for (;;) { continue; }", "loop>again"),
    ("javascript", "do { try { g() } catch { await sleep(3) } } while (n)",
     "loop>try loop>catch loop>wait catch>wait caught_loop>wait"),
    ("typescript", "for await (const x of f(y)) { try { } catch (e: any) { continue } }",
     "loop>try loop>catch loop>again catch>again caught_loop>again"),
    ("go", "for i := 0; i < 3; i++ { if err := f(); err != nil { time.Sleep(1); continue } }",
     "loop>catch loop>wait loop>again catch>wait catch>again caught_loop>wait caught_loop>again"),
    ("go", "for { if stderr != nil { continue } }; err := 1", "loop>again"),
    ("go", "defer func() { if r := recover(); r != nil { log(r) } }()", "literal>recover"),
    ("go", "func() { }(); recover()", ""),
    ("ruby", "begin\n  x\nrescue E => e\n  sleep 1\n  retry if n < 3\nend\n",
     "try>catch try>wait try>again catch>wait catch>again"),
    ("ruby", "begin\n  x\nrescue E\n  y\nensure\n  sleep 1\nend\nsleep 2 # rescue retry", "try>catch try>wait"),
    ("ruby", "x = if a then begin; b; rescue E; end end\nretry # sleep next\n", "try>catch"),
    ("csharp", "async Task<int> RunWithRetry<T>(Func<T> f, int n = (3)) where T : X { if (a) { while (true) { } } }",
     "retry_method>loop"),
    ("csharp", "void Go() { Retry(() => { while (true) { } }); } void B() { for (;;) { } }", ""),
    ("csharp", "foreach (var x in y) { try { f(); } catch (E e) when (e.A(1)) { await Task.Delay(3); } }",
     "loop>try loop>catch loop>wait catch>wait caught_loop>wait"),
]


def pairs_of(spark, language, rows):
    masked = spark.createDataFrame([(r,) for r in rows], "c string").selectExpr(
        f"{text.mask_code_sql('c', language)} AS m")
    found = [r.x for r in masked.selectExpr(f"{block_pairs_sql('m', language)} AS x").collect()]
    return [{f"{o}>{i}" for o in KINDS for i in INSIDE if x & pair_mask(f"{o}>{i}")} for x in found]


@pytest.mark.parametrize("language", sorted(BLOCKS))
def test_pairs(spark, language):
    cases = [(code, set(pairs.split())) for name, code, pairs in PAIRS if name == language]
    # A file in which nothing could be found is not read; its pairs are none, too.
    for (code, expected), found in zip(cases, pairs_of(spark, language, [c for c, _ in cases])):
        assert found == expected, code


def test_deep_nesting_and_loose_ends(spark):
    depth = 100_000
    deep = "for (;;) { " * depth + "try { } catch (E e) { continue; }" + " }" * depth
    loose = "} } }" + deep + "} }" + "{" * 500_000
    assert pairs_of(spark, "java", [deep])[0] >= {"caught_loop>again"}
    assert pairs_of(spark, "java", [loose])[0] >= {"caught_loop>again"}


@pytest.mark.parametrize("language,line", [
    ("java", "while (a) "), ("java", "for (("), ("java", "catch (E e) continue; do "),
    ("go", "for if err func() "), ("go", "if err != nil "), ("go", "func(x int) "),
    ("csharp", "int Retry(int x) where "), ("ruby", "while rescue "), ("javascript", "catch for (await ("),
])
def test_time_grows_with_the_text_alone(spark, language, line):
    tail = " catch rescue err func recover continue sleep Sleep retry etry while for"

    def seconds(n):
        began = time.perf_counter()
        pairs_of(spark, language, [line * n + tail])
        return time.perf_counter() - began

    seconds(100)
    assert seconds(200_000) < 20


NESTED = [
    ("java", "class A { void f() { while (x) { try { g(); } catch (E e) { if (a) { b(); } Thread.sleep(1); } } } }",
     "retry,try_catch", "try_catch"),
    ("java", "class A { void f() { try { g(); } catch (E e) { if (a) { b(); } h(e.status_code); } } }",
     "status_check,try_catch", "status_check,try_catch"),
    ("java", "class A { void f() { try { g(); } catch (E e) { h(); } int status_code = 1; } }",
     "try_catch", "try_catch"),
    ("go", "func f() { for { if err := g(); err != nil { time.Sleep(d) } } }",
     "error_check,exponential_backoff,retry", "error_check"),
    ("go", "func f() { func() { }(); recover() }", "", ""),
    ("go", "func f() { defer recover() }", "defer_recover", "defer_recover"),
    ("ruby", "begin\n  g\nrescue E\n  sleep 1\n  retry\nend\n", "exponential_backoff,rescue,retry,try_catch", "rescue"),
    ("csharp", "class A { async Task RunRetries() { if (a) { for (;;) { } } } }", "retry", "retry"),
    ("csharp", "class A { void RetryOnce() { } void B() { while (x) { } } }", "", ""),
    ("typescript", "async function f() { for (const x of y) { try { g() } catch (e) { continue } } }",
     "retry,try_catch", "try_catch"),
]


@pytest.mark.parametrize("mode", ["fixed", "parity"])
def test_signals_of_nested_code(spark, mode):
    files = files_of(spark, [(language, code) for language, code, *_ in NESTED])
    found = {r.id: set(r.flags) for r in classify_files(files, mode=mode).collect()}
    for i, (language, code, fixed, parity) in enumerate(NESTED):
        expected = set(filter(None, (fixed if mode == "fixed" else parity).split(",")))
        assert found[i] - {"rescue", "try_catch"} == expected - {"rescue", "try_catch"}, code
