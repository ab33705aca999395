"""Broken Python is found by its strings, brackets and indentation."""

import ast
import random
import time
import warnings

import pytest

from conftest import files_of
from faultlens.operators.signals import classify_files

GOOD = [
    "", "\n\n", "x = 1", "# only a remark", '"""only a text"""', "x = (1,\n  2)\ny = [\n3]\n",
    "def f():\n    '''doc'''\n", "def f():\n    # nothing\n    pass\n", "if a:\n\tb()\nelse:\n\tc()\n",
    "if a:\n        b\n        c\n", "if a: b\nc\n", "x = 'it''s' \"a\" 'b'\n", "x = {'a': [1, (2, 3)]}\n",
    "if a:\n  if b:\n     c\n  d\ne\n", "x = 1 + \\\n    2\n", "if a and \\\n  b:\n    c\n",
    "class A:\n    x: int\n    y: str = 'a:'\n\n    def f(self): return 1\n", "for x in y:\n    pass\nelse:\n    pass\n",
    "try:\n  f()\nexcept (A, B):\n  pass\nfinally:\n  g()\n", "x = '''a\n  b\n'''\ny = 2\n", "x = r'\\d'\n",
    "d = {\n  'a':\n    1,\n}\n", "f(lambda: 1)\n", "print(x)\nprint = 3\nprint.x\n", "exec(x)\n",
    "x = \"a # b\" # c 'd\n", "if a:\n    x\n  # odd remark\n    y\n", "match x:\n    case 1:\n        pass\n",
    "((((((((((1))))))))))\n", "x = '\\\n'\n", "@a(1)\ndef f(): ...\n", "async def f():\n    await g()\n",
    "if a:\n    x = [1,\n2,\n  3]\n    y\n", "f(a)[b]{}\n".replace("{}", "[1]"), "x = f'{a}:{b}'\n", "x;y;z\n",
    "\x0cx = 1\n", "if a:\n  \x0c  b\n".replace("  \x0c", ""), "print in x\n", "print if a else b\n", "print >>f, x\n",
]
BAD = [
    "x = (1\n", "x = 1)\n", "x = (1]\n", "f({)}\n", "x = 'a\n", 'x = """a\n', "x = \"a'\n", "  x = 1\n",
    "x = 1\n  y = 2\n", "if a:\nb\n", "if a:\n", "def f():\n\n# nothing\n", "if a:\n    b\n  c\n",
    "if a:\n\tb\n        c\n", "if a:\n        b\n\tc\n", "if a: b\n    c\n", "[" * 201 + "]" * 201,
    "print 'x'\n", "print x\n", "exec 'x'\n", "try:\n  a\nexcept E, e:\n  b\n", "raise E, 'x'\n", "x = `y`\n",
    "if a <> b: c\n", "x = (1,\n  2\ny = 3\n", "def f(:\n    pass\n", "x\x00y\n",
    "".join(" " * i + "if a:\n" for i in range(101)) + " " * 101 + "b\n", "(" * 5000,
    "class A:\n    def f(self):\n    pass\n",
]


def parses(source):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            ast.parse(source)
        except (SyntaxError, ValueError, MemoryError, RecursionError):
            return False
    return True


def verdicts(spark, sources, **options):
    files = files_of(spark, [("python", s) for s in sources])
    found = classify_files(files, languages=("python",), **options).select("id", "parse_status").collect()
    status = {r.id: r.parse_status == "ok" for r in found}
    return [status[i] for i in range(len(sources))]


def test_the_lists_are_what_the_parser_says():
    assert [s for s in GOOD if not parses(s)] == [] and [s for s in BAD if parses(s)] == []


def test_good_and_bad_files(spark):
    found = verdicts(spark, GOOD + BAD)
    assert [s for s, ok in zip(GOOD, found) if not ok] == []
    assert [s for s, ok in zip(BAD, found[len(GOOD):]) if ok] == []


def test_equals_the_parser_on_code_that_is_cut_or_shifted(spark):
    """Lines of good code, some dropped, cut or moved by a blank: only errors inside a line may be missed."""
    import inspect

    from faultlens.operators import relational, rollup

    choose = random.Random(8)
    sources = []
    for module in (relational, rollup):
        lines = inspect.getsource(module).split("\n")
        for _ in range(150):
            low = choose.randrange(len(lines) - 40)
            some = lines[low:low + 40]
            at = choose.randrange(40)
            some[at] = choose.choice([" " + some[at], some[at][:-1], some[at][1:], "", some[at].replace(")", "", 1)])
            sources.append("\n".join(some) + "\n")
    found = verdicts(spark, sources)
    expected = [parses(s) for s in sources]
    assert [s for s, ok, right in zip(sources, found, expected) if right and not ok] == []
    missed = sum(ok and not right for ok, right in zip(found, expected))
    assert expected.count(False) > 100 and missed < 0.1 * expected.count(False)


def test_nothing_is_found_in_a_broken_file(spark):
    files = files_of(spark, [("python", "import requests\nretry(3)\ntry:\n  f(\nexcept E:\n  g()\n"),
                             ("java", "class A { void f() { try { g(); } catch (E e) { ")])
    broken, java = classify_files(files).orderBy("id").collect()
    assert (broken.parse_status, broken.label, broken.flags, broken.http_libraries) == ("failed", "None", [], [])
    assert (java.parse_status, java.label) == ("ok", "Basic")
    unchecked = classify_files(files, check_syntax=False).orderBy("id").first()
    assert (unchecked.parse_status, unchecked.label) == ("ok", "Mixed")


@pytest.mark.parametrize("line", ["(", "[{(", "x = (1, [2, {3: 4}])\n", "if a:\n ", "'", "():\n", "\t \n", "print "])
def test_time_grows_with_the_text_alone(spark, line):
    began = time.perf_counter()
    verdicts(spark, [line * 200_000])
    assert time.perf_counter() - began < 25


def test_broken_corpus_equals_exact_python(spark):
    from faultlens.plans.workload import nested_queries as nested
    from faultlens.plans.workload.snippets import BROKEN_PYTHON

    assert [parses(s) for s in BROKEN_PYTHON] == [i % 2 == 1 for i in range(len(BROKEN_PYTHON))]
    files = nested.broken_files(spark, "/root/testdata/sf0.001")
    checked, exact = (
        sorted(map(tuple, classify_files(files, languages=("python",), **options).collect()))
        for options in ({}, {"exact_python": True}))
    assert checked == exact and {r[4] for r in checked} == {"ok", "failed"}
