import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultlens.llm import simhash, spotsigs, topk
from faultlens.llm.components import components

DOCS = "doc_id long, text string, fingerprint string, component_id int"


def brute_topk(vectors, is_query, k):
    """Over (id, vector) rows, of which some have the same id."""
    out = []
    for at, (q, vector) in enumerate(vectors):
        if is_query(q):
            scores = sorted((-sum(a * b for a, b in zip(vector, v)), i)
                            for other, (i, v) in enumerate(vectors) if other != at)[:k]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores, 1)]
    return out


@pytest.mark.parametrize("seed", range(2))
def test_search_equals_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(topk, "BLOCK", 8)
    monkeypatch.setattr(topk, "RANGE", 32)
    monkeypatch.setattr(topk, "TILE", 1)
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(0, 0.1, 5).astype(float).tolist(), "x") for i in range(150)]
    rows += [(i, [0.5, 0.0, 0.0, 0.0, 0.0], "x") for i in range(150, 220)]  # ties
    rows += [(300, None, "x"), (310, [1.0, None], "x"), (320, [float("nan")] * 5, "x"),
             (330, [float("inf")] * 5, "x"), (340, [1e30] * 5, "x"), (None, [1.0] * 5, "x"), (350, [], "x")]
    # Between the largest that doubles add exactly and the largest that fit a long.
    rows += [(i, [x, -x, 1.0, 0.0, 0.1], "x") for i, x in ((400, 2e4), (401, 3e5), (410, -1.2e6), (411, 1.3e6))]
    # Rows that repeat an id, with the same vector and with another.
    rows += [rows[0], rows[10], (20, [0.9] * 5, "x"), (21, [0.4] * 5, "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, vector string").repartition(4)
    found = topk.search(topk.whole_vectors(table), F.col("vec_id") % 10 == 0, 10).collect()
    vectors = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v, _ in rows
               if i is not None and v is not None and all(x is not None and abs(x) < 1e20 for x in v)]
    expected = brute_topk(vectors, lambda i: i % 10 == 0, 10)
    assert sorted(map(tuple, found)) == sorted(expected)


def test_search_with_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [-1.0])], schema)
    found = topk.search(topk.whole_vectors(few), F.col("vec_id") == 0, 10).collect()
    assert sorted(map(tuple, found)) == [(0, 1, 1, 1024 * 2048), (0, 2, 2, -1024 * 1024)]
    none = spark.createDataFrame([], schema)
    assert topk.search(topk.whole_vectors(none), F.col("vec_id") == 0, 10).collect() == []


def slow_fingerprint(text):
    from xxhash import xxh64_intdigest

    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_definition(monkeypatch):
    texts = ["", " \n", "One", "one two Three", "a b c d", "É È x \x1f y z w v u", "the same " * 50,
             " ".join(random.Random(1).choices("abcdefg", k=3000))]
    for text in texts:
        expected = slow_fingerprint(text)
        assert simhash.fingerprint(text.encode()) == expected
        from faultlens.llm import words

        blocks = words.word_blocks
        with monkeypatch.context() as m:
            m.setattr(simhash, "word_blocks", lambda data: blocks(data, 7))
            assert simhash.fingerprint(text.encode()) == expected


def slow_classes(prints, radius):
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a in prints:
        for b in prints:
            if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= radius:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {frozenset(q for q in prints if find(q) == find(p)) for p in prints}


def test_classes_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 8)
    rng = random.Random(3)
    prints = {rng.getrandbits(64) - 2**63 for _ in range(150)} | {0, -1}
    for p in list(prints)[:60]:
        for _ in range(rng.randint(1, 6)):
            p ^= sum(1 << b for b in rng.sample(range(63), rng.randint(1, 5)))
            prints.add(p)
    prints |= {1 << b for b in range(40)}  # a large class
    table = spark.createDataFrame([(p,) for p in prints], "fingerprint long").repartition(3)
    of = {}
    for r in simhash.classes(table, 4).collect():
        of.setdefault(r["class"], set()).add(r["fingerprint"])
    assert set(map(frozenset, of.values())) == slow_classes(sorted(prints), 4)


def near_rows(spark):
    base = " ".join(f"word{i}" for i in range(300))
    rows = [(5, base), (3, base + " end"), (9, base), (9, base), (None, base), (7, None), (8, ""), (2, " \n"),
            (11, "quite another text of its own"), (None, "text without an id"), (None, "text without an id")]
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS).repartition(3)


def test_near_duplicates_of_rows(spark):
    rows = simhash.near_duplicates(near_rows(spark)).collect()
    found = sorted(((r["doc_id"], r["component_id"]) for r in rows), key=str)
    expected = [(5, 3), (3, 3), (9, 3), (9, 3), (None, 3), (7, 2), (8, 2), (2, 2), (11, 11), (None, None), (None, None)]
    assert found == sorted(expected, key=str)
    assert simhash.near_duplicates(near_rows(spark).limit(0)).collect() == []


def test_one_row_of_each_class_stays(spark):
    kept = simhash.keep_one(near_rows(spark))
    assert kept.columns == ["doc_id", "text", "fingerprint", "component_id"]
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([3, 2, 11, None], key=str)
    assert simhash.keep_one(near_rows(spark).limit(0)).collect() == []


def test_near_copies_without_ids_keep_one(spark):
    schema = "doc_id long, text string, fingerprint int, class int"

    def table(texts):
        return spark.createDataFrame([(None, t, 0, 0) for t in texts], schema)

    words = [f"word{i}" for i in range(1200)]
    given = [" ".join(words), *(" ".join([*words[:i], f"other{i}", *words[i + 1:]]) for i in range(0, 1200, 40))]
    prints = [r.fingerprint for r in simhash.fingerprints(table(given).coalesce(1)).collect()]
    near = [t for t, p in zip(given, prints) if 1 <= ((p ^ prints[0]) % (1 << 64)).bit_count() <= 4][:2]
    assert len(near) == 2  # near, not equal
    texts = [given[0], *near, "quite another text that stands alone"]
    rows = table(texts)
    kept = simhash.keep_one(rows)
    assert kept.columns == rows.columns and len({r.text for r in kept.collect()} & set(texts[:3])) == 1
    assert kept.count() == 2
    named = rows.withColumn("doc_id", F.when(F.col("text") == texts[2], 9))
    assert {(r.doc_id, r.text) for r in simhash.keep_one(named).collect()} == {(9, texts[2]), (None, texts[3])}


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 100), (300, 300)]
    random.Random(1).shuffle(links)
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(1, 61)}, 200: 100}


def slow_signatures(text):
    """Sets of chains as text, without hashing."""
    words = [w.strip(spotsigs.PUNCTUATION) for w in text.encode().lower().split()]
    found = set()
    for i, word in enumerate(words):
        if word in spotsigs.ANCHORS:
            content = [w for w in words[i + 1:] if w and w not in spotsigs.ANCHORS][:2]
            if len(content) == 2:
                found.add((word, *content))
    return found


def random_texts(n, seed=0):
    rng = random.Random(seed)
    return [" ".join(rng.choices(["the", "of", "is", "red", "fox", "ran", "home", "now."], k=rng.randint(0, 60)))
            for _ in range(n)]


def test_signatures_by_definition():
    for text in random_texts(50):
        slow = slow_signatures(text)
        assert len(spotsigs.signatures(text.encode())) == (len(slow) or bool(text.split()))
    a, b = random_texts(2, 5)
    x, y = slow_signatures(a), slow_signatures(b)
    assert spotsigs.jaccard(*(spotsigs.signatures(t.encode()) for t in (a, b))) == pytest.approx(
        len(x & y) / len(x | y))


@pytest.mark.parametrize("parts", [1, 5])
def test_edit_report(spark, parts):
    texts = [None, "", "the red fox ran home", "no anchor here"] + random_texts(30)
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(4, texts[4], "x", 1)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        found = spotsigs.edit_report(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    rows.sort(key=lambda r: r[0])
    expected = []
    for row, following in zip(rows, rows[1:] + rows[:1]):
        text, after = row[1] or "", following[1] or ""
        half = len(text) // 2
        here, edited, there = (spotsigs.signatures(t.encode()) for t in (
            text, text[:len(text) - half] + after[:half], after))
        expected.append((row[0], len(text), spotsigs.digest(here), spotsigs.digest(edited),
                         spotsigs.jaccard(here, edited), spotsigs.jaccard(here, there)))
    cut = [(r["doc_id"], r["n_chars"], r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"])
           for r in found]
    assert sorted(cut) == sorted(expected)
    assert spotsigs.edit_report(spark.createDataFrame([], DOCS)).collect() == []


def test_near_pairs_equal_brute_force(spark):
    texts = random_texts(25, 7)
    texts += [t + " the small end comes" for t in texts[:10]]
    prints = spotsigs.fingerprints(
        spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], DOCS))
    found = {frozenset((r["left"], r["right"])): r["likeness"] for r in spotsigs.near_pairs(prints, 0.8).collect()}
    sets = {spotsigs.digest(s): s for s in (spotsigs.signatures(t.encode()) for t in texts) if len(s)}
    expected = {frozenset((a, b)): spotsigs.jaccard(sets[a], sets[b]) for a in sets for b in sets
                if a < b and spotsigs.jaccard(sets[a], sets[b]) >= 0.8}
    assert found == pytest.approx(expected) and found


@pytest.mark.parametrize("least_hot", [1, 1000])
def test_components_of_stars_and_chains(spark, monkeypatch, least_hot):
    """Hubs joined by broadcast and by shuffle give what a plain union of sets gives."""
    from faultlens.llm import components as module

    monkeypatch.setattr(module, "LEAST_HOT", least_hot)
    rng = np.random.default_rng(3)
    links = [(0, i) for i in range(100, 140)] + [(900, i) for i in range(200, 240)]
    links += [(i, i + 1) for i in range(300, 360)] + [(7, 7), (139, 400), (400, 139)]
    links += [tuple(x) for x in rng.integers(500, 800, (120, 2)).tolist()]
    root = {x: x for pair in links for x in pair}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    table = spark.createDataFrame(links, "a long, b long")
    found = {r["node"]: r["root"] for r in module.components(table).collect()}
    assert found == {x: find(x) for x in root if find(x) != x}
