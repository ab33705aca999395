import functools
import math
import os
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from faultlens.llm import factor_machine, hash_arrays, kneser_ney, line_field, mixing, queries, url_reputation
from faultlens.llm.labelled import training_texts

SF_DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, size string, target int, score int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 1, 1) for i, t, s in rows], DOCS)


def slow_targets(sizes, weights, share, most):
    names = sorted((n for n in sizes if n is not None)) + ([None] if None in sizes else [])
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    left, free, out = share * sum(sizes.values()), list(names), {}
    while free:
        part = {n: weight[n] * left / sum(weight[m] for m in free) for n in free}
        over = [n for n in free if part[n] > most * sizes[n]]
        if not over:
            return out | part
        for n in over:
            out[n] = most * sizes[n]
            left -= out[n]
            free.remove(n)
    return out


def mixed_rows():
    rng = random.Random(2)
    rows = [(i, " \t".join(["w"] * rng.randint(0, 40)), rng.choice(["a", "b", "c", "d", None])) for i in range(600)]
    return rows + [(600, None, "a"), (601, "", "empty"), (None, "x y", "b"), (3, rows[3][1], rows[3][2]),
                   (700, "word " * 5000, "huge")]


def test_mix_report(spark):
    rows = mixed_rows()
    found = mixing.mix_report(docs_of(spark, rows).repartition(5)).collect()
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    expected = slow_targets(sizes, (5, 2, 1), 1.5, 2.0)
    taken = Counter()
    for r in found:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(expected[r["source"]])
        assert r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    assert len(found) == len(rows) and sum(expected.values()) == pytest.approx(1.5 * sum(sizes.values()))
    for source in "abcd":
        assert taken[source] == pytest.approx(expected[source], rel=0.25)
    again = mixing.mix_report(docs_of(spark, rows[::-1])).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, found))
    assert mixing.mix_report(docs_of(spark, [])).collect() == []


def test_mix_emits_the_copies(spark):
    docs = docs_of(spark, mixed_rows())
    copies = Counter()
    for r in mixing.mix_report(docs).collect():
        copies[r["doc_id"]] += r["copies"]
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == +copies
    assert mixing.mix(docs.limit(0)).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_mix_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_DIR}/documents.parquet'")
    sql = con.execute(queries.ORACLE["op3_source_mix"]).fetchall()
    assert sorted(sql) == sorted(map(tuple, queries.op3_source_mix(spark, SF_DIR).collect()))


def test_urls_and_rules(spark):
    cases = {
        "http://A.Example.net/en/x?q#f": ("a.example.net", "/en/x", "example.net/en/", "allow"),
        "https://example.net": ("example.net", "", None, None),
        "https://example.net/de": ("example.net", "/de", "net/", "block"),
        "x://notexample.net/en/": ("notexample.net", "/en/", "net/", "block"),
        "s://b.example.com/de/1": ("b.example.com", "/de/1", "example.com/de/", "block"),
        "s://b.example.com/den": ("b.example.com", "/den", None, None),
        "s://q.org/fr/#": ("q.org", "/fr/", "org/fr/", "allow"),
        "a://b://c/d": ("b:", "//c/d", None, None),
        "s://h?x/y": ("h", "", None, None), "no scheme/net/": ("", "", None, None), None: ("", "", None, None)}
    rows = [(i, u, "x", 1) for i, u in enumerate(cases)]
    pages = spark.createDataFrame(rows + [rows[0]], "page_id long, url string, host string, verdict int")
    none = spark.createDataFrame([], "page_id long, good int")
    found = url_reputation.judge(pages, none).collect()
    assert len(found) == len(rows) + 1
    for r in found:
        host, path, rule, action = cases[rows[r["page_id"]][1]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == action if action else r["verdict"] in ("allow", "block")
    assert url_reputation.judge(pages.limit(0), none).collect() == []


def test_hosts_are_shrunk_and_filtered(spark):
    pages, outcomes = [], []
    for host, good, bad in (("good.a.org", 80, 2), ("bad.a.org", 5, 70), ("few.a.org", 1, 0), ("new.a.org", 0, 0),
                            ("other.b.org", 50, 3)):
        for k in range(good + bad + 1):
            pages.append((len(pages), f"s://{host}/{k}"))
            if k < good + bad:
                outcomes.append((len(pages) - 1, int(k < good)))
    outcomes += [outcomes[0], (None, 1), (10**6, 0), (1, None)]
    found = {r["host"]: r for r in url_reputation.judge(
        spark.createDataFrame(pages, "page_id long, url string"),
        spark.createDataFrame(outcomes, "page_id long, good int"), rules=()).collect()}
    mean = {h.split(".")[0]: r["mean"] for h, r in found.items()}
    assert mean["bad"] < mean["new"] < mean["good"] and mean["new"] < mean["few"] < 1
    assert found["good.a.org"]["verdict"] == "allow" and found["bad.a.org"]["verdict"] == "block"
    assert all(r["bound"] <= r["mean"] for r in found.values())


def test_hosts_are_blocked_on_evidence_only(spark):
    pages, outcomes = [], []
    hosts = [(f"average{k}.a.org", 15, 5) for k in range(6)]
    hosts += [("bad.a.org", 4, 80), ("new.a.org", 0, 0), ("new.c.com", 0, 0), ("one.b.org", 0, 1)]
    for host, good, bad in hosts:
        for k in range(good + bad + 1):
            pages.append((len(pages), f"s://{host}/{k}"))
            if k < good + bad:
                outcomes.append((len(pages) - 1, int(k < good)))
    page_rows = spark.createDataFrame(pages, "page_id long, url string")
    outcome_rows = spark.createDataFrame(outcomes, "page_id long, good int")
    found = {r["host"]: r["verdict"] for r in url_reputation.judge(page_rows, outcome_rows, rules=()).collect()}
    assert found.pop("bad.a.org") == "block"
    assert set(found.values()) == {"allow"}, found
    unlabelled = url_reputation.judge(page_rows, outcome_rows.limit(0), rules=()).collect()
    assert {r["verdict"] for r in unlabelled} == {"allow"}


def slow_model(texts):
    """Probabilities by definition, with plain dictionaries."""
    pairs, tokens = Counter(), Counter()
    for text in texts:
        seq = ["<s>", *text.lower().split(), "</s>"]
        pairs.update(zip(seq, seq[1:]))
        tokens.update(seq[1:])
    second, context = Counter(w for _, w in pairs), Counter()
    for (u, _), n in pairs.items():
        context[u] += n

    def estimate(counts):
        return kneser_ney.discounts(*(sum(n == k for n in counts) for k in (1, 2, 3, 4)))

    def off(d, n):
        return d[min(n, 3) - 1] if n else 0

    d, e = estimate(pairs.values()), estimate(second.values())
    freed = sum(off(e, n) for n in second.values()) / len(pairs)

    def p(u, w):
        alone = max(second[w] - off(e, second[w]), 0) / len(pairs) + freed / (len(second) + 1)
        if not context[u]:
            return alone
        left = sum(off(d, n) for (a, _), n in pairs.items() if a == u) / context[u]
        return (pairs[u, w] - off(d, pairs[u, w])) / context[u] + left * alone

    return p, tokens


def test_scores_equal_the_definition(spark, monkeypatch):
    monkeypatch.setattr(kneser_ney, "SHARD", 400)
    monkeypatch.setattr(kneser_ney, "GATHERED", 50)
    monkeypatch.setattr(kneser_ney, "BLOCK", 64)
    rng = random.Random(1)
    texts = [" ".join(rng.choices("abcdefgh", k=rng.randint(0, 30), weights=[300, 9, 5, 3, 2, 1, 1, 1])) for _ in range(60)]
    texts += [None, "", "A a A", "never seen words a", "a " * 400]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(None, "a b", "s")]
    docs = docs_of(spark, rows).repartition(3)
    train = docs.filter("doc_id % 5 != 0")
    model = kneser_ney.count(train)
    p, tokens = slow_model([t or "" for i, t, _ in rows if i is not None and i % 5])
    n, v = sum(tokens.values()), len(tokens)
    assert (model.tokens, model.words) == (n, v)
    assert sum(p("a", w) for w in tokens) + p("a", "none") == pytest.approx(1)
    for r in kneser_ney.score(docs, model, F.col("doc_id") % 5 == 0).collect():
        text = (texts[r["doc_id"]] or "") if r["doc_id"] is not None else "a b"
        seq = ["<s>", *text.lower().split(), "</s>"]
        assert (r["n_tokens"], r["train_tokens"]) == (len(seq) - 1, n)
        assert r["n_known"] == sum(tokens[w] > 0 for w in seq[1:])
        assert r["base_score"] == pytest.approx(sum(math.log10((tokens[w] + 1) / (n + v + 1)) for w in seq[1:]))
        assert r["score"] == pytest.approx(sum(math.log10(p(u, w)) for u, w in zip(seq, seq[1:])))


def test_hashes_are_ordered_and_found_in_parts(monkeypatch, tmp_path):
    monkeypatch.setattr(hash_arrays, "PART", 3)
    monkeypatch.setattr(hash_arrays, "LEAST_PART", 5)
    rng = np.random.default_rng(4)
    near = np.uint64(7 << 50) + rng.integers(0, 4, 40).astype(np.uint64)  # these differ in their lowest bits alone
    for hashes in (rng.integers(0, 2**64, 3000, dtype=np.uint64), near, np.r_[near, rng.integers(0, 2**64, 99, np.uint64)],
                   np.zeros(0, np.uint64), np.full(9, 2**64 - 1, np.uint64)):
        assert hash_arrays.order_of(hashes).tolist() == np.argsort(hashes, kind="stable").tolist()
        kinds, at = hash_arrays.distinct(hashes)
        wanted, places = np.unique(hashes, return_inverse=True)
        assert (kinds.tolist(), at.tolist()) == (wanted.tolist(), places.tolist())
    folder, stored = tmp_path.as_uri(), np.unique(rng.integers(0, 2**64, 500, dtype=np.uint64))
    for shard, at in hash_arrays.split(stored, 3):
        hash_arrays.store(folder, "x", shard, {"hash": stored[at], "n": np.arange(len(stored), dtype="<u8")[at] + 1})
    asked = np.unique(np.r_[stored[::2], rng.integers(0, 2**64, 200, dtype=np.uint64), np.uint64(0), np.uint64(2**64 - 1)])
    there = {int(h): i + 1 for i, h in enumerate(stored)}
    found = hash_arrays.find(folder, "x", 3, asked, {"n": "<u8"})["n"]
    assert found.tolist() == [there.get(int(h), 0) for h in asked]
    assert hash_arrays.holds(folder, "x", 3, asked).tolist() == [int(h) in there for h in asked]


def test_grams_that_occur_once_are_looked_up_once(monkeypatch, tmp_path):
    folder = tmp_path.as_uri()
    hashes = np.arange(1, 9, dtype=np.uint64)
    kneser_ney._store(folder, "2", 0, hashes, {"token": np.array([1, 1, 1, 2, 300, 1, 3, 1])})
    asked, find = [], hash_arrays.find
    monkeypatch.setattr(hash_arrays, "find", lambda f, name, n, h, c: asked.append((name, h.tolist())) or find(f, name, n, h, c))
    found = kneser_ney._counts(folder, "2", 1, np.arange(0, 10, dtype=np.uint64), ("token",))["token"]
    assert found.tolist() == [0, 1, 1, 1, 2, 300, 1, 3, 1, 0]
    assert asked == [("2", [0, 4, 5, 7, 9]), ("2-token", [5])]


def slow_model_of_order(texts, order):
    """Probabilities by definition: continuation counts below the highest order."""
    counts = {order: Counter()}
    for text in texts:
        seq = ["<s>"] * (order - 1) + [*text.lower().split(), "</s>"]
        counts[order].update(tuple(seq[i - order + 1:i + 1]) for i in range(order - 1, len(seq)))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(gram[1:] for gram in counts[k + 1])

    def off(k, n):
        found = list(counts[k].values())
        d = kneser_ney.discounts(*(found.count(j) for j in (1, 2, 3, 4)))
        return d[min(n, 3) - 1] if n else 0

    def p(gram):
        k = len(gram)
        after = {g: n for g, n in counts[k].items() if g[:-1] == gram[:-1]}
        lower = p(gram[1:]) if k > 1 else 1 / (len(counts[1]) + 1)
        if not after:
            return lower
        n = counts[k][gram]
        return (n - off(k, n) + sum(off(k, m) for m in after.values()) * lower) / sum(after.values())

    return p


@pytest.mark.parametrize("order", [2, 3, 4])
def test_scores_of_any_order_equal_the_definition(spark, monkeypatch, order):
    monkeypatch.setattr(kneser_ney, "SHARD", 400)
    monkeypatch.setattr(kneser_ney, "GATHERED", 50)
    monkeypatch.setattr(kneser_ney, "BLOCK", 64)
    rng = random.Random(3)
    texts = [" ".join(rng.choices("abcde", k=rng.randint(0, 25), weights=[20, 9, 5, 3, 1])) for _ in range(30)]
    texts += ["", "A a A", "never seen a b", "a " * 300, "a b " * 40]
    docs = docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)]).repartition(3)
    model = kneser_ney.count(docs.filter("doc_id % 5 != 0"), order=order)
    p = functools.cache(slow_model_of_order([t for i, t in enumerate(texts) if i % 5], order))
    for r in kneser_ney.score(docs, model, F.col("doc_id") % 5 == 0).collect():
        seq = ["<s>"] * (order - 1) + [*texts[r["doc_id"]].lower().split(), "</s>"]
        grams = [tuple(seq[i - order + 1:i + 1]) for i in range(order - 1, len(seq))]
        assert r["n_tokens"] == len(grams)
        assert r["score"] == pytest.approx(sum(math.log10(p(g)) for g in grams))


def test_the_query_looks_beyond_one_word(spark, monkeypatch, tmp_path):
    rows = [(i, t, "s") for i, t in enumerate(["x a b", "y a c"] * 40)]
    docs_of(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    asked, count = [], kneser_ney.count
    monkeypatch.setattr(kneser_ney, "count", lambda docs, **k: asked.append(m := count(docs, **k)) or m)
    queries.op8_kneser_ney(spark, str(tmp_path)).collect()
    assert asked[0].order >= 3
    extra = docs_of(spark, [(1, "x a b", "s"), (2, "y a b", "s")])
    likely, unlikely = (r["score"] for r in kneser_ney.score(extra, asked[0], F.lit(True)).orderBy("doc_id").collect())
    assert likely > unlikely + 0.5


def test_model_without_training_texts(spark):
    docs = docs_of(spark, [(1, "a b", "s"), (2, None, "s")])
    model = kneser_ney.count(docs.limit(0))
    rows = kneser_ney.score(docs, model, F.lit(True)).collect()
    assert {(r["n_tokens"], r["n_known"], r["score"]) for r in rows} == {(3, 0, 0.0), (1, 0, 0.0)}


def labelled(spark):
    rng = random.Random(5)
    plain = ["the red fox ran", "home over green hills", "and slept there."]
    rows, labels = [], []
    for i in range(240):
        bad, rude = i % 3 == 0, i % 4 == 0
        lines = [" ".join(rng.choices(" ".join(plain).split(), k=8)) for _ in range(rng.randint(1, 6))]
        if bad:
            lines = [x.upper().replace(" ", "!! ") for x in lines]
        if rude:
            lines[0] += " you moron"
        rows.append((i, "\n".join(lines), "s"))
        labels.append((i, int(not bad), int(rude), "x"))
    rows += [(300, None, "s"), (301, "", "s"), (302, "word " * 500_000, "s"), (None, "moron", "s"), rows[0]]
    labels += [labels[1], (None, 0, 1, "x"), (5, None, None, "x")]
    return docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


def test_training_rows_are_bounded_and_from_the_input(spark):
    rows = [(i, f"text {i}", "s") for i in range(20)] + [(7, f"copy {k}", "s") for k in range(50)] + [(8, None, "s")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(2000)], "doc_id long, toxic int")
    docs = docs_of(spark, rows)

    def taught(docs, most):
        return sorted(map(tuple, training_texts(docs, labels, "toxic", 5, 9, most).collect()), key=str)

    everything = taught(docs, 100)
    assert len(everything) == 20 and taught(docs.repartition(7), 100) == everything
    assert {t: y for t, y in everything if t and t.startswith("text")}["text 5"] == 1
    assert len(taught(docs, 12)) == 12 and set(taught(docs, 12)) <= set(everything)


def test_classifiers_learn_and_take_any_text(spark):
    docs, labels = labelled(spark)
    quality = line_field.scorer(line_field.fit(docs, labels))
    toxic = factor_machine.scorer(factor_machine.fit(docs, labels))
    rows = docs.select("doc_id", quality(F.col("text")).alias("q"), toxic(F.col("text")).alias("t")).collect()
    assert len(rows) == 245 and all(0 <= r["q"] <= 1 and 0 <= r["t"] <= 1 for r in rows)
    for r in rows:
        if r["doc_id"] is not None and r["doc_id"] < 240:
            assert (r["q"] >= 0.7) == (r["doc_id"] % 3 != 0)
            assert (r["t"] >= 0.5) == (r["doc_id"] % 4 == 0)
    for fit, scorer in ((line_field.fit, line_field.scorer), (factor_machine.fit, factor_machine.scorer)):
        score = scorer(fit(docs, labels.limit(0)))
        assert docs.limit(3).select(score(F.col("text")).alias("s")).first()["s"] == pytest.approx(0.5)
        assert docs.limit(0).select(score(F.col("text"))).collect() == []


def test_line_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    x, row = rng.normal(size=(7, 3)), np.array([0, 0, 0, 0, 1, 2, 2])
    field = line_field.Field(rng.normal(size=3), rng.normal(size=(2, 2)))
    p, _, log_z = line_field.marginals(field, x, row)
    total = 0.0
    for r in range(3):
        lines = np.flatnonzero(row == r)
        weights = {}
        for code in range(2 ** len(lines)):
            y = [code >> k & 1 for k in range(len(lines))]
            s = sum(float(x[i] @ field.emission) * s for i, s in zip(lines, y))
            weights[tuple(y)] = math.exp(s + sum(field.moves[a, b] for a, b in zip(y, y[1:])))
        z = sum(weights.values())
        total += math.log(z)
        for k, i in enumerate(lines):
            assert p[i] == pytest.approx(sum(w for y, w in weights.items() if y[k]) / z)
    assert log_z == pytest.approx(total)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_pipeline_keeps_what_its_stages_keep(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, kept, SF_DIR)
        assert kept.columns == docs.columns, name
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) < docs.count()
    packed = corpus_pipeline.run(spark, SF_DIR).collect()
    assert {r["doc_id"] for r in packed} <= set(ids)
    copies = Counter(r["doc_id"] for r in packed if r["piece"] == 0)
    assert set(copies.values()) <= {1, 2}
