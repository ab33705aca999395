import functools
import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from faultlens.llm import merkle, pieces, sql, turn_trie
from faultlens.llm.queries import ORACLE, QUERIES, vocabulary

TURNS = "conv_id long, turn long, role string, text string, part int, key string"
DOCS = "doc_id long, source string, lang string, n_chars long, text string, tree int, at string, leaf string"


def in_order(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is not None, x) for x in r))


# --- conversation trie ---------------------------------------------------------------

def rebuilt_by_hand(rows):
    own = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            own.setdefault(conv, []).append((turn is not None, turn or 0, digest, role, text))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    kept = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: tuple(own.get(c - int(math.fmod(c, 5)), [])[:kept[c]] + own[c][kept[c]:]) for c in own}


def trie_by_hand(built):
    members = {}
    for conv, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(conv)
    children = {}
    for prefix in members:
        if prefix:
            children.setdefault(prefix[:-1], []).append(prefix)
    leaves, saved = {}, {}
    for prefix in sorted(members, key=len, reverse=True):
        below = children.get(prefix, [])
        leaves[prefix] = sum(leaves[b] for b in below) or 1
        own = (len(members[prefix]) - 1) * len(prefix[-1][1].encode()) if prefix else 0
        saved[prefix] = own + sum(saved[b] for b in below)
    return [
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), leaves[p],
         saved[p], hashlib.sha256(",".join(
             map(str, sorted(c for c in m if len(built[c]) == len(p)))).encode()).hexdigest())
        for p, m in members.items()]


def odd_conversations():
    choose = random.Random(3)
    rows = []
    for conv in [*range(-7, 60), None]:
        if conv is None or conv % 11 != 3:
            for turn in range(choose.randrange(1, 14)):
                rows.append((conv, choose.choice([None, turn, turn, turn]), choose.choice(["u", "a", None]),
                             choose.choice(["", "x", None, "é"]), 7, "k"))
    rows += rows[:20]
    # Copies of one conversation, most of which are rebuilt to the same turns.
    return rows + [(c, t, "u", "same", 1, "") for c in range(1000, 1150) for t in range(9)]


@pytest.mark.parametrize("weight", [1, 20, 1 << 16])
def test_trie_equals_brute_force_at_every_block_size(spark, weight):
    rows = odd_conversations()
    got = turn_trie.conversation_trie(spark.createDataFrame(rows, TURNS), weight=weight)
    assert in_order(got.collect()) == in_order(trie_by_hand(rebuilt_by_hand(rows)))


def test_trie_of_a_long_conversation_and_long_texts(spark):
    rows = [(c, t, "u", f"t{t}" * (100_000 if t == 3 else 1), 0, "") for c in (0, 1, 7) for t in range(700)]
    got = turn_trie.conversation_trie(spark.createDataFrame(rows, TURNS), weight=500)
    assert in_order(got.collect()) == in_order(trie_by_hand(rebuilt_by_hand(rows)))


def test_a_conversation_without_turns_is_a_member_of_the_root(spark):
    # 11 takes 5 turns or more of conversation 10, which is absent, and has one of its own.
    alone = next(c for c in range(1, 999) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    got = turn_trie.conversation_trie(spark.createDataFrame([(alone, 0, "u", "x", 0, "")], TURNS)).collect()
    assert in_order(got) == [(alone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())]


def test_trie_of_an_empty_table(spark):
    assert turn_trie.conversation_trie(spark.createDataFrame([], TURNS)).collect() == []
    nobody = spark.createDataFrame([(None, 1, "u", "x", 0, "")], TURNS)
    assert turn_trie.conversation_trie(nobody).collect() == []


def test_intervals_by_binary_search(spark):
    import pyarrow as pa

    choose = random.Random(5)
    paths = sorted(b"".join(bytes([choose.randrange(3)]) * 16 for _ in range(choose.randrange(6)))
                   for _ in range(200))
    block = turn_trie._Block(pa.table({
        "path": pa.array(paths, pa.binary()), "conv_id": list(range(200)),
        "sizes": [[1] * (len(p) // 16) for p in paths]}))
    for row, depth, left, right in zip(block.row, block.depth, block.left, block.right):
        inside = [i for i, p in enumerate(paths) if p[:16 * depth] == paths[row][:16 * depth] and len(p) >= 16 * depth]
        assert (left, right) == (inside[0], inside[-1])


# --- Merkle manifest -----------------------------------------------------------------

def digest(*inputs):
    return hashlib.sha256("".join(inputs).encode()).hexdigest()


def manifest_by_hand(rows, arity):
    def field(value):
        return "-" if value is None else f"{len(str(value).encode())}:{value}"

    def leaf(row, lower=False):
        doc_id, source, lang, n_chars, text = row[:5]
        if lower and text is not None:
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        return digest(*map(field, (doc_id, source, lang, n_chars, text)))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([digest(*out[-1][i:i + arity]) for i in range(0, len(out[-1]), arity)])
        return out

    def siblings(tree, place):
        for nodes in tree[:-1]:
            first = place // arity * arity
            yield nodes[first:place], nodes[place + 1:first + arity]
            place //= arity

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    by_lang = [sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
               for lang in langs]
    trees = [levels([leaf(r) for r in group]) for group in by_lang]
    top = levels([t[-1][0] for t in trees])
    root = top[-1][0]
    for k, group in enumerate(by_lang):
        for i, row in enumerate(group):
            path = [*siblings(trees[k], i), *siblings(top, k)]
            folded = leaf(row, row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0)
            for before, after in path:
                folded = digest(*before, folded, *after)
            yield (row[0], leaf(row), trees[k][-1][0], root, digest(*(x for a, b in path for x in a + b)),
                   folded, folded == root)


def odd_documents():
    rows = [(i, "s", ["en", "de", None, "é"][i % 7 % 4], i, f"Text {i} É", 0, "", "") for i in range(300)]
    rows += [(None, None, None, None, None, 1, None, None), (5, "s", "fr", 0, "", 1, "", ""),
             (7, None, "en", 1, "A" * 300_000, 1, "", ""), (1, "-", "-", -5, "-", 1, "", "")]
    rows += [(9, "s", "en", 9, "Copy", 1, "", "")] * 70
    return rows + [(i, "s", f"l{i}", 1, "X", 1, "", "") for i in range(20)]


@pytest.mark.parametrize("arity,rise", [(8, 4), (8, 1), (2, 2)])
def test_manifest_equals_brute_force(spark, arity, rise):
    rows = odd_documents()
    got = merkle.manifest(spark.createDataFrame(rows, DOCS), arity, rise).collect()
    assert in_order(got) == in_order(manifest_by_hand(rows, arity))


def test_manifest_of_lone_leaves_and_of_nothing(spark):
    for rows in ([(3, "s", "en", 1, "A", 1, "", "")], [(i, "s", str(i), 1, "A", 1, "", "") for i in range(9)]):
        got = merkle.manifest(spark.createDataFrame(rows, DOCS)).collect()
        assert in_order(got) == in_order(manifest_by_hand(rows, 8))
    assert merkle.manifest(spark.createDataFrame([], DOCS)).collect() == []


def test_sweeps_hold_few_messages():
    leaves = [digest(str(i)) for i in range(8 ** 4)]
    nodes = merkle.sweep_up(leaves, 4)
    assert [len(n) for n in nodes] == [4096, 512, 64, 8, 1]
    paths = merkle.sweep_down(nodes, (("f" * 64, 1),))
    assert all(merkle.fold(leaf, path[:-1]) == nodes[-1][0] for leaf, path in zip(leaves, paths))


# --- the queries against their SQL ---------------------------------------------------

@pytest.mark.parametrize("name", ["op11_turn_trie", "op12_merkle_manifest"])
def test_query_equals_its_sql(spark, name):
    import os
    import sys

    sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))
    from compare import connect, differences

    sf_dir = "/root/testdata/sf0.001"
    assert differences(spark, connect(sf_dir), sf_dir, name, QUERIES[name], ORACLE[name]) is None


def test_sql_checksum():
    import duckdb

    for x in ("0", "-12", "98765432101"):
        assert duckdb.connect().execute(f"SELECT {sql.crc32(repr(x))}").fetchone()[0] == zlib.crc32(x.encode())


# --- pieces --------------------------------------------------------------------------

MODEL = "piece_bpe_32k.model"


@functools.cache
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=vocabulary(MODEL))


@functools.cache
def words():
    return pieces.Vocabulary(vocabulary(MODEL))


def odd_texts():
    choose = random.Random(1)
    signs = [" "] * 8 + list("abcdehilnorst  \n\t▁.,'01()é̀漢字한😀ﬁ　\x00\x7f") + [
        "the ", "  ", "tion", " " * 17, "\U0001f9ff", "ꙮ"]
    names = [library().id_to_piece(i) for i in range(300, 32000)]
    texts = ["", None, " ", "a", "▁", " " * 100, " " * 15, " " * 31 + "x", "x" + " " * 16,
             "<s></s><unk><0x41>", "x" * 5000, "ab" * 3000, "漢" * 700 + "\n" * 40]
    texts += ["".join(choose.choice(signs) for _ in range(choose.randrange(80))) for _ in range(3000)]
    return texts + ["".join(choose.choice(names) for _ in range(choose.randrange(1, 12))) for _ in range(4000)]


@pytest.mark.parametrize("size", [1 << 22, 300])
def test_ids_equal_the_library(size):
    texts = odd_texts()
    expected = library().encode([t or "" for t in texts], add_eos=True)
    assert [x.tolist() for x in words().encode_many(texts, size)] == expected
    assert [words().decode(x) for x in expected] == library().decode(expected)


def test_decoding_any_ids():
    choose = random.Random(2)
    for _ in range(5000):
        ids = [choose.choice([0, 1, 2, choose.randrange(3, 259), choose.randrange(3, 259),
                              choose.randrange(259, 32000), 28705, 259]) for _ in range(choose.randrange(7))]
        assert words().decode(ids) == library().decode(ids), ids


def test_pairs_stay_apart_as_merging_says():
    """Against carrying out the merges, best score first and leftmost of equals."""
    model, table = library(), words()
    score = {model.id_to_piece(i): model.get_score(i) for i in range(259, 32000)}

    def merged(text):
        parts = list(text)
        while True:
            best = max(((score[a + b], -k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in score),
                       default=None)
            if best is None:
                return parts
            k = -best[1]
            parts[k:k + 2] = [parts[k] + parts[k + 1]]

    choose = random.Random(4)
    blanks = [i for i in range(259, 32000) if set(model.id_to_piece(i)) == {"▁"}]
    some = [i for i in range(259, 32000) if len(model.id_to_piece(i)) < 4]
    pairs = [(choose.choice(some), choose.choice(some)) for _ in range(4000)]
    pairs += [(a, b) for a in blanks for b in blanks]
    names = [[model.id_to_piece(i) for i in p] for p in pairs]
    got = table.taken_apart(*(np.array(x, np.int64) for x in zip(*pairs)))
    assert got.tolist() == [merged(a + b) == [a, b] for a, b in names]


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "ids", 3) for i, t in enumerate(texts)],
                                 "doc_id long, text string, ids string, n_tokens int")


def digests(texts):
    for i, text in enumerate(texts):
        ids = library().encode(text or "", add_eos=True)
        yield (i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
               hashlib.sha256(library().decode(ids).encode()).hexdigest())


def test_round_trip_of_a_table(spark, monkeypatch):
    texts = [*odd_texts()[:500], "word " * 1_000_000]
    got = pieces.round_trip(docs_of(spark, texts), vocabulary(MODEL)).collect()
    assert in_order(got) == in_order(digests(texts))
    assert pieces.round_trip(docs_of(spark, []), vocabulary(MODEL)).collect() == []
    twice = spark.createDataFrame([(None, None), (None, None), (1, "a"), (1, "b")], "doc_id long, text string")
    assert pieces.round_trip(twice, vocabulary(MODEL)).count() == 4


def test_encode_then_decode_a_table(spark):
    texts = [t for t in odd_texts()[:300] if t is None or "▁" not in t]
    encoded = pieces.encode(docs_of(spark, texts), vocabulary(MODEL))
    back = pieces.decode(encoded, vocabulary(MODEL)).collect()
    assert sorted((r.doc_id, r.text) for r in back) == [(i, t or "") for i, t in enumerate(texts)]
