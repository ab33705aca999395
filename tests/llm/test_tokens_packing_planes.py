import functools
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from faultlens.llm import packing, planes
from faultlens.llm.queries import vocabulary
from faultlens.llm.tokens import BLOCK, encoder

DOCS = "doc_id long, text string, lang string, source string, n_chars long, length string, rank int"
ODD = ["", " ", "a  b", "word's it's 's", "x\n\n y", "foo.bar, baz!!qux ", "<|endoftext|> hi<|endoftext|>",
       "中文   abc", "tab\tb \t c", "\x1cabc\x1d d", "ÉÀ ŒUVRE İx ẞ", "a | b||c | d", "AB12 cd.ef",
       "  lead", "trail  ", "don't CAN'T we'LL", "a​b c", "é café.", "x 　 y", "\x00 a\x00b",
       "of%%% a### b*** c&&& (d) [e] f_g h_ \\i j\\ k|l m| n'o p' q.*** A!!\nB?? c", "ΑΣ ΣΑΣ Σ"]


@functools.cache
def plain_tokenizer(name):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary(name))
    tokenizer.encode_special_tokens = True
    return tokenizer


def plain_ids(name, text):
    return plain_tokenizer(name).encode(text, add_special_tokens=False).ids


def docs_of(spark, texts, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame(
        [(i, t, "en", "s", len(t or ""), "x", 1) for i, t in zip(ids, texts)], DOCS)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(name):
    texts = ODD + ["word, " * 30 + "end.\nNext line", "x" * 3000, "long text. " * (BLOCK // 8)]
    found = list(encoder(vocabulary(name)).encode_many(texts))
    for text, ids in zip(texts, found):
        assert np.frombuffer(ids, "<u4").tolist() == plain_ids(name, text), text[:50]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aZéΣ%_* ñ.,!'|\n\t　 中1 ", max_size=30), max_size=6))
def test_encoder_on_random_texts(texts):
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        for text, ids in zip(texts, encoder(vocabulary(name)).encode_many(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == plain_ids(name, text), text


def slow_fill(lengths, size):
    """Minimum bin slack one bin at a time, by trying every sum with plain sets."""
    left, bins = Counter(lengths), []
    while left:
        kinds = sorted(left)
        reach = [{0}]
        for x in kinds:
            reach.append({s + n * x for s in reach[-1] for n in range(left[x] + 1) if s + n * x <= size})
        total, bin_ = max(reach[-1]), []
        for i in range(len(kinds) - 1, -1, -1):
            n = max(n for n in range(left[kinds[i]] + 1) if total - n * kinds[i] in reach[i])
            bin_ += [kinds[i]] * n
            total -= n * kinds[i]
        bins.append(bin_)
        left -= Counter(bin_)
    return bins


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 24), max_size=60))
def test_patterns_are_minimum_bin_slack(lengths):
    fast = [[x for x, n in p.parts for _ in range(n)]
            for p in packing.fill(Counter(lengths), 24) for _ in range(p.times)]
    assert fast == slow_fill(lengths, 24)


def check_packing(rows, size):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= size
    return len(by_sequence)


def test_documents_are_packed_whole(spark):
    texts = [None, "", "a b c", "word " * 700, "word " * 64, "same text"] + ["same text"] * 200
    docs = docs_of(spark, texts, [None, 1, 2, 3, 3, 5] + [6] * 100 + list(range(7, 107)))
    rows = packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), 64, 2).collect()
    n = check_packing(rows, 64)
    assert n == -(-sum(r["length"] for r in rows) // 64)  # no bin too many
    pieces = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
    ids = np.array([*plain_ids("byte_bpe_50k.json", "a b c"), 2], "<u4")
    (short,) = pieces[2]
    assert (short["start"], short["length"], short["ids_crc32"]) == (0, len(ids), zlib.crc32(ids.tobytes()))
    assert [r["length"] for r in pieces[1]] == [1] and [r["length"] for r in pieces[None]] == [1]
    assert len(pieces[6]) == 100
    long = sorted((r for r in pieces[3] if r["length"] == 64), key=lambda r: r["start"])
    assert len(long) >= 10
    assert packing.pack_documents(docs.limit(0), vocabulary("byte_bpe_50k.json"), 64, 2).collect() == []


def test_sequences_hold_the_ids(spark):
    texts = ["a b c", "d e", "word " * 100, ""]
    docs = docs_of(spark, texts)
    name = vocabulary("byte_bpe_50k.json")
    packed = packing.pack_documents(docs, name, 32, 2)
    rows = {r["sequence_id"]: r["ids"] for r in packing.sequences(docs, packed, name, 2).collect()}
    for r in packed.collect():
        ids = [*plain_ids("byte_bpe_50k.json", texts[r["doc_id"]]), 2][r["start"]:r["start"] + r["length"]]
        assert rows[r["sequence_id"]][r["offset"]:r["offset"] + r["length"]] == ids


@pytest.mark.parametrize("kind", [planes.BYTES, planes.BITS])
def test_planes_round_trip(kind):
    for n in (1, 7, 64, 1000):
        ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint32)
        assert (planes.unshuffle_planes(planes.shuffle_planes(ids, kind), n, kind) == ids).all()


@given(st.lists(st.binary(max_size=40), min_size=1, max_size=5))
def test_joined_checksum(parts):
    assert planes.joined_crc([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(b"".join(parts))


@pytest.mark.parametrize("kind", [planes.BYTES, planes.BITS])
def test_files_give_back_every_document(spark, tmp_path, kind):
    texts = [None, "", "a b c", "word " * 700, "tail", "tail", "x y"]
    docs = docs_of(spark, texts, [9, 4, 2, 3, 7, 7, None]).repartition(3)
    name, path = vocabulary("word_bpe_49k.json"), f"file://{tmp_path}/planes-{kind}"
    planes.write_ids(docs, path, name, 2, block=50, kind=kind)
    expected, start = [], 0
    for doc_id, text in [(2, texts[2]), (3, texts[3]), (4, ""), (7, "tail"), (7, "tail"), (9, ""), (None, "x y")]:
        ids = np.array([*plain_ids("word_bpe_49k.json", text), 2], "<u4")
        expected.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    found = planes.read_index(spark, path).collect()
    assert sorted(map(tuple, found), key=lambda r: r[1]) == expected
    back = {r["doc_id"]: r["ids"] for r in planes.read_ids(spark, path).collect()}
    assert back[3] == [*plain_ids("word_bpe_49k.json", texts[3]), 2]
    empty = f"file://{tmp_path}/empty-{kind}"
    planes.write_ids(docs.limit(0), empty, name, 2)
    assert planes.read_index(spark, empty).collect() == []
