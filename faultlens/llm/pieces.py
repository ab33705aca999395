"""SentencePiece BPE encoding by a table of prefixes, and decoding.

Merges of a merge-type vocabulary depend on nothing but the symbols they join, so every
prefix of a text has exactly one last token, and tokens laid end to end are an encoding
if and only if each pair of neighbours is (it stays two tokens when encoded alone). The
encoder therefore goes through a text once: an automaton of the pieces finds those that
end at each character, the one that is compatible with the last token of the prefix
before it becomes the last token of this prefix, and at the end the ids are recovered
backwards, from last token to last token. No merge is ever carried out.

Whether two pieces are compatible is found by taking both apart, the later merge first:
they are not if the two symbols at the seam would have been joined before one of them
was used up. Pieces of equal score are joined from left to right.

The work is done for the distinct words of a block of text at once, in numpy, character
by character of all words together; few long words are finished one by one. A word
begins at a blank after something else, or at a character that no piece has: pieces
do not reach over either.

Results in special cases: a null or empty text has the end id alone and decodes to an
empty text; every row of the table gives a row, repeated ids and null doc_ids too; a
long text is encoded in blocks cut between words, so memory is bounded by ``BLOCK`` and
the longest word (about 100 bytes a character of it); an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.llm.storage import shared_folder

#: How a blank is written in pieces (fixed value).
BLANK = "▁"
#: Bytes of text that are in numpy arrays at a time, and entries kept of tested pairs.
BLOCK, KEPT_PAIRS = 1 << 22, 1 << 21
#: Fewer words than these are finished one by one.
FEW = 24
#: Where a text may be cut: before a blank that follows something else.
CUT = re.compile(rb"(?<=[^ ]) ")

DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


class Vocabulary:
    """Pieces, their merges, and the automaton, from a model file."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.size = n = model.get_piece_size()
        self.end_id, self.unknown = model.eos_id(), n
        special = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
                   for i in range(n)]
        names = [model.id_to_piece(i) for i in range(n)]
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        ids = {names[i]: i for i in range(n) if not special[i]}
        singles = {p for p in ids if len(p) == 1}
        if not all(singles.issuperset(p) and BLANK not in p.lstrip(BLANK) for p in ids):
            raise ValueError("each character of a piece must be a piece, and blanks must come first")

        # A piece is made later the lower its score; single characters are there at first.
        levels = {s: k for k, s in enumerate(sorted({model.get_score(i) for i in ids.values()}, reverse=True))}
        self.made_rank = np.full(n + 1, -1, np.int64)
        for p, i in ids.items():
            if len(p) > 1:
                self.made_rank[i] = levels[model.get_score(i)]
        self.length = np.ones(n + 1, np.int64)
        self.left, self.right = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        joined = {}
        whole = {i: True for i in ids.values()}
        for p, i in ids.items():
            self.length[i] = len(p)
            for k in range(1, len(p)):
                if p[:k] in ids and p[k:] in ids:
                    joined[ids[p[:k]] * (n + 1) + ids[p[k:]]] = i
            if len(p) > 1:
                last = self._merged(p, ids)
                whole[i] = last is not None
                if last:
                    self.left[i], self.right[i] = last
        keys = np.array(sorted(joined), np.int64)
        self.pairs, self.pair_rank = keys, self.made_rank[[joined[k] for k in keys.tolist()]]
        self.pair_of = {k: int(self.made_rank[i]) for k, i in joined.items()}

        # What decoding puts for each id.
        put = [b"" if special[i] else names[i].replace(BLANK, " ").encode() for i in range(n)]
        for b, i in enumerate(self.byte_ids.tolist()):
            put[i] = bytes([b])
        put[model.unk_id()] = " ⁇ ".encode()  # how decoding writes the unknown id (fixed value)
        self.text_of = pa.array(put, pa.large_binary())
        self.begins_blank = np.array([names[i].startswith(BLANK) and not special[i] for i in range(n)])
        self.is_control = np.array([model.is_control(i) for i in range(n)])
        self.digits_of = pa.array([f"{i} ".encode() for i in range(n)], pa.large_binary())

        self._automaton({p: i for p, i in ids.items() if whole[i]})
        self.tested = np.full(KEPT_PAIRS, -1, np.int64)
        in_pieces = {ord(c) for c in singles}
        #: ASCII characters that no piece has: each is a word of its own.
        self.lone = np.array([b < 128 and b not in in_pieces and b != 32 for b in range(256)])

    def _merged(self, piece: str, ids: dict[str, int]) -> tuple[int, int] | None:
        """The two symbols of a piece's last merge, or None if merging does not give the piece."""
        parts, last = list(piece), None
        while len(parts) > 1:
            best = min(((self.made_rank[ids[a + b]], k) for k, (a, b) in enumerate(zip(parts, parts[1:]))
                        if a + b in ids), default=None)
            if best is None:
                return None
            k = best[1]
            last = ids[parts[k]], ids[parts[k + 1]]
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
        return last

    def _automaton(self, pieces: dict[str, int]) -> None:
        """States and edges of all pieces' prefixes; an edge is found by binary search."""
        characters = sorted({c for p in pieces for c in p})
        self.symbols = np.zeros(0x110000, np.int32)  # 0: in no piece
        self.symbols[[ord(c) for c in characters]] = np.arange(1, len(characters) + 1)
        self.symbols[ord(" ")] = self.symbols[ord(BLANK)]
        self.width = len(characters) + 1
        code = {c: k + 1 for k, c in enumerate(characters)}
        edges, ends, total = {}, {}, 1
        for p, i in pieces.items():
            state = 0
            for c in p:
                key = state * self.width + code[c]
                state = edges.get(key, -1)
                if state < 0:
                    state = edges[key] = total
                    total += 1
            ends[state] = i
        self.longest = max(map(len, pieces), default=1)
        self.edges = np.array(sorted(edges), np.int64)
        self.targets = np.array([edges[k] for k in self.edges.tolist()], np.int64)
        self.piece_at = np.full(total, -1, np.int32)
        self.piece_at[list(ends)] = list(ends.values())
        # Edges from the start are a table of their own: half of all steps are these.
        self.start = np.full(self.width, -1, np.int64)
        first = self.edges < self.width
        self.start[self.edges[first]] = self.targets[first]

    def _step(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        keys = states * self.width + symbols
        at = np.searchsorted(self.edges, keys)
        at[at == len(self.edges)] = 0
        return np.where(self.edges[at] == keys, self.targets[at], -1)

    def _join_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """When two neighbours would be joined; later than all merges if never."""
        keys = a * (self.size + 1) + b
        at = np.searchsorted(self.pairs, keys)
        at[at == len(self.pairs)] = 0
        return np.where(self.pairs[at] == keys, self.pair_rank[at], 1 << 40)

    def taken_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair of pieces stays two tokens when encoded together."""
        good = self._join_rank(a, b) >= 1 << 40
        open_ = np.flatnonzero(good)
        a, b = a[open_], b[open_]
        while len(open_):
            rank_a, rank_b = self.made_rank[a], self.made_rank[b]
            more = (rank_a >= 0) | (rank_b >= 0)
            open_, a, b, rank_a, rank_b = (x[more] for x in (open_, a, b, rank_a, rank_b))
            right_later = rank_b >= rank_a
            limit = np.where(right_later, rank_b, rank_a)
            a, b = np.where(right_later, a, self.right[a]), np.where(right_later, self.left[b], b)
            rank = self._join_rank(a, b)
            # Joined before the merge just undone; at equal score what is further left goes first.
            bad = np.where(right_later, rank <= limit, rank < limit)
            good[open_[bad]] = False
            open_, a, b = open_[~bad], a[~bad], b[~bad]
        return good

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``taken_apart``, with a table of pairs tested before. Characters that no piece
        has go with anything."""
        keys = a * (self.size + 1) + b
        slot = (keys * 0x9E3779B1 >> 13) % KEPT_PAIRS
        seen = self.tested[slot]
        known = seen >> 1 == keys
        out = (seen & 1).astype(bool)
        new = np.flatnonzero(~known)
        if len(new):
            x, y = a[new], b[new]
            good = (x == self.unknown) | (y == self.unknown)
            test = np.flatnonzero(~good)
            good[test] = self.taken_apart(x[test], y[test])
            out[new] = good
            self.tested[slot[new]] = keys[new] << 1 | good
        return out

    def _matches(self, symbols: np.ndarray, ends_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces that end at each character, the longest first, and where each character's begin."""
        n = len(symbols)
        found, count = [], np.zeros(n + 1, np.int64)
        where = np.arange(n)
        states = self.start[symbols]
        none = states < 0
        found.append((where, np.where(none, self.unknown, self.piece_at[states])))
        count[1:] += 1
        where, states = where[~none], states[~none]
        for k in range(1, self.longest):
            inside = where + k < ends_of[where]
            where, states = where[inside], states[inside]
            states = self._step(states, symbols[where + k])
            where, states = where[states >= 0], states[states >= 0]
            if not len(where):
                break
            piece = self.piece_at[states]
            ending = piece >= 0
            found.append((where[ending] + k, piece[ending]))
            count[where[ending] + k + 1] += 1
        offsets = np.cumsum(count)
        free, pieces = offsets[:-1].copy(), np.empty(offsets[-1], np.int64)
        for at, piece in reversed(found):
            pieces[free[at]] = piece
            free[at] += 1
        return pieces, offsets

    def prefix_table(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The last token of the prefix that ends at each character, of words laid end to end."""
        ends = starts + lengths
        pieces, offsets = self._matches(symbols, np.repeat(ends, lengths))
        last = np.full(len(symbols), self.unknown, np.int64)
        order = np.argsort(lengths, kind="stable")
        starts, ends, lengths = starts[order], ends[order], lengths[order]
        place, longest = 0, int(lengths[-1]) if len(lengths) else 0
        while place < longest:
            first = int(np.searchsorted(lengths, place, side="right"))
            if len(lengths) - first < FEW:
                for word in range(first, len(lengths)):
                    self._one_by_one(pieces, offsets, last, int(starts[word]), place, int(ends[word]))
                break
            begin = starts[first:]
            at = begin + place
            low, high = offsets[at], offsets[at + 1]
            while len(at):
                piece = pieces[low]
                before = at - self.length[piece]
                good = before < begin  # the whole prefix
                pair = np.flatnonzero(~good)
                good[pair] = self.compatible(last[before[pair]], piece[pair])
                last[at[good]] = piece[good]
                rest = ~good
                rest[rest] = low[rest] + 1 < high[rest]
                at, begin, low, high = at[rest], begin[rest], low[rest] + 1, high[rest]
            place += 1
        return last

    def _one_by_one(self, pieces, offsets, last, start: int, place: int, end: int) -> None:
        """``prefix_table`` for the rest of one word."""
        at = offsets[start + place:end + 1].tolist()
        some = pieces[at[0]:at[-1]].tolist()
        base, length, seen = at[0], self.length, {}
        done = last[start:start + place].tolist()
        for k in range(end - start - place):
            for piece in some[at[k] - base:at[k + 1] - base]:
                before = len(done) - int(length[piece])
                if before < -1:
                    continue
                pair = (done[before], piece) if before >= 0 else None
                good = pair is None or seen.get(pair)
                if good is None:
                    good = seen[pair] = bool(self.compatible(np.array(pair[:1]), np.array(pair[1:]))[0])
                if good:
                    done.append(piece)
                    break
        last[start:end] = done

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words laid end to end, and where each word's begin."""
        text = "".join(words.to_pylist())
        lengths = pc.utf8_length(words).to_numpy().astype(np.int64)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        last = self.prefix_table(self.symbols[points], starts, lengths)
        # Backwards from each word's end; then turned round by a sort of the places.
        at, begin = ends - 1, starts
        places = []
        while len(at):
            places.append(at)
            at = at - self.length[last[at]]
            inside = at >= begin
            at, begin = at[inside], begin[inside]
        places = np.sort(np.concatenate(places)) if places else np.zeros(0, np.int64)
        ids = last[places]
        new = np.flatnonzero(ids == self.unknown)
        if len(new):  # as the bytes of the character
            written = [chr(p).encode() for p in points[places[new]].tolist()]
            times = np.ones(len(ids), np.int64)
            times[new] = [len(w) for w in written]
            first = np.cumsum(times) - times
            ids, places = np.repeat(ids, times), np.repeat(places, times)
            spot = np.repeat(first[new], times[new])
            spot += np.arange(len(spot)) - np.repeat(np.cumsum(times[new]) - times[new], times[new])
            ids[spot] = self.byte_ids[np.frombuffer(b"".join(written), np.uint8)]
        return ids.astype(np.int32), np.searchsorted(places, np.append(starts, len(points)))

    def encode_parts(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts laid end to end, and where each part's begin. A part is UTF-8 text
        with its first blank already in front."""
        raw = b"".join(parts)
        bounds = np.cumsum([0, *map(len, parts)])
        if not raw:
            return np.zeros(0, np.int32), np.zeros(len(bounds), np.int64)
        data = np.frombuffer(raw, np.uint8)
        cut = data == 32
        cut[1:] &= data[:-1] != 32
        lone = self.lone[data]
        cut |= lone
        cut[1:] |= lone[:-1]
        cut[bounds[:-1][bounds[:-1] < len(data)]] = True
        cuts = np.append(np.flatnonzero(cut), len(data))
        words = pa.LargeStringArray.from_buffers(
            len(cuts) - 1, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(raw)).dictionary_encode()
        ids, begins = self._words(words.dictionary)
        at = words.indices.to_numpy()
        n = (begins[1:] - begins[:-1])[at]
        ends = np.cumsum(n)
        place = np.repeat(begins[:-1][at] - (ends - n), n) + np.arange(n.sum())
        return ids[place], np.append(0, ends)[np.searchsorted(cuts, bounds)]

    def blocks(self, texts: Iterable[bytes | None], size: int | None = None
               ) -> Iterator[list[tuple[int, bytes]]]:
        """(number of the text, part of it in order), about ``size`` bytes at a time."""
        size = size or BLOCK
        held, total = [], 0
        for i, text in enumerate(texts):
            text = text or b""
            if text:
                text = b" " + text.replace(BLANK.encode(), b" ")
            low = 0
            while True:
                cut = CUT.search(text, low + size) if len(text) - low > size else None
                high = cut.start() if cut else len(text)
                held.append((i, text[low:high]))
                total += high - low
                if total >= size:
                    yield held
                    held, total = [], 0
                low = high
                if low == len(text):
                    break
        if held:
            yield held

    def encode_blocks(self, texts: Iterable[bytes | None], size: int | None = None
                      ) -> Iterator[list[tuple[int, np.ndarray]]]:
        """(number of the text, ids of a part of it, without the end id), block by block."""
        for held in self.blocks(texts, size):
            ids, ends = self.encode_parts([part for _, part in held])
            yield [(i, ids[a:b]) for (i, _), a, b in zip(held, ends.tolist(), ends[1:].tolist())]

    def encode_many(self, texts: Iterable[str | None], size: int | None = None) -> Iterator[np.ndarray]:
        """Ids of each text in turn, with the end id."""
        now, parts = 0, []
        for block in self.encode_blocks((t.encode() if t else None for t in texts), size):
            for i, ids in block:
                if i != now:
                    yield np.append(np.concatenate(parts), np.int32(self.end_id))
                    now, parts = i, []
                parts.append(ids)
        if parts:
            yield np.append(np.concatenate(parts), np.int32(self.end_id))

    def put(self, table: pa.Array, ids: np.ndarray) -> bytes:
        """What a table has for each id, laid end to end."""
        taken = table.take(pa.array(ids))
        offsets = np.frombuffer(taken.buffers()[1], np.int64)
        return taken.buffers()[2].to_pybytes()[offsets[0]:offsets[len(ids)]] if len(ids) else b""

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces end to end, without the blank put before the first; bytes
        that are no UTF-8 each become U+FFFD."""
        ids = np.asarray(ids, np.int64)
        control = self.is_control[ids]
        first = ids[~control][:1]
        # A control id, which has no text, also ends a run of bytes.
        cuts = np.flatnonzero(control)
        out = "".join(self._decoded(run) for run in (np.split(ids, cuts) if len(cuts) else [ids]))
        # The blank that encoding put in front.
        return out[1:] if len(first) and self.begins_blank[first[0]] else out

    def _decoded(self, ids: np.ndarray) -> str:
        raw = self.put(self.text_of, ids)
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return _each_byte(raw)


def _each_byte(raw: bytes) -> str:
    """UTF-8 in which every byte that belongs to no character becomes U+FFFD by itself."""
    out, low = [], 0
    while low < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[low:low + n].decode())
                low += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            low += 1
    return "".join(out)


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    """One per worker and model file."""
    return Vocabulary(path)


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and ids (with the end id) of every text."""
    shared_folder(docs.sparkSession, "pieces")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        words = vocabulary(model)
        for batch in batches:
            ids = [x for x in words.encode_many(batch.column(1).to_pylist())]
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of every row's ids."""
    shared_folder(encoded.sparkSession, "pieces")
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches):
        words = vocabulary(model)
        for batch in batches:
            texts = [None if ids is None else words.decode(np.array(ids, np.int64))
                     for ids in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


class _Digests:
    """Checksums of one text's ids and of what they decode to, part by part."""

    def __init__(self, words: Vocabulary):
        self.words, self.n = words, 0
        self.ids, self.text = sha256(), sha256()

    def add(self, ids: np.ndarray) -> None:
        if not len(ids):
            return
        self.ids.update(self.words.put(self.words.digits_of, ids))
        # Parts begin at words, so the bytes of a character are never parted.
        raw = self.words.put(self.words.text_of, ids)
        self.text.update(raw[1:] if not self.n and self.words.begins_blank[ids[0]] else raw)
        self.n += len(ids)

    def row(self) -> tuple[int, str, str]:
        self.ids.update(b"%d" % self.words.end_id)
        return self.n + 1, self.ids.hexdigest(), self.text.hexdigest()


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, number and checksum of the ids of every text, checksum of what they decode to."""
    shared_folder(docs.sparkSession, "pieces")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        words = vocabulary(model)
        for batch in batches:
            found = [_Digests(words) for _ in range(len(batch))]
            texts = batch.column(1).cast(pa.large_binary()).to_pylist()
            for block in words.encode_blocks(texts):
                for i, ids in block:
                    found[i].add(ids)
            columns = list(zip(*(d.row() for d in found))) or [()] * 3
            yield pa.record_batch(
                [batch.column(0), pa.array(columns[0], pa.int64()),
                 pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, {DIGESTS}")
