"""Token ids of whole texts by the ``tokenizers`` library, with a cache of chunks.

The vocabularies used here split at white space, and a run of letters between
white space or plain punctuation has the same ids wherever it stands. So a text
is cut at blanks, chunks that are new are encoded many at a time, and a text's
ids are the joined ids of its chunks.

The strings of special tokens in a text are ordinary text (``encode_special_tokens``), as
the notes that come with the vocabularies have it: a document can't write an end id.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Unicode white space, as the vocabularies' patterns see it, and letters that
#: fold and compose one by one (fixed values).
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"

#: Chunks whose pieces are plain to see: words and the signs after them, on one or more
#: lines. Apostrophes can begin a piece of letters, and ``|`` is the mark between chunks.
SIGNS = r'.,!;:?"#$%&()*+/<=>@\[\\\]^_`{}~-'
SIMPLE = re.compile(f"[{LETTERS}]+[{SIGNS}]*(?:\n[{LETTERS}]+[{SIGNS}]*)*")
PUNCTUATION = re.compile(f"([{SIGNS}]+)")
#: Where a long text may be cut: before a single blank between two runs.
CUT = re.compile(f"(?<=[^{WHITE}]) (?=[^{WHITE}])")
#: Where white space is more than single blanks between chunks.
UNEVEN = re.compile(f" [{WHITE}]")

#: A sign that is a piece of its own, in vocabularies that drop white space.
LONE = re.compile(f"(?<=[{LETTERS}])([.,])(?= )")

#: Entries of each half of the cache, and characters that are cut into chunks at a time.
CACHED, BLOCK = 300_000, 1 << 22

#: Stands between pieces; it is in no simple chunk.
BETWEEN = "\x00"


def _byte_alphabet() -> np.ndarray:
    """The character by which byte-level vocabularies write each byte."""
    table = np.arange(256, dtype="<u2")
    printable = np.zeros(256, bool)
    for low, high in ((0x21, 0x7F), (0xA1, 0xAD), (0xAE, 0x100)):
        printable[low:high] = True
    table[~printable] = 256 + np.arange((~printable).sum())
    table[ord(BETWEEN)] = ord(BETWEEN)
    return table


ALPHABET = _byte_alphabet()


def _folded(text: str) -> str:
    """Lower case, where that is letter by letter; other texts are left to the vocabulary."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers.

    Vocabularies that do not keep the blank before a word are taken to fold case
    and to drop white space.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings are ordinary text
        self.blank = self._ids(" a") != self._ids("a")
        # The same model for pieces that are cut and in its alphabet already.
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(BETWEEN)
        # Between chunks stands a piece whose single id does not occur in a simple chunk.
        mark = self._ids("|")
        self.mark = mark[0] if len(mark) == 1 else None
        # Chunks used lately, and those used before them; what neither has is forgotten.
        self.chunks: dict[str, bytes] = {}
        self.earlier: dict[str, bytes] = {}

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _plainly(self, texts: list[str]) -> list[bytes]:
        return [np.array(found.ids, "<u4").tobytes()
                for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: list[str]) -> None:
        """Ids of new chunks, with the blank before each."""
        simple = list(filter(SIMPLE.fullmatch, chunks)) if self.mark is not None else []
        if simple:
            before = " " if self.blank else ""
            text = before + f"{BETWEEN}|{BETWEEN}{before}".join(simple)
            text = PUNCTUATION.sub(BETWEEN + r"\1", text)
            if self.blank:
                text = text.replace("\n", f"{BETWEEN}\n{BETWEEN}")
            else:
                text = text.lower().replace("\n", BETWEEN)
            written = ALPHABET[np.frombuffer(text.encode(), np.uint8)].tobytes().decode("utf-16-le")
            ids = np.array(
                self.model.encode_batch_fast([written], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(ids == self.mark)
            if len(cuts) == len(simple) - 1:
                raw = ids.tobytes()
                starts = [0, *((cuts + 1) * 4).tolist()]
                ends = [*(cuts * 4).tolist(), len(raw)]
                self.chunks.update(zip(simple, [raw[a:b] for a, b in zip(starts, ends)]))
        rest = [c for c in chunks if c not in self.chunks]
        self.chunks.update(zip(rest, self._plainly([" " + c for c in rest])))

    def _known(self, chunks: list[str]) -> list[bytes]:
        """Ids of distinct chunks."""
        if len(self.chunks) > CACHED:
            self.chunks, self.earlier = {}, self.chunks
        new = [c for c in chunks if c not in self.chunks]
        if self.earlier:
            again = {c: self.earlier[c] for c in new if c in self.earlier}
            self.chunks.update(again)
            new = [c for c in new if c not in again]
        if new:
            self._learn(new)
        return [self.chunks[c] for c in chunks]

    def _block(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that are short together."""
        if not texts:
            return []
        return self._with_blanks(texts) if self.blank else self._without_blanks(texts)

    def _with_blanks(self, texts: list[str]) -> list[bytes]:
        """A chunk stands for the blank before it, too; a text's first has none."""
        out: list[bytes | None] = [None] * len(texts)
        uneven = [i for i, t in enumerate(texts) if UNEVEN.search(t)]
        for i, ids in zip(uneven, self._plainly([texts[i] for i in uneven])):
            out[i] = ids
        even = [i for i, ids in enumerate(out) if ids is None]
        if even:
            firsts = self._plainly([texts[i].partition(" ")[0] for i in even])
            for i, ids in zip(even, self._of_words([texts[i] for i in even], firsts)):
                out[i] = ids
        return out

    def _without_blanks(self, texts: list[str]) -> list[bytes]:
        """White space only parts words here, so lines and single signs are parted, too."""
        return self._of_words([LONE.sub(r" \1", _folded(t).replace("\n", " ")) for t in texts])

    def _of_words(self, texts: list[str], firsts: list[bytes] | None = None) -> list[bytes]:
        """Each distinct word is looked up once; the ids of all words are then gathered.
        ``firsts`` are the ids of each text's first word."""
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded = split.flatten().dictionary_encode()
        offsets, at = split.offsets.to_numpy(), coded.indices.to_numpy()
        ids = self._known(coded.dictionary.to_pylist())
        if firsts is not None:
            at = at.copy()
            at[offsets[:-1]] = np.arange(len(ids), len(ids) + len(firsts))
            ids += firsts
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        starts = np.cumsum(lengths) - lengths
        n = lengths[at]
        ends = np.cumsum(n)
        place = np.repeat(starts[at] - (ends - n), n) + np.arange(n.sum())
        raw = np.frombuffer(b"".join(ids), "<u4")[place].tobytes()
        cuts = (4 * np.concatenate(([0], ends))[offsets]).tolist()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]

    def encode_many(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each text in turn; a long text is encoded block by block."""
        held, size = [], 0
        for text in texts:
            if len(text) > BLOCK:
                yield from self._block(held)
                held, size = [], 0
                yield b"".join(self._block([part])[0] for part in self._parts(text))
                continue
            held.append(text)
            size += len(text)
            if size > BLOCK:
                yield from self._block(held)
                held, size = [], 0
        yield from self._block(held)

    @staticmethod
    def _parts(text: str) -> Iterator[str]:
        low = 0
        while low < len(text):
            cut = CUT.search(text, low + BLOCK)
            high = cut.start() if cut else len(text)
            yield text[low:high]
            low = high

    def encode(self, text: str) -> bytes:
        return b"".join(self.encode_many([text]))


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder per worker and vocabulary file."""
    return Encoder(path)
