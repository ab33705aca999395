"""Sorted arrays of 64-bit hashes with columns beside them, in files that workers map.

The hashes are split into shards of consecutive values. Workers send what they have
counted as compressed pieces, one for each shard; whoever gets a shard's pieces adds
them up and stores the shard's arrays as files in the shared folder, under their
final name only when complete, so a task that is run again writes the same once
more. Readers map a file into memory: it is read page by page, as looked up.
"""

from __future__ import annotations

import functools
import io
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np

#: Hashes that are searched for in one part of an array, and stored ones in a part, at least.
PART, LEAST_PART = 256, 4096


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return (((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def split(hashes: np.ndarray, shards: int) -> Iterator[tuple[int, slice]]:
    """(shard, places) of sorted hashes."""
    of = shard_of(hashes, shards)
    starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else []
    for a, b in zip(starts, [*starts[1:], len(of)]):
        yield int(of[a]), slice(a, b)


def packed(hashes: np.ndarray, columns: Sequence[np.ndarray]) -> bytes:
    """Sorted hashes as their differences, and the columns, byte plane by byte plane."""
    import zstandard

    out = io.BytesIO()
    np.save(out, np.array([len(hashes), len(columns)]))
    out.write("".join(c.dtype.str.ljust(4) for c in columns).encode())
    for values in (np.diff(hashes, prepend=np.uint64(0)), *columns):
        planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
        out.write(np.ascontiguousarray(planes).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(out.getvalue())


def unpacked(blob: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
    import zstandard

    raw = io.BytesIO(zstandard.ZstdDecompressor().decompress(blob))
    n, k = np.load(raw).tolist()
    kinds = raw.read(4 * k).decode()
    out = []
    for kind in ("<u8", *(kinds[4 * i:4 * i + 4].strip() for i in range(k))):
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(raw.read(n * width), np.uint8).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
    return np.cumsum(out[0], dtype=np.uint64), out[1:]


def order_of(hashes: np.ndarray) -> np.ndarray:
    """The stable order of hashes: their upper bits and places are sorted as one number, and
    what differs in lower bits alone is put right after that."""
    n = len(hashes)
    bits = np.uint64(max(1, (n - 1).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    order = (np.sort((hashes & ~low) | np.arange(n, dtype=np.uint64)) & low).astype(np.int64)
    ordered = hashes[order]
    for _ in range(8):
        bad = np.flatnonzero(ordered[1:] < ordered[:-1])
        if not len(bad):
            return order
        bad = bad[np.r_[True, bad[1:] != bad[:-1] + 1]]
        for values in (order, ordered):
            values[bad], values[bad + 1] = values[bad + 1], values[bad]
    return np.argsort(hashes, kind="stable")


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order, and where in them each hash is."""
    if not len(hashes):
        return hashes, np.zeros(0, np.int64)
    order = order_of(hashes)
    ordered = hashes[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    at = np.empty(len(hashes), np.int64)
    at[order] = np.cumsum(new) - 1
    return ordered[new], at


def summed(hashes: np.ndarray, columns: Iterable[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct hashes in order, with the sums of their rows; floats are added as long ones."""
    if not len(hashes):
        return hashes, list(columns)
    order = order_of(hashes)
    hashes = hashes[order]
    starts = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
    return hashes[starts], [
        np.add.reduceat(c[order], starts, dtype="<f8" if c.dtype.kind == "f" else c.dtype) for c in columns]


def store(folder: str, name: str, shard: int, arrays: Mapping[str, np.ndarray]) -> None:
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    for key, values in arrays.items():
        draft = f"{path}/.{uuid.uuid4().hex}"
        with system.open_output_stream(draft, compression=None) as out:
            out.write(np.ascontiguousarray(values).data if len(values) else b"")
        system.move(draft, f"{path}/{name}-{shard}-{key}")


@functools.lru_cache(maxsize=1 << 15)
def mapped(folder: str, name: str, shard: int, key: str, kind: str) -> np.ndarray:
    """An array of a shard, mapped into memory; empty if nothing was stored.

    A file that is not on a mounted file system is copied to a file of the worker's
    that has no name, and so goes with the worker.
    """
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(f"{folder}/{name}-{shard}-{key}")
    info = system.get_file_info(path)
    if info.type == fs.FileType.NotFound or not info.size:
        return np.zeros(0, kind)
    if isinstance(system, fs.LocalFileSystem):
        return np.asarray(np.memmap(path, kind, "r"))
    with tempfile.TemporaryFile() as copy, system.open_input_stream(path) as source:
        while chunk := source.read(1 << 24):
            copy.write(chunk)
        copy.flush()
        return np.asarray(np.memmap(copy, kind, "r"))


def _places(stored: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where sorted ``hashes`` are in sorted ``stored`` ones, and which of them are there at all.

    Both are parted at the same values first, so that a search stays in a small part of
    ``stored`` and not every search passes over all of it.
    """
    place = np.empty(len(hashes), np.int64)
    step = max(LEAST_PART, PART * len(stored) // max(1, len(hashes)))
    cuts = [0, *hashes.searchsorted(stored[step::step]).tolist(), len(hashes)]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if a < b:
            np.add(stored[i * step:(i + 1) * step].searchsorted(hashes[a:b]), i * step, out=place[a:b])
    np.minimum(place, len(stored) - 1, out=place)
    return place, stored[place] == hashes


def find(
    folder: str, name: str, shards: int, hashes: np.ndarray, columns: Mapping[str, str],
) -> dict[str, np.ndarray]:
    """The columns (name: type) of sorted ``hashes``; zero where a hash is not stored."""
    out = {key: np.zeros(len(hashes), kind) for key, kind in columns.items()}
    for shard, at in split(hashes, shards):
        stored = mapped(folder, name, shard, "hash", "<u8")
        if not len(stored):
            continue
        place, hit = _places(stored, hashes[at])
        place = place[hit]
        for key, kind in columns.items():
            out[key][at][hit] = mapped(folder, name, shard, key, kind)[place]
    return out


def holds(folder: str, name: str, shards: int, hashes: np.ndarray) -> np.ndarray:
    """Which of sorted ``hashes`` are stored."""
    out = np.zeros(len(hashes), bool)
    for shard, at in split(hashes, shards):
        stored = mapped(folder, name, shard, "hash", "<u8")
        if len(stored):
            out[at] = _places(stored, hashes[at])[1]
    return out


def merged(rows: Iterable[tuple[int, bytes]]) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """(shard, hashes, columns) of the pieces of shards that come one after another.

    Pieces are added up whenever they hold twice what is summed already, so that
    one shard's arrays and not all its pieces are held.
    """
    def total(held):
        return summed(np.concatenate([h for h, _ in held]),
                      map(np.concatenate, zip(*(c for _, c in held))))

    shard, held, size, least = None, [], 0, 0
    for of, blob in rows:
        if of != shard and held:
            yield shard, *total(held)
            held, size, least = [], 0, 0
        shard = of
        piece = unpacked(blob)
        held.append(piece)
        size += len(piece[0])
        if size > max(1 << 22, 2 * least):
            held = [total(held)]
            size = least = len(held[0][0])
    if held:
        yield shard, *total(held)
