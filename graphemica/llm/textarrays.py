"""Vectorised text primitives: words, word hashes and window hashes straight from Arrow buffers.

A batch of texts is one byte buffer plus offsets.  Everything below works on whole batches with numpy, so
the cost per byte is a handful of array passes and no Python object is made per word.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import xxhash
import zstandard

#: glibc keeps freed blocks; other C libraries have no such call and need none.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)

#: ASCII white space: space and U+0009 to U+000D.  A word is a maximal run of anything else.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The low 0 to 8 bytes of a number.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
#: Words whose hashes are taken at a time (their arrays stay in the cache), and bytes of a word taken in numpy.
_STEP, _LONG = 1 << 16, 64


def release() -> None:
    """Give freed memory back to the system: a Python worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, end to end, and the n + 1 offsets between them.  Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.cast(pa.large_binary()).combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
    else:
        column = column.cast(pa.large_binary())
    if len(column) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, dtype=np.uint8), off - off[0]
    return np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]], off - off[0]


class Words:
    """Words of a batch: byte spans ``start``/``end``, and ``first[i]:first[i + 1]`` are those of text i."""

    def __init__(self, column: pa.Array | pa.ChunkedArray):
        self.bytes, self.offsets = text_buffer(column)
        n = len(self.bytes)
        inside = ~_SPACE[self.bytes]
        cut = np.zeros(n + 1, dtype=bool)
        cut[self.offsets] = True
        edge = np.empty(n, dtype=bool)
        if n:
            edge[0] = True
            np.logical_not(inside[:-1], out=edge[1:])
        self.start = np.flatnonzero(inside & (edge | cut[:-1]))
        if n:
            np.logical_not(inside[1:], out=edge[:-1])
            edge[-1] = True
        self.end = np.flatnonzero(inside & (edge | cut[1:])) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.counts = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.start)

    def place(self) -> np.ndarray:
        """The index of each word within its text."""
        return np.arange(len(self.start)) - np.repeat(self.first[:-1], self.counts)

    def hashes(self, nocase: bool = False) -> np.ndarray:
        return span_hashes(self.bytes, self.start, self.end, nocase)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as one number each; zeros follow the last byte."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, nocase: bool = False) -> np.ndarray:
    """A 64-bit hash of each byte span; equal bytes have equal hashes wherever they stand.

    Eight bytes at a time enter a state that is mixed in between, so no pattern of letters makes spans collide
    beyond chance.  Spans of over 64 bytes are hashed one by one by xxh3.
    """
    if nocase:
        data = _LOWER[data]
    view = eights(data)
    out = np.empty(len(start), dtype=np.uint64)
    for i in range(0, len(start), _STEP):
        s, size = start[i : i + _STEP], end[i : i + _STEP] - start[i : i + _STEP]
        h = mix((view[s] & _LOW[np.minimum(size, 8)]) + size.astype(np.uint64) * _ODD)
        for at in range(8, _LONG, 8):
            on = np.flatnonzero(size > at)
            if not len(on):
                break
            h[on] = mix(h[on] * _ODD + (view[s[on] + at] & _LOW[np.minimum(size[on] - at, 8)]))
        out[i : i + _STEP] = h
    far = np.flatnonzero(end - start > _LONG)
    if len(far):
        raw = memoryview(np.ascontiguousarray(data))
        out[far] = [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(start[far].tolist(), end[far].tolist(), strict=True)]
    return out


def equal_spans(view: np.ndarray, a: np.ndarray, other: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the bytes from a on and those of another text from b on are equal, ``size`` of each.  Both texts are
    given as ``eights``."""
    same = np.ones(len(a), dtype=bool)
    at, on = 0, np.arange(len(a))
    while len(on):
        if at >= _LONG:  # few spans are so long: each in one go
            for i in on.tolist():
                same[i] = bool((view.base[a[i] + at : a[i] + size[i]] == other.base[b[i] + at : b[i] + size[i]]).all())
            break
        low = _LOW[np.minimum(size[on] - at, 8)]
        same[on] = (view[a[on] + at] & low) == (other[b[on] + at] & low)
        at += 8
        on = on[same[on] & (size[on] > at)]
    return same


def _two(a: np.ndarray, b: np.ndarray, base: np.uint64) -> np.ndarray:
    x = a * base
    x += b
    x ^= x >> _U(29)
    x *= _U(0xBF58476D1CE4E5B9)
    return x


def window_hashes(words: np.ndarray, length: int, at: np.ndarray | None = None, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Hashes of ``length`` consecutive word hashes, from every word that has so many after it or from ``at``.

    Blocks of 1, 2, 4 ... words are made of two smaller ones, mixed each time, and a window of its blocks.
    """
    n = max(len(words) - length + 1, 0)
    out = np.empty(n, dtype=np.uint64)
    for i in range(0, n, _STEP):
        if at is not None and np.searchsorted(at, i) == np.searchsorted(at, i + _STEP):
            continue  # ``at`` ascends and has no place here
        m = min(n - i, _STEP)
        block, done, window, size = words[i : i + m + length - 1], 0, None, 1
        while size <= length:
            if length & size:
                part = block[done : done + m]
                window = part if window is None else _two(window, part, _U(base))
                done += size
            block = _two(block[:-size], block[size:], _U(base)) if size * 2 <= length else block
            size *= 2
        out[i : i + m] = mix(window)
    return out if at is None else out[at]


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n places lie within ``length`` places from one of ``starts``."""
    edges = np.zeros(n + length + 1, dtype=np.int32)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + length, -1)
    return np.cumsum(edges[:n]) > 0


def joined(words: Words, keep: np.ndarray) -> pa.Array:
    """Each text's kept words, joined by one space."""
    s, e = words.start[keep], words.end[keep]
    per_text = np.add.reduceat(np.append(keep, False).astype(np.int64), np.minimum(words.first[:-1], len(keep))) * (words.counts > 0) if len(words.counts) else np.zeros(0, np.int64)
    cut = np.zeros(len(words.bytes) + 1, dtype=np.int8)
    cut[s] += 1
    cut[e] -= 1
    source = words.bytes[np.cumsum(cut[:-1], dtype=np.int8).astype(bool)]
    sizes = e - s + 1
    last = np.cumsum(per_text) - 1
    sizes[last[per_text > 0]] -= 1
    ends = np.cumsum(sizes)
    out = np.full(int(ends[-1]) if len(ends) else 0, 32, dtype=np.uint8)
    letters = np.ones(len(out), dtype=bool)
    separators = np.ones(len(s), dtype=bool)
    separators[last[per_text > 0]] = False
    letters[ends[separators] - 1] = False
    out[letters] = source
    offsets = np.zeros(len(per_text) + 1, dtype=np.int64)
    offsets[1:] = np.concatenate([[0], ends])[np.cumsum(per_text)]
    return pa.Array.from_buffers(pa.large_string(), len(per_text), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


_zip, _unzip = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed record; their byte columns stand apart, so equal high bytes shrink."""
    parts = [np.array([len(arrays)], dtype=np.int64).tobytes()]
    for a in arrays:
        a = np.ascontiguousarray(a)
        head = a.dtype.str.encode().ljust(8)
        parts += [head, np.array([len(a)], dtype=np.int64).tobytes(), a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()]
    return _zip.compress(b"".join(parts))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = _unzip.decompress(blob)
    n, at, out = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
    for _ in range(n):
        kind = np.dtype(raw[at : at + 8].decode().strip())
        size = int(np.frombuffer(raw, np.int64, 1, at + 8)[0])
        body = np.frombuffer(raw, np.uint8, size * kind.itemsize, at + 16).reshape(kind.itemsize, size)
        out.append(np.ascontiguousarray(body.T).view(kind).reshape(size))
        at += 16 + size * kind.itemsize
    return out


def gaps(ordered: np.ndarray) -> np.ndarray:
    """Ascending numbers as differences; ``np.cumsum`` undoes it."""
    return np.diff(ordered, prepend=ordered.dtype.type(0))


def gathered(flat: np.ndarray, heads: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Slices ``flat[heads[i]:heads[i] + sizes[i]]``, end to end."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(heads - (ends - sizes), sizes)]


class SpanCache:
    """Encodes byte spans by their distinct contents and remembers them from batch to batch.

    ``encode`` takes distinct spans, end to end, and their sizes, and returns their ids, end to end, and the number of
    ids of each.  The memory is bounded: with ``most`` entries or ``most_bytes`` of spans it starts anew.  Hashes
    only find equal spans: bytes are compared.
    """

    _SLOTS, _PROBES = 1 << 21, 4

    def __init__(self, encode, most: int = 600_000, most_bytes: int = 32 << 20):
        self.encode, self.most, self.most_bytes = encode, most, most_bytes
        self._clear()

    def _clear(self) -> None:
        self.table = np.full(self._SLOTS, -1, dtype=np.int32)
        self.hash, self.bytes, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, np.uint32)
        self.view = eights(self.bytes)
        self.start, self.size, self.head, self.count = (np.zeros(0, np.int64) for _ in range(4))

    def _slot(self, hashes: np.ndarray, probe: int) -> np.ndarray:
        return ((hashes >> _U(43)).astype(np.intp) + probe) & (self._SLOTS - 1)

    def _find(self, hashes: np.ndarray, view: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The entry of each span, or -1."""
        found, left = np.full(len(hashes), -1, dtype=np.int64), np.arange(len(hashes))
        for probe in range(self._PROBES if len(self.hash) else 0):
            entry = self.table[self._slot(hashes[left], probe)]
            left, entry = left[entry >= 0], entry[entry >= 0]
            same = (self.hash[entry] == hashes[left]) & (self.size[entry] == size[left])
            at, entry = left[same], entry[same]
            ok = equal_spans(view, start[at], self.view, self.start[entry], size[at])
            found[at[ok]] = entry[ok]
            left = left[~same]
            if not len(left):
                break
        return found

    def _add(self, hashes: np.ndarray, raw: np.ndarray, size: np.ndarray, flat: np.ndarray, count: np.ndarray) -> None:
        base, ends = len(self.hash), np.cumsum(size)
        self.start = np.concatenate([self.start, len(self.bytes) + ends - size])
        self.head = np.concatenate([self.head, len(self.flat) + np.cumsum(count) - count])
        self.hash, self.bytes, self.flat = np.concatenate([self.hash, hashes]), np.concatenate([self.bytes, raw]), np.concatenate([self.flat, flat.astype(np.uint32)])
        self.size, self.count = np.concatenate([self.size, size]), np.concatenate([self.count, count])
        self.view = eights(self.bytes)
        left = base + np.arange(len(hashes))
        for probe in range(self._PROBES):  # a span that finds no free slot isn't remembered
            slot = self._slot(self.hash[left], probe)
            free = self.table[slot] < 0
            self.table[slot[free]] = left[free]
            left = left[self.table[slot] != left]

    def ids(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all spans, end to end; number of ids of each span)."""
        size, hashes, view = end - start, span_hashes(data, start, end), eights(data)
        entry = self._find(hashes, view, start, size)
        new = np.flatnonzero(entry < 0)
        if len(new):
            _, first, which = np.unique(hashes[new], return_index=True, return_inverse=True)
            one = new[first][which]
            other = np.flatnonzero((size[new] != size[one]) | ~equal_spans(view, start[new], view, start[one], np.minimum(size[new], size[one])))
            if len(other):  # equal hashes of unequal spans: each of these spans stands for itself
                which[other] = len(first) + np.arange(len(other))
                first = np.concatenate([first, other])
            some = new[first]
            entry[new] = len(self.hash) + which
            raw = gathered(data, start[some], size[some])
            self._add(hashes[some], raw, size[some], *self.encode(raw, size[some]))
        count = self.count[entry]
        out = gathered(self.flat, self.head[entry], count)
        if len(self.hash) > self.most or len(self.bytes) > self.most_bytes:
            self._clear()
        return out, count


def blocks_of(column: pa.Array, most: int = 8 << 20):
    """Slices of a text column of at most ``most`` bytes, or of one longer text."""
    sizes = text_buffer(column)[1]
    t, n = 0, len(column)
    while t < n:
        u = max(t + 1, int(np.searchsorted(sizes, sizes[t] + most, side="right")) - 1)
        yield column.slice(t, u - t)
        t = u
