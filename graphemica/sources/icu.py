"""Resource bundles of the ICU library among Spark's jars, read as files: no JVM is asked."""

from __future__ import annotations

import functools
import struct
import zipfile
from collections.abc import Iterator

from graphemica.kernels.dictionary import icu_jar

_FOLDER = "com/ibm/icu/impl/data/icudata/brkitr/"


class _Bundle:
    """ICU's binary form of resources: tables and arrays of strings, which lie in a pool of 16-bit units."""

    def __init__(self, data: bytes):
        self.body = data[struct.unpack(">H", data[:2])[0] :]
        self.ints = struct.unpack(f">{len(self.body) // 4}I", self.body[: len(self.body) // 4 * 4])
        self.units = struct.unpack(f">{len(self.body) // 2}H", self.body[: len(self.body) // 2 * 2])
        self.pool = 2 * self.ints[2]

    def _key(self, at: int) -> str:
        return self.body[at : self.body.index(0, at)].decode() if at < 4 * self.ints[2] else ""

    def _string(self, at: int) -> str:
        u, at = self.units, at + self.pool
        first = u[at]
        if not 0xDC00 <= first <= 0xDFFF:  # ends with a zero
            size = next(k for k in range(len(u) - at) if u[at + k] == 0)
        elif first < 0xDFEF:
            size, at = first & 0x3FF, at + 1
        elif first < 0xDFFF:
            size, at = (first - 0xDFEF) << 16 | u[at + 1], at + 2
        else:
            size, at = u[at + 1] << 16 | u[at + 2], at + 3
        return struct.pack(f">{size}H", *u[at : at + size]).decode("utf-16-be")

    def arrays(self, resource: int | None = None, path: str = "") -> Iterator[tuple[str, list[str]]]:
        """(path, strings) of every array."""
        resource = self.ints[0] if resource is None else resource
        kind, at, u = resource >> 28, resource & 0xFFFFFFF, self.units
        if kind == 2 and at:  # a table: number, keys, padding, resources; at place 0 is the empty one
            n, first = u[2 * at], 2 * at + 1
            body = (first + n + 1) // 2
            for key, item in zip(u[first : first + n], self.ints[body : body + n], strict=True):
                yield from self.arrays(item, f"{path}/{self._key(key)}")
        elif kind == 9:  # an array of strings by 16-bit places
            at += self.pool
            yield path, [self._string(x) for x in u[at + 1 : at + 1 + u[at]]]
        elif kind == 8:
            yield path, [self._string(x & 0xFFFFFFF) for x in self.ints[at + 1 : at + 1 + self.ints[at]]]


@functools.lru_cache(None)
def sentence_exceptions(locale: str) -> tuple[str, ...]:
    """Abbreviations that a locale's own file lists; none without a file or without ICU."""
    jar = icu_jar()
    if jar is None:
        return ()
    with zipfile.ZipFile(jar) as z:
        try:
            data = z.read(f"{_FOLDER}{locale.replace('-', '_')}.res")
        except KeyError:
            return ()
    return next((tuple(x) for path, x in _Bundle(data).arrays() if path == "/exceptions/SentenceBreak"), ())
