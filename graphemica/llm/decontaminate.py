"""Benchmark decontamination by pigeonhole edit matching.

A test item of m bytes may occur in a document with up to k = RATE * m edits.  Cut it into k + 1 pieces: k
edits leave at least one piece untouched, so every occurrence holds an exact piece.  Documents are scanned
once for the pieces' first bytes (a hash of every window, against a bit table), hits are compared with the
whole piece, and Myers' bit-parallel algorithm measures the edit distance around each hit.  Items under LEAST
bytes would be like chance texts with any edit: they must occur exactly, between word borders.

Plan: the scan is a narrow map without a shuffle.  The distinct texts of the benchmark are cut into chunks of about
CHUNK_BYTES; a chunk's pieces travel with the tasks of one scan, whose hits are written to the shared folder
before the next chunk is read, so neither the driver nor a task holds more than one.  Hits meet the items by text
in an ordinary join.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphemica.llm.buckets import materialize
from graphemica.llm.textarrays import blocks_of, mix, release, text_buffer

#: Edits per byte of an item; items under LEAST bytes must occur exactly; bytes of items in a scan.
RATE, LEAST, CHUNK_BYTES = 0.08, 20, 8 << 20
_STEP = 2 << 20
_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER[_SPACE] = 32
#: Bytes that belong to a word: ASCII letters and digits, and all beyond ASCII.
_INNER = np.zeros(256, dtype=bool)
_INNER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_HITS = "doc_id long, item binary, item_bytes int, distance int, start long, end long"
_HITS_ARROW = pa.schema([("doc_id", pa.int64()), ("item", pa.binary()), ("item_bytes", pa.int32()), ("distance", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])


def _normal(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A-Z as a-z, a run of white space as one space: the bytes that stay and where they were."""
    space = _SPACE[data]
    keep = np.ones(len(data), dtype=bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[cuts[cuts < len(data)]] = True
    at = np.flatnonzero(keep)
    return _LOWER[data[at]], at


def normal_text(text: str | None) -> bytes:
    data = np.frombuffer((text or "").encode(), dtype=np.uint8)
    return _normal(data, np.zeros(1, dtype=np.int64))[0].tobytes().strip(b" ")


def myers(pattern: bytes, text: bytes) -> tuple[int, int]:
    """(least edit distance between the pattern and a part of the text, end of the first such part)."""
    m = len(pattern)
    full, last = (1 << m) - 1, 1 << (m - 1)
    eq: dict[int, int] = {}
    for i, c in enumerate(pattern):
        eq[c] = eq.get(c, 0) | 1 << i
    plus, minus, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text, 1):
        e = eq.get(c, 0)
        d0 = (((e & plus) + plus) ^ plus) | e | minus
        hp = minus | (full & ~(d0 | plus))
        hm = plus & d0
        if hp & last:
            score += 1
        elif hm & last:
            score -= 1
        hp <<= 1
        plus = ((hm << 1) & full) | (full & ~(d0 | hp))
        minus = hp & d0 & full
        if score < best:
            best, end = score, j
    return best, end


class Pieces:
    """The pieces of all items, and the table that finds their first bytes."""

    def __init__(self, items: list[tuple[bytes, bytes]], rate: float):
        """items: (name, normalised text); with a rate of 0, occurrences must stand between word borders."""
        self.items, self.exact = items, rate == 0
        self.budget = [int(rate * len(t)) for _, t in items]
        cut = []
        for n, (_, t) in enumerate(items):
            edges = [len(t) * i // (self.budget[n] + 1) for i in range(self.budget[n] + 2)]
            cut += [(n, a, t[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
        self.cut = cut
        self.q = min([16, *(len(p) for _, _, p in cut)])
        keys = np.array([self.windows(np.frombuffer(p[: self.q], dtype=np.uint8))[0] for _, _, p in cut], dtype=np.uint64)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.bits = max(16, (len(cut) * 64).bit_length())
        self.table = np.zeros(1 << self.bits, dtype=bool)
        self.table[keys >> _U(64 - self.bits)] = True

    def windows(self, data: np.ndarray) -> np.ndarray:
        """A hash of every q bytes."""
        n = len(data) - self.q + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        x = data.astype(np.uint64)
        have = 1
        while have * 2 <= min(self.q, 8):  # x[i] holds `have` bytes from i on
            x = x[:-have] | (x[have:] << _U(8 * have))
            have *= 2
        out = x[:n] * _U(0x9E3779B97F4A7C15)
        if have < self.q:
            rest = range(have, self.q - have, have)
            for j in [*rest, self.q - have]:
                out ^= out >> _U(29)
                out += x[j : j + n]
                out *= _U(0xBF58476D1CE4E5B9)
        return mix(out)

    def find(self, data: np.ndarray) -> Iterator[tuple[int, int]]:
        """(piece, place) of every exact piece."""
        h = self.windows(data)
        at = np.flatnonzero(self.table[(h >> _U(64 - self.bits)).astype(np.intp)])
        h = h[at]
        a, b = np.searchsorted(self.keys, h, side="left"), np.searchsorted(self.keys, h, side="right")
        raw = data.tobytes() if (a < b).any() else b""
        for i in np.flatnonzero(a < b):
            place = int(at[i])
            for k in self.order[a[i] : b[i]]:
                if raw.startswith(self.cut[k][2], place):
                    yield int(k), place


def _occurrences(found: set[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(distance, start, end) of occurrences that don't overlap: nearest first, then first."""
    taken: list[tuple[int, int, int]] = []
    starts: list[int] = []
    for d, a, b in sorted(found):
        i = bisect.bisect_left(starts, a)
        if (i == 0 or taken[i - 1][2] <= a) and (i == len(starts) or b <= starts[i]):
            starts.insert(i, a)
            taken.insert(i, (d, a, b))
    return taken


def scan(column: pa.Array, pieces: Pieces) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item, distance, start byte, end byte) of the occurrences of each item in each text."""
    data, offsets = text_buffer(column)
    measured: dict[tuple[int, bytes], tuple[int, int, int]] = {}
    t = 0
    while t < len(offsets) - 1:
        u = max(t + 1, int(np.searchsorted(offsets, offsets[t] + _STEP, side="right")) - 1)
        base = int(offsets[t])
        bounds = offsets[t : u + 1] - base
        text, was = _normal(data[base : int(offsets[u])], bounds)
        edges = np.searchsorted(was, bounds)
        found: dict[tuple[int, int], set[tuple[int, int, int]]] = {}
        tried: set[tuple[int, int, int]] = set()
        raw = None
        for k, place in pieces.find(text):
            n, offset, piece = pieces.cut[k]
            item, budget = pieces.items[n][1], pieces.budget[n]
            row = int(np.searchsorted(edges, place, side="right")) - 1
            lo, hi = int(edges[row]), int(edges[row + 1])
            if place + len(piece) > hi:
                continue
            if pieces.exact:
                end = place + len(item)
                if not (place > lo and _INNER[text[place - 1]] and _INNER[item[0]]) and not (end < hi and _INNER[text[end]] and _INNER[item[-1]]):
                    found.setdefault((row, n), set()).add((0, place, end))
                continue
            a, b = max(lo, place - offset - budget), min(hi, place - offset + len(item) + budget)
            if (row, n, place - offset) in tried:
                continue
            tried.add((row, n, place - offset))
            raw = text.tobytes() if raw is None else raw
            part = raw[a:b]
            if (n, part) not in measured:
                if len(measured) > 50_000:
                    measured.clear()
                distance, end = myers(item, part)
                back = myers(item[::-1], part[:end][::-1])[1] if distance <= budget else 0
                measured[n, part] = (distance, end - back, end)
            distance, start, end = measured[n, part]
            if distance <= budget:
                found.setdefault((row, n), set()).add((distance, a + start, a + end))
        for (row, n), some in sorted(found.items()):
            for distance, a, b in _occurrences(some):
                yield t + row, n, distance, base + int(was[a]), base + int(was[b - 1]) + 1
        t = u


def _points(data: np.ndarray) -> int:
    """Code points in UTF-8 bytes."""
    return int(((data & 0xC0) != 0x80).sum())


def _scanner(items: list[tuple[bytes, bytes]], rate: float, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = [Pieces(some, r) for some, r in (([x for x in items if len(x[1]) >= least], rate), ([x for x in items if len(x[1]) < least], 0.0)) if some]
        for batch in batches:
            at = 0
            for column in blocks_of(batch.column(1)):
                ids = batch.column(0).slice(at, len(column))
                at += len(column)
                rows = [(r, pieces.items[n], d, s, e) for pieces in sets for r, n, d, s, e in scan(column, pieces)]
                if not rows:
                    continue
                data, offsets = text_buffer(column)
                spans = [(_points(data[offsets[r] : s]), _points(data[s:e])) for r, _, _, s, e in rows]
                yield pa.RecordBatch.from_arrays([
                    pa.array([ids[r].as_py() for r, *_ in rows], pa.int64()), pa.array([x[0] for _, x, *_ in rows], pa.binary()), pa.array([len(x[1]) for _, x, *_ in rows], pa.int32()),
                    pa.array([d for _, _, d, _, _ in rows], pa.int32()), pa.array([s for s, _ in spans], pa.int64()), pa.array([s + n for s, n in spans], pa.int64()),
                ], schema=_HITS_ARROW)
            release()

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rate: float = RATE, least: int = LEAST) -> DataFrame:
    """Occurrences of benchmark items in documents with up to ``rate`` edits per byte of the item.

    Returns doc_id, item_id, distance, start, end (code points of the document's text) and item_bytes (of the
    item as compared): every occurrence in every row of ``docs``; of occurrences of one item that overlap, the one
    of least distance, then the first.  Texts are compared with A-Z as a-z and runs of white space as one space.
    Defined cases: null, empty and white texts and items match nothing; items under ``least`` bytes must occur
    exactly and between word borders, and what they prove is left to the caller; very long texts are scanned whole;
    equal items, under one id or several, each have their rows, as repeated documents have; null ids of either
    table are reported as null; empty tables give no rows.  Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    name = F.unhex(F.sha2("text", 256))
    items = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("item_id"), F.col(f"`{item_text}`").cast("string").alias("text")).where("text is not null")
    items = items.withColumn("item", name)
    distinct = items.select("item", "text").distinct()
    size = distinct.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    chunks = -(-size // CHUNK_BYTES)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    out = spark.createDataFrame([], _HITS)
    for c in range(chunks):
        part = distinct.where(F.pmod(F.xxhash64("item"), F.lit(chunks)) == c).collect()
        known = [x for x in sorted((bytes(r[0]), normal_text(r[1])) for r in part) if x[1]]
        if known:
            hits = texts.mapInArrow(_scanner(known, rate, least), _HITS)
            out = out.unionByName(materialize(hits, "hits") if chunks > 1 else hits)
    return out.join(items.select("item", "item_id"), "item").select("doc_id", "item_id", "distance", "start", "end", "item_bytes")


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
