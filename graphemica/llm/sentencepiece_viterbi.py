"""SentencePiece encoding and decoding by a batched numpy Viterbi search.

Words of equal length advance together, one character at a time.  Hashes of all substrings probe the sorted
keys of the pieces; from every place, each piece that starts there offers its sum to the place where it ends, and
the largest sum and its piece (the backpointer) stay there.  Words are cut beforehand where no piece holds the two
characters side by side, so text without spaces falls into short parts, and each distinct part is searched once.

Two kinds of model differ in what a step adds:

* unigram: the piece's score;
* BPE: scores are merge ranks, and their sum says nothing (see the README for how far a sum of ranks is from
  the library).  A step adds 0 if the piece is compatible with the one before it, else minus infinity: two pieces
  are compatible if merging their characters by rank gives back these two.  Merging happens within any two
  neighbours just as within the whole word, so exactly one path has the sum 0, and it is what the merges give.
  Compatibility is decided by undoing merges from the last to the first, for arrays of pairs, and remembered.

Bars (spaces) that follow each other merge with each other after everything else: see ``Encoder.bars``.

Plan: a narrow map; the model's tables (a few MB, fixed by the vocabulary) are broadcast.  Each worker
encodes a distinct word once (bounded memory).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphemica.llm.textarrays import SpanCache, blocks_of, gathered, release, text_buffer

BAR = "▁"
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_FAR = np.int64(1) << 40
#: Places (words times characters) that are prepared at a time, and slots for the remembered compatibility of pairs.
_CELLS, _SLOTS = 1 << 15, 1 << 20
#: Words that a worker remembers (also from task to task), and bytes of text that it takes at a time: both bound its memory.
REMEMBERED, TAKEN = 300_000, 3 << 20


def _key(text: str) -> int:
    h = 0
    for c in text:
        h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
    return h


def merge(text: str, score: dict[str, float]) -> list[str]:
    """BPE by its definition: the best-scored neighbouring pair merges, leftmost first, until none is a piece."""
    parts = list(text)
    while len(parts) > 1:
        best = max(((score[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in score), default=None)
        if best is None:
            break
        i = -best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


@dataclass
class Tables:
    """A model as arrays.  Id ``unknown`` also stands for characters without a piece."""

    bpe: bool
    unknown: int
    longest: int
    keys: np.ndarray  # sorted hashes of usable pieces
    ids: np.ndarray  # their ids
    scores: np.ndarray  # by id
    order: np.ndarray  # BPE: 0 for single characters, else 1 + rank of the piece's merge
    left: np.ndarray  # BPE: the two halves of a piece's last merge
    right: np.ndarray
    pairs: np.ndarray  # BPE: sorted left * V + right of every two pieces that make a piece
    merged: np.ndarray  # ... and that piece's order
    ties: bool  # BPE: pieces with equal scores exist: of several bars, and these scores are the least
    inside: np.ndarray  # sorted: first << 32 | second of every two characters side by side in a piece
    names: list[str]
    byte_ids: np.ndarray  # id of each byte, -1 without byte fallback
    surface: list[bytes]  # by id, for decoding
    dummy_prefix: bool
    key: str  # a digest of the file and the kind


def load(model_path: str, unigram: bool | None = None) -> Tables:
    """Read a .model file with the sentencepiece library; ``unigram`` overrides the kind found in it."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    v = sp.vocab_size()
    names = [sp.id_to_piece(i) for i in range(v)]
    scores = np.array([sp.get_score(i) for i in range(v)], dtype=np.float64)
    plain = [i for i in range(v) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
    if any(BAR in names[i].lstrip(BAR) for i in plain):
        raise ValueError("pieces with a space inside or at the end aren't supported")
    byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int64)
    if not all(sp.is_byte(int(i)) for i in byte_ids):
        byte_ids[:] = -1
    surface = [b"" if sp.is_control(i) else bytes([int(n[3:5], 16)]) if sp.is_byte(i) else " ⁇ ".encode() if sp.is_unknown(i) else n.replace(BAR, " ").encode() for i, n in enumerate(names)]
    probe = sp.encode("a", out_type=str)
    order = np.zeros(v, dtype=np.int64)
    left, right = np.full(v, -1), np.full(v, -1)
    bpe = (scores[plain] <= 0).all() and (scores[plain] == np.round(scores[plain])).all() if unigram is None else not unigram
    usable, ties = plain, False
    pairs, merged = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    if bpe:
        score = {names[i]: scores[i] for i in plain}
        of = {names[i]: i for i in plain}
        by_score = sorted((i for i in plain if len(names[i]) > 1), key=lambda i: (-scores[i], i))
        for rank, i in enumerate(by_score, 1):
            order[i] = rank
        usable = []
        for i in plain:
            if len(names[i]) == 1:
                usable.append(i)
                continue
            halves = _last_merge(names[i], score)
            if halves:
                left[i], right[i] = of.get(halves[0], sp.unk_id()), of.get(halves[1], sp.unk_id())
                usable.append(i)
        good = set(usable)
        found = []
        for i in plain:
            n = names[i]
            for c in range(1, len(n)):
                a, b = of.get(n[:c]), of.get(n[c:])
                if a in good and b in good:
                    found.append((a * v + b, order[i]))
        found.sort()
        pairs, merged = np.array([k for k, _ in found], dtype=np.int64), np.array([m for _, m in found], dtype=np.int64)
        values, times = np.unique(scores[by_score], return_counts=True)
        tied = set(values[times > 1].tolist())
        ties = bool(tied)
        if any(scores[i] in tied and names[i].strip(BAR) for i in by_score) or (ties and (len(tied) > 1 or scores[by_score].min() < min(tied))):
            raise ValueError("pieces with equal scores must consist of spaces and have the least score")
        if ties and any(names[i].startswith(BAR * 2) and names[i].strip(BAR) for i in by_score):
            raise ValueError("pieces of several spaces and other characters aren't supported")
    keys = np.array([_key(names[i]) for i in usable], dtype=np.uint64)
    at = np.argsort(keys)
    inside = np.unique(np.array([ord(x) << 32 | ord(y) for i in usable for x, y in zip(names[i], names[i][1:], strict=False)], dtype=np.uint64))
    return Tables(bool(bpe), sp.unk_id(), max(len(names[i]) for i in usable), keys[at], np.array(usable, dtype=np.int64)[at], scores, order, left, right, pairs, merged, ties, inside, names, byte_ids, surface, probe[0].startswith(BAR), hashlib.sha256(open(model_path, "rb").read() + bytes([bool(bpe)])).hexdigest())


def _last_merge(text: str, score: dict[str, float]) -> tuple[str, str] | None:
    """The two halves that merge into ``text`` last, or None if merging stops short of it."""
    parts = list(text)
    while len(parts) > 2:
        best = max(((score[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in score), default=None)
        if best is None:
            return None
        parts[-best[1] : 2 - best[1]] = [parts[-best[1]] + parts[1 - best[1]]]
    return (parts[0], parts[1]) if "".join(parts) in score else None


class Encoder:
    def __init__(self, tables: Tables):
        self.t = tables
        self.v = len(tables.names)
        slot = self._slot(tables.keys)
        self.key_at, self.id_at = np.zeros(_SLOTS, dtype=np.uint64), np.full(_SLOTS, -1, dtype=np.int32)
        self.key_at[slot], self.id_at[slot] = tables.keys, tables.ids  # of keys that share a slot, the last stays
        lost = self.key_at[slot] != tables.keys
        self.crowded = np.zeros(_SLOTS, dtype=bool)
        self.crowded[slot[lost]] = True
        self.beside = np.zeros(_SLOTS, dtype=bool)
        self.beside[self._slot(tables.inside)] = True
        self.score = {tables.names[i]: tables.scores[i] for i in tables.ids}
        self.of = {tables.names[i]: int(i) for i in tables.ids}
        usable = tables.scores[tables.ids]
        self.gain = np.zeros(self.v, dtype=np.float32) if tables.bpe else tables.scores.astype(np.float32)
        if not tables.bpe:
            self.gain[tables.unknown] = (usable.min() if len(usable) else 0.0) - 10.0
        self.seen, self.answer = np.full(_SLOTS, -1, dtype=np.int64), np.zeros(_SLOTS, dtype=bool)
        self.cache = SpanCache(self._each, REMEMBERED)

    @staticmethod
    def _slot(hashes: np.ndarray) -> np.ndarray:
        return ((hashes * _U(0xBF58476D1CE4E5B9)) >> _U(64 - _SLOTS.bit_length() + 1)).astype(np.intp)

    def _piece(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes, or -1."""
        slot = self._slot(hashes)
        out = np.where(self.key_at[slot] == hashes, self.id_at[slot], np.int32(-1))
        more = self.crowded[slot] & (out < 0)
        if more.any():
            h = hashes[more]
            at = np.minimum(np.searchsorted(self.t.keys, h), len(self.t.keys) - 1)
            out[more] = np.where(self.t.keys[at] == h, self.t.ids[at], -1)
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the characters of pieces a and b leaves just these two."""
        t = self.t
        out = np.ones(len(a), dtype=bool)
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), _FAR)
        at = np.arange(len(a))
        while len(at):
            x, y = a[at], b[at]
            key = x * self.v + y
            k = np.minimum(np.searchsorted(t.pairs, key), max(len(t.pairs) - 1, 0))
            early = (t.pairs[k] == key) & (t.merged[k] < limit[at]) if len(t.pairs) else np.zeros(len(at), dtype=bool)
            out[at[early]] = False
            ox, oy = t.order[x], t.order[y]
            undo_left = ox > oy
            go = ~early & (undo_left | (oy > 0))
            left, right = go & undo_left, go & ~undo_left
            limit[at[left]] = ox[left]
            a[at[left]] = t.right[x[left]]
            limit[at[right]] = oy[right] + 1
            b[at[right]] = t.left[y[right]]
            at = at[go]
        return out

    def _compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``compatible`` by memory: a slot holds the last pair that fell into it."""
        key = a.astype(np.int64) * self.v + b
        slot = self._slot(key.view(np.uint64))
        new = np.unique(key[self.seen[slot] != key])
        if not len(new):
            return self.answer[slot]
        ok = self.compatible(new // self.v, new % self.v)
        at = np.minimum(np.searchsorted(new, key), len(new) - 1)
        out = np.where(new[at] == key, ok[at], self.answer[slot])
        where = self._slot(new.view(np.uint64))
        where, first = np.unique(where, return_index=True)  # of pairs that share a slot, one stays
        self.seen[where], self.answer[where] = new[first], ok[first]
        return out

    def _starting(self, codes: np.ndarray, a: int, b: int, longest: int) -> np.ndarray:
        """words x places a to b x lengths: the piece of that many characters from that place, or -1."""
        n, size = codes.shape
        out = np.full((n, b - a, longest), -1, dtype=np.int32)
        grown = np.zeros((n, b - a), dtype=np.uint64)
        for k in range(1, min(longest, size - a) + 1):
            grown = grown[:, : min(b, size - k + 1) - a] * _BASE + codes[:, a + k - 1 : min(b, size - k + 1) + k - 1] + _U(1)
            out[:, : grown.shape[1], k - 1] = self._piece(grown)
        one = out[:, :, 0]
        one[one < 0] = self.t.unknown
        return out

    def _steps(self, starting: np.ndarray, reach: int) -> np.ndarray:
        """For the places from ``reach`` on: words x places x length before x length after, whether both can stand there."""
        n, places, longest = starting.shape
        ending = np.full((n, places - reach, longest), -1, dtype=np.int32)
        for k in range(1, min(longest, places - 1) + 1):
            first = max(reach, k)
            ending[:, first - reach :, k - 1] = starting[:, first - k : places - k, k - 1]
        starting = starting[:, reach:]
        before, after = ending >= 0, starting >= 0
        left, right = np.flatnonzero(before), np.flatnonzero(after)  # ascend by word and place
        lefts, rights = before.sum(axis=2).ravel(), after.sum(axis=2).ravel()
        each = np.repeat(rights, lefts)  # pieces after, for every piece before
        one, two = np.repeat(left, each), gathered(right, np.repeat(np.cumsum(rights) - rights, lefts), each)
        ok = np.zeros(n * (places - reach) * longest * longest, dtype=bool)
        ok[one * longest + two % longest] = self._compatible(ending.ravel()[one], starting.ravel()[two])
        return ok.reshape(n, places - reach, longest, longest)

    def search(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces of equally long words, end to end; number of pieces of each): ``codes`` is words x characters.

        Characters without a piece are given as -1 - character.
        """
        t, (n, size) = self.t, codes.shape
        longest = min(t.longest, size)
        total = np.full((size + longest + 1, n), -np.inf, dtype=np.float32)
        total[0] = 0.0
        last = np.zeros((size + longest + 1, n), dtype=np.int32)  # the piece that ends here with the largest sum ...
        back = np.ones((size + longest + 1, n), dtype=np.int16)  # ... and its length
        rows, block = np.arange(n), max(longest, _CELLS // n)
        lengths = np.arange(1, longest + 1, dtype=np.int16)[:, None]
        for a in range(0, size, block):
            b, from_ = min(a + block, size), max(0, a - longest)
            starting = self._starting(codes, from_, b, longest)
            ok = self._steps(starting, a - from_) if t.bpe else None
            starting = starting[:, a - from_ :]
            for j in range(a, b):
                most = min(longest, size - j)
                pieces = starting[:, j - a, :most].T
                can = pieces >= 0
                if t.bpe and j:
                    can = can & ok[rows, j - a, back[j] - 1, :most].T
                sums = np.where(can, total[j] + self.gain[pieces], np.float32(-np.inf))
                ends = slice(j + 1, j + 1 + most)
                better = sums > total[ends]
                np.copyto(total[ends], sums, where=better)
                np.copyto(last[ends], pieces, where=better)
                np.copyto(back[ends], lengths[:most], where=better)
        found = np.zeros((n, size), dtype=np.int64)  # from the end: place k holds the piece k before the last
        count, end, at = np.zeros(n, dtype=np.int64), np.full(n, size), rows
        while len(at):
            e = end[at]
            ids = last[e, at].astype(np.int64)
            found[at, count[at]] = np.where(ids == t.unknown, -1 - codes[at, e - 1].astype(np.int64), ids)
            count[at] += 1
            end[at] = e - back[e, at]
            at = at[end[at] > 0]
        flat = gathered(found.ravel(), rows * size, count)
        starts = np.cumsum(count) - count
        return flat[np.repeat(2 * starts + count - 1, count) - np.arange(len(flat))], count  # each word's turned round

    def bars(self, n: int) -> list[int]:
        """Pieces of n bars.  Their scores are equal, so the leftmost two that make a piece merge, again and again: all
        that stands left of a new bar has merged as far as it can."""
        sizes: list[int] = []
        for _ in range(n):
            sizes.append(1)
            while len(sizes) > 1 and BAR * (sizes[-2] + sizes[-1]) in self.of:
                sizes[-2:] = [sizes[-2] + sizes[-1]]
        return [self.of.get(BAR * k, self.t.unknown) for k in sizes]

    def _each(self, raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, end to end; number of ids of each); the words are given as UTF-8, end to end."""
        codes = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        codes[codes == 32] = ord(BAR)
        heads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)[np.cumsum(sizes) - 1]]).astype(np.int64)
        spare = np.zeros(len(sizes), dtype=np.int64)
        if self.t.bpe and self.t.ties:  # several bars: the last one goes with what follows, and the others wait for it
            other = np.append(np.flatnonzero(codes != ord(BAR)), len(codes))
            lead = np.minimum(other[np.searchsorted(other, heads[:-1])], heads[1:]) - heads[:-1]
            spare = np.maximum(lead - 1, 0)
            drop = gathered(np.arange(len(codes)), heads[:-1], spare)
            codes = np.delete(codes, drop)
            heads = heads - np.concatenate([[0], np.cumsum(spare)])
        # cut where no piece holds both characters (of few others, whose slots are taken, it isn't known)
        cut = np.ones(len(codes) + 1, dtype=bool)
        if len(codes) > 1:
            cut[1:-1] = ~self.beside[self._slot(codes[:-1] << _U(32) | codes[1:])]
        cut[heads] = True
        edges = np.flatnonzero(cut)
        sizes = np.diff(edges)
        flats, which, of_part, base = [], np.empty(len(sizes), dtype=np.int64), [], 0
        for size in np.unique(sizes).tolist():
            mine = np.flatnonzero(sizes == size)
            if size == 1:  # characters repeat most
                some, back = np.unique(codes[edges[mine]], return_inverse=True)
                some = some[:, None]
            else:
                some, back = codes[edges[mine][:, None] + np.arange(size)], np.arange(len(mine))
            which[mine] = back + base
            base += len(some)
            step = max(1, _CELLS // size)
            for a in range(0, len(some), step):
                flat, count = self.search(some[a : a + step])
                flats.append(flat)
                of_part.append(count)
        flat, count = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (flats, of_part))
        starts = np.cumsum(count) - count
        ids = gathered(flat, starts[which], count[which])
        of_word = np.concatenate([[0], np.cumsum(count[which])])[np.searchsorted(edges, heads)]
        ids, of_word = self._characters(ids, of_word)
        count = np.diff(of_word)
        if not spare.any():
            return ids, count
        parts, done, lone = [], 0, self.of.get(BAR, self.t.unknown)
        for i in np.flatnonzero(spare).tolist():
            a = int(of_word[i])
            alone = int(ids[a] == lone)
            bars = self.bars(int(spare[i]) + alone)
            parts += [ids[done:a], np.array(bars)]
            done = a + alone
            count[i] += len(bars) - alone
        return np.concatenate([*parts, ids[done:]]), count

    def _characters(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece (negative) as their bytes, or as one unknown piece for several side by side."""
        odd = np.flatnonzero(ids < 0)
        if not len(odd):
            return ids, ends
        times = np.ones(len(ids), dtype=np.int64)
        if self.t.byte_ids[0] < 0:
            again = odd[(odd > 0) & (ids[np.maximum(odd - 1, 0)] < 0)]
            times[again[~np.isin(again, ends)]] = 0
            ids = np.where(ids < 0, self.t.unknown, ids)
            grown = ids[times > 0]
        else:
            code = -1 - ids[odd]
            times[odd] = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
            grown = np.repeat(ids, times)
            text = np.frombuffer("".join(map(chr, code.tolist())).encode(), dtype=np.uint8)
            grown[grown < 0] = self.t.byte_ids[text]
        return grown, np.concatenate([[0], np.cumsum(times)])[ends]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, end to end; n + 1 offsets).  Null is empty."""
        column = pc.replace_substring(column.cast(pa.large_string()).fill_null(""), BAR, " ")
        if self.t.dummy_prefix:
            column = pc.if_else(pc.equal(column, ""), column, pc.binary_join_element_wise(pa.scalar("", pa.large_string()), column, pa.scalar(" ", pa.large_string())))
        data, offsets = text_buffer(column)
        cut = np.zeros(len(data) + 1, dtype=bool)
        if len(data):
            space = data == 0x20
            cut[1:-1] = space[1:] & ~space[:-1]
        cut[offsets] = True
        cut[len(data)] = False
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(data)) if len(start) else start
        ids, sizes = self.cache.ids(data, start, end)
        return ids, np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(start, offsets)]


class Decoder:
    def __init__(self, tables: Tables):
        self.flat = np.frombuffer(b"".join(tables.surface), dtype=np.uint8)
        self.sizes = np.array([len(s) for s in tables.surface], dtype=np.int64)
        self.heads = np.cumsum(self.sizes) - self.sizes
        self.prefix = tables.dummy_prefix

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        sizes = self.sizes[ids]
        data = gathered(self.flat, self.heads[ids], sizes).tobytes()
        ends = np.concatenate([[0], np.cumsum(sizes)])[offsets].tolist()
        out = []
        for a, b in zip(ends, ends[1:], strict=False):
            text = data[a:b].decode(errors="replace")
            out.append(text[1:] if self.prefix and text.startswith(" ") else text)
        return out


_known: dict[str, Encoder] = {}


def _encoder(tables: Tables) -> Encoder:
    """One for each worker: what it has encoded in one task serves the next."""
    if tables.key not in _known:
        _known.clear()
        _known[tables.key] = Encoder(tables)
    return _known[tables.key]


def _mapper(tables, names: list[str], text_col: str, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _encoder(tables.value), Decoder(tables.value)
        for batch in batches:
            at = 0
            for texts in blocks_of(batch.column(text_col), TAKEN):
                ids, offsets = encoder.encode(texts)
                values = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32), pa.int32()))
                some = [batch.column(n).slice(at, len(texts)) for n in names]
                decoded = [pa.array(decoder.decode(ids, offsets), pa.string())] if keep_text else []
                yield pa.RecordBatch.from_arrays([*some, values, pa.array(np.diff(offsets), pa.int64()), *decoded], [*names, "ids", "n_tokens", *["decoded"][: len(decoded)]])
                at += len(texts)
            release()

    return run


def encode_pieces(docs: DataFrame, model_path: str, *, text_col: str = "text", decode: bool = False, keep_text: bool = True) -> DataFrame:
    """Add ids (array of int) and n_tokens, and with ``decode`` the text that the ids give back.  Without
    ``keep_text`` the text column stays behind.

    Ids are those of the sentencepiece library for the same model.  Decoding gives the text again, with U+2581
    as a space.  Defined cases: null and empty texts have no ids and decode to empty; characters outside the
    vocabulary become their bytes; very long texts and words are encoded whole, in time proportional to their length;
    of paths with equal sums (unigram models) the one with longer pieces at its end goes; repeated rows get equal
    results; columns of ``docs`` named ids, n_tokens or decoded are replaced; an empty table stays empty.
    """
    spark = docs.sparkSession
    tables = spark.sparkContext.broadcast(load(model_path))
    new = ["ids", "n_tokens", *["decoded"][: int(decode)]]
    names = [c for c in docs.columns if c not in ("ids", "n_tokens", "decoded") and (keep_text or c != text_col)]
    kept = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]  # names of any kind stay out of it
    text = f"c{names.index(text_col)}" if text_col in names else "text"
    source = docs.select(*kept, *([] if text_col in names else [F.col(f"`{text_col}`").alias("text")]))
    out = docs.select(*kept, F.array(F.lit(0)).alias("ids"), F.lit(0).cast("long").alias("n_tokens"), *([F.lit("").alias("decoded")] if decode else []))
    found = source.mapInArrow(_mapper(tables, [f"c{i}" for i in range(len(names))], text, decode), out.schema)
    return found.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), *new)


def decode_pieces(encoded: DataFrame, model_path: str, *, ids_col: str = "ids") -> DataFrame:
    """Add decoded, the text of each row's ids; null ids decode to null.  A column named decoded is replaced."""
    spark = encoded.sparkSession
    tables = spark.sparkContext.broadcast(load(model_path))
    names = [c for c in encoded.columns if c != "decoded"]
    kept = encoded.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)))
    ids_at = names.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(tables.value)
        for batch in batches:
            column = batch.column(ids_at)
            rows = [np.array(x or [], dtype=np.int64) for x in column.to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
            texts = decoder.decode(np.concatenate(rows) if rows else np.zeros(0, np.int64), offsets)
            texts = [t if known else None for t, known in zip(texts, column.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    found = kept.mapInArrow(run, kept.withColumn("decoded", F.lit(None).cast("string")).schema)
    return found.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), "decoded")


def op9_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_xxhash64 (of the whole id array) and round_trip (decoding gives the text again)."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), decode=True)
    same = F.col("decoded") == F.replace(F.coalesce("text", F.lit("")), F.lit(BAR), F.lit(" "))
    return out.select("doc_id", "n_tokens", F.xxhash64("ids").alias("ids_xxhash64"), same.alias("round_trip"))
