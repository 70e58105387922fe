"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded and verified.

A document is the multiset of its five-word shingles; a shingle weighs tf * idf with
idf = 1 + IDF ln(N / df) / ln(N) over all N documents, between 1 and 1 + IDF at every corpus size.  An edit makes
rare shingles out of common ones, so a steep idf would turn the threshold into a much higher one for any edited
copy of a frequent text.  Samples of improved consistent weighted sampling (Ioffe 2010, without the t part as in
Li 2015) agree in two documents with a probability close to their weighted Jaccard similarity; bands of three
samples make candidates, and each candidate pair is verified by its weighted Jaccard similarity.

Plan: document frequencies come from one round of packed hash sets (see ``buckets``): shingles of one document
only answer with a zero bit.  What two documents share lies among shingles of two documents or more, so a
document's vector holds only those, and its total weight.  If they are less than the threshold's share of the
document, it has no partner and gets neither bands nor a vector.  Documents with equal vectors are one node
before any pairing, named by a 128-bit digest.

Links are found in two passes.  First a band bucket links each member to two leaders (least name, least hash),
and verified links go through distributed connected components: most buckets are of one component then.  A
bucket that still holds several is compared across them, for similarity isn't transitive and two members may be
alike though no leader is like both.  That is done in a grid of cells of bounded size (``_cells``): the
bucket's largest component meets the others, and these each other, but never itself.  A cell returns links
between components, no pairs of members, and at most one fewer than it has components.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphemica.llm.buckets import bucket_count, corpus_size, cut_by_bucket, discard, materialize
from graphemica.llm.components import connected_components
from graphemica.llm.textarrays import Words, gaps, mix, pack, release, unpack, window_hashes

SHINGLE, THRESHOLD, IDF = 5, 0.8, 0.25
#: 1 - (1 - 0.8^3)^10 = 0.9992: the chance that a pair at the threshold shares a band.
BANDS, ROWS = 10, 3
#: Members of a block of a band bucket: a cell of the grid compares two blocks.
BLOCK = 128
#: Parts of a group of equal documents when their class is handed out.
SALTS = 16
_SENT = "hb long, dest long, blob binary"
_SENT_ARROW = pa.schema([("hb", pa.int64()), ("dest", pa.int64()), ("blob", pa.binary())])
_ROW = "doc_id long, th long, digest binary, bands array<long>, total double, vector binary"
_ROW_ARROW = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64())), ("total", pa.float64()), ("vector", pa.binary())])
_LINKS = pa.schema([("u", pa.binary()), ("v", pa.binary())])

#: Odd factors, one for each sample; shingles whose samples are drawn at a time, to stay in the cache.
_SALTS = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_DRAWN = 1 << 14


class _Bucket:
    """Shingles of one text bucket: (document, shingle, times) in document order, and the distinct shingles."""

    def __init__(self, table: pa.Table, size: int):
        self.ids, self.text_hashes = table.column("__id"), table.column("__th")
        words = Words(table.column("__text"))
        hashes, place = words.hashes(nocase=True), words.place()
        rolled = window_hashes(hashes, size)
        full = np.flatnonzero(place[: len(rolled)] + size <= np.repeat(words.counts, words.counts)[: len(rolled)])
        doc_of = np.repeat(np.arange(len(words.counts)), words.counts)
        docs, shingles = doc_of[full], rolled[full]
        # fewer words than a shingle: all of them are the shingle
        short = np.flatnonzero((words.counts > 0) & (words.counts < size))
        if len(short):
            own = np.array([window_hashes(hashes[words.first[i] : words.first[i + 1]], int(words.counts[i]))[0] for i in short], dtype=np.uint64)
            docs, shingles = np.concatenate([docs, short]), np.concatenate([shingles, own])
        order = np.lexsort((shingles, docs))
        docs, shingles = docs[order], shingles[order]
        fresh = np.ones(len(docs), dtype=bool)
        fresh[1:] = (docs[1:] != docs[:-1]) | (shingles[1:] != shingles[:-1])
        at = np.flatnonzero(fresh)
        self.docs, self.shingles, self.tf = docs[at], shingles[at], np.diff(at, append=len(docs))
        self.distinct, self.which, self.df = np.unique(self.shingles, return_inverse=True, return_counts=True)


def _send(size: int, buckets: int) -> Callable:
    def send(table: pa.Table) -> pa.Table:
        dest, b = table.column("__dest")[0].as_py(), _Bucket(table, size)
        rows = [(hb, dest, pack(gaps(b.distinct[i:j]), np.minimum(b.df[i:j], 0xFFFFFFFF).astype(np.uint32))) for hb, i, j in cut_by_bucket(b.distinct, buckets)]
        del b
        release()
        return _table(rows)

    return send


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ([], [], []), _SENT_ARROW.types, strict=True)], schema=_SENT_ARROW)


def _count(table: pa.Table) -> pa.Table:
    """Document frequencies over all buckets; a blob's answer marks those of 2 or more and lists them."""
    asked = [unpack(x) for x in table.column("blob").to_pylist()]
    every = np.concatenate([np.cumsum(h) for h, _ in asked])
    _, which = np.unique(every, return_inverse=True)
    df = np.bincount(which, np.concatenate([n for _, n in asked]))[which].astype(np.int64)
    parts = np.split(df, np.cumsum([len(h) for h, _ in asked])[:-1])
    blobs = [pack(np.packbits(p > 1), p[p > 1]) for p in parts]
    return pa.table([table.column("hb"), table.column("dest"), pa.array(blobs, pa.binary())], schema=_SENT_ARROW)


def _uniform(bits: np.ndarray, low: int) -> np.ndarray:
    """21 bits from ``low`` on, as a number within (0, 1)."""
    return (((bits >> np.uint64(low)) & np.uint64(0x1FFFFF)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-21)


def _draws(shingles: np.ndarray, salt: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r ~ Gamma(2, 1), ln c with c ~ Gamma(2, 1), beta ~ U(0, 1) of a shingle and salt, each from bits of its own."""
    one = mix(shingles * salt)
    two = mix(one + np.uint64(0x9E3779B97F4A7C15))
    r = -np.log(_uniform(one, 0) * _uniform(one, 21))
    ln_c = np.log(-np.log(_uniform(two, 0) * _uniform(two, 21)))
    return r, ln_c, _uniform(one, 42)


def icws(shingles: np.ndarray, log_weights: np.ndarray, starts: np.ndarray, samples: int) -> np.ndarray:
    """One 32-bit sample per segment and salt: the shingle whose ln a is least, ties to the smaller hash."""
    out = np.empty((len(starts), samples), dtype=np.uint32)
    low = shingles & np.uint64(0xFFFFFFFF)
    key = np.empty(len(shingles), dtype=np.uint64)
    for k in range(samples):
        for i in range(0, len(shingles), _DRAWN):
            part = slice(i, i + _DRAWN)
            r, ln_c, beta = _draws(shingles[part], _SALTS[k])
            t = np.floor(log_weights[part] / r + beta)
            ln_a = ln_c - r * (t - beta + np.float32(1))
            bits = ln_a.view(np.uint32)
            high = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(0x80000000)).astype(np.uint64)
            key[part] = high << np.uint64(32) | low[part]
        out[:, k] = (np.minimum.reduceat(key, starts) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    keys = np.empty((len(samples), BANDS), dtype=np.int64)
    for b in range(BANDS):
        x = np.full(len(samples), b + 1, dtype=np.uint64)
        for k in range(b * ROWS, (b + 1) * ROWS):
            x = mix(x * np.uint64(0x9E3779B97F4A7C15) + samples[:, k])
        keys[:, b] = x.view(np.int64)
    return keys


def _sign(size: int, buckets: int, corpus: int, threshold: float) -> Callable:
    scale = IDF / math.log(corpus) if corpus > 1 else 0.0

    def sign(answers: pa.Table, table: pa.Table) -> pa.Table:
        if not len(table):
            return _ROW_ARROW.empty_table()
        b = _Bucket(table, size)
        got = dict(zip(answers.column("hb").to_pylist(), answers.column("blob").to_pylist(), strict=True))
        df = np.ones(len(b.distinct), dtype=np.int64)
        for hb, i, j in cut_by_bucket(b.distinct, buckets):
            bits, many = unpack(got[hb])
            part = df[i:j]
            part[np.unpackbits(bits, count=j - i).astype(bool)] = many
        df = df[b.which]
        idf = 1 + scale * np.log(corpus / df)
        weights = (b.tf * idf).astype(np.float32)
        heads = np.flatnonzero(np.diff(b.docs, prepend=-1))
        n = len(b.ids)
        bands, digests, totals, vectors = [None] * n, [None] * n, [0.0] * n, [None] * n
        if len(heads):
            ends = np.append(heads[1:], len(b.docs))
            sums, shared = (np.add.reduceat(w, heads) for w in (weights.astype(np.float64), np.where(df > 1, weights, 0).astype(np.float64)))
            able = shared / sums >= threshold - 1e-6
            if able.any():
                of = np.repeat(able, ends - heads)
                starts = np.concatenate([[0], np.cumsum((ends - heads)[able])[:-1]])
                keys = iter(band_keys(icws(b.shingles[of], np.log(weights[of]), starts, BANDS * ROWS)))
            for row, (i, j) in enumerate(zip(heads, ends, strict=True)):
                d = int(b.docs[i])
                digests[d] = hashlib.blake2b(b.shingles[i:j].tobytes() + b.tf[i:j].tobytes(), digest_size=16).digest()
                totals[d] = float(sums[row])
                if able[row]:
                    many = df[i:j] > 1
                    bands[d], vectors[d] = next(keys), pack(gaps(b.shingles[i:j][many]), weights[i:j][many])
        out = pa.table([b.ids.cast(pa.int64()), b.text_hashes.cast(pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(totals, pa.float64()), pa.array(vectors, pa.binary())], schema=_ROW_ARROW)
        del b, vectors
        release()
        return out

    return sign


def alike(x: tuple, y: tuple) -> float:
    """Weighted Jaccard similarity; (total, hashes, weights) of each text."""
    (ta, hx, wx), (tb, hy, wy) = x, y
    _, i, j = np.intersect1d(hx, hy, assume_unique=True, return_indices=True)
    shared = float(np.minimum(wx[i], wy[j]).astype(np.float64).sum())
    return shared / (ta + tb - shared)


def _read(total: float, vector: bytes) -> tuple:
    jumps, weights = unpack(vector)
    return total, np.cumsum(jumps), weights


def _link_rows(rows: list[tuple[bytes, bytes]]) -> list[pa.Array]:
    return [pa.array(c, pa.binary()) for c in (zip(*rows, strict=True) if rows else ([], []))]


def _similar(threshold: float) -> Callable:
    def similar(batches):
        for batch in batches:
            rows = []
            for u, v, ta, tb, x, y in zip(*(batch.column(c).to_pylist() for c in ("u", "v", "ta", "tb", "va", "vb")), strict=True):
                if alike(_read(ta, x), _read(tb, y)) >= threshold:
                    rows.append((u, v))
            yield pa.record_batch(_link_rows(rows), schema=_LINKS)

    return similar


def _bounds(left: list[tuple], right: list[tuple]) -> np.ndarray:
    """Upper bounds of ``alike`` for every left text with every right one: min(x, y) <= sqrt(x y)."""
    both = np.intersect1d(np.concatenate([v[1] for v in left]), np.concatenate([v[1] for v in right]))
    shared = np.zeros((len(left), len(right)))
    step = 1 << 13

    def dense(side: list[tuple], cols: np.ndarray) -> np.ndarray:
        root = np.zeros((len(side), len(cols)), dtype=np.float32)
        for k, (_, hashes, weights) in enumerate(side):
            # hashes and columns ascend, so a text's part of these columns is a slice
            a, b = np.searchsorted(hashes, cols[0]), np.searchsorted(hashes, cols[-1], side="right")
            at = np.minimum(np.searchsorted(cols, hashes[a:b]), len(cols) - 1)
            hit = cols[at] == hashes[a:b]
            root[k, at[hit]] = np.sqrt(weights[a:b][hit])
        return root

    for c in range(0, len(both), step):
        shared += dense(left, both[c : c + step]) @ dense(right, both[c : c + step]).T
    tx, ty = np.array([v[0] for v in left])[:, None], np.array([v[0] for v in right])[None, :]
    shared = np.minimum(shared, np.minimum(tx, ty))
    return shared / (tx + ty - shared)


def _across(threshold: float) -> Callable:
    """Links between components of one cell: block ``p`` against block ``q`` of a bucket."""

    def across(table: pa.Table) -> pa.Table:
        get = {c: table.column(c).to_pylist() for c in ("p", "block", "component", "total", "vector")}
        texts = [_read(*x) for x in zip(get["total"], get["vector"], strict=True)]
        block, parts = np.array(get["block"]), get["component"]
        left = np.flatnonzero(block == get["p"][0])
        right = np.flatnonzero(block != get["p"][0]) if (block != block[0]).any() else left
        root = {c: c for c in parts}

        def find(c: bytes) -> bytes:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        links = []
        if len(left) and len(right):
            # products of 32-bit floats may fall short by a rounding
            bound = _bounds([texts[k] for k in left], [texts[k] for k in right])
            for i, j in np.argwhere(bound >= threshold - 1e-3).tolist():
                u, v = parts[left[i]], parts[right[j]]
                x, y = find(u), find(v)
                if x != y and alike(texts[left[i]], texts[right[j]]) >= threshold:
                    root[x] = y
                    links.append((u, v))
        del texts
        release()
        return pa.table(_link_rows(links), schema=_LINKS)

    return across


def _vectors(docs: DataFrame, id_col: str, text_col: str, size: int, threshold: float) -> DataFrame:
    spark = docs.sparkSession
    rows, volume = corpus_size(docs, text_col)
    buckets = bucket_count(spark, volume)
    text = F.col(f"`{text_col}`")
    keyed = docs.select(F.col(f"`{id_col}`").cast("long").alias("__id"), text.alias("__text"), F.xxhash64(text).alias("__th"))
    # documents go to buckets by id and text: neither copies nor rows of one id meet in one bucket for that alone
    cut = keyed.withColumn("__dest", F.pmod(F.xxhash64("__id", "__th"), F.lit(buckets)))
    texts = cut.groupBy("__dest")
    df = texts.applyInArrow(_send(size, buckets), _SENT).groupBy("hb").applyInArrow(_count, _SENT)
    return materialize(df.groupBy("dest").cogroup(texts).applyInArrow(_sign(size, buckets, rows, threshold), _ROW), "minhash")


def _members(nodes: DataFrame) -> DataFrame:
    return nodes.select("digest", F.posexplode("bands").alias("band", "key"))


def _candidates(nodes: DataFrame) -> DataFrame:
    """Distinct (u, v): each member of a band bucket with its two leaders."""
    members, hashed = _members(nodes), F.struct(F.xxhash64("digest").alias("h"), "digest")
    heads = members.groupBy("band", "key").agg(F.min("digest").alias("l1"), F.min(hashed)["digest"].alias("l2"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = members.join(heads, ["band", "key"]).select(F.explode(F.array("l1", "l2")).alias("l"), "digest").where("l <> digest")
    return stars.select(F.least("l", "digest").alias("u"), F.greatest("l", "digest").alias("v")).distinct()


def _cells(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(bucket, p, q, block, digest, component): the members of buckets of several components, by cell.

    A bucket's largest component is its main part and the others are the rest.  Blocks of the rest have the
    numbers from 0, blocks of the main part those after them; cells are (p, q) with p <= q and p in the rest.  So
    a main member is in as many cells as the rest has blocks, and an outlier of a hot bucket costs one pass over it.
    Buckets of the same members (in several bands) are compared once.
    """
    members = _members(nodes).join(found.withColumnRenamed("node", "digest"), "digest", "left").withColumn("component", F.coalesce("component", "digest"))
    parts = members.groupBy("band", "key", "component").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("digest").cast("decimal(38,0)")).alias("mark"))
    mixed = parts.groupBy("band", "key").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts"), F.sum("mark").alias("mark")).where("parts > 1 and n > 2")
    one = mixed.groupBy("n", "mark").agg(F.min(F.struct("band", "key", "top")).alias("b"))
    grid = one.select("b.band", "b.key", F.col("b.top.component").alias("main"), F.ceil((F.col("n") - F.col("b.top.n")) / BLOCK).alias("rests"), F.ceil(F.col("b.top.n") / BLOCK).alias("mains"))
    mine, at = F.col("component") == F.col("main"), F.xxhash64("digest")
    block = F.when(mine, F.col("rests") + F.pmod(at, F.col("mains"))).otherwise(F.pmod(at, F.col("rests")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.when(mine, F.col("rests")).otherwise(F.col("rests") + F.col("mains")) - 1))
    placed = members.join(grid, ["band", "key"]).withColumn("block", block).withColumn("other", other)
    return placed.select("band", "key", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "digest", "component")


def minhash_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """Group documents whose weighted Jaccard similarity over TF-IDF shingles reaches ``threshold``.

    Returns a row for each row of ``docs``: doc_id, class_id (the least doc_id of the group, its own if alone), th
    (xxhash64 of the text) and head (whether the row stands for its group: it has the group's least doc_id and,
    under that id, the least th).

    Words are runs of anything but ASCII white space, A-Z as a-z.  Defined cases: documents under
    ``shingle`` words are one shingle; null, empty and white texts have none and stand alone; very long texts are
    taken whole; rows of one doc_id are grouped by their texts alone, so unlike texts under one id are
    different groups, though both may be named by it; repeated rows join their twin's group, and each of them is
    a head if one is; rows with a null id keep a null class_id, are heads, and no other row joins them; ties
    between samples go to the smaller hash; an empty table gives no rows.  Other columns are ignored, whatever
    their names.
    """
    signed = _vectors(docs, id_col, text_col, shingle, threshold)
    known = signed.where("doc_id is not null and digest is not null")
    head = F.min(F.struct("doc_id", "th"))
    counted = known.groupBy("digest").agg(head.alias("head"), F.count(F.lit(1)).alias("n"))
    # equal texts are one node; the row with the least id has its vector
    nodes = materialize(known.where("bands is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands")), "nodes")
    pairs = materialize(_candidates(nodes), "pairs")
    # vectors are met by document and digest, which deals copies out evenly
    needed = pairs.select(F.explode(F.array("u", "v")).alias("digest")).distinct().join(nodes.select("digest", "doc_id"), "digest")
    vectors = known.join(needed, ["doc_id", "digest"], "left_semi").groupBy("digest").agg(F.min(F.struct("total", "vector")).alias("w"))
    vectors = materialize(vectors.select("digest", "w.total", "w.vector"), "vectors")
    left = vectors.select(F.col("digest").alias("u"), F.col("total").alias("ta"), F.col("vector").alias("va"))
    right = vectors.select(F.col("digest").alias("v"), F.col("total").alias("tb"), F.col("vector").alias("vb"))
    links = pairs.join(left, "u").join(right, "v").select("u", "v", "ta", "tb", "va", "vb").mapInArrow(_similar(threshold), "u binary, v binary")
    found = materialize(connected_components(links), "found")
    cells = _cells(nodes, found).join(vectors, "digest").groupBy("band", "key", "p", "q")
    across = materialize(cells.applyInArrow(_across(threshold), "u binary, v binary"), "across")
    if not across.isEmpty():
        first, found = found, materialize(connected_components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(across)), "found")
        discard(first)
    discard(nodes, pairs, vectors, across)  # what is left to do reads signatures and components
    # documents of a group of several meet its head by digest and a salt; the others need no join
    # (grouped by a struct, so that the join by component has plain shuffles on both sides and a hot one can be split)
    heads = found.join(counted, found.node == counted.digest).groupBy(F.struct("component").alias("k")).agg(F.min("head").alias("top")).select("k.component", "top")
    grouped = counted.join(found.join(heads, "component").select(F.col("node").alias("digest"), "top"), "digest", "left").where("n > 1 or top is not null")
    grouped = grouped.select("digest", F.coalesce("top", "head").alias("top"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    own = signed.select("doc_id", "digest", "th", F.pmod(F.xxhash64("doc_id", "th"), F.lit(SALTS)).cast("int").alias("salt"))
    out = own.join(grouped, ["digest", "salt"], "left")
    alone = F.col("doc_id").isNull() | F.col("top").isNull()
    first = (F.col("doc_id") == F.col("top.doc_id")) & (F.col("th") == F.col("top.th"))
    return out.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("top.doc_id", "doc_id")).alias("class_id"), "th", F.when(alone, F.lit(True)).otherwise(first).alias("head"))


def keep_first(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each group of ``classes``: its head, and of repeated heads the least by all columns.

    Rows with a null id stay, and so does one row of each null, empty or white text under an id.  Column names with
    dots and any extra columns are kept; columns of types without an order (maps) don't take part in the choice.
    """
    key, th = "__id_of_row", "__th_of_row"
    heads = classes.where("head and doc_id is not null").select(F.col("doc_id").alias(key), F.col("th").alias(th)).distinct()
    columns = [F.col(f"`{c}`") for c in docs.columns]
    marked = docs.select(F.struct(*(c.alias(f"c{i}") for i, c in enumerate(columns))).alias("row"), F.col(f"`{id_col}`").cast("long").alias(key), F.xxhash64(f"`{text_col}`").alias(th))
    ordered = [F.col(f"row.c{i}") for i, f in enumerate(docs.schema) if "map<" not in f.dataType.simpleString()]
    least = F.min("row") if len(ordered) == len(columns) else F.min_by("row", F.struct(*ordered))
    kept = marked.join(heads, [key, th], "left_semi").groupBy(key, th).agg(least.alias("row"))
    nameless = marked.where(F.col(key).isNull())
    return kept.select("row").unionByName(nameless.select("row")).select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)))


def op7_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return minhash_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "class_id")
