"""Substring dedup by difference-cover anchors.

A window is 20 consecutive words of one document.  Every word under a window whose word sequence also starts
earlier (smaller doc_id, or same document and earlier start) goes.

Hashing every window would move one hash per word.  {0, 1, 3, 9} is a difference cover modulo 13: for any two
starts i and j some shift d < 13 puts i + d and j + d both at cover positions (place in the document, modulo
13).  So two equal 20-word windows share an aligned 8-word anchor (12 + 8 = 20), and only 4 of 13 places send
a hash.  Anchors that occur once in the corpus are out; those that occur again extend to the windows that
hold them, and 96 bits of hashes of these windows decide (words have hashes of 64 bits).

Plan: text buckets are ranges of doc_id in order, of about equal bytes, so "starts earlier" means "in a smaller
bucket", and no document id travels with a hash.  An id whose rows fill several buckets is cut by a hash of the
text.  Two rounds of packed hash sets (see ``buckets``): anchors, then windows.  A hash leaves a bucket once
however often it occurs there, so a passage in a third of all documents costs as many entries as there are buckets.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphemica.llm.buckets import bucket_count, corpus_size, cut_by_bucket
from graphemica.llm.textarrays import Words, covered, gaps, joined, pack, release, unpack, window_hashes

WINDOW = 20
#: A perfect difference cover: every difference modulo 13 is one of two of its members.
PERIOD, COVER = 13, (0, 1, 3, 9)
_LAST = (1 << 63) - 1
#: Shares of a bucket by which ids are weighed, and what a row weighs besides its text.
GRAINS, ROW_BYTES = 1024, 64
_SENT = "hb long, dest long, blob binary"
_SENT_ARROW = pa.schema([("hb", pa.int64()), ("dest", pa.int64()), ("blob", pa.binary())])


class _Bucket:
    """The documents of one bucket in order, with their anchors; the same in each round."""

    def __init__(self, table: pa.Table, window: int, buckets: int):
        order = [("__id", "ascending"), ("__tie", "ascending"), ("__text", "ascending")]
        self.table = table.sort_by(order)
        self.window, self.buckets = window, buckets
        self.words = Words(self.table.column("__text"))
        self.hashes = self.words.hashes()
        self.place = self.words.place()
        self.left = np.repeat(self.words.counts, self.words.counts) - self.place
        length = window - PERIOD + 1
        rolled = window_hashes(self.hashes, length)
        here = np.isin(self.place % PERIOD, COVER)[: len(rolled)] & (self.left[: len(rolled)] >= length)
        here &= (self.place + self.left >= window)[: len(rolled)]
        self.at = np.flatnonzero(here)
        self.anchors, self.which, self.times = np.unique(rolled[self.at], return_inverse=True, return_counts=True)

    def windows(self, repeated: np.ndarray) -> None:
        """Windows that hold a repeated anchor at a cover shift: their distinct hashes and first places."""
        at = self.at[repeated[self.which]]
        begins = at - np.minimum(self.place[at], PERIOD - 1)
        edges = np.zeros(len(self.hashes) + 1, dtype=np.int32)
        np.add.at(edges, begins, 1)
        np.add.at(edges, at + 1, -1)
        self.starts = np.flatnonzero((np.cumsum(edges[:-1]) > 0) & (self.left >= self.window))
        high = window_hashes(self.hashes, self.window, self.starts)
        low = window_hashes(self.hashes, self.window, self.starts, base=0xA24BAED4963EE407).astype(np.uint32)
        order = np.lexsort((low, high))  # stable: equal windows stay in document order
        h, w = high[order], low[order]
        fresh = np.ones(len(order), dtype=bool)
        fresh[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
        self.later = order[~fresh]
        self.firsts, self.high, self.low = order[fresh], h[fresh], w[fresh]


def _bits(answers: pa.Table, kind: int, n: int, cuts: list[tuple[int, int, int]]) -> np.ndarray:
    """The answers of all hash buckets, end to end: one bit for each hash that was sent."""
    out = np.zeros(n, dtype=bool)
    got = {(k, hb): blob for k, hb, blob in zip(*(answers.column(c).to_pylist() for c in ("round", "hb", "blob")), strict=True)}
    for hb, a, b in cuts:
        out[a:b] = np.unpackbits(np.frombuffer(got[kind, hb], dtype=np.uint8), count=b - a).astype(bool)
    return out


def _sent(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ([], [], []), _SENT_ARROW.types, strict=True)], schema=_SENT_ARROW)


def _send_anchors(window: int, buckets: int) -> Callable:
    def send(table: pa.Table) -> pa.Table:
        dest, b = table.column("__dest")[0].as_py(), _Bucket(table, window, buckets)
        out = _sent([(hb, dest, pack(gaps(b.anchors[i:j]), b.times[i:j] > 1)) for hb, i, j in cut_by_bucket(b.anchors, buckets)])
        del b
        release()
        return out

    return send


def _repeated(table: pa.Table) -> pa.Table:
    """Which anchors occur twice in one bucket or in two buckets."""
    asked = [unpack(x) for x in table.column("blob").to_pylist()]
    every, again = np.concatenate([np.cumsum(a) for a, _ in asked]), np.concatenate([t for _, t in asked])
    _, which, times = np.unique(every, return_inverse=True, return_counts=True)
    yes = (np.bincount(which, again) + times)[which] > 1
    return _answer(table, [len(a) for a, _ in asked], yes)


def _earlier(table: pa.Table) -> pa.Table:
    """Which windows also occur in a bucket of smaller documents."""
    table = table.sort_by("dest")
    asked = [unpack(x) for x in table.column("blob").to_pylist()]
    high, low = np.concatenate([np.cumsum(h) for h, _ in asked]), np.concatenate([w for _, w in asked])
    order = np.lexsort((low, high))
    same = np.zeros(len(order), dtype=bool)
    same[1:] = (high[order][1:] == high[order][:-1]) & (low[order][1:] == low[order][:-1])
    yes = np.zeros(len(order), dtype=bool)
    yes[order] = same
    return _answer(table, [len(h) for h, _ in asked], yes)


def _answer(table: pa.Table, sizes: list[int], yes: np.ndarray) -> pa.Table:
    parts = np.split(yes, np.cumsum(sizes)[:-1])
    return pa.table([table.column("hb"), table.column("dest"), pa.array([np.packbits(p).tobytes() for p in parts], pa.binary())], schema=_SENT_ARROW)


def _send_windows(window: int, buckets: int) -> Callable:
    def send(answers: pa.Table, table: pa.Table) -> pa.Table:
        if not len(table):
            return _sent([])
        dest, b = table.column("__dest")[0].as_py(), _Bucket(table, window, buckets)
        b.windows(_bits(answers, 1, len(b.anchors), cut_by_bucket(b.anchors, buckets)))
        out = _sent([(hb, dest, pack(gaps(b.high[i:j]), b.low[i:j])) for hb, i, j in cut_by_bucket(b.high, buckets)])
        del b
        release()
        return out

    return send


def _cut(window: int, buckets: int, schema: pa.Schema, carry: list[str]) -> Callable:
    def cut(answers: pa.Table, table: pa.Table) -> pa.Table:
        if not len(table):
            return schema.empty_table()
        b = _Bucket(table, window, buckets)
        b.windows(_bits(answers, 1, len(b.anchors), cut_by_bucket(b.anchors, buckets)))
        earlier = _bits(answers, 2, len(b.high), cut_by_bucket(b.high, buckets))
        bad = b.starts[np.concatenate([b.later, b.firsts[earlier]])]
        gone = covered(bad, window, len(b.words))
        removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[b.words.first])
        new = {"n_words": pa.array(b.words.counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_text": joined(b.words, ~gone).cast(pa.string())}
        out = pa.table([new[f.name] if f.name in new else b.table.column("__id" if f.name == "doc_id" else f"__c{carry.index(f.name)}").cast(f.type) for f in schema], schema=schema)
        del b, new
        release()
        return out

    return cut


def _ranges(keyed: DataFrame, rows: int, size: int, buckets: int) -> Callable:
    """A function of (id, tie) to buckets: ranges of ids that hold about equal bytes.

    Quantiles are taken over ids that stand as often as they have shares of bytes (GRAINS a bucket, the rest of a share
    by chance, from a hash), so long documents count as what they are.  An id that several quantiles name fills the
    buckets between them: its rows are dealt to these by ranges of ``__tie``.  One number per bucket comes to the
    driver.  (Quantiles are doubles, so ids beyond 2^53 are not cut, but those without an id are.)
    """
    if not rows or buckets < 2:
        edges = np.zeros(0)
    else:
        share = (size + ROW_BYTES * rows) / (buckets * GRAINS)
        chance = F.pmod(F.xxhash64("__id", "__tie", F.lit("share")), F.lit(1 << 20)) / float(1 << 20)
        times = F.floor((F.coalesce(F.octet_length("__text"), F.lit(0)) + ROW_BYTES) / F.lit(share) + chance).cast("int")
        weighed = keyed.select(F.explode(F.array_repeat(F.coalesce("__id", F.lit(_LAST)), times)).alias("i"))
        edges = np.array(weighed.approxQuantile("i", [i / buckets for i in range(1, buckets)], 0.2 / buckets))
    values, times = np.unique(edges, return_counts=True)
    exact = (np.abs(values) < 2.0**53) | (values >= float(_LAST))
    parts = np.where(exact, times, 1)
    heads = np.concatenate([[0], np.cumsum(parts)])  # the bucket of the rows up to each value; the last one's are beyond all

    @F.pandas_udf(T.LongType())
    def bucket_of(ids: pd.Series, ties: pd.Series) -> pd.Series:
        i = ids.to_numpy()
        at = np.searchsorted(values, i.astype(np.float64), side="left")
        out = heads[at]
        for k in np.unique(at[at < len(values)]).tolist():
            if parts[k] > 1:
                mine = (at == k) & (i.astype(np.float64) == values[k]) & ((np.abs(i) < 1 << 53) | (i == _LAST))
                tie = (ties.to_numpy()[mine].view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)  # in the order of the signed number
                out[mine] += ((tie * np.uint64(parts[k])) >> np.uint64(32)).astype(np.int64)
        return pd.Series(out)

    return bucket_of


def substring_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, carry: tuple[str, ...] = ()) -> DataFrame:
    """Remove every word under a window of ``window`` words that starts earlier in the corpus.

    Returns a row for each row of ``docs``: doc_id, n_words, n_removed, kept_text (kept words joined by one
    space), then the columns named in ``carry``.

    Words are runs of anything but space and U+0009 to U+000D, unchanged.  Defined cases: a null text has no
    words (0, 0, empty); texts under ``window`` words keep all; very long texts are cut like any other; rows
    with a null id come after all others; rows that share an id stand in the order of a hash of their texts, and
    a repeated row loses what its twin keeps; an empty table gives no rows.  Other columns of ``docs`` are
    ignored, whatever their names; a carried column named like a result column is an error.
    """
    if window < PERIOD + 1:
        raise ValueError(f"window must be over {PERIOD} words")
    if clash := {"doc_id", "n_words", "n_removed", "kept_text"} & set(carry):
        raise ValueError(f"carried columns clash with result columns: {sorted(clash)}")
    spark = docs.sparkSession
    rows, size = corpus_size(docs, text_col)
    buckets = bucket_count(spark, size)
    keyed = docs.select(F.col(f"`{id_col}`").cast("long").alias("__id"), F.col(f"`{text_col}`").alias("__text"), *(F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(carry)))
    keyed = keyed.withColumn("__tie", F.xxhash64("__text"))
    bucket_of = _ranges(keyed, rows, size, buckets)
    cut = keyed.withColumn("__dest", bucket_of(F.coalesce("__id", F.lit(_LAST)), F.col("__tie")))
    texts = cut.groupBy("__dest")
    # round 1: which anchors occur again
    asked = texts.applyInArrow(_send_anchors(window, buckets), _SENT)
    anchors = asked.groupBy("hb").applyInArrow(_repeated, _SENT).withColumn("round", F.lit(1))
    # round 2: which of their windows start in an earlier bucket
    asked = anchors.groupBy("dest").cogroup(texts).applyInArrow(_send_windows(window, buckets), _SENT)
    windows = asked.groupBy("hb").applyInArrow(_earlier, _SENT).withColumn("round", F.lit(2))
    out = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()), *(docs.select(f"`{c}`").schema[0] for c in carry)])
    from pyspark.sql.pandas.types import to_arrow_schema

    answers = anchors.unionByName(windows).groupBy("dest")
    return answers.cogroup(texts).applyInArrow(_cut(window, buckets, to_arrow_schema(out), list(carry)), out)


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = substring_dedup(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(words[i:i + 19], ' ') AS key
  FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 19)) AS i FROM w)
), late AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY key ORDER BY doc_id, i) AS rn FROM win) WHERE rn > 1
), gone AS (
  SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(generate_series(i, i + 19)) AS p FROM late) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN ps IS NULL THEN words
              ELSE list_transform(list_filter(list_zip(words, range(1, len(words) + 1)), lambda z: NOT list_contains(ps, z[2])), lambda z: z[1]) END, ' ')) AS kept_sha256
FROM w LEFT JOIN gone ON w.doc_id = gone.doc_id
"""
