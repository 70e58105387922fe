import random

import numpy as np
import pyarrow as pa
import pytest

from graphemica.llm import buckets
from graphemica.llm.substring_dedup import COVER, PERIOD, substring_dedup
from graphemica.llm.textarrays import Words, joined, pack, span_hashes, unpack, window_hashes

SCHEMA = "doc_id long, text string"


def brute(docs, window=20):
    """docs: (id, text) in any order.  (id, words, removed, kept) by looking at every window."""
    order = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0, (d[1] or "")))
    seen, out = set(), []
    for i, text in order:
        words = (text or "").encode().split()
        gone = set()
        for a in range(len(words) - window + 1):
            key = tuple(words[a : a + window])
            if key in seen:
                gone.update(range(a, a + window))
            seen.add(key)
        out.append((i, len(words), len(gone), b" ".join(w for a, w in enumerate(words) if a not in gone).decode()))
    return sorted(out, key=repr)


def run(spark, docs, **kw):
    return sorted((tuple(r) for r in substring_dedup(spark.createDataFrame(docs, SCHEMA), **kw).collect()), key=repr)


def test_cover():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def test_random_overlaps(spark):
    rnd = random.Random(5)
    passages = [[f"w{rnd.randrange(40)}" for _ in range(rnd.randint(15, 60))] for _ in range(6)]
    docs = []
    for i in range(60):
        words = []
        for _ in range(rnd.randint(0, 4)):
            p = rnd.choice(passages)
            a = rnd.randrange(len(p))
            words += p[a : a + rnd.randint(10, 50)] + [f"u{rnd.randrange(10**6)}" for _ in range(rnd.randrange(8))]
        docs.append((i * 3, " \n\t".join(words)))
    assert run(spark, docs) == brute(docs)
    assert sum(r[2] for r in brute(docs)) > 100


def test_edges(spark):
    same = " ".join(f"a{i}" for i in range(25))
    docs = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, same), (6, same), (6, same), (7, same + " x"), (None, same), (9, "x " * 3000 + same), (10, " ".join(f"é{i}\u00a0b" for i in range(30)))]
    assert run(spark, docs) == brute(docs)
    assert run(spark, []) == []


def test_other_columns(spark):
    df = spark.createDataFrame([(1, "a b", "x", 5)], "doc_id long, text string, dest string, n_chars int")
    assert substring_dedup(df, carry=("dest",)).collect()[0].asDict() == {"doc_id": 1, "n_words": 2, "n_removed": 0, "kept_text": "a b", "dest": "x"}
    clash = df.withColumnRenamed("dest", "n_words")
    assert substring_dedup(clash).columns == ["doc_id", "n_words", "n_removed", "kept_text"]
    with pytest.raises(ValueError, match="clash"):
        substring_dedup(clash, carry=("n_words",))


def test_text_arrays():
    column = pa.array(["a bb  c", None, "", " é x ", "y" * 3000 + " a", "a"])
    w = Words(column)
    parts = [bytes(w.bytes[a:b]).decode() for a, b in zip(w.start, w.end)]
    assert parts == ["a", "bb", "c", "é", "x", "y" * 3000, "a", "a"] and w.counts.tolist() == [3, 0, 0, 2, 2, 1]
    h = w.hashes()
    assert h[0] == h[6] == h[7] and len(set(h.tolist())) == 6
    assert joined(w, np.array([1, 0, 1, 1, 1, 0, 1, 0], bool)).to_pylist() == ["a c", "", "", "é x", "a", ""]
    assert joined(w, np.zeros(8, bool)).to_pylist() == [""] * 6
    assert Words(pa.array(["A b", "a B"])).hashes(nocase=True)[0] == Words(pa.array(["a"])).hashes(nocase=True)[0]
    assert len(window_hashes(h, 9)) == 0 and window_hashes(h, 3, np.array([1]))[0] == window_hashes(h, 3)[1]
    a, b = unpack(pack(np.arange(5, dtype=np.uint64), np.array([True, False])))
    assert a.tolist() == [0, 1, 2, 3, 4] and b.tolist() == [True, False]
    # hashes don't depend on where a text stands, over several steps
    big = pa.array(["z q " * 400_000, "hello"])
    w = Words(big)
    assert w.hashes()[-1] == Words(pa.array(["hello"])).hashes()[0]
    assert len(span_hashes(w.bytes, w.start[:0], w.end[:0])) == 0
    # every length has its own hash, and windows of any length are told apart
    parts = ["a" * k for k in range(1, 200)]
    assert len(set(Words(pa.array([" ".join(parts)])).hashes().tolist())) == 199
    for n in (1, 2, 3, 5, 8, 20):
        assert len(set(window_hashes(h, n).tolist())) == len({tuple(h[i : i + n]) for i in range(len(h) - n + 1)})


def thue_morse():
    """Two words of 1,024 characters that polynomials modulo 2^64 don't tell apart."""
    a = "a"
    for _ in range(10):
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_words_that_polynomials_confuse(spark):
    a, b = thue_morse()
    assert len(set(Words(pa.array([f"{a} {b} {a[:512]} {b[:512]}"])).hashes().tolist())) == 4
    rest = " ".join(f"w{i}" for i in range(19))
    docs = [(1, f"{rest} {a}"), (2, f"{rest} {b}"), (3, f"{rest} {a}")]
    assert run(spark, docs) == brute(docs) and brute(docs)[1][2] == 0


def test_hot_ids_are_cut(spark):
    """An id (and no id) with many rows fills several buckets; the order within it is that of the texts' hashes."""
    rnd = random.Random(8)
    word = lambda: f"w{rnd.randrange(30)}"
    shared = [[word() for _ in range(30)] for _ in range(5)]
    docs = [(rnd.choice([7, 7, 7, None, None, 3, 12, 40 + i]), " ".join(rnd.choice(shared)[rnd.randrange(8) :] + [word() for _ in range(rnd.randrange(12))])) for i in range(400)]
    df = spark.createDataFrame(docs, SCHEMA)
    keys = {r.text: r.h for r in df.selectExpr("text", "xxhash64(text) h").collect()}
    seen, want = set(), []
    for i, text in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0, keys[d[1]], d[1])):
        words, gone = text.split(), set()
        for at in range(len(words) - 19):
            key = tuple(words[at : at + 20])
            if key in seen:
                gone.update(range(at, at + 20))
            seen.add(key)
        want.append((i, len(words), len(gone), " ".join(w for at, w in enumerate(words) if at not in gone)))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = run(spark, docs)
        from graphemica.llm import substring_dedup as s

        keyed = df.selectExpr("doc_id __id", "text __text", "xxhash64(text) __tie")
        dest = s._ranges(keyed, len(docs), sum(len(t) for _, t in docs), 16)
        sizes = keyed.groupBy(dest(s.F.coalesce("__id", s.F.lit(s._LAST)), s.F.col("__tie")).alias("d")).count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == sorted(want, key=repr)
    assert len(sizes) >= 12 and max(r["count"] for r in sizes) < 80


def test_buckets(spark):
    assert buckets.bucket_count(spark, 0) == 4
    assert buckets.bucket_count(spark, 10**9) < buckets.bucket_count(spark, 10**12) < buckets.bucket_count(spark, 10**14)
    h = np.sort(np.random.default_rng(1).integers(0, 1 << 64, 1000, dtype=np.uint64))
    cuts = buckets.cut_by_bucket(h, 7)
    assert cuts[0][1] == 0 and cuts[-1][2] == 1000 and all(a[2] == b[1] for a, b in zip(cuts, cuts[1:]))
