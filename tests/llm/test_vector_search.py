import numpy as np
import pytest
from pyspark.sql import functions as F

from graphemica.llm import vector_search as v

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every, best=5):
    good = [(i, np.array(x, dtype=np.float32).astype(float)) for i, x in rows if i is not None and x and all(c is not None and np.isfinite(c) for c in x) and any(x)]
    out = {}
    for q, a in good:
        if q % every == 0:
            s = {(-v.cosines(a[None], b[None, None])[0, 0], i) for i, b in good if i != q and len(b) == len(a)}
            out[q] = [(i, -c) for c, i in sorted(s)[:best]]
    return out


def run(spark, rows, every, **kw):
    df = spark.createDataFrame([(i, x, 1) for i, x in rows], SCHEMA)
    out = {}
    for r in v.nearest(df, F.col("vec_id") % every == 0, **kw).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=32).astype(np.float32).tolist()) for i in range(6000)]
    want, got = brute(rows, 200), run(spark, rows, 200)
    hits = sum(len(set(want[q]) & set(got[q])) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    assert all(len(got[q]) == 5 for q in want)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, [0.0, 0.0, 0.0]), (4, None), (5, [1.0, None, 0.0]), (6, [nan, 1.0, 0.0]), (7, [inf, 0.0, 1.0]), (8, []), (9, [0.0, -1.0, 0.0]), (10, [1.0, 1.0]), (12, [1.0, 2.0]), (9, [0.0, -1.0, 0.0]), (None, [1.0, 0.0, 0.0])]
    want, got = brute(rows, 2), run(spark, rows, 2)
    assert got == {q: x for q, x in want.items() if x}
    assert got[0] == [(1, 1.0), (2, 1.0), (9, 0.0)] and got[10][0][0] == 12 and 3 not in got
    assert run(spark, [], 2) == {} and run(spark, rows[:1], 2) == {}


def test_many_equal_vectors(spark):
    rows = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(500)] + [(500, [-1.0, 0.0, 0.0, 0.0])]
    got = run(spark, rows, 100)
    assert [i for i, _ in got[0]] == [1, 2, 3, 4, 5] and [i for i, _ in got[100]] == [0, 1, 2, 3, 4]
    assert [i for i, _ in got[500]] == [0, 1, 2, 3, 4]


def test_group_of_close_vectors_larger_than_the_shortlist(spark):
    """1,500 vectors with cosines of 0.99 or more share few codes; their order is that of brute force."""
    rng = np.random.default_rng(8)
    centre = rng.normal(size=64)
    close = [centre + 0.05 * rng.normal(size=64) for _ in range(1500)]
    rows = [(i, np.asarray(x, dtype=np.float32).tolist()) for i, x in enumerate(close + [rng.normal(size=64) for _ in range(2500)])]
    x = np.array([r for _, r in rows], dtype=np.float32).astype(float)
    want = {}
    for q in range(0, 4000, 100):
        score = v.cosines(x[q : q + 1], x[None])[0]
        score[q] = -2
        want[q] = np.lexsort((np.arange(4000), -score))[:5].tolist()
    assert {q: [i for i, _ in found] for q, found in run(spark, rows, 100).items()} == want


@pytest.mark.parametrize(("members", "noise"), [(500, 0.01), (1000, 0.01), (500, 0.001), (1000, 0.001)])
def test_tight_clusters(spark, members, noise):
    """All rows lie in clusters of near-equal vectors; the nearest found are those of brute force."""
    rng = np.random.default_rng(members)
    centres = rng.normal(size=(4000 // members, 64))
    x = (np.repeat(centres, members, axis=0) + noise * rng.normal(size=(4000, 64))).astype(np.float32)
    got = run(spark, [(i, r.tolist()) for i, r in enumerate(x)], 100)
    x = x.astype(float)
    hits = 0
    for q in range(0, 4000, 100):
        score = v.cosines(x[q : q + 1], x[None])[0]
        score[q] = -2
        hits += len(set(np.lexsort((np.arange(4000), -score))[:5].tolist()) & {i for i, _ in got[q]})
    assert hits >= 0.99 * 200


def test_long_vectors_get_small_cells(spark, monkeypatch):
    monkeypatch.setattr(v, "CELL_BYTES", 1)
    monkeypatch.setattr(v, "COMPONENTS", 1)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=24).astype(np.float32).tolist()) for i in range(900)]
    assert {q: [i for i, _ in x] for q, x in run(spark, rows, 300).items()} == {q: [i for i, _ in x] for q, x in brute(rows, 300).items()}


def test_components_of_any_size(spark):
    rows = [(0, [1e-200, 2e-200]), (1, [1e200, 2e200]), (2, [3e-310, 1e-310]), (3, [1.0, 2.5]), (4, [-1e-200, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = v.nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 3, 2, 4] and abs(got[0].score - 1) < 1e-12 and abs(got[3].score + 5**-0.5) < 1e-12


def test_no_row_of_a_value_is_out_of_reach():
    rng = np.random.default_rng(6)
    x = v._unit(rng.normal(size=(2000, 33)) + rng.normal(size=33) * rng.integers(0, 3, 2000)[:, None])
    book = v.fit(x)
    packed = v.pack_codes(book.encode(x))
    assert (v.unpack_codes(packed) == book.encode(x)).all()
    reach = v._Reach(book, x, packed)
    eight, step, low = v._tables(book, x[:20])
    sums = v._sums(eight, packed)
    for k in range(20):
        for value in (-1.0, -0.2, 0.0, 0.5, 0.9, 0.999):
            assert set(np.flatnonzero(x @ x[k] >= value)) <= set(reach.rows(sums[k], step[k], low[k], value))


def test_anisotropic_codes_lose_less_along_the_vector():
    x = v._unit(np.random.default_rng(1).normal(size=(3000, 48)))
    book = v.fit(x)
    flat = v.Codebook(book.centres, 1.0)
    along = []
    for b in (book, flat):
        codes = b.encode(x)
        y = book.centres[np.arange(codes.shape[1])[None, :], codes].reshape(len(x), -1)
        along.append((((x - y) * x).sum(axis=1) ** 2).mean())
    assert along[0] < along[1]
    packed = v.pack_codes(book.encode(x[:64]))
    sums = v.scan(book, x[:4], packed)
    assert sums.shape == (4, 64) and (sums.argmax(axis=1) == np.arange(4)).all()


def test_extra_columns(spark):
    df = spark.createDataFrame([(0, [1.0], 1, "a", 2), (1, [2.0], 1, "b", 3)], SCHEMA + ", score string, rank int")
    assert v.nearest(df, F.col("vec_id") == 0).collect()[0][2:] == (1, 1.0)
