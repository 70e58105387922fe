import zlib

import numpy as np
from conftest import SMALL

from graphemica.llm import language_id as g


def test_held_out_accuracy(spark, duck):
    truth = dict(duck.execute("SELECT doc_id, lang FROM documents").fetchall())
    rows = g.op10_language_id(spark, "/root/testdata/sf0.01").collect()
    truth = dict(__import__("duckdb").sql("SELECT doc_id, lang FROM '/root/testdata/sf0.01/documents.parquet'").fetchall())
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {d for d in truth if zlib.crc32(str(d).encode()) % 4 == 2}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows) and len(rows) == 1000
    assert g.op10_language_id(spark, SMALL).count() == 200


def kernel(a, b):
    """Normalised presence kernel by its definition, over hashed n-grams."""
    x, _ = g.presence([a, b])
    x = x.astype(float)
    return (x[0] @ x[1]) / np.sqrt(x[0].sum() * x[1].sum())


def test_kernel():
    assert kernel("the cat", "the cat") == 1 and 0 < kernel("the cat", "the dog") < 1 and kernel("THE  cat!", "the cat") > 0.9
    x, lettered = g.presence(["", "123 !", "é", "a"])
    assert x[:2].sum() == 0 and lettered.tolist() == [False, False, True, True]


def test_weights_are_kernel_ridge():
    """Scores are those of ridge regression on kernel values with the landmarks, solved here step by step."""
    rnd = np.random.default_rng(4)
    words = {"en": "the and house of dog with", "de": "der und haus von hund mit", "fr": "le et maison de chien avec"}
    rows = [(" ".join(rnd.choice(w.split(), 8)), lang) for _ in range(30) for lang, w in words.items()]
    model = g.fit(rows)
    texts, n = [t for t, _ in rows], len(rows)
    gram = np.array([[kernel(a, b) for b in texts] for a in texts])  # all rows are landmarks
    values, vectors = np.linalg.eigh(gram)
    strong = values > 1e-6 * values.max()
    root = vectors[:, strong] / np.sqrt(values[strong])
    phi = gram @ root
    y = np.array([[1.0 if lang == c else -1.0 for c in model.languages] for _, lang in rows])
    middle = phi.mean(axis=0)
    w = np.linalg.solve((phi - middle).T @ (phi - middle) + g.RIDGE * n / 100 * np.eye(phi.shape[1]), (phi - middle).T @ (y - y.mean(axis=0)))
    for text in ("the dog", "der hund und le chien", "avec"):
        want = (np.array([kernel(text, z) for z in texts]) @ root - middle) @ w + y.mean(axis=0)
        soft = np.exp(g.SHARPNESS * (want - want.max()))
        langs, scores = model.predict([text])
        assert langs == [model.languages[want.argmax()]] and abs(scores[0] - soft.max() / soft.sum()) < 1e-3
    langs, scores = model.predict(["the dog", "der hund", None, "42", "", "the " * 100_000])
    assert langs == ["en", "de", "und", "und", "und", "en"] and scores[2] == 0 and min(scores[0], scores[1]) > 0.5


def test_sample_is_bounded_and_even(spark, monkeypatch):
    """Rows without an id, one id for all, many languages and repeated rows: all learned, within the bound."""
    taken = []
    monkeypatch.setattr(g, "SAMPLE", 60)
    monkeypatch.setattr(g, "fit", lambda rows: taken.append(rows))
    rows = [(None, f"word {i}", "aa") for i in range(500)] + [(7, f"term {i}", "bb") for i in range(500)] + [(1, "same", "cc")] * 500 + [(2, "x" * 10**6, "dd")]
    g.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    langs = [lang for _, lang in taken[0]]
    assert len(taken[0]) == 32 and {c: langs.count(c) for c in set(langs)} == {"aa": 15, "bb": 15, "cc": 1, "dd": 1}
    many = [(i, f"text {i}", f"l{i}") for i in range(1300)]
    g.train(spark.createDataFrame(many, "doc_id long, text string, lang string"))
    assert sorted(lang for _, lang in taken[1]) == sorted(r[2] for r in many)


def test_edges(spark):
    df = spark.createDataFrame([(1, "the dog and the cat", "en"), (3, None, "en"), (5, "der hund und die katze", "de"), (5, "der hund und die katze", "de"), (None, "und", None), (7, "", "de"), (9, "x", None)], "doc_id long, text string, lang string")
    model = g.train(df)
    out = g.predict_language(df.withColumn("score", g.F.lit("clash")), model).collect()
    assert [r.lang_pred for r in out] == ["en", "und", "de", "de", out[4].lang_pred, "und", out[6].lang_pred] and out[0].asDict().keys() == {"doc_id", "text", "lang", "lang_pred", "score"}
    assert g.predict_language(df.limit(0), model).count() == 0
    none = g.train(df.limit(0))
    assert {r.lang_pred for r in g.predict_language(df, none).collect()} == {"und"}
    assert df.select(g.held_out()).where(g.held_out().isNull()).count() == 0
