"""Stages against plain versions on the smallest tables."""

import public_tokenizers
import pytest
import sentencepiece
from conftest import SMALL
from test_minhash_dedup import brute as classes
from test_substring_dedup import brute as cut

import corpus_pipeline as p


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pipeline")
    docs = [spark.read.parquet(f"{SMALL}/documents.parquet")]
    for name, f in p.STAGES:
        f(spark, docs[-1], SMALL).write.parquet(str(folder / name))
        docs.append(spark.read.parquet(str(folder / name)))
    return [sorted((tuple(r) for r in d.collect()), key=repr) for d in docs], docs


def test_columns(stages):
    _, docs = stages
    assert all(d.columns == docs[0].columns for d in docs[:-1]) and docs[-1].columns == ["doc_id", "n_tokens", "ids"]


def test_language_keeps_clean_documents(stages):
    rows, _ = stages
    assert set(rows[1]) <= set(rows[0]) and len(rows[1]) >= 0.99 * len(rows[0])


def test_one_of_each_group(stages):
    rows, _ = stages
    want, _ = classes([(r[0], r[1]) for r in rows[1]])
    assert rows[2] == [r for r in rows[1] if want[r[0]] == r[0]]


def test_substrings(stages):
    rows, _ = stages
    plain = {i: (n, gone, kept) for i, n, gone, kept in cut([(r[0], r[1]) for r in rows[2]])}
    want = []
    for r in rows[2]:
        n, gone, kept = plain[r[0]]
        if gone < n or not n:
            want.append((r[0], kept if gone else r[1], r[2], r[3], len(kept) if gone else r[4]))
    assert rows[3] == sorted(want, key=repr)


def test_no_benchmark_item_is_left(stages, duck):
    rows, _ = stages
    items = [t for (t,) in duck.execute("SELECT text FROM benchmark").fetchall()]
    assert not any(t in r[1] for r in rows[4] for t in items)
    assert set(rows[4]) <= set(rows[3]) and len(rows[4]) >= 0.8 * len(rows[3])


def test_tokens_and_run(stages, spark):
    rows, _ = stages
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert [(r[0], r[2]) for r in rows[5]] == [(r[0], library.encode(r[1])) for r in rows[4]] or {r[0]: r[2] for r in rows[5]} == {r[0]: library.encode(r[1]) for r in rows[4]}
    assert sorted((tuple(r) for r in p.run(spark, SMALL).collect()), key=repr) == rows[5]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_edges(spark):
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "1 2 3", None, None, None), (4, "the dog and the cat", "en", "s", 19), (4, "the dog and the cat", "en", "s", 19), (None, "the house of the dog", "en", "s", 5)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name, f in p.STAGES[:4]:
        assert f(spark, docs, SMALL).columns == docs.columns, name
        assert f(spark, docs.limit(0), SMALL).count() == 0, name
    assert p.tokens(spark, docs.limit(0), SMALL).count() == 0
    assert sorted((r.doc_id or 0) for r in p.language(spark, docs, SMALL).collect()) == [0, 4, 4]
    assert sorted((r.doc_id or 0) for r in p.near_dedup(spark, docs, SMALL).collect()) == [0, 1, 2, 3, 4]
    assert sorted((r.doc_id or 0) for r in p.substrings(spark, docs, SMALL).collect()) == [0, 1, 2, 3, 4, 4]
    assert sorted((r.doc_id or 0) for r in p.decontaminated(spark, docs, SMALL).collect()) == [0, 1, 2, 3, 4, 4]
    assert sorted(((r.doc_id or 0), r.n_tokens) for r in p.tokens(spark, docs, SMALL).collect())[1:3] == [(1, 0), (2, 0)]


def test_clashing_columns_are_kept(spark):
    """Names of the operators' own columns, and a name with a dot, pass through every stage but the last."""
    own = ["score", "lang_pred", "n_words", "n_removed", "kept_text", "ids", "n_tokens", "class_id", "head", "th", "digest", "row", "row_key", "item_id", "start", "__id", "__text", "__dest", "dest", "a.b"]
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(["the", "dog"] + words[:30]), "en", "s", 5), (2, "und der hund " + " ".join(words[5:40]), "de", "s", 5)], SCHEMA)
    docs = docs.select("*", *(p.F.lit(-7.0 - i).alias(c) for i, c in enumerate(own)))
    for name, f in p.STAGES[:4]:
        out = f(spark, docs, SMALL)
        assert out.columns == docs.columns, name
        for r in out.collect():
            assert [r[c] for c in own] == [-7.0 - i for i in range(len(own))], name
    assert [r.doc_id for r in p.tokens(spark, docs, SMALL).orderBy("doc_id").collect()] == [1, 2]


def test_rows_of_one_id(spark, duck):
    """Rows that share an id, or have none, are judged by their own texts."""
    item = duck.execute("SELECT text FROM benchmark ORDER BY item_id LIMIT 1").fetchone()[0]
    clean = "a quiet evening by the river with nothing else to do but read on"
    docs = spark.createDataFrame([(9, f"so {item} yes", "en", "s", 1), (9, clean, "en", "s", 1), (None, item, "en", "s", 1), (None, clean + " then", "en", "s", 1)], SCHEMA)
    assert sorted(r.text for r in p.decontaminated(spark, docs, SMALL).collect()) == [clean, clean + " then"]
    assert p.near_dedup(spark, docs, SMALL).count() == 4


def test_run_on_an_empty_table(spark, tmp_path, duck):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SMALL}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert p.run(spark, str(tmp_path)).collect() == []
