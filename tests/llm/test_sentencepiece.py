import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from conftest import SMALL

from graphemica.llm import sentencepiece_viterbi as s

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", None, " ", "  ", "a", " a", "   a  b ", "\n\n x\ty", "日本語 テスト", "▁▁ a▁b", "aaaa aaaaaaaa aaa", "x" * 3000, " " * 300 + "b", "🙂 ok z", "  " * 40 + "the thing", "é ñ ü ß", "hello world!!! don't", "the " * 20_000]


@pytest.fixture(scope="module")
def tables():
    return s.load(PATH)


def texts():
    rnd = random.Random(1)
    return ODD + ["".join(rnd.choice("aabet nohis  ▁é") for _ in range(rnd.randrange(60))) for _ in range(400)]


def test_ids_equal_library(tables):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    some = texts()
    ids, at = s.Encoder(tables).encode(pa.array(some))
    assert tables.bpe and [ids[a:b].tolist() for a, b in zip(at, at[1:])] == library.encode([t or "" for t in some])
    back = s.Decoder(tables).decode(ids, at)
    assert back == [(t or "").replace("▁", " ") for t in some]
    assert back == library.decode([ids[a:b].tolist() for a, b in zip(at, at[1:])])


def test_unigram_sums_are_the_library_s(tmp_path):
    """The same pieces with scores of a unigram model: no two paths have equal sums, so ids must be equal."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.ParseFromString(open(PATH, "rb").read())
    model.trainer_spec.model_type = 1
    rng = np.random.default_rng(1)
    for p in model.pieces:
        if p.type == 1:
            p.score = float(-rng.uniform(1, 12))
    path = tmp_path / "unigram.model"
    path.write_bytes(model.SerializeToString())
    library = sentencepiece.SentencePieceProcessor(model_file=str(path))
    tables = s.load(str(path))
    some = [t for t in texts() if t and len(set(t)) > 2]
    ids, at = s.Encoder(tables).encode(pa.array(some))
    same = sum(ids[a:b].tolist() == w for a, b, w in zip(at, at[1:], library.encode(some)))
    assert not tables.bpe and same >= 0.99 * len(some)


def test_compatible_by_definition(tables):
    encoder = s.Encoder(tables)
    rng = np.random.default_rng(5)
    ids = rng.choice(tables.ids[tables.order[tables.ids] > 0], 4000)
    near = tables.pairs[rng.integers(0, len(tables.pairs), 500)]
    a, b = np.concatenate([ids[:2000], near // len(tables.names)]), np.concatenate([ids[2000:], near % len(tables.names)])
    plain = [not tables.names[y].startswith("▁") or not tables.names[x].endswith("▁") for x, y in zip(a, b)]
    got = encoder.compatible(a, b)
    for x, y, ok, use in zip(a, b, got, plain):
        if use:
            assert ok == (s.merge(tables.names[x] + tables.names[y], encoder.score) == [tables.names[x], tables.names[y]])
    assert got.any() and not got.all()


def test_bars_by_definition(tables):
    encoder = s.Encoder(tables)
    for n in range(1, 70):
        assert encoder.bars(n) == [encoder.of[x] for x in s.merge("▁" * n, encoder.score)]


def test_long_words(tables):
    """Text without spaces, words over several blocks, and the two words that polynomials modulo 2^64 confuse."""
    import time

    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rnd = random.Random(6)
    a = "a"
    for _ in range(10):
        a += a.translate(str.maketrans("ab", "ba"))
    some = ["".join(chr(rnd.randrange(0x4E00, 0x9FFF)) for _ in range(40_000)), "数据获取一个" * 3000, "".join(rnd.choice("etaoinshr") for _ in range(40_000)), "x" * 40_001, f"{a} {a.translate(str.maketrans('ab', 'ba'))}", "http" * 9000 + "数" * 50 + " " * 37 + "the" * 99]
    began = time.process_time()
    ids, at = s.Encoder(tables).encode(pa.array(some))
    assert time.process_time() - began < 20
    assert [ids[x:y].tolist() for x, y in zip(at, at[1:])] == library.encode(some)


def test_query(spark, duck):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    docs = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    got = s.op9_sentencepiece(spark, SMALL).collect()
    assert all(r.round_trip and r.n_tokens == len(library.encode(docs[r.doc_id])) for r in got) and len(got) == len(docs)


def test_operator(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)], "doc_id long, text string, ids string")
    out = s.encode_pieces(df, PATH, decode=True)
    assert out.columns == ["doc_id", "text", "ids", "n_tokens", "decoded"]
    rows = out.orderBy("doc_id").collect()
    assert rows[0].ids == [] and rows[1].decoded == "" and all(r.n_tokens == len(r.ids) for r in rows)
    again = s.decode_pieces(out.drop("decoded"), PATH).orderBy("doc_id").collect()
    assert [r.decoded for r in again] == [r.decoded for r in rows]
    assert s.encode_pieces(df.limit(0), PATH).count() == 0
    nulls = spark.createDataFrame([(None,), ([15],)], "ids array<int>")
    assert s.decode_pieces(nulls, PATH).collect()[0].decoded is None
