import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest import SMALL
from tokenizers import Tokenizer

from graphemica.llm import token_records as r

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["a   b", " x", "a  <|endoftext|> b", "don't  stop\n\n now \t\n", "é  à  x", "", " ", "\n\n", "x" * 5000, "日本 語　 a", None, "a\x1c b", "a\u0085 b", "à Ã  z", "\u00a0  b", "🙂  🙂", "a" * 70_000 + " b"]

A = "a"
for _ in range(10):  # two words of 1,024 characters that polynomials modulo 2^64 don't tell apart
    A += A.translate(str.maketrans("ab", "ba"))
ODD.append(f"{A} {A.translate(str.maketrans('ab', 'ba'))} {A}")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_encode_equals_library(library):
    pairs = r.BytePairs(open(PATH).read())
    assert pairs.cuts
    for texts in (ODD, ODD[::-1], [" ".join(x or "" for x in ODD)]):
        ids, at = pairs.encode(pa.array(texts))
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == library(t), t
    pairs.cuts = False
    ids, at = pairs.encode(pa.array(ODD))
    assert ids[at[0] : at[1]].tolist() == library(ODD[0])


def expected(docs, library):
    out, start = [], 0
    for doc, text in docs:
        ids = [*library(text), 0]
        out.append((doc, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def test_query(spark, duck, library):
    docs = duck.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()
    assert sorted(map(tuple, r.op3_token_records(spark, SMALL).collect())) == expected(docs, library)


def test_files(spark, tmp_path, library):
    docs = [(None, "null id"), *enumerate(ODD), (90, "tie"), (91, "x")]
    df = spark.createDataFrame([(t, d, "e", 1) for d, t in docs], "text string, doc_id long, part string, start int")
    parts = r.write_token_records(df.repartition(7), str(tmp_path / "out"), PATH)
    assert sorted(map(tuple, r.read_token_records(spark, parts).collect()), key=lambda x: x[1]) == expected(docs, library)
    path = parts[0].path
    plain, mixed = list(r.read_record_ids(path, 2)), list(r.read_record_ids(path, 2, shuffle_seed=1))
    assert sorted(str(d) for d, _ in plain) == sorted(str(d) for d, _ in mixed)
    raw = bytearray(open(f"{path}.rec", "rb").read())
    payload, end = r.unframe(bytes(raw))
    assert r.frame(payload) == bytes(raw[:end])
    for at in (0, 15):
        damaged = bytearray(raw)
        damaged[at] ^= 1
        with pytest.raises(ValueError, match="damaged"):
            r.unframe(bytes(damaged))
    assert not list((tmp_path / "out").glob(".*"))


def test_repeats_and_empty(spark, tmp_path):
    same = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b")], "doc_id long, text string")
    got = r.read_token_records(spark, r.write_token_records(same, str(tmp_path / "a"), PATH)).collect()
    assert [x["start"] for x in sorted(got, key=lambda x: x["start"])] == [0, 2, 4]
    none = r.write_token_records(same.limit(0), str(tmp_path / "b"), PATH)
    assert none == [] and r.read_token_records(spark, none).count() == 0


def test_mask():
    assert r.masked(b"") == 0xA282EAD8 and np.uint32(r.masked(b"123456789")) != zlib.crc32(b"123456789")
