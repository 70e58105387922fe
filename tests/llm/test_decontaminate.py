import random

import pyarrow as pa
from conftest import SMALL

from graphemica.llm import decontaminate as d


def distance(a, b):
    """Least edits that turn a into a part of b, by the full table."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(prev + (x != y), row[j] + 1, row[j - 1] + 1)
    return min(row), row.index(min(row))


def test_myers():
    rnd = random.Random(4)
    for _ in range(400):
        a, b = (bytes(rnd.choice(b"abc") for _ in range(rnd.randint(1, 80))) for _ in range(2))
        best, end = d.myers(a, b)
        assert (best, end) == distance(a, b)


def edited(text, k, rnd):
    s = list(text)
    for _ in range(k):
        i = rnd.randrange(len(s))
        what = rnd.randrange(3)
        s[i : i + (what != 1)] = [] if what == 0 else [rnd.choice("xyz")]
    return "".join(s)


def test_whole_budget_is_found(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("aeiounrstl") for _ in range(rnd.randint(2, 9)))
    items = [(i, " ".join(word() for _ in range(rnd.randint(8, 40)))) for i in range(12)]
    docs = []
    for i in range(150):
        n, item = rnd.choice(items)
        body = " ".join(word() for _ in range(rnd.randint(0, 200)))
        docs.append((i, body[: rnd.randrange(len(body) + 1)] + edited(item, rnd.randint(0, int(0.1 * len(item))), rnd) + " " + body if i % 2 else body))
    got = {(r.doc_id, r.item_id): r for r in reversed(sorted(d.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect(), key=lambda r: r.distance))}
    for i, text in docs:
        for n, item in items:
            best, _ = distance(d.normal_text(item), d.normal_text(text))
            within = best <= int(d.RATE * len(d.normal_text(item)))
            assert within == ((i, n) in got), (i, n, best)
            if within:
                assert got[i, n].distance == best
                assert distance(d.normal_text(item), d.normal_text(text[got[i, n].start : got[i, n].end]))[0] == best
    assert len(got) > 30


def test_every_occurrence_is_found(spark):
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("aeiounrstl") for _ in range(rnd.randint(2, 9)))
    item = " ".join(word() for _ in range(15))
    planted, text = [], ""
    for _ in range(50):
        text += " ".join(word() for _ in range(rnd.randint(3, 30))) + " "
        copy = edited(item, rnd.randint(0, 3), rnd)
        planted.append((len(text), len(text) + len(copy)))
        text += copy + " "
    rows = sorted(d.contamination(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect(), key=lambda r: r.start)
    assert len(rows) == 50 and all(abs(r.start - a) < 9 and abs(r.end - b) < 9 for r, (a, b) in zip(rows, planted))
    assert all(r.distance == distance(item, text[r.start : r.end])[0] for r in rows)


def test_query_finds_every_exact_item(spark, duck):
    want = set(duck.execute("SELECT doc_id, item_id FROM documents d, benchmark b WHERE contains(d.text, b.text)").fetchall())
    got = {(r.doc_id, r.item_id) for r in d.op5_decontaminate(spark, SMALL).collect()}
    assert want <= got


def test_edges(spark):
    item = "The quick brown fox jumps over the lazy dog again and again"
    docs = [(1, None), (2, ""), (3, f"é {item.upper()}!"), (3, f"é {item.upper()}!"), (None, item), (5, item.replace(" ", " \n ")), (6, "x" * 3_000_000 + " " + item), (7, item[:30]), (8, item[:30]), (9, item[30:])]
    docs += [(10, "A short one; shorter, (SHORT) ashort"), (11, f"{item} {item[:20]}X{item[21:]}\n{item}{item}")]
    bench = [(1, item), (2, None), (3, "short"), (4, ""), (5, item), (None, item), (6, " \n")]
    docs_df = spark.createDataFrame([(i, t, 1, "z") for i, t in docs], "doc_id long, text string, item_id int, distance string")
    rows = d.contamination(docs_df, spark.createDataFrame(bench, "item_id long, text string")).collect()
    got = sorted(((r.doc_id or -1, r.item_id or -2, r.distance, r.start) for r in rows))
    n = len(item)
    whole = ((-1, 0, 0), (3, 2, 0), (3, 2, 0), (5, 0, 0), (6, 3_000_001, 0), (11, 0, 0), (11, n + 1, 1), (11, 2 * n + 2, 0), (11, 3 * n + 2, 0))
    assert got == sorted([(i, k, e, s) for i, s, e in whole for k in (1, 5, -2)] + [(10, 3, 0, 2), (10, 3, 0, 23)])
    assert {r.item_bytes for r in rows if r.item_id == 3} == {5}
    twice = spark.createDataFrame([(1, item), (1, item)], "item_id long, text string")
    assert d.contamination(docs_df.where("doc_id = 5"), twice).count() == 2
    empty = spark.createDataFrame([], "item_id long, text string")
    assert d.contamination(docs_df, empty).count() == 0 and d.contamination(docs_df.limit(0), empty).count() == 0


def test_chunks_give_the_same(spark, monkeypatch):
    rnd = random.Random(1)
    items = [(i, " ".join(str(rnd.randrange(10**6)) for _ in range(10))) for i in range(30)]
    docs = spark.createDataFrame([(i, f"a {t} b") for i, t in items], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, d.contamination(docs, bench).collect()))
    monkeypatch.setattr(d, "CHUNK_BYTES", 600)
    assert sorted(map(tuple, d.contamination(docs, bench).collect())) == whole and len(whole) == 30


def test_short_pieces():
    pieces = d.Pieces([(1, b"abcdefghijklmnopqrstuvwxy")], 0.2)
    assert pieces.q == 4 and [x[0] for x in d.scan(pa.array(["__abcdeXghijkXmnopqXstuvwxy", "no"]), pieces)] == [0]
