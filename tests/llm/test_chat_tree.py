import random

from graphemica.llm import chat_tree as c

SCHEMA = "conv_id long, turn long, role string, text string"


def read(spark, rows, **kw):
    blocks = c.format_conversations(spark.createDataFrame(rows, SCHEMA), **kw)
    return blocks, {r["conv_id"]: r for r in c.read_conversations(blocks).collect()}


def test_escape_is_reversible():
    rnd = random.Random(2)
    for _ in range(3000):
        role = "".join(rnd.choice(["\\", "#", "###", ":", "a", "\n"]) for _ in range(rnd.randrange(5)))
        text = "".join(rnd.choice(["\\", "#", "###", "</turn>", "<", "/turn>", "### user:\n", "é", "\n"]) for _ in range(rnd.randrange(8)))
        formatted, a, b = c.format_turn(role, text)
        assert c.parse(formatted * 2) == [(role, text)] * 2 and c.unescape(formatted[a:b]) == text


def check_forest(blocks, rows):
    """The tree against a plain one: each prefix once, at its position, with its ancestors' ranges and loss."""
    got = blocks.collect()
    convs = {}
    for i, t, role, text in rows:
        convs.setdefault(i, []).append((t, role, text))
    paths = {i: tuple((role, text) for _, role, text in sorted(x)) for i, x in convs.items()}
    prefixes = {p[: i + 1] for p in paths.values() for i in range(len(p))}
    assert sum(len(b["nodes"]) for b in got) == len(prefixes)
    assert sum(len(b["text"]) for b in got) == sum(len(c.format_turn(*p[-1])[0]) for p in prefixes)
    by = {(b["part"], b["block"]): b for b in got}
    text_of = lambda b, s: b["text"][s["start"] - b["at"] : s["end"] - b["at"]]
    for b in got:
        up = [by[o["part"], o["block"]] for o in b["outside"]]
        outer = [(o, text_of(x, o)) for o, x in zip(b["outside"], up)]
        seen = set()
        for k, n in enumerate(b["nodes"]):
            line, at = [(n, text_of(b, n))], n["parent"]
            while at is not None and at >= 0:
                line.append((b["nodes"][at], text_of(b, b["nodes"][at])))
                at = b["nodes"][at]["parent"]
            line += [outer[i] for i in range(-1 - at, -1, -1)] if at is not None else []
            line.reverse()
            prefix = tuple(c.parse(t)[0] for _, t in line)
            assert prefix in prefixes and prefix not in seen
            seen.add(prefix)
            assert n["position"] == sum(len(t) for _, t in line[:-1]) == sum(s["end"] - s["start"] for s in n["attend"])
            assert all(s["end"] <= n["start"] for s in n["attend"]) and all(x["end"] < y["start"] for x, y in zip(n["attend"], n["attend"][1:]))
            role, text = prefix[-1]
            assert (c.unescape(text_of(b, n["loss"])) == text) if role == "assistant" else n["loss"] is None
    assert sorted((x["conv_id"] is None, x["conv_id"] or 0) for b in got for x in b["leaves"]) == sorted((k is None, k or 0) for k in convs)


def test_tree(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (2, 1, "assistant", "no"), (2, 2, "user", "why"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (4, 0, "user", "bye")]
    blocks, found = read(spark, rows)
    assert {k: [(t["role"], t["text"]) for t in v["turns"]] for k, v in found.items()}[2] == [("user", "hi"), ("assistant", "no"), ("user", "why")]
    text = "".join(b["text"] for b in blocks.collect())
    assert [text.count(x) for x in ("hi", "yo", "no", "why", "bye")] == [1] * 5
    check_forest(blocks, rows)


def test_shared_turns_are_written_once_over_blocks_and_parts(spark):
    long = "start " * 300  # longer than any block
    rows = [(i, t, ("user", "assistant")[t % 2], long if t == 0 else "same" if t < 3 else f"{i}-{t}") for i in range(60) for t in range(2 + i % 4)]
    blocks, found = read(spark, rows, block=100)
    assert blocks.count() > 8
    check_forest(blocks, rows)
    for i in range(60):
        want = [t for c_, _, _, t in rows if c_ == i]
        assert [t["text"] for t in found[i]["turns"]] == want and found[i]["loss_text"] == "".join(want[1::2])
    assert sum(b["text"].count("start " * 300) for b in blocks.collect()) == 1


def test_random_forests(spark):
    rnd = random.Random(7)
    rows = [(i, t, rnd.choice(["user", "assistant", "system"]), rnd.choice(["", "a", "b\n", "\\### x"])) for i in range(300) for t in range(rnd.randint(1, 5))]
    for block in (1, 37, 1 << 16):
        blocks, found = read(spark, rows, block=block)
        check_forest(blocks, rows)
        for i in range(300):
            want = [(role, text) for c_, _, role, text in rows if c_ == i]
            assert [(t["role"], t["text"]) for t in found[i]["turns"]] == want
            assert found[i]["loss_text"] == "".join(t for role, t in want if role == "assistant")


def test_edges(spark):
    rows = [(1, 0, None, None), (1, None, "assistant", "first"), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (1, 1, "assistant", "a"), (None, 0, "user", "x"), (5, 0, "assistant", "long " * 50_000), (6, 0, "a:b", "### a:\n</turn>")]
    _, found = read(spark, rows)
    assert [(t["role"], t["text"]) for t in found[1]["turns"]] == [("assistant", "first"), ("", ""), ("assistant", "a"), ("assistant", "b"), ("assistant", "b")]
    assert found[1]["loss_text"] == "firstabb" and found[5]["loss_text"] == "long " * 50_000
    assert [(t["role"], t["text"]) for t in found[6]["turns"]] == [("a:b", "### a:\n</turn>")] and None in found
    assert read(spark, [])[1] == {}
    extra = spark.createDataFrame([(1, 0, "user", "x", "y", "z")], SCHEMA + ", path string, nodes string")
    assert c.read_conversations(c.format_conversations(extra)).count() == 1
