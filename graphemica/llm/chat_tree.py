"""Chat formatting as prefix trees.

A turn becomes ``### role:\\ntext</turn>\\n``; a backslash before ``\\``, ``###`` or ``</turn>`` inside a text
(and before ``:`` in a role) makes that reversible.  Conversations are sorted by the digests of their turns, so
those that share initial turns are neighbours, and all of them together are the walk through a forest, depth
first.  Each distinct prefix is a node: a turn after the turns before it.  Its text is written once in the whole
output, however many conversations and blocks share it.

The output is cut into parts (one for each task) and these into blocks.  Places are counted in the stream of a part.
A node has its range there, the position of its first character within its conversation, the span that counts for
the loss (the text of an assistant turn), and the ranges of its ancestors, to which it may attend besides itself.
Depth first, the ancestors of what a block holds are in the block, or on the path that was open when it began: a
block names those nodes (``outside``) by part, block and range.  Turns that a part shares with the part before it come
first in its stream, at the places that their positions say, though their text stands elsewhere.

Plan: one aggregate by conversation, one range shuffle by path, kept by a checkpoint, so that the parts stay the same
while three things happen: each part tells its first and last path (one row of digests for each part comes to the
driver, which sees how many turns each part shares with the one before); each part is written; and each part's last
path tells where the shared turns of the next one stand.  A first turn that a third of all conversations share is
spread over as many parts as it fills.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from graphemica.llm.buckets import materialize, shared_folder, shuffle_partitions

#: Characters after which a block ends with the conversation that it is at.
BLOCK = 1 << 16
_CONTROL = re.compile(r"\\|###|</turn>")
_CONTROL_ROLE = re.compile(r"\\|###|</turn>|:")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*+):\n((?:[^\\<]|\\(?:\\|###|</turn>)|<(?!/turn>))*+)</turn>\n", re.S)

_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_NODE = [T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("position", T.LongType()), T.StructField("loss", _SPAN)]
#: ``parent`` and a leaf's ``node``: the number of a node of the block; -1 - k is the k-th of ``outside``; null is none.
BLOCKS = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("at", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("nodes", T.ArrayType(T.StructType([*_NODE, T.StructField("parent", T.IntegerType()), T.StructField("attend", T.ArrayType(_SPAN))]))),
    T.StructField("outside", T.ArrayType(T.StructType([T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType()), *_NODE]))),
    T.StructField("leaves", T.ArrayType(T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("node", T.IntegerType())]))),
])
_WRITTEN = T.StructType([*BLOCKS, T.StructField("tail", BLOCKS["outside"].dataType)])
_TURNS = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))
READ = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turns", _TURNS), T.StructField("loss_text", T.StringType()), T.StructField("formatted", T.StringType())])


def escape(text: str, role: bool = False) -> str:
    return (_CONTROL_ROLE if role else _CONTROL).sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """(the turn, start and end of its escaped text within it)."""
    head = f"### {escape(role, role=True)}:\n"
    body = escape(text)
    return f"{head}{body}</turn>\n", len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at character {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def _common(a: list[bytes], b: list[bytes]) -> int:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: part, first and last path."""
    first = last = None
    for batch in batches:
        if len(batch):
            paths = batch.column("path")
            first, last = paths[0].as_py() if first is None else first, paths[len(paths) - 1].as_py()
    if first is not None:
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "first": pa.array([first], pa.list_(pa.binary())), "last": pa.array([last], pa.list_(pa.binary()))})


class _Writer:
    """One part.  ``shared`` turns of its first conversation stand in parts before: they have places in the part's
    stream, before all others, but no text."""

    def __init__(self, part: int, shared: int):
        self.part, self.shared, self.size, self.number = part, shared, 0, -1
        self.stack: list[tuple[bytes, dict]] = []  # digest and node of the turns of the last conversation
        self.begin()

    def begin(self) -> None:
        self.number += 1
        self.at, self.text, self.nodes, self.leaves = self.size, [], [], []
        self.outside = [n for _, n in self.stack]
        for k, n in enumerate(self.outside):
            n["here"] = -1 - k

    def add(self, conv_id: int | None, turns: list[dict], keys: list[bytes]) -> None:
        same = _common(keys, [k for k, _ in self.stack])
        del self.stack[same:]
        for key, turn in zip(keys[same:], turns[same:], strict=True):
            text, a, b = format_turn(turn["role"], turn["text"])
            up = self.stack[-1][1] if self.stack else None
            attend = []
            if up:  # the parent's ancestors and the parent; touching ranges are one
                attend = [dict(s) for s in up["attend"]]
                if attend and attend[-1]["end"] == up["start"]:
                    attend[-1]["end"] = up["end"]
                else:
                    attend.append({"start": up["start"], "end": up["end"]})
            node = {
                "part": self.part, "block": self.number, "start": self.size, "end": self.size + len(text), "position": up["position"] + up["end"] - up["start"] if up else 0,
                "loss": {"start": self.size + a, "end": self.size + b} if turn["role"] == "assistant" else None, "parent": up["here"] if up else None, "attend": attend,
            }
            self.size += len(text)
            self.stack.append((key, node))
            if len(self.stack) <= self.shared:
                node["here"], self.at = -len(self.stack), self.size
                self.outside.append(node)
            else:
                node["here"] = len(self.nodes)
                self.nodes.append(node)
                self.text.append(text)
        self.shared = 0
        self.leaves.append({"conv_id": conv_id, "node": self.stack[-1][1]["here"]})

    def row(self, last: bool) -> pa.RecordBatch:
        tail = [n for _, n in self.stack] if last else None
        row = {"part": self.part, "block": self.number, "at": self.at, "text": "".join(self.text), "nodes": self.nodes, "outside": self.outside, "leaves": self.leaves, "tail": tail}
        return pa.RecordBatch.from_pylist([row], schema=to_arrow_schema(_WRITTEN))


def _packer(most: int, shared: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        w, full = _Writer(part, shared.get(part, 0)), False
        for batch in batches:
            for row in batch.to_pylist():
                if full:
                    yield w.row(last=False)
                    w.begin()
                w.add(row["conv_id"], row["turns"], row["path"])
                full = w.size - w.at >= most or len(w.leaves) >= most
        if w.leaves:
            yield w.row(last=True)

    return run


_PLACES = "part int, places array<struct<at: long, part: int, block: int, start: long, end: long, loss: struct<start: long, end: long>>>"


def _with_places(blocks: DataFrame, found: list[tuple]) -> DataFrame:
    """Outside nodes that a part shares with those before it get the place of their text."""
    known = blocks.sparkSession.createDataFrame(found, _PLACES)
    place = lambda k: F.get("places", k)
    moved = lambda o, k: F.struct(place(k)["part"].alias("part"), place(k)["block"].alias("block"), place(k)["start"].alias("start"), place(k)["end"].alias("end"), o["position"].alias("position"), place(k)["loss"].alias("loss"))
    shared = lambda o, k: F.coalesce((o["part"] == F.col("part")) & (o["start"] == place(k)["at"]), F.lit(False))
    outside = F.transform("outside", lambda o, k: F.when(shared(o, k), moved(o, k)).otherwise(o))
    return blocks.join(known, "part", "left").withColumn("outside", outside).select(*(f.name for f in BLOCKS))


def format_conversations(rows: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """rows: conv_id, turn, role, text.  Returns blocks: part, block, at (where its text begins in the part's stream),
    text, nodes, outside and leaves (see the module's text).

    Defined cases: a null text or role is empty; turns stand in ascending order, null first, ties by role and
    text; repeated rows are turns of their own; rows with a null conv_id are one conversation; equal
    conversations share all nodes and keep a leaf each; very long texts are one node each; an empty table gives no
    blocks.  Other columns are ignored, whatever their names.  A conversation is held whole by one task.
    """
    spark = rows.sparkSession
    shared_folder(spark)
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    key = lambda t: F.substring(F.unhex(F.sha2(F.concat(F.length(t["role"]).cast("string"), F.lit(":"), t["role"], t["text"]), 256)), 1, 16)
    pathed = convs.withColumn("path", F.transform("turns", key))
    dealt = pathed.repartitionByRange(shuffle_partitions(spark), "path", "conv_id").sortWithinPartitions("path", "conv_id").checkpoint()
    edges = sorted(map(tuple, dealt.select("path").mapInArrow(_edges, "part int, first array<binary>, last array<binary>").collect()))
    shared = {p: _common(list(map(bytes, first)), list(map(bytes, last))) for (_, _, last), (p, first, _) in zip(edges, edges[1:], strict=False)}
    written = materialize(dealt.mapInArrow(_packer(block, shared), _WRITTEN), "chat")
    # one row for each part: the nodes of its last conversation, from which those that the next part shares are known
    tails = {r["part"]: [n.asDict(True) for n in r["tail"]] for r in written.where("tail is not null").select("part", "tail").collect()}
    found, before = [], []
    for p, _, _ in edges:
        own, at = [], 0
        for node in before[: shared.get(p, 0)]:  # the places that they have in this part's stream
            own.append({**node, "at": at})
            at += node["end"] - node["start"]
        if own:
            found.append((p, [(n["at"], n["part"], n["block"], n["start"], n["end"], n["loss"] and (n["loss"]["start"], n["loss"]["end"])) for n in own]))
        before = [own[i] if n["start"] < at else n for i, n in enumerate(tails[p])]
    written = written.drop("tail")
    return _with_places(written, found) if found else written


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = to_arrow_schema(READ)
    for batch in batches:
        for block in batch.to_pylist():
            text, at, rows = block["text"], block["at"], []
            cut = [text[n["start"] - at : n["end"] - at] for n in block["nodes"]]
            for leaf in block["leaves"]:
                path, k = [], leaf["node"]
                while k is not None and k >= 0:
                    path.append((block["nodes"][k], cut[k]))
                    k = block["nodes"][k]["parent"]
                path += [(block["outside"][i], block["pieces"][i]) for i in range(-1 - k, -1, -1)] if k is not None else []
                path.reverse()
                loss = "".join(unescape(t[n["loss"]["start"] - n["start"] : n["loss"]["end"] - n["start"]]) for n, t in path if n["loss"])
                formatted = "".join(t for _, t in path)
                rows.append({"conv_id": leaf["conv_id"], "turns": [{"role": r, "text": t} for r, t in parse(formatted)], "loss_text": loss, "formatted": formatted})
                if len(rows) >= 64:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)


def read_conversations(blocks: DataFrame) -> DataFrame:
    """A row per leaf: conv_id, turns (role, text), loss_text (unescaped, in order) and formatted.

    Blocks get the text of their outside nodes by an equi-join on part and block.
    """
    need = blocks.select(F.col("part").alias("p"), F.col("block").alias("b"), F.posexplode("outside").alias("k", "o")).select("p", "b", "k", "o.part", "o.block", "o.start", "o.end")
    found = need.join(blocks.select("part", "block", "at", "text"), ["part", "block"])
    piece = F.substr("text", (F.col("start") - F.col("at") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    pieces = found.select("p", "b", F.struct("k", piece.alias("piece")).alias("piece")).groupBy("p", "b").agg(F.array_sort(F.collect_list("piece"))["piece"].alias("pieces"))
    whole = blocks.join(pieces, (F.col("part") == F.col("p")) & (F.col("block") == F.col("b")), "left").select(*(f.name for f in BLOCKS), "pieces")
    return whole.mapInArrow(_read, READ)


PROBE = "\\### Assistant: </turn> ok"


def op2_chat_tree(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], rows.schema)
    back = read_conversations(format_conversations(rows.unionByName(probe)))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(14 + length(regexp_replace(role, '(\\|###|</turn>|:)', '_\1', 'g')) + length(regexp_replace(text, '(\\|###|</turn>)', '_\1', 'g'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
