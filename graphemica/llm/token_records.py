"""Token-ID output: length-delimited binary records with masked checksums, and a separate offset index.

A record is: length (u64), masked checksum of those 8 bytes (u32), payload, masked checksum of the payload
(u32); all little-endian.  A payload is the document id (i64) and its token ids (u16 or u32, by vocabulary).
Checksums are CRC-32, rotated right by 15 bits plus 0xA282EAD8, so that a checksum of data that holds
checksums stays sound.  Beside ``part-k.rec`` lies ``part-k.idx``: document id, byte offset and number of
ids (i64 each) of every record, which is all that a shuffled read needs.

Encoding: byte-level BPE splits before a run of white space, so a text is cut there and each distinct piece
is encoded once per worker by the tokenizers library; ids are equal to those of the whole text.

Plan: one range shuffle by id, sorted within partitions; each task streams its documents into its own file
(temporary name, then rename: a retried task replaces equal bytes).  Only one row per file comes to the driver.
"""

from __future__ import annotations

import json
import os
import random
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphemica.llm.buckets import MOST_BYTES, corpus_size, shared_folder, shuffle_partitions
from graphemica.llm.textarrays import SpanCache, blocks_of, gathered, release, text_buffer

END = 0
_NO_ID = -(1 << 63)
#: Bytes of distinct pieces that are encoded in a row, and of text taken at a time (which bounds a worker's memory).
_ROW, TAKEN = 4096, 3 << 20
#: Distinct pieces that a worker remembers, also from task to task (about 90 bytes each).
REMEMBERED = 800_000
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PARTS = "part int, path string, docs long, tokens long, width int"


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = len(payload).to_bytes(8, "little")
    return b"".join((size, masked(size).to_bytes(4, "little"), payload, masked(payload).to_bytes(4, "little")))


def unframe(data: bytes, at: int = 0) -> tuple[bytes, int]:
    """(payload of the record at ``at``, end of the record); raises ValueError if a checksum is wrong."""
    size = data[at : at + 8]
    if len(size) < 8 or masked(size) != int.from_bytes(data[at + 8 : at + 12], "little"):
        raise ValueError(f"damaged record length at byte {at}")
    end = at + 12 + int.from_bytes(size, "little")
    payload = data[at + 12 : end]
    if masked(payload) != int.from_bytes(data[end : end + 4], "little"):
        raise ValueError(f"damaged record at byte {at}")
    return payload, end + 4


class BytePairs:
    """Ids of whole texts by the tokenizers library, distinct pieces once."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        known = json.loads(definition)
        pre = known.get("pre_tokenizer") or {}
        special = any(any(c.isspace() for c in t["content"]) or t.get("lstrip") or t.get("rstrip") for t in known.get("added_tokens", []))
        #: Cutting before white space is exact for the byte-level pattern only.
        self.cuts = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not known.get("normalizer") and not special
        self.widths = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(self.vocabulary)], dtype=np.int64)
        self.cache = SpanCache(self._each, REMEMBERED)

    def _each(self, raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each part and their number.  Parts that start with white space and end in a sure character stand in
        a row: a token of byte-level BPE has a fixed number of bytes, so the ids of the row are cut by bytes."""
        ends = np.cumsum(sizes)
        starts = ends - sizes
        last = raw[ends - 1]
        line = np.zeros(len(sizes), dtype=bool)
        if self.cuts:
            line = _SPACE[raw[starts]] & (((last > 0x20) & (last < 0x7F)) | ((last >= 0x80) & (raw[np.maximum(ends - 2, 0)] == 0xC3)))
        order = np.concatenate([np.flatnonzero(line), np.flatnonzero(~line)])
        size, lined = sizes[order], int(line.sum())
        buffer = gathered(raw, starts[order], size).tobytes()
        ends = np.cumsum(size)
        fresh = np.ones(len(size), dtype=bool)  # a row ends with the part that reaches the next _ROW bytes
        fresh[1:lined] = ends[1:lined] // _ROW != ends[: max(lined - 1, 0)] // _ROW
        heads = (ends - size)[fresh].tolist()
        found, counts = [], []
        for a in range(0, len(heads), 512):
            texts = [buffer[x:y].decode() for x, y in zip(heads[a : a + 512], [*heads[a + 1 : a + 513], *([len(buffer)] if a + 512 >= len(heads) else [])], strict=False)]
            for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
                found.append(np.array(e.ids, dtype=np.uint32))
                counts.append(len(found[-1]))
        flat = np.concatenate(found) if found else np.zeros(0, dtype=np.uint32)
        count = np.empty(len(size), dtype=np.int64)
        count[lined:] = counts[len(counts) - (len(size) - lined) :]
        tokens = int(len(flat) - count[lined:].sum())
        if lined:
            cuts = np.searchsorted(np.cumsum(self.widths[flat[:tokens]]), ends[:lined], side="left") + 1
            count[:lined] = np.diff(cuts, prepend=0)
        back = np.empty(len(order), dtype=np.int64)
        back[order] = np.arange(len(order))
        return gathered(flat, (np.cumsum(count) - count)[back], count[back]), count[back]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, end to end; n + 1 offsets)."""
        data, offsets = text_buffer(column)
        cut = np.zeros(len(data) + 1, dtype=bool)
        if self.cuts and len(data) > 1:
            # white space after a character that is surely none: printable ASCII, or a letter U+00C0 to U+00FF
            sure = (data > 0x20) & (data < 0x7F)
            sure[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80)
            cut[1:-1] = _SPACE[data[1:]] & sure[:-1]
        cut[offsets] = True
        cut[len(data)] = False
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(data)) if len(start) else start
        ids, sizes = self.cache.ids(data, start, end)
        return ids, np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(start, offsets)]


_known: dict[str, BytePairs] = {}


def _pairs(definition: str) -> BytePairs:
    """One for each worker: what it has encoded in one task serves the next."""
    if definition not in _known:
        _known.clear()
        _known[definition] = BytePairs(definition)
    return _known[definition]


def _place(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{os.path.abspath(folder)}")


def _writer(definition, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        files, root = _place(folder)
        pairs = _pairs(definition.value)
        kind = np.dtype("<u2") if pairs.vocabulary <= 1 << 16 else np.dtype("<u4")
        mine = f"{root}/.{part:05d}-{uuid.uuid4().hex}"
        index: list[np.ndarray] = []
        docs = tokens = at = 0
        with files.open_output_stream(f"{mine}.rec") as out:
            for batch in batches:
                for ids, texts in ((batch.column(0).slice(o, len(c)), c) for o, c in _with_offsets(batch.column(1))):
                    flat, offsets = pairs.encode(texts)
                    flat, rows = flat.astype(kind), []
                    for i, doc in enumerate(ids.to_pylist()):
                        doc = _NO_ID if doc is None else doc
                        n = int(offsets[i + 1] - offsets[i]) + 1
                        record = frame(doc.to_bytes(8, "little", signed=True) + flat[offsets[i] : offsets[i + 1]].tobytes() + END.to_bytes(kind.itemsize, "little"))
                        out.write(record)
                        rows.append((doc, at, n))
                        at += len(record)
                        tokens += n
                    docs += len(rows)
                    index.append(np.array(rows, dtype="<i8").reshape(-1, 3))
                release()
        with files.open_output_stream(f"{mine}.idx") as out:
            for rows in index:
                out.write(rows.tobytes())
        for kind_of in ("rec", "idx"):
            files.move(f"{mine}.{kind_of}", f"{root}/part-{part:05d}.{kind_of}")
        if docs:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [f"{folder}/part-{part:05d}"], "docs": [docs], "tokens": [tokens], "width": pa.array([kind.itemsize], pa.int32())})

    return run


def _with_offsets(column: pa.Array):
    at = 0
    for block in blocks_of(column, TAKEN):
        yield at, block
        at += len(block)


def write_token_records(docs: DataFrame, folder: str, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> list:
    """Encode every whole text, append id 0, and write records in ascending id order over the files in order.

    Returns one row per file that has records: part, path (without ending), docs, tokens, width (bytes of an
    id).  Defined cases: null and empty texts are the end id alone; null ids come first and read back as
    null, and so does an id of -2^63; rows that share an id follow each other in the order of a hash of their text;
    very long texts are one record each; repeated rows have a record each; an empty table writes no records.  Other
    columns are ignored, whatever their names.  ``folder`` must be one that all executors reach.
    """
    spark = docs.sparkSession
    definition = spark.sparkContext.broadcast(open(tokenizer_path, encoding="utf-8").read())
    _, size = corpus_size(docs, text_col)
    files, root = _place(folder)
    files.create_dir(root, recursive=True)
    parts = max(shuffle_partitions(spark), -(-size // MOST_BYTES))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    tie = F.xxhash64("text")
    dealt = rows.repartitionByRange(parts, "id", tie).sortWithinPartitions("id", tie)
    return sorted(dealt.mapInArrow(_writer(definition, folder), _PARTS).collect())


def read_record_ids(path: str, width: int, shuffle_seed: int | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
    """(document id, ids) of every record of a file; through the index in shuffled order if a seed is given."""
    files, at = _place(path)
    with files.open_input_file(f"{at}.idx") as f:
        index = np.frombuffer(f.read(), dtype="<i8").reshape(-1, 3)
    order = list(range(len(index)))
    if shuffle_seed is not None:
        random.Random(shuffle_seed).shuffle(order)
    kind = np.dtype(f"<u{width}")
    with files.open_input_file(f"{at}.rec") as f:
        for i in order:
            doc, offset, n = index[i].tolist()
            f.seek(offset)
            payload, _ = unframe(f.read(16 + 8 + n * width))
            if int.from_bytes(payload[:8], "little", signed=True) != doc:
                raise ValueError(f"{path}: index and record {i} differ")
            yield None if doc == _NO_ID else doc, np.frombuffer(payload, dtype=kind, offset=8)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in batch.to_pylist():
            at, rows = part["start"], []
            for doc, ids in read_record_ids(part["path"], part["width"]):
                rows.append((doc, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                at += len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_records(spark: SparkSession, parts: list) -> DataFrame:
    """Read files back: doc_id, start (ids of all documents before it), n_tokens (with the end id), ids_crc32."""
    out, start = [], 0
    for p in parts:
        out.append((p.part, p.path, p.width, start))
        start += p.tokens
    table = spark.createDataFrame(out, "part int, path string, width int, start long")
    return table.repartition(max(1, len(out))).mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_records(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    return read_token_records(spark, write_token_records(docs, folder, public_tokenizers.path("byte_bpe_50k.json")))
