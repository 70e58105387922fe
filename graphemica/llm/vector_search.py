"""Nearest neighbours by score-aware (anisotropic) quantisation, four-bit table scans and exact reranking.

Vectors are scaled to length one and cut into two-dimensional parts with 16 centres each, four bits a part.
The error of a quantised vector along the vector itself changes its largest products most, so it weighs ETA
times the error across it (Guo et al. 2020); codes and centres minimise that loss by coordinate descent, a part at
a time and in closed form.  A query's products with all centres, rounded to eight bits, make its tables; two parts
share a byte, and a scan adds one table entry per byte.  The SHORTLIST best of a block are reranked by the
cosine of the original vectors in double precision, and after them every row that could still be among the best:
the angle between a vector and its quantised form is known, so the scan bounds the angle to the query from below.
The result is that of brute force.

Plan: the query set is a fixed share of the rows, so queries meet rows in a grid of (query block, row block),
each held by one task; every cell keeps only its best few, and a rank-limited window joins the cells.  The
codebooks are fitted on at most TRAIN rows and are a few KB.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a cell and queries of a cell, at least and at most; training rows; rows that a cell reranks per query to get a bound,
#: beyond which it reranks whatever the bound leaves.
ROWS, MOST_ROWS, QUERIES, MOST_QUERIES, TRAIN, SHORTLIST = 4096, 65536, 1024, 16384, 8192, 192
#: Bytes of a cell's rows as doubles, and components of the rows reranked at a time: long vectors get smaller cells.
CELL_BYTES, COMPONENTS = 256 << 20, 1 << 24
CENTRES, PART, THRESHOLD = 16, 2, 0.2
_FOUND = "query_id long, vec_id long, score double"


def _parts(x: np.ndarray) -> np.ndarray:
    """n x parts x PART, with zeros at the end if the dimension is odd."""
    n, d = x.shape
    m = -(-d // (2 * PART)) * 2  # an even number of parts: two share a byte
    out = np.zeros((n, m * PART), dtype=np.float64)
    out[:, :d] = x
    return out.reshape(n, m, PART)


def _unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(axis=1, keepdims=True)
    x = x / big
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Codebook:
    def __init__(self, centres: np.ndarray, eta: float):
        self.centres, self.eta = centres, eta  # parts x CENTRES x PART

    def encode(self, units: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """n x parts codes that minimise |r|^2 + (eta - 1) (r . x)^2 part by part."""
        x = _parts(units)
        n, m, _ = x.shape
        codes = np.empty((n, m), dtype=np.uint8)
        along = np.empty((n, m))  # the part's share of r . x
        for p in range(m):
            diff = x[:, p, None, :] - self.centres[p]
            codes[:, p] = (diff * diff).sum(axis=2).argmin(axis=1)
            along[:, p] = (x[:, p] * (x[:, p] - self.centres[p, codes[:, p]])).sum(axis=1)
        total = along.sum(axis=1)
        for _ in range(sweeps):
            for p in range(m):
                diff = x[:, p, None, :] - self.centres[p]
                own = np.einsum("nkp,np->nk", diff, x[:, p])
                rest = total - along[:, p]
                loss = (diff * diff).sum(axis=2) + (self.eta - 1) * (rest[:, None] + own) ** 2
                codes[:, p] = loss.argmin(axis=1)
                along[:, p] = own[np.arange(n), codes[:, p]]
                total = rest + along[:, p]
        return codes


def fit(vectors: np.ndarray, rounds: int = 6) -> Codebook:
    """vectors: the training rows, not zero."""
    units = _unit(vectors)
    x = _parts(units)
    n, m, _ = x.shape
    d = vectors.shape[1]
    eta = max(1.0, (d - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
    seed = np.random.Generator(np.random.PCG64(4))
    centres = np.stack([x[seed.choice(n, CENTRES, replace=n < CENTRES), p] for p in range(m)])
    for _ in range(rounds):
        codes = Codebook(centres, eta).encode(units, sweeps=1)
        # part by part, with the others fixed: for the rows of a centre, (n + (eta - 1) sum x x') c = eta sum x - (eta - 1) sum x r,
        # where r is what the other parts' centres already give of the product with the row
        shares = np.einsum("nmp,nmp->nm", x, centres[np.arange(m), codes])
        total = shares.sum(axis=1)
        for p in range(m):
            own, code = x[:, p], codes[:, p]
            rest = total - shares[:, p]
            left = np.zeros((CENTRES, PART, PART))
            np.add.at(left, code, (eta - 1) * own[:, :, None] * own[:, None, :])
            left += (np.bincount(code, minlength=CENTRES) + 1e-3)[:, None, None] * np.eye(PART)
            right = 1e-3 * centres[p]
            np.add.at(right, code, own * (eta - (eta - 1) * rest)[:, None])
            centres[p] = np.linalg.solve(left, right[:, :, None])[:, :, 0]
            shares[:, p] = (own * centres[p, code]).sum(axis=1)
            total = rest + shares[:, p]
    return Codebook(centres, eta)


def pack_codes(codes: np.ndarray) -> np.ndarray:
    return codes[:, 0::2] << 4 | codes[:, 1::2]


def unpack_codes(packed: np.ndarray) -> np.ndarray:
    return np.stack([packed >> 4, packed & 15], axis=2).reshape(len(packed), -1)


def _tables(book: Codebook, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eight-bit tables (parts x CENTRES x queries), the step of a query and its sum of least entries."""
    tables = np.einsum("qmp,mkp->mkq", _parts(queries), book.centres)
    low = tables.min(axis=1, keepdims=True)
    step = np.maximum((tables - low).max(axis=(0, 1)), 1e-30) / 255
    return np.rint((tables - low) / step).astype(np.int16), step, low.sum(axis=(0, 1))


def scan(book: Codebook, queries: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """queries x rows: rounded table sums, larger for larger products."""
    return _sums(_tables(book, queries)[0], packed)


def _sums(eight: np.ndarray, packed: np.ndarray) -> np.ndarray:
    out = np.zeros((packed.shape[0], eight.shape[2]), dtype=np.int16 if packed.shape[1] * 510 < 32767 else np.int32)
    for b in range(packed.shape[1]):
        pair = (eight[2 * b][:, None, :] + eight[2 * b + 1][None, :, :]).reshape(256, -1)
        out += pair[packed[:, b]]
    return out.T


def cosines(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """queries (q x d) against rows (q x r x d), in double precision, summed in component order."""
    dot, a, b = np.zeros(rows.shape[:2]), np.zeros((len(queries), 1)), np.zeros(rows.shape[:2])
    for j in range(queries.shape[1]):
        x, y = queries[:, j, None], rows[:, :, j]
        dot += x * y
        a += x * x
        b += y * y
    return dot / (np.sqrt(a) * np.sqrt(b))


class _Reach:
    """Which rows of a cell may have a cosine of at least some value, by their codes' table sums alone.

    With the angle a between a row and its quantised form, b between that and the query, and g of the value,
    the row's angle to the query is at least b - a, so the row is out if cos b < cos(a + g).
    """

    def __init__(self, book: Codebook, units: np.ndarray, packed: np.ndarray):
        codes = unpack_codes(packed)
        quantised = book.centres[np.arange(codes.shape[1]), codes]
        self.length = np.sqrt((quantised * quantised).sum(axis=(1, 2)))
        along = (quantised * _parts(units)).sum(axis=(1, 2)) / np.maximum(self.length, 1e-30)
        self.angle = np.arccos(np.clip(along, -1, 1))
        self.parts = codes.shape[1]

    def rows(self, sums: np.ndarray, step: float, low: float, value: float) -> np.ndarray:
        # an entry is rounded by half a step at most
        product = low + step * (sums + self.parts / 2) + 1e-6
        most = np.minimum(self.angle + math.acos(min(max(value, -1.0), 1.0)), math.pi)
        return np.flatnonzero(product >= self.length * np.cos(most))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Each row times a power of two that brings its largest component near one: exact, and squares stay in range."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) if len(x) else x


def _matrix(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def _encoder(book: Codebook, d: int):
    def run(batches):
        for batch in batches:
            if len(batch):
                packed = pack_codes(book.encode(_unit(_matrix(batch.column(1), d))))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in packed], pa.binary())], names=["id", "v", "codes"])

    return run


def _cell(book: Codebook, d: int, best: int, shortlist: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(rows) or not len(queries):
            return schema.empty_table()
        rows = rows.sort_by("id")  # ties of the scan go to smaller ids
        ids, x = rows.column("id").to_numpy(), _scaled(_matrix(rows.column("v"), d))
        packed = np.frombuffer(b"".join(rows.column("codes").to_pylist()), dtype=np.uint8).reshape(len(ids), -1)
        qids, q = queries.column("id").to_numpy(), _scaled(_matrix(queries.column("v"), d))
        units = _unit(x)
        reach = _Reach(book, units, packed)
        n, out = len(ids), []
        together = max(1, min(128, COMPONENTS // (max(shortlist, best) * d)))
        for a in range(0, len(q), together):
            mine, own = q[a : a + together], qids[a : a + together]
            mine_units = _unit(mine)
            eight, step, low = _tables(book, mine_units)
            sums = _sums(eight, packed)
            key = sums.astype(np.int64) * n + np.arange(n - 1, -1, -1)
            key[ids[None, :] == own[:, None]] = -1  # not its own row
            take = min(max(shortlist, best), n)
            at = np.argpartition(-key, take - 1, axis=1)[:, :take]
            score = cosines(mine, x[at])
            score[np.take_along_axis(key, at, axis=1) < 0] = -np.inf
            del key
            # the best-th score of the shortlist is what a row must reach
            worst = np.partition(score, take - best, axis=1)[:, take - best] if take >= best else np.full(len(mine), -np.inf)
            for k in range(len(mine)):
                near = reach.rows(sums[k], step[k], low[k], worst[k])
                near = near[ids[near] != own[k]]
                # products in any order of summation, then those near the cut in the order of ``cosines``
                product = units[near] @ mine_units[k]
                if len(near) > best:
                    near = near[product >= np.partition(product, -best)[-best] - 1e-9]
                exact = cosines(mine[k : k + 1], x[None, near])[0]
                order = np.lexsort((ids[near], -exact))[:best]
                out.append((np.full(len(order), own[k]), ids[near][order], exact[order]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)]
        return pa.table([pa.array(c) for c in cols], schema=schema)

    return run


def _sound(v: Column) -> Column:
    """No null and no infinite or NaN component, and not all zero."""
    ok = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return v.isNotNull() & F.coalesce(ok, F.lit(False)) & F.exists(v, lambda c: c != 0)


def nearest(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", best: int = 5, shortlist: int = SHORTLIST) -> DataFrame:
    """The ``best`` rows of largest cosine for every row that ``is_query`` marks: query_id, rank, vec_id, score.

    Defined cases: vectors that are null, zero, empty, or hold null or non-finite components take no part, nor
    do rows with a null id; vectors meet those of their own dimension; a repeated row counts once; different
    vectors under one id are all candidates, never for that id itself; components whose squares leave the range of
    doubles count like any other; ties go to the smaller id; fewer
    candidates than ``best`` give fewer rows; an empty table gives none.  Other columns are ignored.
    """
    spark = vectors.sparkSession
    kind = vectors.select(F.col(f"`{vector_col}`").alias("v")).schema["v"].dataType
    kind = "float" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "double"  # floats travel as they are
    v = F.col(f"`{vector_col}`").cast(f"array<{kind}>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v"), is_query.alias("q")).where(F.col("id").isNotNull() & _sound(F.col("v")))
    rows = rows.dropDuplicates(["id", "v"])
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("q")).alias("q")).orderBy("d").collect()
    found = spark.createDataFrame([], _FOUND)
    for d, n, q in sizes:
        if not q:
            continue
        own = rows.where(F.size("v") == d)
        draw = F.pmod(F.xxhash64("id", "v", F.lit("train")), F.lit(1 << 30)) / float(1 << 30)
        learned = min(TRAIN, max(256, COMPONENTS // (4 * d)))
        sample = own.where(draw < learned / n).select("id", "v").limit(2 * learned).collect() or own.select("id", "v").limit(learned).collect()
        book = fit(np.array([r[1] for r in sorted(sample)], dtype=np.float64))
        size = min(MOST_ROWS, max(256, CELL_BYTES // (8 * d)), max(ROWS, int(math.sqrt(n) * 4)))
        row_blocks, query_blocks = -(-n // size), -(-q // min(MOST_QUERIES, max(QUERIES, size // 4)))
        codes = own.select("id", "v").mapInArrow(_encoder(book, d), f"id long, v array<{kind}>, codes binary")
        # blocks are drawn by id and vector, so not even the vectors of one id share a block
        block = lambda n, salt: F.pmod(F.xxhash64("id", "v", F.lit(salt)), F.lit(n)).cast("int")
        left = codes.select("*", block(row_blocks, "row").alias("rb"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"))
        right = own.where("q").select("id", "v", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("rb"), block(query_blocks, "query").alias("qb"))
        found = found.unionByName(left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInArrow(_cell(book, d, best, shortlist), _FOUND))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best).select("query_id", "rank", "vec_id", "score")


def op4_vector_search(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


SQL = """
WITH e AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(c.v, c.v))) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
