"""Buckets: how a corpus is cut so that packed hash sets can meet, and where intermediate tables go.

Two corpora-wide questions ("does this hash occur elsewhere?", "in how many documents?") are asked the same
way.  Documents lie in text buckets; each bucket sends its sorted distinct hashes, cut by hash range, to the
hash buckets; a hash bucket sees each hash once per text bucket at most, however hot it is, and answers with
one bit or one number per hash, in the order in which it was asked.  Rows between the two are packed arrays,
so there are (text buckets x hash buckets) rows, not one per hash, and an answer needs no key.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text in a bucket, at least and at most, and the packed bytes that a pair of buckets should exchange.
LEAST_BYTES, MOST_BYTES, PAIR_BYTES = 4 << 20, 128 << 20, 3000


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def corpus_size(df: DataFrame, text: str) -> tuple[int, int]:
    """Rows and bytes of text: one row comes to the driver."""
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    return n, size


def bucket_count(spark: SparkSession, size: int) -> int:
    """Buckets grow with the corpus, and so does each, up to what one Python worker holds with ease."""
    n = max(size / MOST_BYTES, min(size / LEAST_BYTES, math.sqrt(size / PAIR_BYTES)))
    return max(1, math.ceil(n), shuffle_partitions(spark))


def hash_bucket(hashes: np.ndarray, n: int) -> np.ndarray:
    """Equal ranges of the 64-bit hashes: ascending hashes have ascending buckets."""
    return ((hashes >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def cut_by_bucket(ordered: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of every bucket that has some of the ascending hashes."""
    if not len(ordered):
        return []
    b = hash_bucket(ordered, n).astype(np.int64)
    at = np.flatnonzero(np.diff(b, prepend=-1))
    return list(zip(b[at].tolist(), at.tolist(), [*at[1:].tolist(), len(b)], strict=True))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; set here only where nothing is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        context = spark.sparkContext._jsc.sc().getCheckpointDir()
        if context.isDefined():
            return context.get()
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "/tmp/graphemica-checkpoints"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write a table into the shared folder and read it: lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing will read again."""
    for df in tables:
        session, path = df.sparkSession, df._written_to
        where = session._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(session._jsc.hadoopConfiguration()).delete(where, True)
