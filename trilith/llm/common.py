"""Shared pieces: scratch tables, word and window hashes, packed blocks that travel between tasks."""

from __future__ import annotations

import gc
import itertools
import tempfile
import time
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

U64 = np.uint64
#: An odd multiplier: what stands left counts other than what stands right.
LEFT = U64(0x9E3779B97F4A7C15)
#: Bytes of text that a task hashes at once; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 21
NULL_ID = -(1 << 63)


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """The shared folder in spark.checkpoint.dir; where the session names none, one on this machine, in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix=f"trilith-{purpose}-")
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder, so a lost executor costs no recomputation."""
    sc = df.sparkSession.sparkContext
    if not (df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()):
        sc.setCheckpointDir(shared_folder(df.sparkSession, "checkpoint"))
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that nothing refers to any more.

    It acts when the driver collects garbage, which on a quiet driver comes long after the disks are full. What Python lets
    go of is unbound on the other side a moment later, so a first round alone frees little.
    """
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.7)


def partitions_for(total: int, each: int, least: int = 16) -> int:
    """Buckets so that each holds about `each` units; grows with the data without a limit."""
    return max(least, -(-int(total or 0) // each))


def total_chars(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0


def with_key(docs: DataFrame) -> DataFrame:
    """doc_id, key_id, key_hash, text: rows that repeat a doc_id with another text stay apart; a null text is empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("key_id"), F.xxhash64(text).alias("key_hash"), text.alias("text"))


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, in place."""
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


#: Random numbers for each byte at each of the first places of a word; sums of them are the hashes of words.
PLACES = 64
_VALUES = tuple(mix(np.arange(PLACES << 8, dtype=U64) * LEFT + U64(seed)) for seed in (0x243F6A8885A308D3, 0x13198A2E03707344))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of some texts: a hash and a document index each."""

    def __init__(self, texts: list[bytes], lower: bool = False) -> None:
        joined = b"\n".join(texts) + b"\n"
        if lower:
            joined = joined.lower()
        self.joined = joined
        self.buf = np.frombuffer(joined, np.uint8)
        word = ~_SPACE[self.buf]
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        if word[0]:
            edge = np.concatenate([np.zeros(1, edge.dtype), edge])
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.hash = self.hashed(0)
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.doc = (np.searchsorted(np.cumsum(sizes), self.starts, "right")).astype(np.int32)
        self.count = np.bincount(self.doc, minlength=len(texts)).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.count)[:-1]]).astype(np.int64)

    def hashed(self, which: int) -> np.ndarray:
        """The hash of each word by the first or the second table of random numbers, independent of one another.

        Works through runs of words of some bytes each, so that a long text needs little more memory than its words.
        """
        values, size = _VALUES[which], self.ends - self.starts
        out = size.astype(U64) * U64(0xA0761D6478BD642F)
        total = np.concatenate([[0], np.cumsum(size)])
        cuts = np.unique(np.searchsorted(total, np.arange(0, total[-1] + CHUNK_BYTES, CHUNK_BYTES)).clip(0, len(size)))
        for a, b in zip(cuts[:-1], cuts[1:]):
            each, first = size[a:b], total[a:b] - total[a]
            place = np.arange(total[b] - total[a], dtype=np.int32) - np.repeat(first.astype(np.int32), each)
            raw = self.buf[self.starts[a] : self.ends[b - 1]]
            terms = values[(place & (PLACES - 1)) << 8 | raw[~_SPACE[raw]]]
            if each.max() > PLACES:
                late = np.flatnonzero(place >= PLACES)
                terms[late] = mix(terms[late] ^ (place[late] // PLACES).astype(U64) * LEFT)
            out[a:b] += np.add.reduceat(terms, first)
        return mix(out)


    def spaced(self, keep: np.ndarray | None = None) -> tuple[bytes, np.ndarray]:
        """The words (those to keep) with one space after each, and where each begins there, with the end of all."""
        size = self.ends - self.starts
        if keep is None:
            raw = self.buf[~_SPACE[self.buf]]
        else:
            raw = self.buf[~_SPACE[self.buf]][np.repeat(keep, size)]
            size = size[keep]
        at = np.concatenate([[0], np.cumsum(size + 1)])
        out = np.full(at[-1], 0x20, np.uint8)
        word = np.ones(at[-1], bool)
        word[at[1:] - 1] = False
        out[word] = raw
        return out.tobytes(), at


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive entries, len(h) - k + 1 of them: halves are mixed into one, by doubling."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out, at, size, level = None, 0, 1, h
    while True:
        if k & size:
            part = level[at : at + n]
            out, at = part if out is None else mix(out * LEFT + part), at + size
        if 2 * size > k:
            return out.copy() if out.base is not None else out
        level = mix(level[:-size] * LEFT + level[size:])
        size *= 2


def chunks(batches: Iterable[pa.RecordBatch], most: int = CHUNK_BYTES) -> Iterator[tuple[list[pa.RecordBatch], list[bytes]]]:
    """Runs of rows with about `most` bytes of text: their columns but the last, and the text (the last column) as bytes."""
    for batch in batches:
        text = batch.column(batch.num_columns - 1)
        sizes = np.asarray(pc.fill_null(pc.binary_length(text), 0))
        at = 0
        while at < batch.num_rows:
            upto = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), most, "right")))
            part = batch.slice(at, upto - at)
            yield part, part.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()
            at = upto


def planes(a: np.ndarray) -> bytes:
    """Bytes of equal weight side by side: sorted numbers then compress."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes() if len(a) else b""


def unplanes(b: bytes, dtype: type) -> np.ndarray:
    n = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(n, -1).T).view(dtype).ravel() if b else np.zeros(0, dtype)


def packed_sorted(a: np.ndarray) -> bytes:
    """Sorted numbers as their differences: the fewer bytes that aren't zero, the denser they lie."""
    return planes(np.diff(a, prepend=a.dtype.type(0))) if len(a) else b""


def unpacked_sorted(b: bytes, dtype: type) -> np.ndarray:
    return np.cumsum(unplanes(b, dtype), dtype=dtype)


def keys_of(part: pa.RecordBatch) -> np.ndarray:
    """Two columns of whole numbers, key_id and key_hash, as one array of pairs."""
    return np.stack([np.asarray(part.column("key_id")), np.asarray(part.column("key_hash"))], axis=1).astype(np.int64)


BLOCK = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("kind", pa.int32()), *((c, pa.binary()) for c in "abcd")])
BLOCK_DDL = "bucket long, chunk long, kind int, a binary, b binary, c binary, d binary"


def blocks(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of BLOCK; the last fields may be missing."""
    cols = zip(*(r + (None,) * (7 - len(r)) for r in rows)) if rows else [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, BLOCK)], schema=BLOCK)


def chunk_ids() -> Iterator[int]:
    """Numbers for the chunks of the task's partition, unlike those of other partitions and the same when a lost task runs again."""
    return itertools.count(TaskContext.get().partitionId() << 32)


def own_bucket(chunk: int) -> int:
    """A negative bucket for what a chunk keeps of itself, so that such rows spread."""
    return -1 - int(mix(np.array([chunk], U64))[0] >> U64(2))


def bucket_bounds(n: int) -> np.ndarray:
    """Hashes at which the buckets 1 to n - 1 begin."""
    return np.array([(i << 64) // n for i in range(1, n)], U64)


def runs(sorted_: np.ndarray) -> np.ndarray:
    """Where runs of equal entries begin."""
    return np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(sorted_) else np.zeros(0, np.int64)


def column(name: str) -> Column:
    """The column of exactly that name."""
    return F.col("`" + name.replace("`", "``") + "`")


def schema(docs: DataFrame, names: list[str], **more: str) -> StructType:
    """Columns of docs, and further ones by name and type."""
    fields = [StructField(n, docs.schema[n].dataType) for n in names]
    return StructType([*fields, *(StructField(n, StructType.fromDDL(f"x {t}")[0].dataType) for n, t in more.items())])


def crc32_mod4_is_2(c: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
