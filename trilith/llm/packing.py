"""Operator 6, packing by power-of-two decomposition.

A document's ids are cut into pieces of binary length: as many of the greatest length as fit, then one for each bit
of the rest, longest first. A piece is a sequence of its own, and sequences of equal length form a bucket, so batches
of one length need no padding and no sequence crosses documents.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, read, schema

LENGTH, END_ID = 2048, 1

_tokenizers: dict[str, object] = {}


def tokenizer(name: str):
    """The ids of texts by a byte-level BPE file of `tokenizers`, its special tokens recognised.

    The same vocabulary is kept as ranks for tiktoken, which gives the same ids (a test compares them) four times as
    fast; a file without such a twin is read by `tokenizers` itself.
    """
    if name not in _tokenizers:
        import public_tokenizers

        try:
            twin = public_tokenizers.path(name.removesuffix(".json") + ".tiktoken")
            lines = open(twin, "rb").read().splitlines()
        except (OSError, KeyError, ValueError):
            lines = None
        if lines:
            import tiktoken

            special = {x["content"]: x["id"] for x in json.load(open(public_tokenizers.path(name)))["added_tokens"]}
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            own = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
            _tokenizers[name] = lambda text: own.encode(text, allowed_special="all")
        else:
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(public_tokenizers.path(name))
            _tokenizers[name] = lambda text: own.encode(text, add_special_tokens=False).ids
    return _tokenizers[name]


def pieces(n: int, length: int) -> list[int]:
    """n as a sum of powers of two, none above length (itself one), the longest first."""
    rest = n % length
    return [length] * (n // length) + [1 << b for b in reversed(range(length.bit_length())) if rest >> b & 1]


def _pack(name: str, length: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, seq = tokenizer(name), TaskContext.get().partitionId() << 40
        for part, texts in chunks(batches, 1 << 20):
            row, cols, kept = [], [[] for _ in range(5)], []
            for i, text in enumerate(texts):
                ids = np.array([*encode(text.decode()), end_id], "<u4")
                raw, start = memoryview(ids).cast("B"), 0
                for size in pieces(len(ids), length):
                    cut = raw[4 * start : 4 * (start + size)]
                    row.append(i)
                    for col, x in zip(cols, (start, size, zlib.crc32(cut), len(ids), seq)):
                        col.append(x)
                    if with_ids:
                        kept.append(bytes(cut))
                    start, seq = start + size, seq + 1
            docs = part.column("doc_id").take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([docs, *(pa.array(c, pa.int64()) for c in cols), pa.array(np.zeros(len(row), np.int64)), pa.array(kept if with_ids else [None] * len(row), pa.binary())], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    return run


def bucketed(pieces: DataFrame) -> DataFrame:
    """The same rows dealt out by length, so that sequences of a length lie together, and batches of one length need no padding.

    A length that a third of all sequences have is split over tasks by their sizes, and rare lengths share one.
    """
    dealt = pieces.sparkSession.sql("SELECT /*+ REBALANCE(length) */ * FROM {pieces}", pieces=pieces)
    return dealt.sortWithinPartitions("length", "sequence_id")


def pack(docs: DataFrame, name: str = "byte_bpe_50k.json", length: int = LENGTH, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (little-endian uint32).

    Each document's ids, ended by end_id, are cut into pieces of binary length up to `length` (a power of two), each a
    sequence of its own: sequence_id is unique, offset 0. A null or empty text is the end id alone. Rows that repeat a
    doc_id are documents of their own; a null doc_id stays null; other columns are ignored; no rows, no pieces. Rows come
    in buckets of equal length.
    """
    if length < 1 or length & (length - 1):
        raise ValueError("length must be a power of two")
    kept = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_pack(name, length, end_id, with_ids), schema(docs, ["doc_id"], start="long", length="long", ids_crc32="long", doc_tokens="long", sequence_id="long", offset="long", ids="binary"))
    return bucketed(kept if with_ids else kept.drop("ids"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), with_ids=False)
