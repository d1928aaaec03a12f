"""Operator 5, substring dedup by de Bruijn compaction.

Edges are windows of `length` consecutive words, nodes their (length - 1)-word overlaps. The steps:

1. Seeds: of every window the least hashed `seed`-word mer is its seed; equal windows have equal seeds, and there are
   few seeds. Seeds are counted over the corpus; a window whose seed stands once is not repeated.
2. Edges: the windows left meet by 96 bits of hashes. Each repeated edge learns whether all its places agree on the word
   before it and the word after it, that is, whether a path forks there.
3. Compaction: repeated edges that follow one another without a fork are one path. Where a path lies in a document are
   its source coordinates.
4. Verification: the words of every path are read at its source coordinates, and a path is repeated where two places
   hold the same words (a 128-bit BLAKE2 digest of them). All places of a nonbranching path do, unless different words
   had equal hashes; the windows of such a path are then compared one by one, words with words, so hashes never decide.
5. The words under what is verified go.

Both counts deal hash ranges out to tasks; what a chunk of documents holds several times travels once with a count,
so a passage that a third of all documents share floods no task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLOCK_DDL, NULL_ID, U64, Words, blocks, bucket_bounds, checkpointed, chunk_ids, chunks, column, keys_of, own_bucket, packed_sorted, partitions_for, planes, read, release, schema, total_chars, unpacked_sorted, unplanes, window_hashes, with_key

RANGE_CHARS = 1 << 23
#: Entries of the exchange: hash, second hash, word before, word after.
EDGE = np.dtype([("h", "u8"), ("check", "u4"), ("before", "u4"), ("after", "u4")])
#: Stands for words that differ from place to place.
FORK = np.uint32(0xFFFFFFFF)
FORKS_BEFORE, FORKS_AFTER = 1, 2
#: Bits of a bitmap of window hashes.
FILTER = 1 << 15


def seed_places(words: Words, length: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(start of each window, place of its seed), as word numbers in the chunk."""
    n = len(words.hash)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(words.doc[: n - length + 1] == words.doc[length - 1 :])
    mers = window_hashes(words.hash, seed)
    wide = length - seed + 1
    # the place of the least of `wide` hashes, by doubling; the first of equals
    place, reach = np.arange(len(mers)), 1

    def least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(mers[b] < mers[a], b, a)

    while reach * 2 <= wide:
        place = least(place[:-reach], place[reach:])
        reach *= 2
    if reach < wide:
        place = least(place[: len(mers) - wide + 1], place[wide - reach :][: len(mers) - wide + 1])
    return starts, place[starts]


def _pack(me: int, keys: np.ndarray, words: Words, edge: np.ndarray, ref: np.ndarray, ranges: int, bounds: np.ndarray) -> pa.RecordBatch:
    """kind 0: entries that stand once in the chunk, with their places; 1: entries that stand more often, with counts;
    2: the chunk's documents, and the places of the entries of kind 1."""
    order = np.lexsort((edge["check"], edge["h"]))
    edge, ref = edge[order], ref[order].astype(np.uint32)
    new = np.ones(len(edge), bool)
    new[1:] = (edge["h"][1:] != edge["h"][:-1]) | (edge["check"][1:] != edge["check"][:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(edge)))
    alone = np.repeat(count == 1, count)
    table = np.concatenate([keys, words.first[:, None], words.count[:, None]], axis=1)
    local = ~alone
    several, n_several = edge[at[count > 1]].copy(), count[count > 1].astype(np.uint32)
    out = [(own_bucket(me), me, 2, table.tobytes(), n_several.tobytes(), ref[local].tobytes())]
    if len(several):
        for side in ("before", "after"):
            low, high = np.minimum.reduceat(edge[side], at)[count > 1], np.maximum.reduceat(edge[side], at)[count > 1]
            several[side] = np.where(low == high, low, FORK)
    edge, ref = edge[alone], ref[alone]
    for kind, e, x in ((0, edge, ref), (1, several, n_several)):
        cut = np.concatenate([[0], np.searchsorted(e["h"], bounds), [len(e)]])
        out += [(b, me, kind, packed_sorted(e["h"][s]), planes(np.ascontiguousarray(e["check"][s])), planes(np.concatenate([e["before"][s], e["after"][s]])), planes(x[s])) for b in range(ranges) if cut[b] < cut[b + 1] for s in [slice(cut[b], cut[b + 1])]]
    return blocks(out)


def _deal_seeds(length: int, seed: int, ranges: int):
    bounds = bucket_bounds(ranges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for me, (part, texts) in zip(chunk_ids(), chunks(batches)):
            words = Words(texts)
            ref = np.unique(seed_places(words, length, seed)[1])
            edge = np.zeros(len(ref), EDGE)
            edge["h"] = window_hashes(words.hash, seed)[ref]
            yield _pack(me, keys_of(part), words, edge, ref, ranges, bounds)

    return run


def _windows(words: Words, length: int, bits: int) -> np.ndarray:
    return window_hashes(words.hash, length) & U64((1 << bits) - 1)


def _deal_edges(length: int, seed: int, ranges: int, bits: int):
    bounds = bucket_bounds(ranges) >> U64(64 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for me, (part, texts) in zip(chunk_ids(), chunks(batches)):
            words = Words(texts)
            starts, place = seed_places(words, length, seed)
            seeds = np.concatenate([np.frombuffer(x, np.uint32).astype(np.int64) + f for x, f in zip(part.column("places").to_pylist(), words.first)])
            known = np.zeros(len(words.hash) + 1, bool)
            known[seeds] = True
            ref = starts[known[place]]
            edge = np.zeros(len(ref), EDGE)
            edge["h"] = _windows(words, length, bits)[ref]
            if bits > 32:
                edge["check"] = window_hashes(words.hashed(1), length)[ref] >> U64(32)
            # the words around a window; 0 is the edge of a document
            around = np.concatenate([[0], 1 + words.hash % U64(0xFFFFFFFE), [0]]).astype(np.uint32)
            doc = np.concatenate([[-1], words.doc, [-1]])
            mine = words.doc[ref]
            edge["before"] = np.where(doc[ref] == mine, around[ref], 0)
            edge["after"] = np.where(doc[ref + length + 1] == mine, around[ref + length + 1], 0)
            yield _pack(me, keys_of(part), words, edge, ref, ranges, bounds)

    return run


def _count(group: pa.Table) -> pa.Table:
    """One range: entries that stand more than once return to their chunks, with what forks there."""
    rows = group.to_pylist()
    if rows[0]["kind"] == 2:
        return group
    sizes = [len(r["b"]) // 4 for r in rows]
    edge = np.zeros(sum(sizes), EDGE)
    edge["h"] = np.concatenate([unpacked_sorted(r["a"], U64) for r in rows])
    edge["check"] = np.concatenate([unplanes(r["b"], np.uint32) for r in rows])
    around = np.concatenate([unplanes(r["c"], np.uint32).reshape(2, -1) for r in rows], axis=1)
    n = np.concatenate([np.ones(s, np.int64) if r["kind"] == 0 else unplanes(r["d"], np.uint32) for s, r in zip(sizes, rows)])
    order = np.lexsort((edge["check"], edge["h"]))
    new = np.ones(len(edge), bool)
    h, check = edge["h"][order], edge["check"][order]
    new[1:] = (h[1:] != h[:-1]) | (check[1:] != check[:-1])
    at = np.flatnonzero(new)
    flags = np.zeros(len(at), np.uint8)
    for bit, side in ((FORKS_BEFORE, around[0]), (FORKS_AFTER, around[1])):
        low, high = np.minimum.reduceat(side[order], at), np.maximum.reduceat(side[order], at)
        flags |= np.where((low != high) | (high == FORK), bit, 0).astype(np.uint8)
    flags[np.add.reduceat(n[order], at) < 2] = 255
    back = np.empty(len(edge), np.uint8)
    back[order] = np.repeat(flags, np.diff(np.append(at, len(edge))))
    out, start = [], 0
    for size, r in zip(sizes, rows):
        f = back[start : start + size]
        some = f != 255
        if some.any() and r["kind"] == 0:
            out.append((0, r["chunk"], 0, None, None, f[some].tobytes(), planes(unplanes(r["d"], np.uint32)[some])))
        elif some.any():
            out.append((r["bucket"], r["chunk"], 1, None, None, f.tobytes()))
        start += size
    return pa.Table.from_batches([blocks(out)])


PLACES = pa.schema([("key_id", pa.int64()), ("key_hash", pa.int64()), ("places", pa.binary()), ("forks", pa.binary())])
PLACES_DDL = "key_id long, key_hash long, places binary, forks binary"


def _places(group: pa.Table) -> pa.Table:
    """One chunk: of each document that has any, the word numbers of repeated entries and what forks there."""
    rows = group.to_pylist()
    me = next((r for r in rows if r["kind"] == 2), None)
    if me is None:
        raise ValueError("a chunk came without its documents: the input has to give the same rows in the same order each time it is read; checkpoint it first")
    table = np.frombuffer(me["a"], np.int64).reshape(-1, 4)
    count, who = np.frombuffer(me["b"], np.uint32), np.frombuffer(me["c"], np.uint32)
    single = [r for r in rows if r["kind"] == 0]
    # flags return by range in the order of the hashes, as the chunk has its places
    known = b"".join(r["c"] for r in sorted((r for r in rows if r["kind"] == 1), key=lambda r: r["bucket"]))
    own_flags = np.repeat(np.frombuffer(known, np.uint8), count)
    ref = np.concatenate([who, *(unplanes(r["d"], np.uint32) for r in single)]).astype(np.int64)
    flags = np.concatenate([own_flags, *(np.frombuffer(r["c"], np.uint8) for r in single)])
    order = np.argsort(ref)
    ref, flags = ref[order], flags[order]
    first, end = np.searchsorted(ref, table[:, 2]), np.searchsorted(ref, table[:, 2] + table[:, 3])
    some = np.flatnonzero(first < end)
    places = [(ref[first[i] : end[i]] - table[i, 2]).astype(np.uint32).tobytes() for i in some]
    forks = [flags[first[i] : end[i]].tobytes() for i in some]
    return pa.Table.from_arrays([pa.array(table[some, 0]), pa.array(table[some, 1]), pa.array(places, pa.binary()), pa.array(forks, pa.binary())], schema=PLACES)


def compacted(places: bytes, forks: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First windows and numbers of windows of a document's nonbranching repeated paths."""
    at, f = np.frombuffer(places, np.uint32).astype(np.int64), np.frombuffer(forks, np.uint8)
    if not len(at):
        return at, at
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (f[1:] & FORKS_BEFORE > 0) | (f[:-1] & FORKS_AFTER > 0)
    first = np.flatnonzero(new)
    return at[first], np.diff(np.append(first, len(at)))


def _paths(length: int):
    """Documents with the places of repeated edges -> their paths: pairs of first window and number of windows, and a digest of the words each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            words = Words(texts)
            raw, at = words.spaced()
            paths, digests = [], []
            for first, places, forks in zip(words.first.tolist(), part.column("places").to_pylist(), part.column("forks").to_pylist()):
                start, size = compacted(places, forks)
                paths.append(np.stack([start, size], axis=1).astype(np.uint32).tobytes())
                ends = zip(at[first + start].tolist(), (at[first + start + size + length - 1] - 1).tolist())
                digests.append(b"".join(hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in ends))
            yield pa.RecordBatch.from_arrays([part.column("key_id"), part.column("key_hash"), pa.array(paths, pa.binary()), pa.array(digests, pa.binary())], names=["key_id", "key_hash", "paths", "digests"])

    return run


PATHS_DDL = "key_id long, key_hash long, paths binary, digests binary"


def _deal_digests(ranges: int):
    """Rows of _paths -> blocks of digests by range, each digest of a batch once, and whether it stands there more than once."""
    bounds = bucket_bounds(ranges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                digest, count = _distinct(np.frombuffer(b"".join(batch.column("digests").slice(at, 4096).to_pylist()), ">u8").reshape(-1, 2).astype(U64))
                cut = np.concatenate([[0], np.searchsorted(digest[:, 0], bounds), [len(digest)]])
                yield blocks([(int(i), 0, 0, digest[cut[i] : cut[i + 1]].tobytes(), (count[cut[i] : cut[i + 1]] > 1).tobytes()) for i in np.flatnonzero(cut[1:] > cut[:-1])])

    return run


def _distinct(digest: np.ndarray, many: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Digests in order, and how often each stands; those that stood more than once before count twice."""
    order = np.lexsort((digest[:, 1], digest[:, 0]))
    digest, n = digest[order], np.ones(len(digest), np.int64) if many is None else 1 + many[order].astype(np.int64)
    new = np.ones(len(digest), bool)
    new[1:] = (digest[1:] != digest[:-1]).any(axis=1)
    at = np.flatnonzero(new)
    return digest[at], np.add.reduceat(n, at) if len(at) else n


def _single(group: pa.Table) -> pa.Table:
    """One range: the digests that stand once."""
    rows = group.to_pylist()
    digest, count = _distinct(np.concatenate([np.frombuffer(r["a"], U64) for r in rows]).reshape(-1, 2), np.concatenate([np.frombuffer(r["b"], bool) for r in rows]))
    once = digest[count == 1]
    return pa.Table.from_batches([blocks([(0, 0, 0, once.astype(">u8").tobytes())] if len(once) else [])])


def _one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = b"".join(batch.column("a").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([raw[i : i + 16] for i in range(0, len(raw), 16)], pa.binary())], names=["digest"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _paths -> a row for each path."""
    for batch in batches:
        paths, digests = batch.column("paths").to_pylist(), batch.column("digests").to_pylist()
        row = np.repeat(np.arange(len(paths)), [len(p) // 8 for p in paths])
        pair = np.frombuffer(b"".join(paths), np.uint32).reshape(-1, 2).astype(np.int64)
        digest = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(row), [None, pa.py_buffer(b"".join(digests))]).cast(pa.binary())
        keys = (batch.column(c).take(pa.array(row, pa.int64())) for c in ("key_id", "key_hash"))
        yield pa.RecordBatch.from_arrays([*keys, pa.array(pair[:, 0]), pa.array(pair[:, 1]), digest], names=["key_id", "key_hash", "start", "size", "digest"])


DIGESTS_DDL = "key_id long, key_hash long, start long, size long, digest binary"


def _each_window(length: int, bits: int, seen: bytes | None):
    """Documents with paths -> windows of the paths, with a digest of their words; with `seen` only those whose hash is in that bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            words = Words(texts)
            raw, at = words.spaced()
            h = _windows(words, length, bits)
            for i, (first, paths) in enumerate(zip(words.first.tolist(), part.column("paths").to_pylist())):
                pair = np.frombuffer(paths, np.uint32).reshape(-1, 2).astype(np.int64)
                window = np.concatenate([np.zeros(0, np.int64), *(np.arange(s, s + n) for s, n in pair)])
                if seen is not None:
                    bit = h[first + window] % U64(FILTER)
                    window = window[np.unpackbits(np.frombuffer(seen, np.uint8), bitorder="little")[bit] > 0]
                digest = [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(at[first + window].tolist(), (at[first + window + length] - 1).tolist())]
                keys = (pa.array(np.full(len(window), part.column(c)[i].as_py(), np.int64)) for c in ("key_id", "key_hash"))
                yield pa.RecordBatch.from_arrays([*keys, pa.array(window), pa.array((h[first + window] % U64(FILTER)).astype(np.int64)), pa.array(digest, pa.binary())], names=["key_id", "key_hash", "window", "bit", "digest"])

    return run


WINDOWS_DDL = "key_id long, key_hash long, window long, bit long, digest binary"


class Repeats:
    """What is repeated in docs: source coordinates of nonbranching paths, and the windows in them that no other words equal."""

    def __init__(self, docs: DataFrame, length: int, seed: int | None, range_chars: int, bits: int) -> None:
        if length < 2:
            raise ValueError("length must be at least 2")
        self.ranges = partitions_for(total_chars(docs), range_chars)
        keyed = with_key(docs.select("doc_id", "text")).select("key_id", "key_hash", "text")
        #: a row for each row of docs that has any
        self.paths = self.found(keyed, length, seed or max(1, length * 4 // 7), bits)
        # nothing refers to those exchanges any more
        release(docs.sparkSession)
        self.digests = self.paths.mapInArrow(_digests, DIGESTS_DDL)
        once = checkpointed(self.paths.mapInArrow(_deal_digests(self.ranges), BLOCK_DDL).groupBy("bucket").applyInArrow(_single, BLOCK_DDL))
        #: key_id, key_hash, windows: those that stand once after all; None if hashes told no lie
        self.single: DataFrame | None = None
        if not once.isEmpty():
            suspect = self.digests.join(once.mapInArrow(_one_by_one, "digest binary"), "digest").select("key_id", "key_hash")
            each = lambda rows, seen: keyed.join(rows, ["key_id", "key_hash"]).select("key_id", "key_hash", "paths", "text").mapInArrow(_each_window(length, bits, seen), WINDOWS_DDL)
            whole = self.paths.dropDuplicates(["key_id", "key_hash"])
            suspects = checkpointed(each(whole.join(suspect.distinct(), ["key_id", "key_hash"], "left_semi"), None))
            seen = bytes(suspects.select(F.bitmap_construct_agg("bit")).first()[0])
            counts = each(whole, seen).groupBy("digest").agg(F.count("*").alias("n")).where("n = 1").select("digest")
            single = suspects.join(counts, "digest").groupBy("key_id", "key_hash").agg(F.collect_set("window").alias("single"))
            self.single = checkpointed(single)

    def found(self, keyed: DataFrame, length: int, seed: int, bits: int) -> DataFrame:
        dealt = keyed.repartition(self.ranges, "key_id", "key_hash")  # both joins below read the texts from this one exchange

        def exchange(frame: DataFrame, deal) -> DataFrame:
            counted = frame.mapInArrow(deal, BLOCK_DDL).groupBy("bucket").applyInArrow(_count, BLOCK_DDL)
            return counted.groupBy("chunk").applyInArrow(_places, PLACES_DDL).dropDuplicates(["key_id", "key_hash"])

        seeds = exchange(keyed, _deal_seeds(length, seed, self.ranges))
        seeded = dealt.join(seeds, ["key_id", "key_hash"]).select("key_id", "key_hash", "places", "text")
        edges = exchange(seeded, _deal_edges(length, seed, self.ranges, bits))
        joined = dealt.join(edges, ["key_id", "key_hash"]).select("key_id", "key_hash", "places", "forks", "text")
        return checkpointed(joined.mapInArrow(_paths(length), PATHS_DDL))


def _kept(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            words = Words(texts)
            step = np.zeros(len(words.hash) + 1, np.int64)
            for first, paths, single in zip(words.first.tolist(), part.column("paths").to_pylist(), part.column("single").to_pylist()):
                if paths:
                    pair = np.frombuffer(paths, np.uint32).reshape(-1, 2).astype(np.int64)
                    start, size = pair[:, 0] + first, pair[:, 1]
                    if single:
                        start = np.setdiff1d(np.concatenate([np.arange(s, s + n) for s, n in zip(start, size)]), np.array(single) + first)
                        size = np.ones(len(start), np.int64)
                    np.add.at(step, start, 1)
                    np.add.at(step, start + size + length - 1, -1)
            gone = np.cumsum(step[:-1]) > 0
            removed = np.bincount(words.doc[gone], minlength=len(texts)).astype(np.int64)
            raw, at = words.spaced(~gone)
            end = np.cumsum(words.count - removed)
            kept = [raw[a : max(a, b - 1)] for a, b in zip(at[end - words.count + removed].tolist(), at[end].tolist())]
            text = pa.array([k if r else t for k, r, t in zip(kept, removed.tolist(), texts)], pa.binary()).cast(pa.string())
            digest = pa.array([hashlib.sha256(k).hexdigest() for k in kept])
            yield pa.RecordBatch.from_arrays([part.column("carried"), text, pa.array(words.count), pa.array(removed), digest], names=["carried", "text", "n_words", "n_removed", "kept_sha256"])

    return run


def drop_repeats(docs: DataFrame, length: int = 35, seed: int | None = None, range_chars: int = RANGE_CHARS, bits: int = 64) -> DataFrame:
    """docs(doc_id, text, ...) -> the same columns, n_words, n_removed, kept_sha256: one row per row of docs.

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged. Every word under a window of `length` words whose word sequence
    starts anywhere else goes; the words kept are joined by one space, for the digest and, where any went, as the new
    text. A null text counts as empty; a text of fewer words than `length` keeps all; rows that repeat a doc_id, with
    equal texts or others, are documents of their own; a null doc_id stays null; other columns stay (those named as
    the new ones are replaced); an empty table gives an empty result. bits of the first hash of a window: fewer only
    cost time.

    docs has to give the same rows in the same order each time it is read (files or a checkpoint).
    """
    repeats = Repeats(docs, length, seed, range_chars, bits)
    new = ("text", "n_words", "n_removed", "kept_sha256")
    carry = [c for c in docs.columns if c not in new]
    text = F.coalesce(F.col("text"), F.lit(""))
    whole = docs.select(F.struct(*map(column, carry)).alias("carried"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("key_id"), F.xxhash64(text).alias("key_hash"), text.alias("text"))
    paths = repeats.paths.select("key_id", "key_hash", "paths").dropDuplicates(["key_id", "key_hash"])
    if repeats.single is None:
        paths = paths.withColumn("single", F.lit(None).cast("array<bigint>"))
    else:
        paths = paths.join(repeats.single, ["key_id", "key_hash"], "left")
    joined = whole.join(paths, ["key_id", "key_hash"], "left").select("carried", "paths", "single", "text")
    kept = joined.mapInArrow(_kept(length), schema(joined, ["carried", "text"], n_words="long", n_removed="long", kept_sha256="string"))
    return kept.select(*(F.col("text") if c == "text" else F.col("carried").getField(c).alias(c) for c in docs.columns if c in carry or c == "text"), "n_words", "n_removed", "kept_sha256")


def repeated_paths(docs: DataFrame, length: int = 35, seed: int | None = None, range_chars: int = RANGE_CHARS) -> DataFrame:
    """The compacted paths and their coordinates: path (digest of its words), n_words, key_id (doc_id), start, places (of the path)."""
    spans = Repeats(docs, length, seed, range_chars, 64).digests
    many = spans.groupBy("digest").agg(F.count("*").alias("places")).where("places > 1")
    return spans.join(many, "digest").select(F.lower(F.hex("digest")).alias("path"), (F.col("size") + length - 1).alias("n_words"), F.when(F.col("key_id") != NULL_ID, F.col("key_id")).alias("doc_id"), "start", "places")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE_SQL = {
    "op5_substring_dedup": r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i : i + 34], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)
), repeated AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS n FROM windows) WHERE n > 1
), gone AS (
  SELECT doc_id, list(DISTINCT j) AS js FROM (SELECT doc_id, unnest(range(i, i + 35)) AS j FROM repeated) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(js), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN js IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda j: NOT list_contains(js, j)), lambda j: w[j]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""
}
