"""Operator 7, n-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Documents link when 100 * |A & B| >= percent * |A | B| over their sets of distinct k-word shingles. The matrix is
held as blocks (a chunk of documents by a range of shingle hashes). The steps:

1. Each task hashes the shingles of its chunks and deals them out by hash range. A shingle that several documents of
   a chunk share travels once, with its count, so no frequent shingle floods a range.
2. Each range counts documents per shingle; a shingle of one document can't overlap with any other, so only shared
   ones return. A document of whose shingles fewer than `percent` in a hundred are shared can't link: it is done.
3. Of the rest, equal sets become one class. Each class indexes the rarest shingles of its set, as many as the bound
   on the overlap makes necessary, and is first compared with one leader that shares one of these (a star, linear in
   the index). Then classes that share an indexed shingle, are not yet in the same group and pass the bounds on size
   and position are compared; very frequent shingles are compared in blocks of classes.
4. Overlaps of blocks of pairs accumulate in a sparse product of their packed rows, restricted to the entries that the
   bounds left, and links become components.

Nothing is capped: the bounds discard only pairs that can't reach the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLOCK_DDL, NULL_ID, U64, Words, blocks, bucket_bounds, checkpointed, chunk_ids, chunks, keys_of, mix, own_bucket, packed_sorted, partitions_for, planes, read, release, runs, total_chars, unpacked_sorted, unplanes, window_hashes, with_key
from .components import connected_components

#: Classes of a frequent shingle that one task compares with as many others.
BLOCK_ROWS = 512
#: Characters of text whose shingles make one range of hashes.
RANGE_CHARS = 1 << 23
#: Fewer bits than a word has: a chance equality can only keep a document for the exact count, within a pair it is negligible.
HASH_BITS = 48


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, Words]:
    """(hash, document) of the distinct shingles, by hash and document; a shorter text is one shingle as a whole."""
    words = Words(texts, lower=True)
    h, n = window_hashes(words.hash, k), words.count
    doc = words.doc[: len(h)]
    inside = doc == words.doc[k - 1 :] if len(h) else np.zeros(0, bool)
    h, doc = h[inside], doc[inside]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        whole = np.zeros(len(short), U64)
        for j in range(k - 1):
            more = n[short] > j
            at = np.minimum(words.first[short] + j, len(words.hash) - 1)
            whole[more] = mix(whole[more] * U64(31) + words.hash[at][more] + U64(j + 7))
        h, doc = np.concatenate([h, whole]), np.concatenate([doc, short.astype(np.int32)])
    order = np.argsort(h, kind="stable")
    h, doc = h[order], doc[order]
    if len(short):  # a text's only shingle may have come after others of its hash
        order = np.lexsort((doc, h))
        h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], doc[new], words


def _deal(k: int, ranges: int):
    """Documents -> blocks. kind 0: hashes that one document of the chunk has, and which; 1: hashes that several have,
    and how many; 2: the chunk itself: keys, sizes, signatures, and who has the hashes of kind 1."""
    bounds = bucket_bounds(ranges) >> U64(64 - HASH_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for me, (part, texts) in zip(chunk_ids(), chunks(batches)):
            keys = keys_of(part)
            h, doc, _ = shingle_sets(texts, k)
            sign = np.zeros((len(texts), 2), U64)
            np.add.at(sign[:, 0], doc, h)
            np.add.at(sign[:, 1], doc, mix(h ^ U64(0x5851F42D4C957F2D)))
            size = np.bincount(doc, minlength=len(texts)).astype(np.int64)
            h >>= U64(64 - HASH_BITS)
            at = runs(h)
            count = np.diff(np.append(at, len(h)))
            alone = np.repeat(count == 1, count)
            local = np.flatnonzero(~alone)
            out = [(own_bucket(me), me, 2, np.concatenate([keys.view(U64), size[:, None].view(U64), sign], axis=1).tobytes(), packed_sorted(h[local]), planes(doc[local].astype(np.uint32)))]
            several, n_several = h[at[count > 1]], count[count > 1].astype(np.uint32)
            h, doc = h[alone], doc[alone].astype(np.uint16 if len(texts) < 1 << 16 else np.uint32)
            cut = np.concatenate([[0], np.searchsorted(h, bounds), [len(h)]])
            cuts = np.concatenate([[0], np.searchsorted(several, bounds), [len(several)]])
            for b in range(ranges):
                if cut[b] < cut[b + 1]:
                    s = slice(cut[b], cut[b + 1])
                    out.append((b, me, 0, packed_sorted(h[s]), planes(doc[s]), bytes([doc.itemsize])))
                if cuts[b] < cuts[b + 1]:
                    s = slice(cuts[b], cuts[b + 1])
                    out.append((b, me, 1, packed_sorted(several[s]), planes(n_several[s])))
            yield blocks(out)

    return run


def _docs_of(row: dict) -> np.ndarray:
    return unplanes(row["b"], np.uint16 if row["c"] == b"\2" else np.uint32).astype(np.uint32)


def _count(group: pa.Table) -> pa.Table:
    """One range: documents per hash; what several documents have returns to its chunk with that count."""
    rows = group.to_pylist()
    if rows[0]["kind"] == 2:
        return group
    hashes = [unpacked_sorted(r["a"], U64) for r in rows]
    h = np.concatenate(hashes)
    n = np.concatenate([np.ones(len(x), np.uint32) if r["kind"] == 0 else unplanes(r["b"], np.uint32) for x, r in zip(hashes, rows)])
    order = np.argsort(h)
    at = runs(h[order])
    total = np.add.reduceat(n[order].astype(np.int64), at)
    df = np.empty(len(h), np.int64)
    df[order] = np.repeat(total, np.diff(np.append(at, len(h))))
    df = np.minimum(df, 0xFFFFFFFF).astype(np.uint32)
    out, start = [], 0
    for x, r in zip(hashes, rows):
        d = df[start : start + len(x)]
        start += len(x)
        some = d > 1
        if some.any():
            out.append((0, r["chunk"], r["kind"], packed_sorted(x[some]), planes(d[some]), planes(_docs_of(r)[some]) if r["kind"] == 0 else None))
    return pa.Table.from_batches([blocks(out)])


DOC = pa.schema([("key_id", pa.int64()), ("key_hash", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("shared", pa.int64()), ("tokens", pa.binary())])
DOC_DDL = "key_id long, key_hash long, n long, s1 long, s2 long, shared long, tokens binary"


def packed(h: np.ndarray) -> bytes:
    """Hashes as HASH_BITS each."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : HASH_BITS // 8]).tobytes()


def unpacked(b: bytes) -> np.ndarray:
    raw = np.frombuffer(b, np.uint8).reshape(-1, HASH_BITS // 8)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, : HASH_BITS // 8] = raw
    return out.view("<i8").ravel()


def _assemble(percent: int):
    """One chunk: the shared shingles of each document, rarest first; only of documents that may link."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        me = next((r for r in rows if r["kind"] == 2), None)
        if me is None:
            raise ValueError("a chunk came without its documents: the input has to give the same rows in the same order each time it is read; checkpoint it first")
        table = np.frombuffer(me["a"], np.int64).reshape(-1, 5)
        own, who = unpacked_sorted(me["b"], U64), unplanes(me["c"], np.uint32)
        known = [r for r in rows if r["kind"] == 1]
        kh = np.concatenate([unpacked_sorted(r["a"], U64) for r in known] or [np.zeros(0, U64)])
        kd = np.concatenate([unplanes(r["b"], np.uint32) for r in known] or [np.zeros(0, np.uint32)])
        order = np.argsort(kh)
        own_df = kd[order][np.searchsorted(kh[order], own)] if len(own) else np.zeros(0, np.uint32)
        single = [r for r in rows if r["kind"] == 0]
        h = np.concatenate([own, *(unpacked_sorted(r["a"], U64) for r in single)])
        df = np.concatenate([own_df, *(unplanes(r["b"], np.uint32) for r in single)])
        doc = np.concatenate([who, *(unplanes(r["c"], np.uint32) for r in single)]).astype(np.int64)
        shared = np.bincount(doc, minlength=len(table))
        may = (shared * 100 >= percent * table[:, 2]) & (table[:, 2] > 0)
        some = may[doc]
        h, df, doc = h[some], df[some], doc[some]
        h = h[np.lexsort((h, df, doc))]
        cut = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(table)))])
        tokens = [packed(h[cut[i] : cut[i + 1]]) if may[i] else None for i in range(len(table))]
        return pa.Table.from_arrays([*(pa.array(table[:, i]) for i in range(5)), pa.array(shared.astype(np.int64)), pa.array(tokens, pa.binary())], schema=DOC)

    return run


def _index(percent: int):
    """Classes -> the shingles that a partner has to share one of, with their positions (shingles of one document come first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n = np.asarray(part.column("n"))
                sets = [unpacked(x) for x in part.column("tokens").to_pylist()]
                alone = n - np.array([len(x) for x in sets], np.int64)
                keep = np.maximum(0, n - (-(-percent * n // 100)) + 1 - alone)
                sets = [x[:i] for x, i in zip(sets, keep)]
                size = np.array([len(x) for x in sets], np.int64)
                each = lambda a: np.repeat(a, size)
                pos = np.concatenate([np.arange(a, a + i) for a, i in zip(alone, size)] or [np.zeros(0, np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*sets, np.zeros(0, np.int64)]).astype(np.int64)), pa.array(each(np.asarray(part.column("class")))), pa.array(each(n)), pa.array(each(alone)), pa.array(pos.astype(np.int64))], names=["h", "class", "n", "alone", "pos"])

    return run


#: Bytes of shingles whose overlaps are counted at once, and pairs, which share a number with a shingle.
PRODUCT_BYTES, PRODUCT_PAIRS = 1 << 23, 1 << (64 - HASH_BITS)


def overlaps(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """The entries of a sparse product that are asked for: of the i-th packed set on either side, how many shingles both hold.

    The product accumulates over the shingles of all pairs at once: an entry for a pair and a shingle stands twice
    among the sorted ones where both sides have it.
    """
    sides = []
    for sets in (left, right):
        pair = np.repeat(np.arange(len(sets), dtype=U64), [len(x) * 8 // HASH_BITS for x in sets])
        sides.append(pair << U64(HASH_BITS) | unpacked(b"".join(sets)).view(U64))
    both = np.sort(np.concatenate(sides))
    twice = both[1:][both[1:] == both[:-1]]
    return np.bincount((twice >> U64(HASH_BITS)).astype(np.int64), minlength=len(left))


def _overlaps(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.asarray(batch.column(c)) for c in ("x", "y"))
            n = np.asarray(batch.column("nx")) + np.asarray(batch.column("ny"))
            sizes = np.cumsum(np.asarray(pc.binary_length(batch.column("tx"))).astype(np.int64) + np.asarray(pc.binary_length(batch.column("ty"))))
            got, at = np.zeros(len(x), np.int64), 0
            while at < len(x):
                upto = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + PRODUCT_BYTES, "right"))
                upto = min(max(at + 1, upto), at + PRODUCT_PAIRS)
                left, right = (batch.column(c).slice(at, upto - at).to_pylist() for c in ("tx", "ty"))
                got[at:upto] = overlaps(left, right)
                at = upto
            link = 100 * got >= percent * (n - got)
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(link)], names=["x", "y", "link"])

    return run


def _compared(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """pairs(x, y) of classes -> x, y, link."""
    side = lambda c: classes.select(F.col("class").alias(c), F.col("n").alias(f"n{c}"), F.col("tokens").alias(f"t{c}"))
    return checkpointed(pairs.join(side("x"), "x").join(side("y"), "y").mapInArrow(_overlaps(percent), "x long, y long, link boolean"))


def _bound(percent: int) -> str:
    """SQL: the least overlap by the sizes can still be reached after the positions of a shared shingle in two sets."""
    return f"least(a.n - a.pos, b.n - b.pos) * {100 + percent} >= {percent} * (a.n + b.n) AND least(a.n - a.alone, b.n - b.alone) * {100 + percent} >= {percent} * (a.n + b.n)"


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, range_chars: int = RANGE_CHARS) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_shingles, component_id, key_hash (of the text), group: one row per row of docs.

    Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z. A text of fewer than k words is one shingle; a null,
    empty or blank text has none and links with nothing. component_id is the smallest doc_id that links reach. Rows
    that repeat a doc_id are documents of their own; a null doc_id counts as the smallest number, and a component of
    it has a null id. group tells components apart where doc_ids repeat, and is null for a document that can't link.
    Other columns are ignored. An empty table gives an empty result.

    docs has to give the same rows in the same order each time it is read (files or a checkpoint).
    """
    spark = docs.sparkSession
    keyed = with_key(docs).select("key_id", "key_hash", "text")
    ranges = partitions_for(total_chars(docs), range_chars)
    rows = checkpointed(keyed.mapInArrow(_deal(k, ranges), BLOCK_DDL).groupBy("bucket").applyInArrow(_count, BLOCK_DDL).groupBy("chunk").applyInArrow(_assemble(percent), DOC_DDL))
    release(spark)

    may = rows.where("tokens IS NOT NULL")
    # numbers that no two classes share; they hold as what is read from here on is the checkpoint
    classes = checkpointed(may.groupBy("n", "s1", "s2").agg(F.min(F.struct("key_id", "key_hash")).alias("least"), F.first("tokens").alias("tokens")).withColumn("class", F.monotonically_increasing_id()).select("class", "n", "s1", "s2", F.col("least.key_id").alias("least_id"), "tokens"))
    index = checkpointed(classes.select("class", "n", "tokens").mapInArrow(_index(percent), "h long, class long, n long, alone long, pos long"))
    often = index.groupBy("h").agg(F.count("*").alias("m"), F.min(F.struct((F.col("alone") / F.col("n")).alias("r"), "class", "n", "alone", "pos")).alias("lead")).where("m > 1")
    index = checkpointed(index.join(often, "h"))

    # a star: each class against one leader, the least damaged class that shares an indexed shingle with it
    star = index.selectExpr("class AS x", "named_struct('r', lead.r, 'c', lead.class) AS lead", f"lead.class <> class AND {_bound(percent).replace('a.', 'lead.').replace('b.', '')} AS fits").where("fits")
    star = _compared(star.groupBy("x").agg(F.min("lead").alias("lead")).select("x", F.col("lead.c").alias("y")), classes, percent)
    release(spark)
    lead = star.where("link").select(F.col("x").alias("class"), F.col("y").alias("to"))
    up = lead.select(F.col("class").alias("to"), F.col("to").alias("top"))
    for _ in range(2):
        lead = lead.join(up, "to", "left").select("class", F.coalesce("top", "to").alias("to"))
    # pairs of different stars; a frequent shingle is dealt out as blocks of classes, each with each
    near = index.drop("lead").join(checkpointed(lead), "class", "left").withColumn("star", F.coalesce("to", "class")).drop("to")
    mixed = near.groupBy("h").agg((F.min("star") < F.max("star")).alias("mixed")).where("mixed").select("h")
    near = checkpointed(near.join(mixed, "h", "left_semi").withColumn("of", F.ceil(F.col("m") / BLOCK_ROWS)).withColumn("own", F.pmod(F.xxhash64("class"), F.col("of"))))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1))
    a, b = near.withColumn("q", other).withColumn("p", F.col("own")).alias("a"), near.withColumn("p", other).withColumn("q", F.col("own")).alias("b")
    rest = a.join(b, F.expr(f"a.h = b.h AND a.p = b.p AND a.q = b.q AND a.class < b.class AND a.star <> b.star AND {_bound(percent)}")).selectExpr("a.class AS x", "b.class AS y").distinct()
    done = star.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    rest = _compared(checkpointed(rest.join(done, ["x", "y"], "left_anti")), classes, percent)

    links = star.union(rest).where("link").select("x", "y")
    group = connected_components(links)
    member = classes.join(group, classes["class"] == group.node, "left").select("n", "s1", "s2", "least_id", F.coalesce("component", "class").alias("group"))
    least = member.groupBy("group").agg(F.min("least_id").alias("component_id"))
    member = checkpointed(member.join(least, "group").select("n", "s1", "s2", "component_id", "group"))
    # the smallest copy of a class is in member, so only documents that may link look there
    linked = may.select("key_id", "key_hash", "n", "s1", "s2").join(member, ["n", "s1", "s2"]).select("key_id", "key_hash", "n", "component_id", "group")
    single = rows.where("tokens IS NULL").select("key_id", "key_hash", "n", F.col("key_id").alias("component_id"), F.lit(None).cast("long").alias("group"))
    null = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return single.union(linked).select(null("key_id").alias("doc_id"), F.col("n").alias("n_shingles"), null("component_id").alias("component_id"), "key_hash", "group")


#: Rows to drop that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, one_row: bool = False) -> DataFrame:
    """docs with one document of each component, the one of the smallest doc_id; all columns stay.

    Rows that repeat a doc_id with the same text are one document and stay or go together; of rows that repeat it with
    other texts in the same component the one of the smallest text hash stays. With one_row only one of the rows that
    repeat a doc_id with the same text stays, the first by all its columns as JSON; texts without a shingle all stay.
    """
    rows = checkpointed(jaccard_components(docs, k, percent).where("group IS NOT NULL").select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("key_id"), "key_hash", "group"))
    release(docs.sparkSession)
    # a document is in one group, so those that stay are looked up by their own keys: a large group is no hot key
    stays = rows.groupBy("group").agg(F.min(F.struct("key_id", "key_hash")).alias("stays")).select("stays.*")
    goes = checkpointed(rows.select("key_id", "key_hash").distinct().join(stays, ["key_id", "key_hash"], "left_anti"))
    goes = F.broadcast(goes) if goes.count() <= BROADCAST_ROWS else goes
    keyed = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("key_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key_hash"))
    key = ["key_id", "key_hash"]
    kept = keyed.join(goes, key, "left_anti")
    if one_row:
        again = checkpointed(rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key))
        n_again = again.count()
        if n_again:
            again = F.broadcast(again) if n_again <= BROADCAST_ROWS else again
            one = kept.join(again, key, "left_semi").groupBy(*key).agg(F.min_by("row", F.to_json("row")).alias("row"))
            kept = kept.join(again, key, "left_anti").select("row").union(one.select("row"))
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


ORACLE_SQL = {
    "op7_ngram_jaccard": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), o AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y
)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(reach.y)::BIGINT AS component_id
FROM d JOIN reach ON reach.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""
}
