"""Operator 8, quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed features of the text is shared by all grades: P(grade > j) = sigmoid(w . x - t_j), with
ordered thresholds t_0 < t_1 < ... It gives the expected grade, and the tail probability P(grade >= g) for selection.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Words, chunks, column, mix, read, schema

BITS = 18
#: Slots count 1, over this power of their number.
DAMPING = 0.25
#: The bound of the labelled rows that the driver learns from, chosen by a hash of doc_id.
MAX_TRAIN = 16000
STEPS, DECAY = 150, 1e-4
#: A slot that fewer rated documents have gets no weight: it would only remember them.
MIN_ROWS = 5
BLOCK = 1024
#: Documents whose probability of the best grade is lower are rejected.
KEEP_FROM = 0.5


#: Words as features stand without punctuation.
_BARE = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


def features(texts: list[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(document, slot), sorted and distinct: words, their endings, and how often a word repeats the one before."""
    words, bare = Words(texts, lower=True), Words([t.translate(_BARE) for t in texts], lower=True)
    buf = np.frombuffer(words.joined, np.uint8).astype(np.uint32)
    end, size = words.ends, words.ends - words.starts
    tail = [np.where(size > j, buf[np.maximum(end - 1 - j, 0)], 0) for j in range(3)]
    ending = mix((tail[0] | tail[1] << np.uint32(8) | tail[2] << np.uint32(16)).astype(U64) + U64(1 << 40))
    doc = words.doc.astype(np.int64)
    same = np.zeros(len(doc), bool)
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (doc[1:] == doc[:-1])
    # shares of repeats and of bytes other than letters, in steps
    n = np.maximum(1, words.count)
    repeats = np.ceil(10 * np.bincount(doc, same, len(texts)) / n).astype(np.int64)
    odd = np.bincount(doc, tail[0] < 0x30, len(texts))
    odd = np.ceil(20 * odd / n).astype(np.int64)
    mask = U64((1 << bits) - 1)
    whole = np.arange(len(texts))
    slots = [(bare.doc.astype(np.int64), bare.hash), (doc, ending)]
    dense = [(mix(x.astype(U64) + U64(k << 50)) & mask).astype(np.int64) for k, x in ((1, repeats), (2, odd), (3, np.log2(n + 1).astype(np.int64)))]
    key = np.unique(np.concatenate([d << bits | (h & mask).astype(np.int64) for d, h in slots] + [whole << bits | s for s in dense]))
    return key >> bits, key & ((1 << bits) - 1)


class Model:
    """weights by slot, and ordered thresholds between the grades."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray) -> None:
        self.weights, self.thresholds = weights, thresholds

    def tails(self, doc: np.ndarray, slot: np.ndarray, n: int) -> np.ndarray:
        """P(grade > j) of n documents by j."""
        count = np.maximum(1.0, np.bincount(doc, minlength=n))
        score = np.bincount(doc, self.weights[slot], n) * count ** -DAMPING
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -40, 40)))


def fit(doc: np.ndarray, slot: np.ndarray, grade: np.ndarray, bits: int = BITS, steps: int = STEPS, decay: float = DECAY, min_rows: int = MIN_ROWS) -> Model:
    """Maximum likelihood by Adam over all rows at once; the thresholds are a first one and positive gaps."""
    n, top = len(grade), int(grade.max()) if len(grade) else 0
    if not n or top == 0:
        return Model(np.zeros(1 << bits), np.zeros(top))
    scale = np.maximum(1.0, np.bincount(doc, minlength=n)) ** -DAMPING
    some = (np.bincount(slot, minlength=1 << bits) >= min(min_rows, max(1, n // 20)))[slot]
    doc, slot = doc[some], slot[some]
    # gradients add up over blocks of documents, so the driver never holds more than a part of the products
    edges = np.searchsorted(doc, np.arange(0, n + BLOCK, BLOCK))
    parts = [(at, min(at + BLOCK, n), slice(a, b)) for at, a, b in zip(range(0, n, BLOCK), edges[:-1], edges[1:])]
    rank = np.clip([(grade > j).mean() for j in range(top)], 1e-3, 1 - 1e-3)
    logit = -np.log(rank / (1 - rank))
    params = np.concatenate([np.zeros(1 << bits), logit[:1], np.log(np.maximum(np.diff(logit), 1e-2))])
    m, v = np.zeros_like(params), np.zeros_like(params)
    w = 1 << bits
    for step in range(1, steps + 1):
        gaps = np.exp(params[w + 1 :])
        cut = np.concatenate([[-np.inf], params[w] + np.concatenate([[0], np.cumsum(gaps)]), [np.inf]])
        score = np.concatenate([np.bincount(doc[x] - at, params[slot[x]], end - at) for at, end, x in parts]) * scale
        low, high = cut[grade] - score, cut[grade + 1] - score
        f = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
        fl, fh = np.where(np.isinf(low), 0, f(low)), np.where(np.isinf(high), 1, f(high))
        p = np.maximum(fh - fl, 1e-12)
        dl, dh = fl * (1 - fl) / p, fh * (1 - fh) / p
        back = dh - dl  # of the negative log likelihood by the score
        g = np.zeros_like(params)
        pull = back * scale / n
        g[:w] = decay * params[:w]
        for _, _, x in parts:
            g[:w] += np.bincount(slot[x], pull[doc[x]], w)
        by_cut = np.array([np.sum(dl[grade == j + 1]) - np.sum(dh[grade == j]) for j in range(top)]) / n
        g[w] = by_cut.sum()
        g[w + 1 :] = [by_cut[j:].sum() * gaps[j - 1] for j in range(1, top)]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        params -= 0.3 * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(params[:w], params[w] + np.concatenate([[0], np.cumsum(np.exp(params[w + 1 :]))]))


def _slots(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            doc, slot = features(texts, bits)
            cut = np.searchsorted(doc, np.arange(len(texts) + 1))
            packed = [slot[a:b].astype(np.uint32).tobytes() for a, b in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("grade"), pa.array(packed, pa.binary())], names=["doc_id", "grade", "slots"])

    return run


def train(docs: DataFrame, ratings: DataFrame, max_train: int = MAX_TRAIN, bits: int = BITS) -> Model:
    """docs(doc_id, text, ...), ratings(doc_id, grade: 0 and up): fits on at most max_train rated documents.

    Rated doc_ids are chosen by a hash, so the sample is the same at any partitioning; a doc_id with several ratings
    counts with its lowest, one with several texts with the one of the least slots. The sample of ids is bounded, so it
    may be broadcast; what the driver gathers is the slots of one document for each, a few kB each.
    """
    ratings = ratings.where("doc_id IS NOT NULL AND grade >= 0").groupBy("doc_id").agg(F.min("grade").cast("long").alias("grade"))
    share = max_train / max(1, ratings.count())
    point = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(43)), F.lit(1 << 30)) / float(1 << 30)
    sample = ratings.where(point < share).orderBy(point).limit(max_train)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id").select("doc_id", "grade", "text")
    got = rows.mapInArrow(_slots(bits), schema(sample, ["doc_id", "grade"], slots="binary")).groupBy("doc_id", "grade").agg(F.min("slots").alias("slots")).toArrow()
    got = got.take(pc.sort_indices(got, [("doc_id", "ascending"), ("slots", "ascending")])) if got.num_rows else got
    sizes = np.array([len(x.as_buffer()) // 4 for x in got.column("slots")], np.int64)
    slot = np.frombuffer(b"".join(x.as_buffer() for x in got.column("slots")), np.uint32).astype(np.int32)
    return fit(np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), slot, np.asarray(got.column("grade")), bits)


def _graded(shared, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part, texts in chunks(batches):
            doc, slot = features([t or b"" for t in texts], bits)
            tails = model.tails(doc, slot, len(texts))
            best = tails[:, -1] if tails.shape[1] else np.ones(len(texts))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(tails.sum(axis=1)), pa.array(best)], names=[*part.schema.names, "expected_grade", "p_best"])

    return run


def grade(docs: DataFrame, model: Model, bits: int = BITS) -> DataFrame:
    """docs(..., text) -> the same columns, expected_grade, p_best (the probability of the best grade): one row per row.

    A null or empty text has no words and gets what the thresholds alone say; the whole of a long text counts; repeated
    rows stay; an empty table gives an empty result; columns named expected_grade or p_best are replaced. The model
    goes to the executors whole: 8 bytes for each of 2**bits slots. With no ratings every document gets 1.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c not in ("text", "expected_grade", "p_best")]
    rows = docs.select(F.struct(*map(column, rest)).alias("carried"), "text")
    graded = rows.mapInArrow(_graded(shared, bits), schema(rows, ["carried", "text"], expected_grade="double", p_best="double"))
    return graded.select(*(F.col("carried").getField(c).alias(c) for c in rest), "text", "expected_grade", "p_best")


def ratings_of(labels: DataFrame) -> DataFrame:
    """labels(doc_id, quality 0/1, toxic 0/1) -> doc_id, grade: 0 poor, 1 toxic, 2 good."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 2).alias("grade")).where("grade IS NOT NULL")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train(docs, ratings_of(read(spark, sf_dir, "labels")))
    return grade(docs.select("doc_id", "text"), model).select("doc_id", "expected_grade", "p_best", (F.col("p_best") >= KEEP_FROM).alias("keep"))


def drop_rejected(docs: DataFrame, ratings: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """docs whose probability of the best grade is keep_from at least; all columns stay. Without ratings all stay."""
    # under names of their own, should docs have columns like the new ones
    rest = [c for c in docs.columns if c != "text"]
    graded = grade(docs.select(F.struct(*map(column, rest)).alias("kept"), "text"), train(docs, ratings)).where(F.col("p_best") >= keep_from)
    return graded.select(*(F.col("text") if c == "text" else F.col("kept").getField(c).alias(c) for c in docs.columns))
