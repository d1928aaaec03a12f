"""Operator 10, language identification with a string kernel.

The kernel of two texts is the number of n-grams (of all lengths up to `spectrum`, hashed to `width` slots) present in
both, over the geometric mean of their numbers. Landmarks from the training rows give a Nyström map; one-versus-rest
kernel ridge regression is solved on it. Weights of landmarks fold into one matrix, slots by languages, so a batch of
presence rows is scored by one matrix product.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks, crc32_mod4_is_2, read

WIDTH, SPECTRUM, LANDMARKS, RIDGE = 1 << 15, 3, 256, 1e-3
#: Bounds of what the driver learns from: rows in all, shared out among the languages, but so many for each at least.
MAX_TRAIN, LEAST_EACH = 2400, 8
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
#: Letters and bytes of other scripts count, in lower case; all else is a space.
_FOLD = np.full(256, 0x20, np.uint8)
for _c in range(0x61, 0x7B):
    _FOLD[_c] = _FOLD[_c - 32] = _c
_FOLD[0x80:] = np.arange(0x80, 0x100)


def presence(text: bytes, width: int = WIDTH, spectrum: int = SPECTRUM) -> np.ndarray:
    """Which slots the n-grams of a whole text fall into."""
    row = np.zeros(width, bool)
    a = _FOLD[np.frombuffer(b" " + text + b" ", np.uint8)]
    space = a == 0x20
    keep = np.ones(len(a), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    gram = a[keep].astype(np.uint32)
    code = gram
    for n in range(1, spectrum + 1):
        if n > 1:
            code = (code[:-1] << np.uint32(8)) | gram[n - 1 :] if n <= 4 else code[:-1] * np.uint32(0x01000193) ^ gram[n - 1 :]
        row[((code + np.uint32(n * 0x3C6EF372)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - (width - 1).bit_length())] = True
    return row


def _has_letter(text: bytes) -> bool:
    return bool(_LETTER.search(text.decode()))


class Model:
    """languages, and the matrix of slots by languages."""

    def __init__(self, languages: list[str], weights: np.ndarray) -> None:
        self.languages, self.weights = languages, weights

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return (rows.astype(np.float32) @ self.weights) / np.sqrt(np.maximum(1, rows.sum(axis=1)))[:, None]


def _unit(bits: np.ndarray, width: int) -> np.ndarray:
    rows = np.unpackbits(bits, axis=1, count=width)
    return rows / np.sqrt(np.maximum(1, rows.sum(axis=1, dtype=np.float32)))[:, None]


def fit(bits: np.ndarray, labels: list[str], width: int = WIDTH, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Kernel ridge regression on the Nyström map of packed presence rows, one language against the rest.

    There are two landmarks for each language at least: fewer than languages could not tell all of them apart.
    """
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((width, 0), np.float32))
    pick = np.sort(np.random.default_rng(7).permutation(len(bits))[: max(landmarks, 2 * len(languages))])
    z = _unit(bits[pick], width).astype(np.float32)
    values, vectors = np.linalg.eigh((z @ z.T).astype(np.float64))
    ok = values > 1e-6 * values[-1]
    root = vectors[:, ok] / np.sqrt(values[ok])
    kernel = np.concatenate([_unit(bits[at : at + 64], width).astype(np.float32) @ z.T for at in range(0, len(bits), 64)])
    phi = kernel @ root
    target = np.where(np.array(labels)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    w = np.linalg.solve(phi.T @ phi + ridge * len(bits) * np.eye(phi.shape[1]), phi.T @ target)
    return Model(languages, (z.T @ (root @ w)).astype(np.float32))


def _rows(width: int, spectrum: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            some = [i for i, t in enumerate(texts) if _has_letter(t)]
            bits = [np.packbits(presence(texts[i], width, spectrum)).tobytes() for i in some]
            yield pa.RecordBatch.from_arrays([part.column("lang").take(pa.array(some, pa.int64())), pa.array(bits, pa.binary())], names=["lang", "bits"])

    return run


def train(labelled: DataFrame, max_train: int = MAX_TRAIN, width: int = WIDTH, spectrum: int = SPECTRUM) -> Model:
    """labelled(doc_id, text, lang): fits on max_train rows at most, or LEAST_EACH for every language if that is more.

    Each language has the same share, or all its rows where it has fewer. Rows are chosen by a hash of doc_id and text,
    the same at any partitioning; texts of equal presence count once. What reaches the driver is bounded by that: bitmaps
    of width / 8 bytes, and a cut for each language.
    """
    point = F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(41))
    labelled = labelled.where("lang IS NOT NULL").select("lang", F.coalesce("text", F.lit("")).alias("text"), point.alias("point"))
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    each = max(LEAST_EACH, max_train // max(1, len(counts)))
    # about twice as many of a language as are wanted pass by their points alone, however frequent it is
    near = {lang: -(1 << 63) + int((1 << 64) * min(1.0, 2 * each / n)) - 1 for lang, n in counts.items()}
    of = lambda cuts: F.try_element_at(F.from_json(F.lit(json.dumps(cuts)), "map<string,bigint>"), F.col("lang"))
    first = labelled.select("lang", "point").where(F.col("point") <= of(near)).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("point"))).where(F.col("rank") <= each)
    cuts = {r["lang"]: r["cut"] for r in first.groupBy("lang").agg(F.max("point").alias("cut")).collect()}
    if not cuts:
        return fit(np.zeros((0, width // 8), np.uint8), [], width)
    sample = labelled.where(F.col("point") <= of(cuts)).select("lang", "text")
    got = sample.mapInArrow(_rows(width, spectrum), "lang string, bits binary").distinct().collect()
    got.sort(key=lambda r: (r["lang"], r["bits"]))  # arrival order must not matter
    bits = np.frombuffer(b"".join(r["bits"] for r in got), np.uint8).reshape(len(got), width // 8)
    return fit(bits, [r["lang"] for r in got], width)


def _predict(shared, width: int, spectrum: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part, texts in chunks(batches):
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            some = [i for i, t in enumerate(texts) if _has_letter(t)] if model.languages else []
            for at in range(0, len(some), 64):
                which = some[at : at + 64]
                got = model.scores(np.stack([presence(texts[i], width, spectrum) for i in which]))
                top = got.argmax(axis=1)
                score[which] = np.clip((got[np.arange(len(which)), top] + 1) / 2, 0, 1)
                for i, j in zip(which, top.tolist()):
                    lang[i] = model.languages[j]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(lang), pa.array(score)], names=[*part.schema.names[:-1], "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model, width: int = WIDTH, spectrum: int = SPECTRUM) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, lang_pred, score (0 to 1): one row per row of docs, in whatever order.

    `und` with score 0 where the text is null or has no letter, or nothing was learned. Only the text is an input; rows
    that repeat a doc_id stay; other columns are ignored; an empty table gives an empty result. The model goes to the
    executors whole: 4 bytes for each slot and language, 128 kB a language.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_predict(shared, width, spectrum), f"doc_id {kind}, lang_pred string, score double")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train(docs.where(~crc32_mod4_is_2(F.col("doc_id"))).select("doc_id", "text", "lang"))
    return identify(docs, model).select("doc_id", crc32_mod4_is_2(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
