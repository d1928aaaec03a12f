"""Operator 9, SentencePiece encoding and decoding by shared-prefix Viterbi.

Spaces become marks that begin words. The distinct marked words of a chunk are sorted, which lays them out as the
depth-first order of their trie: the best scores of the ends of a prefix are computed once and reused by every word
that shares it.

A unigram model's own scores are maximised. A BPE model has no probabilities, only the order of its merges; a piece of
rank r then scores -log(r + 1), so that few and frequent pieces win. Characters without a piece become byte pieces, so
decoding gives back every text exactly.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, read

MARK, LITERAL = "▁", "\ud800"
#: Words that a task remembers before it starts anew: bounds its memory, not its results.
REMEMBERED = 400_000


class Pieces:
    """Pieces of a model file with their scores."""

    def __init__(self, name: str) -> None:
        import public_tokenizers
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        scores = {i: sp.get_score(i) for i in plain}
        if all(s == int(s) for s in scores.values()):  # ranks of merges
            top = max(scores.values())
            scores = {i: -math.log(top - s + 1 + math.e) for i, s in scores.items()}
        self.ids = {sp.id_to_piece(i): (i, scores[i]) for i in plain}
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        if len(self.bytes) != 256:
            raise ValueError("the model has no byte pieces, so it can't give back every text")
        self.unknown = min(scores.values()) - 10.0
        self.trie: dict = {}
        for p, (i, s) in self.ids.items():
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = (i, s, (i,))
        self.text = {i: p.replace(MARK, " ").encode() for p, (i, _) in self.ids.items()} | {i: bytes([b]) for b, i in self.bytes.items()}
        # no piece of several characters holds any other character, so words can be cut around those
        inner = {c for p in self.ids if len(p) > 1 for c in p} - {MARK}
        self.words = re.compile(f"{MARK}*[{''.join(map(re.escape, sorted(inner)))}]+|{MARK}+|[^{MARK}]", re.DOTALL)

    def best(self, words: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """The best pieces of each word; words have to come sorted.

        For each end of a prefix: its score, where its last piece starts, that piece, and the open nodes of the
        pieces' trie, by where they started. All of these stand for any word with that prefix.
        """
        root, unknown, own = self.trie, self.unknown, self.bytes
        score, back, piece, opened, last, out = [0.0], [0], [()], [()], "", {}
        for word in words:
            if word.startswith(last):
                shared = len(last)
            else:
                shared = 0
                while word[shared] == last[shared]:  # the last word is no prefix, and no word equals it
                    shared += 1
                del score[shared + 1 :], back[shared + 1 :], piece[shared + 1 :], opened[shared + 1 :]
            nodes = opened[shared]
            for at, c in enumerate(word[shared:], shared):
                top, start, how, going = -1e300, at, None, []
                for begin, node in nodes:  # the longest first, so it wins among equals
                    node = node.get(c)
                    if node:
                        going.append((begin, node))
                        found = node.get("")
                        if found and score[begin] + found[1] > top:
                            top, start, how = score[begin] + found[1], begin, found[2]
                node = root.get(c)
                if node:
                    going.append((at, node))
                    found = node.get("")
                else:
                    found = None
                if not found:
                    raw = (MARK if c == LITERAL else c).encode()
                    found = 0, unknown * len(raw), tuple(own[b] for b in raw)
                if score[at] + found[1] > top:
                    top, start, how = score[at] + found[1], at, found[2]
                score.append(top)
                back.append(start)
                piece.append(how)
                opened.append(going)
                nodes = going
            parts, end = [], len(word)
            while end:
                parts.append(piece[end])
                end = back[end]
            parts.reverse()
            out[word] = tuple(chain.from_iterable(parts))
            last = word
        return out

    def marked(self, text: str) -> list[str]:
        """The words of a text, each with the spaces before it as marks; one mark goes before the whole text."""
        return self.words.findall(MARK + text.replace(MARK, LITERAL).replace(" ", MARK)) if text else []

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.text.__getitem__, ids))[1:].decode()


_models: dict[str, Pieces] = {}


def pieces(name: str) -> Pieces:
    if name not in _models:
        _models[name] = Pieces(name)
    return _models[name]


class Encoder:
    """Encodes texts, and remembers words within bounds."""

    def __init__(self, model: Pieces) -> None:
        self.model, self.known = model, {}

    def encode(self, texts: list[str]) -> Iterator[array]:
        words = [self.model.marked(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = set(chain.from_iterable(words)).difference(self.known)
        self.known.update(self.model.best(sorted(new)))
        for w in words:
            yield array("I", chain.from_iterable(map(self.known.__getitem__, w)))


def _encoded(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(pieces(name))
        for part, texts in chunks(batches):
            ids = list(encoder.encode([t.decode() for t in texts]))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.frombuffer(b"".join(x.tobytes() for x in ids), np.uint32).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[*part.schema.names[:-1], "ids"])

    return run


def _decoded(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(name)
        for batch in batches:
            texts = [None if x is None else model.decode(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*batch.schema.names[:-1], "text"])

    return run


def encode(docs: DataFrame, name: str = "piece_bpe_32k.model") -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, ids (array of int): one row per row of docs.

    A null or empty text has no ids. Texts are taken whole and as they are; repeated rows stay; other columns are
    ignored; an empty table gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_encoded(name), f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, name: str = "piece_bpe_32k.model") -> DataFrame:
    """encoded(doc_id, ids, ...) -> doc_id, text; null ids stay null, no ids are an empty text."""
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(_decoded(name), f"doc_id {kind}, text string")


def _digested(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(name)
        encoder = Encoder(model)
        for part, texts in chunks(batches):
            rows = [(len(x), zlib.crc32(x.tobytes()), zlib.crc32(back), back == raw) for raw, x in zip(texts, encoder.encode([t.decode() for t in texts])) for back in [model.decode(x).encode()]]
            n, ids, text, same = zip(*rows)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.int64()), pa.array(text, pa.int64()), pa.array(same)], names=["doc_id", "n_ids", "ids_crc32", "decoded_crc32", "round_trip"])

    return run


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every document: doc_id, n_ids, ids_crc32 (little-endian uint32), decoded_crc32 (UTF-8), round_trip."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return docs.mapInArrow(_digested("piece_bpe_32k.model"), "doc_id long, n_ids long, ids_crc32 long, decoded_crc32 long, round_trip boolean")
