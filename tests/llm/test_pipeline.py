"""The pipeline, stage by stage, against what each stage has to do to its own input."""

import random
import zlib

import corpus_pipeline
import pytest


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(21)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    passage, docs, labels = prose(50), [], []
    for i in range(240):
        if i % 4 == 0:
            text, quality = " | ".join(r.choice(vocab) + "%%%" for _ in range(40)), 0
        elif i % 12 == 5:
            text, quality = prose(30) + " " + passage + " " + prose(30), 1
        else:
            text, quality = prose(80), 1
        if i % 12 == 3 and len(docs) > 2 and docs[-2][0] % 4:
            text, quality = docs[-2][1] + " more", 1
        if i % 12 == 7:
            text += f" write to user{i}@example.com now"
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, quality, 0))
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path), {d[0]: d[1] for d in docs}, dict((d, q) for d, q, _ in labels), passage


def shingles(t):
    w = t.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


@pytest.fixture(scope="module")
def seen(spark, folder, tmp_path_factory):
    """The rows of each stage."""
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    columns, seen, to = docs.columns, {}, tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder[0]).write.parquet(str(to / name))
        docs = spark.read.parquet(str(to / name))
        assert name == "packing" or docs.columns == columns
        seen[name] = docs.collect()
    return seen


def test_stages(folder, seen):
    _, texts, quality, passage = folder
    kept = {r.doc_id for r in seen["quality"]}
    assert sum(quality[i] == 1 for i in kept) >= 0.97 * sum(quality.values()) and sum(quality[i] == 0 for i in kept) <= 3
    left = {r.doc_id: r.text for r in seen["near_duplicates"]}
    for i in kept - set(left):
        assert any(10 * len(shingles(texts[i]) & shingles(t)) >= 8 * len(shingles(texts[i]) | shingles(t)) for t in left.values())
    assert all(10 * len(shingles(a) & shingles(b)) < 8 * len(shingles(a) | shingles(b)) for x, a in left.items() for y, b in left.items() if x < y)
    after = {r.doc_id: r.text for r in seen["repeated_passages"]}
    assert set(after) == set(left) and not any(passage in t for t in after.values()) and sum(passage in t for t in left.values()) > 3
    assert all(r.n_chars == len(r.text) for r in seen["repeated_passages"])
    clean = {r.doc_id: r.text for r in seen["personal_data"]}
    assert set(clean) == set(left) and not any("@example.com" in t for t in clean.values()) and any("[EMAIL]" in t for t in clean.values())
    packed = {}
    for r in seen["packing"]:
        assert zlib.crc32(r.ids) == r.ids_crc32
        packed.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    assert set(packed) == set(clean) and all(sum(n for _, n, _ in p) == p[0][2] for p in packed.values())


def test_run_is_the_stages_one_after_another(spark, folder, seen):
    rows = lambda got: sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, bytes(r.ids)) for r in got)
    got = corpus_pipeline.run(spark, folder[0]).collect()
    assert rows(got) == rows(seen["packing"]) and len({r.sequence_id for r in got}) == len(got)


def test_a_repeated_row_leaves_one_whole_document(spark, tmp_path):
    r = random.Random(5)
    prose = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    docs = [(i, prose(60), "en", "s", 419) for i in range(20)]
    rows = [*docs, *docs[:10], *docs[:5], (30, None, "en", "s", None), (31, docs[12][1], "en", "s", 419), (31, docs[12][1], "en", "t", 419)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "in"))
    kept = corpus_pipeline.near_duplicates(spark, spark.read.parquet(str(tmp_path / "in")), "")
    kept.write.parquet(str(tmp_path / "kept"))
    after = corpus_pipeline.repeated_passages(spark, spark.read.parquet(str(tmp_path / "kept")), "")
    assert sorted((x.doc_id, x.text or "") for x in after.collect()) == [*((i, t) for i, t, *_ in docs), (30, "")]
