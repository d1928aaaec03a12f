"""Each document operator against brute force, on texts with every odd case."""

import functools
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from trilith.llm import language_id, licenses, packing, pii, piece_tokenizer, quality
from trilith.llm.ngram_jaccard import drop_near_duplicates, jaccard_components
from trilith.llm.substring_dedup import drop_repeats, repeated_paths

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, spans string, label string, key_id string, key_hash string, _cuts string, `my col.x` string, row string, carried string, paths string"
R = random.Random(3)
VOCAB = ["".join(R.choice("abcdefghijk") for _ in range(R.randint(1, 7))) for _ in range(400)]


def prose(n):
    return " ".join(R.choice(VOCAB) for _ in range(n))


PASSAGE, BASE = prose(60), prose(120)


def twins(n=1024):
    """Two words of n letters that are equal under any polynomial hash modulo 2 ** 64 with an odd base."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@functools.cache
def texts():
    near = BASE.split()
    near[60] = "zzz"
    far = BASE.split()
    far[::7] = ["y"] * len(far[::7])
    return [
        None, "", "   \t\n", "one", "one two three four", "One two\x0bthree four", BASE, BASE, " ".join(near), " ".join(far), BASE.upper(),
        prose(40) + " " + PASSAGE + " " + prose(30), PASSAGE + "\n" + prose(50), prose(20) + "\n" + PASSAGE[: len(PASSAGE) // 2],
        "go " * 300, prose(20000), prose(35), "a" * 30000, "café 日本語     x", "\x00\x01\x02 ﻿ end", "12 34 56 !!! ...",
        "mail a.b+c@d-e.fr, x@y, a@b.c_d@e.f; ip 1.2.3.4.5.6.7.8 300.1.1.1 001.2.3.4", "card 4111 1111 1111 1111 or 4111-1111-1111-1112, call +1 (555) 123-4567 now",
        "CC-BY cc by; Cc.By", "GNU General Public License. All rights reserved. all RIGHTS reserved", "▁ mark ▁▁ and  two spaces ", "<|endoftext|> x <0x0A>",
        *(" ".join([w] * 41) for w in twins()), *(" ".join(w if i % 5 == 0 else f"w{i}" for i in range(45)) for w in twins()),
    ]


@functools.cache
def rows():
    clash = dict.fromkeys(("key_id", "key_hash", "_cuts", "my col.x", "row", "carried", "paths"), "mine")
    out = [Row(doc_id=i, text=t, lang="en", source="s", n_chars=0, n_words=7, spans="old", label="old", **clash) for i, t in enumerate(texts())]
    none = dict.fromkeys(("lang", "source", "n_chars", "n_words", "spans", "label", *clash))
    out += [out[6], out[11], out[6], out[15], Row(doc_id=12, text="another text of a repeated id", **none)]
    return out + [Row(doc_id=None, text=BASE, **none), Row(doc_id=None, text=prose(50), **none)] * 2


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    # rows that repeat one another lie in different files
    n, parts = len(texts()), []
    for some in (rows()[: n // 2], rows()[n // 2 : n], rows()[n : n + 3], rows()[n + 3 : n + 7], rows()[n + 7 :]):
        parts.append(spark.createDataFrame(some, SCHEMA).coalesce(1))
    functools.reduce(lambda a, b: a.union(b), parts).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return (t or "").encode().split()


def counted(tuples):
    return Counter(tuples)


def test_jaccard(docs):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    all_rows = [(r.doc_id if r.doc_id is not None else -(2**63), shingles(r.text)) for r in rows()]
    parent = list(range(len(all_rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(all_rows):
        for j, (_, b) in enumerate(all_rows[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(all_rows):
        least[top(i)] = min(d, least.get(top(i), d))
    null = lambda x: None if x == -(2**63) else x
    want = counted((null(d), len(s), null(least[top(i)])) for i, (d, s) in enumerate(all_rows))
    got = counted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(docs, range_chars=40000).collect())
    assert got == want


def test_jaccard_of_many_variants(spark, tmp_path):
    """A large group of near copies, chains, and pairs about the threshold; every link counts."""
    r = random.Random(11)
    base, out = [r.choice(VOCAB) + str(r.randint(0, 99)) for _ in range(90)], []
    for i in range(260):
        w = list(base if i % 3 else base[:45] + [f"q{i}" for _ in range(1)] + base[46:])
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = f"x{r.randint(0, 40)}"
        out.append(" ".join(w))
    path = str(tmp_path / "d")
    spark.createDataFrame([(i, t) for i, t in enumerate(out)], "doc_id long, text string").write.parquet(path)
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in (t.split() for t in out)]
    parent = list(range(len(out)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = top(i), top(j)
                parent[max(x, y)] = min(x, y)
    got = {r.doc_id: r.component_id for r in jaccard_components(spark.read.parquet(path)).collect()}
    assert got == {i: top(i) for i in range(len(out))}


def test_near_duplicates_keep_one_of_each_group(docs):
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    got = counted(r.doc_id for r in kept.collect())
    assert got[None] == 4 and got[6] == 0 and got[7] == 0 and got[8] == 0 and got[10] == 0  # the null id is the smallest
    assert all(got[i] == 1 for i in (0, 1, 2, 3, 9, 16)) and got[11] == 2 and got[15] == 2 and got[12] == 2
    assert {r.key_id for r in kept.collect()} <= {"mine", None} and {r["my col.x"] for r in kept.collect()} <= {"mine", None}
    once = drop_near_duplicates(docs, one_row=True)
    assert once.columns == docs.columns and {k: v for k, v in counted(r.doc_id for r in once.collect()).items() if v > 1} == {12: 2, None: 2}


def test_substring_dedup(docs, none):
    all_rows = [(r.doc_id, words(r.text)) for r in rows()]
    seen = Counter(tuple(w[i : i + 35]) for _, w in all_rows for i in range(len(w) - 34))
    want = []
    for d, w in all_rows:
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        want.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    for bits in (64, 7):  # with 7 bits nearly all windows meet others' hashes, and only their words tell them apart
        frame = drop_repeats(docs, range_chars=40000, bits=bits)
        got = frame.collect()
        assert counted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == counted(want)
        assert all(r["my col.x"] in ("mine", None) and r.key_id in ("mine", None) for r in got) and set(docs.columns) < set(frame.columns)
    assert sum(r.n_removed for r in got if r.doc_id is None) > 0 and not any(r.n_removed for r in got if r.doc_id in (len(texts()) - 1, len(texts()) - 2))
    assert drop_repeats(none).count() == 0
    paths = repeated_paths(docs).collect()
    assert paths and all(p.places > 1 for p in paths)


def test_packing(docs, none):
    from tokenizers import Tokenizer
    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {}
    for r in rows():
        ids.setdefault(r.doc_id, []).append([*tok.encode(r.text or "", add_special_tokens=False).ids, 1])
    got = packing.pack(docs).collect()
    assert len({r.sequence_id for r in got}) == len(got) and all(r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 2048 for r in got)
    back = Counter()
    pieces = {}
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    for d, lists in ids.items():
        for one in lists:
            same = sum(x == one for x in lists)
            parts = pieces[d, len(one)]
            assert sum(len(p) for _, p in parts) == len(one) * sum(len(x) == len(one) for x in lists)
            assert all((s, one[s : s + len(p)]) == (s, p) or len({tuple(x) for x in lists if len(x) == len(one)}) > 1 for s, p in parts), (d, same)
            back[d] += 1
    assert packing.pack(none).count() == 0
    by_task = {}
    for r in packing.pack(docs).withColumn("task", F.spark_partition_id()).select("task", "length").collect():
        by_task.setdefault(r.task, []).append(r.length)
    assert all(x == sorted(x) for x in by_task.values())
    assert packing.pieces(2048 + 5, 2048) == [2048, 4, 1]


def test_entities(docs, none):
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]

    def spans(t):
        out = []
        for k, p in enumerate(patterns):
            for m in re.finditer(p, t or ""):
                d = re.sub("[^0-9]", "", m[0])
                luhn = sum(v - 9 * (v > 9) for i, c in enumerate(reversed(d)) for v in [int(c) * (1 + i % 2)]) % 10 == 0
                if (k == 1 and any(int(x) > 255 for x in m[0].split("."))) or (k == 2 and not (12 <= len(d) <= 19 and luhn)) or (k == 3 and not 9 <= len(d) <= 15):
                    continue
                out.append((m.start(), k, m.end()))
        return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))

    got = counted((r.doc_id, r.base_sha256) for r in pii.digests(pii.find(docs)).collect())
    assert got == counted((r.doc_id, hashlib.sha256(spans(r.text).encode()).hexdigest()) for r in rows())
    assert pii.find(none).count() == 0


def test_terms_that_disclose_an_entity_go(spark):
    mail = "owl@example.com"
    told = [f"report {i}: the secretary Zyxwvut wrote to {mail} about item {i} again" for i in range(6)]
    other = [f"report {i}: the secretary of the office wrote about item number {i} again" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(told + other + [None])), "doc_id long, text string")
    found = {r.doc_id: r for r in pii.find(docs).collect()}
    assert all({told[i][t.start : t.end] for t in found[i].terms} == {"Zyxwvut"} for i in range(6))
    assert all(not found[i].terms and not found[i].base for i in range(6, 67))
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[0] == "report 0: the secretary [TERM] wrote to [EMAIL] about item 0 again" and clean[66] is None and clean[10] == other[4]


def test_terms_anywhere_in_the_document_disclose_an_entity(spark):
    mail = "owl@example.com"
    filler = "and then the office went on about the other matters of the week as it always did before"
    block = [f"Zyxwvut, head of item {i}\n\n{filler}\n{filler}\nwrite to {mail}\n{filler}\nsigned: ZYXWVUT" for i in range(6)]
    pair = [f"Qponmlk {filler} number {i}\n{filler}\n10.0.0.7" for i in range(2)]
    copies = [f"Hgfedcb {filler}\n{filler}\n10.0.0.8"] * 5
    other = [f"report {i}: the head of the office signed and will write about item number {i} of {filler}" for i in range(600)] + ["Zyxwvut without an address"]
    docs = spark.createDataFrame(list(enumerate(block + pair + copies + other)), "doc_id long, text string")
    found = {r.doc_id: r for r in pii.find(docs).collect()}
    assert all([block[i][t.start : t.end] for t in found[i].terms] == ["Zyxwvut", "ZYXWVUT"] for i in range(6))
    assert all([pair[i - 6][t.start : t.end] for t in found[i].terms] == ["Qponmlk"] for i in (6, 7))
    assert not any(found[i].terms for i in range(8, len(found)))  # five copies are one text: chance explains one; no entity, no term
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[0] == f"[TERM], head of item 0\n\n{filler}\n{filler}\nwrite to [EMAIL]\n{filler}\nsigned: [TERM]" and clean[613] == other[-1]


def test_disclosing_terms_are_those_of_brute_force(spark):
    """Every pair of an entity and a term, by the definition: PMI against IC, and a tail bound over all pairs."""
    import math

    r = random.Random(8)
    names = ["".join(r.choice("bcdfghjk") for _ in range(6)) for _ in range(12)]
    common = ["".join(r.choice("aeioulmn") for _ in range(5)) for _ in range(25)]
    out = []
    for i in range(260):
        words = [r.choice(common) for _ in range(r.randint(4, 14))]
        k = r.randrange(12)
        if i % 3 == 0:
            words.insert(r.randrange(len(words)), f"m{k}@x.org")
            if r.random() < 0.9:
                words.insert(r.randrange(len(words)), names[k].upper() if r.random() < 0.3 else names[k])
        elif r.random() < 0.03:
            words.append(names[k])
        out.append(" ".join(words))
    out += out[:20]
    docs = spark.createDataFrame(list(enumerate(out)), "doc_id long, text string")
    terms = [{w.lower() for w in re.findall(r"[^\W\d_]{3,}", t)} for t in out]
    held = [set(re.findall(r"m\d+@x\.org", t)) for t in out]
    n, entities, vocabulary = len(out), sorted(set().union(*held)), sorted(set().union(*terms))
    least = math.log2(len(entities) * len(vocabulary) / pii.CHANCE)
    told = {}
    for e in entities:
        df = sum(e in h for h in held)
        texts = {t for t, h in zip(out, held) if e in h}
        for t in vocabulary:
            df_term = sum(t in x for x in terms)
            c = sum(e in h and t in x for h, x in zip(held, terms))
            y = sum(t in {w.lower() for w in re.findall(r"[^\W\d_]{3,}", x)} for x in texts)
            if not c or df == n:
                continue
            share, part, bits = df_term / n, y / len(texts), 0.0
            if part > share:
                bits = len(texts) * (part * math.log2(part / share) + ((1 - part) * math.log2((1 - part) / (1 - share)) if part < 1 else 0))
            if math.log2(c * n / (df_term * df)) >= pii.DISCLOSURE * math.log2(n / df) and bits >= least:
                told.setdefault(e, set()).add(t)
    want = {i: sorted((m.start(), m.end()) for m in re.finditer(r"[^\W\d_]{3,}", out[i]) if m[0].lower() in set().union(*(told.get(e, set()) for e in held[i])) and not any(a.start() < m.end() and m.start() < a.end() for a in re.finditer(r"m\d+@x\.org", out[i]))) for i in range(n)}
    got = {r.doc_id: sorted((t.start, t.end) for t in r.terms) for r in pii.find(docs).collect()}
    assert got == want and sum(map(len, want.values())) > 40


def test_sanitised_rows_keep_their_columns(docs):
    clean = pii.sanitise(docs)
    assert clean.columns == docs.columns
    got = clean.collect()
    assert len(got) == len(rows()) and {r.key_id for r in got} == {"mine", None} and {r._cuts for r in got} == {"mine", None}
    assert any("[EMAIL]" in (r.text or "") for r in got)


def test_licenses(docs, none):
    def base(t):
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w, at, labels = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t), [], set()
        for p, label in licenses.BASE:
            n = len(p.split())
            for i in range(len(w) - n + 1):
                if w[i : i + n] == p.split():
                    at.append(i)
                    labels.add(label)
        return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))

    got = licenses.scan(docs).collect()
    assert counted((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == counted((r.doc_id, *base(r.text)) for r in rows())
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    assert licenses.scan(none).count() == 0


def test_license_rules_suppress_what_a_grant_contains(spark):
    docs = spark.createDataFrame([(1, "Licensed under the Apache License, Version 2.0"), (2, "the MIT license and the Apache license"), (3, "no such thing")], "doc_id long, text string")
    assert len(licenses.rules()) > 200
    got = [(r.doc_id, r.label, r.first_word, r.end_word) for r in licenses.detections(docs).orderBy("doc_id", "first_word").collect()]
    assert got == [(1, "apache-2.0", 0, 8), (2, "mit", 1, 3), (2, "apache-2.0", 5, 7)]
    assert {r.doc_id: r.labels for r in licenses.scan(docs).collect()} == {1: "apache-2.0", 2: "apache-2.0,mit", 3: ""}


def test_license_suppression_is_that_of_brute_force(spark):
    """Of all matches of all rules, those that none of the same or a higher priority contains."""
    r = random.Random(4)
    words = "the mit license apache 2 0 licensed under terms of gnu general public v3 gpl or later creative commons attribution share alike copyright 2020 all rights reserved see full bsd 3 clause is proprietary and confidential".split()
    out = [" ".join(r.choice(words) for _ in range(r.randint(5, 60))) for _ in range(60)] + ["licensed under the terms of the gnu general public license version 3 or later see the full text of the mit license"]
    docs = spark.createDataFrame(list(enumerate(out)), "doc_id long, text string")
    table, want = licenses.rules(), {}
    for i, t in enumerate(out):
        norm = f" {t} "
        hits = sorted((m.start(), -m.end(), -rule.priority, k) for k, rule in enumerate(table) for m in re.finditer(f"(?<= )(?:{rule.regex})(?= )", norm))
        kept = [h for j, h in enumerate(hits) if not any(g[2] <= h[2] and g[0] <= h[0] and g[1] <= h[1] for g in hits[:j])]
        want[i] = Counter((table[k].label, norm[: a].count(" ") - 1, norm[: -e].count(" ")) for a, e, _, k in kept)
    got = {i: Counter() for i in range(len(out))}
    for x in licenses.detections(docs).collect():
        got[x.doc_id][x.label, x.first_word, x.end_word] += 1
    assert got == want and sum(map(len, want.values())) > 60
    assert {x.doc_id: set(filter(None, x.labels.split(","))) for x in licenses.scan(docs).collect()} == {i: {k[0] for k in c} | {label for p, label in licenses.BASE if f" {p} " in f" {out[i]} "} for i, c in want.items()}


def sample(parsed, r):
    """A text that a parsed regex matches."""
    out = []
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            out.append(chr(arg))
        elif op == "IN":
            kind, value = r.choice(arg)
            out.append(chr(value) if str(kind) == "LITERAL" else chr(r.randint(*value)) if str(kind) == "RANGE" else "1" if str(value) == "CATEGORY_DIGIT" else "x")
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            out += [sample(arg[2], r) for _ in range(r.randint(arg[0], min(int(arg[1]), arg[0] + 2)))]
        elif op == "BRANCH":
            out.append(sample(r.choice(arg[1]), r))
        else:
            assert op == "SUBPATTERN", op
            out.append(sample(arg[3], r))
    return "".join(out)


def test_license_gates_hide_no_alternative(spark, monkeypatch):
    r = random.Random(9)
    patterns = [names for _, _, names in licenses.FAMILIES] + [o[-1] for o in licenses.OTHERS]
    found = {sample(re._parser.parse(p), r) for p in patterns for _ in range(25)}
    told = {
        "Licensed under the AGPLv3": "agpl-3.0", "AGPL 3": "agpl-3.0", "GNU General Public License v2": "gpl-2.0", "GNU General Public License v3.0": "gpl-3.0",
        "LGPL v2.1": "lgpl-2.1", "MPL 2.0": "mpl-2.0", "EPL-2.0": "epl-2.0", "CDDL 1.0": "cddl", "SIL OFL 1.1": "ofl", "PSF license": "python", "ODC ODbL": "odbl", "All rights are reserved": "reserved", "without warranties of any kind": "disclaimer",
    }
    docs = spark.createDataFrame(list(enumerate([*told, *sorted(found)])), "doc_id long, text string")
    gated = {x.doc_id: x.labels for x in licenses.scan(docs).collect()}
    assert all(v in gated[i].split(",") for i, v in enumerate(told.values()))
    rules = [rule._replace(keywords=("",)) for rule in licenses.rules()]
    monkeypatch.setattr(licenses, "rules", lambda: rules)
    monkeypatch.setattr(licenses, "GATES", ("",))
    assert gated == {x.doc_id: x.labels for x in licenses.scan(docs).collect()} and all(gated.values())


def test_piece_tokenizer_round_trip(docs, none):
    coded = piece_tokenizer.encode(docs)
    got = counted((r.doc_id, r.text) for r in piece_tokenizer.decode(coded).collect())
    assert got == counted((r.doc_id, r.text or "") for r in rows())
    assert piece_tokenizer.encode(none).count() == 0


def test_piece_tokenizer_is_the_best_segmentation():
    model = piece_tokenizer.pieces("piece_bpe_32k.model")
    sample = sorted({w for t in texts() if t and len(t) < 5000 for w in model.marked(t)} | {"▁the", "▁there", "▁therefore", "▁thé", "xx"})
    got = model.best(sample)
    score = {i: s for i, s in model.ids.values()}

    def best(word):
        top = [0.0] + [-1e9] * len(word)
        for e in range(1, len(word) + 1):
            for s in range(max(0, e - 16), e):
                if word[s:e] in model.ids:
                    top[e] = max(top[e], top[s] + model.ids[word[s:e]][1])
            if word[e - 1] not in model.ids:
                raw = ("▁" if word[e - 1] == piece_tokenizer.LITERAL else word[e - 1]).encode()
                top[e] = max(top[e], top[e - 1] + model.unknown * len(raw))
        return top[-1]

    for w in sample:
        assert abs(sum(score.get(i, model.unknown) for i in got[w]) - best(w)) < 1e-6, w


def test_language(spark, docs, none):
    r = random.Random(5)
    langs = {"aa": ["ulu", "wawa", "oolo", "kuku"], "bb": ["stren", "gths", "ckts", "nd"], "cc": ["été", "çaçà", "oùoù", "êê"]}
    data = [(i, " ".join(r.choice(v) + r.choice(v) for _ in range(r.randint(3, 40))), k) for i, (k, v) in enumerate(list(langs.items()) * 60)]
    table = spark.createDataFrame(data + [(9999, "123 !!", None), (10000, None, "aa"), (None, "ulu wawa", None)], "doc_id long, text string, lang string")
    model = language_id.train(table.where(~language_id.crc32_mod4_is_2(F.col("doc_id"))))
    got = {r.doc_id: r for r in language_id.identify(table, model).collect()}
    assert all(got[i].lang_pred == k and 0 <= got[i].score <= 1 for i, _, k in data)
    assert (got[9999].lang_pred, got[9999].score) == ("und", 0) and got[10000].lang_pred == "und" and got[None].lang_pred == "aa"
    assert language_id.identify(none, model).count() == 0 and language_id.identify(docs, model).count() == len(rows())
    empty = language_id.train(none)
    assert {x.lang_pred for x in language_id.identify(docs, empty).collect()} == {"und"}


def test_quality(spark, docs, none):
    r = random.Random(9)
    make = {0: lambda: " | ".join(r.choice(VOCAB) + "%%%" for _ in range(30)), 1: lambda: prose(30) + " nasty " + prose(5), 2: lambda: prose(40)}
    data = [(i, make[i % 3](), i % 3) for i in range(600)]
    table = spark.createDataFrame(data, "doc_id long, text string, grade int")
    model = quality.train(table.where("doc_id % 5 <> 0"), table.where("doc_id % 5 <> 0").select("doc_id", "grade"))
    assert (np.diff(model.thresholds) > 0).all()
    held = quality.grade(table.where("doc_id % 5 = 0").drop("grade").withColumn("p_best", F.lit("old")), model).collect()
    right = sum((r.p_best >= 0.5) == (r.doc_id % 3 == 2) for r in held)
    assert right >= 0.9 * len(held) and all(0 <= r.expected_grade <= 2 for r in held)
    assert quality.grade(docs, model).count() == len(rows()) and quality.grade(none, model).count() == 0
    kept = quality.drop_rejected(table.drop("grade"), table.select("doc_id", "grade"))
    assert kept.columns == ["doc_id", "text"] and 150 <= kept.count() <= 260
    assert quality.drop_rejected(docs, table.select("doc_id", "grade").limit(0)).count() == len(rows())


def test_quality_is_maximum_likelihood():
    """The gradient of the penalised likelihood, by differences, is next to nothing at what fit() returns, and every step away is worse."""
    g = np.random.default_rng(3)
    n, bits = 240, 5
    grade = g.integers(0, 3, n)
    doc, slot = [], []
    for i in range(n):
        some = np.unique(np.concatenate([g.integers(0, 32, 5), g.choice([grade[i] * 3, 20], 1)]))
        doc += [i] * len(some)
        slot += some.tolist()
    doc, slot, decay = np.array(doc), np.array(slot), 1e-2
    model = quality.fit(doc, slot, grade, bits, steps=3000, decay=decay, min_rows=1)
    scale = np.bincount(doc, minlength=n) ** -quality.DAMPING

    def loss(w, t):
        score = np.bincount(doc, w[slot], n) * scale
        above = np.concatenate([np.ones((n, 1)), 1 / (1 + np.exp(-(score[:, None] - t[None, :]))), np.zeros((n, 1))], axis=1)
        return -np.log(above[np.arange(n), grade] - above[np.arange(n), grade + 1]).mean() + decay * (w @ w) / 2

    at, w, t = loss(model.weights, model.thresholds), model.weights, model.thresholds
    for k in range(len(w) + len(t)):
        step = np.zeros(len(w) + len(t))
        step[k] = 1e-4
        up, down = (loss(w + s * step[: len(w)], t + s * step[len(w) :]) for s in (1, -1))
        assert abs(up - down) / 2e-4 < 2e-3, k
        for size in (0.3, -0.3):
            assert loss(w + size / 1e-4 * step[: len(w)], t + size / 1e-4 * step[len(w) :]) > at or np.any(np.diff(t + size / 1e-4 * step[len(w) :]) <= 0)
    tails = model.tails(doc, slot, n)
    assert np.all(np.diff(tails, axis=1) < 0) and np.allclose(tails[:, 0], 1 / (1 + np.exp(-(np.bincount(doc, w[slot], n) * scale - t[0]))))


def test_quality_trains_on_one_row_of_a_repeated_id(spark, monkeypatch):
    rows_ = [(i % 7, f"word{i % 3} text {i}") for i in range(70)]
    docs = spark.createDataFrame(rows_, "doc_id long, text string")
    ratings = spark.createDataFrame([(i, i % 2) for i in range(7)], "doc_id long, grade int")
    seen = {}
    real = quality.fit
    monkeypatch.setattr(quality, "fit", lambda doc, slot, grade, bits: seen.update(n=len(grade)) or real(doc, slot, grade, bits))
    quality.train(docs, ratings)
    assert seen["n"] == 7


def test_language_with_all_rows_as_landmarks_is_kernel_ridge_regression():
    r = random.Random(12)
    make = {"pp": "abcd", "qq": "cdef", "rr": "efgh"}
    data = [("".join(r.choice(v + " ") for _ in range(60)).encode(), k) for k, v in make.items() for _ in range(25)]
    width, ridge = 1 << 10, 1e-2
    present = np.stack([language_id.presence(t, width) for t, _ in data])
    unit = present / np.sqrt(present.sum(axis=1))[:, None]
    kernel = unit @ unit.T
    labels = np.array([k for _, k in data])
    target = np.where(labels[:, None] == np.array(sorted(make))[None, :], 1.0, -1.0)
    dual = np.linalg.solve(kernel + ridge * len(data) * np.eye(len(data)), target)
    new = np.stack([language_id.presence("".join(r.choice("abcdefgh ") for _ in range(50)).encode(), width) for _ in range(40)])
    want = (new / np.sqrt(new.sum(axis=1))[:, None]) @ unit.T @ dual
    model = language_id.fit(np.packbits(present, axis=1), labels.tolist(), width, landmarks=len(data), ridge=ridge)
    assert model.languages == sorted(make) and np.allclose(model.scores(new), want, atol=2e-3)


def test_every_language_is_learned(spark):
    """300 languages of two rows each, one of which is very frequent."""
    word = lambda i: "".join(chr(0x4E00 + 7 * i + j) for j in range(6))
    data = [(i, word(i % 300) + " " + word(i % 300)[:: 1 + i // 300], f"l{i % 300:03d}") for i in range(600)] + [(1000 + i, word(0), "l000") for i in range(3000)]
    table = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = language_id.train(table)
    assert len(model.languages) == 300
    got = {r.doc_id: r.lang_pred for r in language_id.identify(table, model).collect()}
    assert sum(got[i] == k for i, _, k in data[:600]) >= 550
