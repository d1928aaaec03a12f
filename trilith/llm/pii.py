"""Operator 3, PII: information-theoretic sanitisation, in DataFrame functions only.

Protected entities are what patterns find: e-mail addresses, IP addresses, payment card and phone numbers. A term of a
document that holds an entity, wherever in it, discloses the entity as far as the two share information: with document
counts over the whole corpus, PMI(term; entity) = log2(c * N / (df(term) * df(entity))), against the entity's own
information IC = log2(N / df). Terms with PMI / IC at the threshold or above are generalised to a label, as entities are,
unless chance explains it: were the x texts of an entity drawn at random, y of them or more would hold a term of share q
with a probability of at most 2 ** -(x * KL(y / x, q)), and the corpus has as many trials as entities times terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NULL_ID, checkpointed, read, with_key
from .native import let, matches, matches_if

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: Runs are taken whole, never given back: the same matches, in time that grows with the text alone.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Share of an entity's information that a term may disclose, and how many of all pairs flagged may be there by chance.
DISCLOSURE, CHANCE = 0.8, 0.05
#: A term: three or more letters.
WORD = r"\p{L}{3,}+"
PLACES = "array<struct<start:bigint,end:bigint>>"


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    each = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: let(F.substring(digits, -i, 1).cast("int") * F.when(i % 2 == 0, 2).otherwise(1), lambda d: F.when(d > 9, d - 9).otherwise(d)))
    return F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        part = lambda p: let(F.regexp_replace(p, "^0+", ""), lambda q: (F.length(q) <= 3) & (F.when(F.length(q) <= 3, F.concat(F.lit("0"), q)).otherwise("256").cast("int") <= 255))
        return F.forall(F.split(hit, r"\."), part)
    if kind == "card":
        return let(_digits(hit), lambda d: F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(hit)).between(9, 15)
    return F.lit(True)


def _gate(kind: str, text: Column) -> Column:
    return {"email": F.instr(text, "@") > 0, "ip": F.rlike(text, F.lit(r"[0-9]\.[0-9]")), "card": F.rlike(text, F.lit(r"[0-9](?:[\x20-]?[0-9]){11}")), "phone": F.instr(text, "+") > 0}[kind]


def entity_spans(text: Column) -> Column:
    """The entities of a text: array of kind (its place in KINDS), start, end, hit; by start, then kind."""

    def of(i: int, kind: str) -> Column:
        found = F.filter(matches_if(_gate(kind, text), text, PATTERNS[kind]), lambda m: _valid(kind, m["hit"]))
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(i).alias("kind"), m["end"].alias("end"), m["hit"].alias("hit")))

    return F.array_sort(F.concat(*(of(i, k) for i, k in enumerate(KINDS))))


def _entity(kind: Column, hit: Column) -> Column:
    """One name for one entity however it is written."""
    return F.concat(kind.cast("string"), F.lit(":"), F.when(kind >= 2, _digits(hit)).otherwise(F.lower(hit)))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(F.split(text, r"[^\p{L}]+"), lambda t: F.length(t) >= 3), F.lower))


def _bits(texts: Column, of: Column, share: Column) -> Column:
    """-log2 of the bound on the probability that `texts` or more of `of` texts hold a term of that share; 0 up to the share."""
    y = texts / of
    rest = F.when(texts < of, (1 - y) * F.log2((1 - y) / (1 - share))).otherwise(0.0)
    return F.when(y > share, of * (y * F.log2(y / share) + rest)).otherwise(0.0)


def _flagged(keyed: DataFrame, base: DataFrame, n_docs: int, disclosure: float, chance: float) -> DataFrame:
    """key_id, key_hash, told: the terms that disclose entities of a document, for documents with any."""
    n = F.lit(float(n_docs))
    held = base.where("text IS NOT NULL")
    named = held.select("key_id", "key_hash", F.explode(F.array_distinct(F.transform("base", lambda s: s["entity"]))).alias("entity"))
    # copies of a text are documents, but no further evidence
    entities = checkpointed(named.groupBy("entity", "key_hash").agg(F.count("*").alias("c")).groupBy("entity").agg(F.sum("c").alias("df_entity"), F.count("*").alias("of")))
    df_term = checkpointed(keyed.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df_term")))
    least = F.log2(F.lit(max(1.0, float(entities.count()) * df_term.count() / chance)))
    # y texts that hold both say y * log2(N / y) bits at most: what stays below `least` even then isn't paired or joined
    possible = lambda y: (F.col(y) < n) & (F.col(y) * F.log2(n / F.col(y)) >= least - 1e-6)
    some = named.join(entities.where(possible("of")).select("entity"), "entity").groupBy("key_id", "key_hash").agg(F.collect_set("entity").alias("some"))
    pairs = held.select("key_id", "key_hash", "text").join(some, ["key_id", "key_hash"]).select("key_hash", "some", F.explode(_terms(F.col("text"))).alias("term")).select("key_hash", "term", F.explode("some").alias("entity"))
    together = pairs.groupBy("entity", "term", "key_hash").agg(F.count("*").alias("c")).groupBy("entity", "term").agg(F.sum("c").alias("c"), F.count("*").alias("texts")).where(possible("texts"))
    scored = together.join(df_term, "term").join(entities, "entity")
    ic = F.log2(n / F.col("df_entity"))
    pmi = F.log2(F.col("c") * n / (F.col("df_term") * F.col("df_entity")))
    flagged = scored.where((ic > 0) & (pmi >= ic * disclosure) & (_bits(F.col("texts"), F.col("of"), F.col("df_term") / n) >= least))
    told = flagged.groupBy("entity").agg(F.collect_set("term").alias("told"))
    return named.join(told, "entity").groupBy("key_id", "key_hash").agg(F.array_distinct(F.flatten(F.collect_set("told"))).alias("told"))


def find(docs: DataFrame, disclosure: float = DISCLOSURE, chance: float = CHANCE) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, key_id, key_hash, base, terms: one row per row of docs.

    base: entities (start, kind, end, hit), by start and kind; terms: spans (start, end) of every place of a term that
    discloses an entity of the document, outside of entities. Offsets are code points, ends exclusive. A null text
    counts as empty and has none; rows that repeat a doc_id are documents of their own; a null doc_id stays null; other
    columns are ignored; an empty table gives an empty result. Counts are over all documents, and an entity or term in
    a third of them is counted before it is shuffled.
    """
    keyed = with_key(docs)
    spans = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), _entity(s["kind"], s["hit"]).alias("entity")))
    base = checkpointed(keyed.withColumn("base", entity_spans(F.col("text"))).select("doc_id", "key_id", "key_hash", F.when(F.size("base") > 0, F.col("text")).alias("text"), spans.alias("base")))
    told = checkpointed(_flagged(keyed, base, base.count(), disclosure, chance))
    if not told.isEmpty():
        words = F.filter(matches(F.col("text"), WORD), lambda m: F.array_contains("told", F.lower(m["hit"])))
        outside = F.filter(words, lambda t: ~F.exists("base", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
        places = base.where("text IS NOT NULL").join(told, ["key_id", "key_hash"]).select("key_id", "key_hash", F.transform(outside, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"))).alias("terms"))
        base = base.drop("text").join(places.dropDuplicates(["key_id", "key_hash"]), ["key_id", "key_hash"], "left")
    else:
        base = base.withColumn("terms", F.lit(None).cast(PLACES))
    return base.select("doc_id", "key_id", "key_hash", F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))).alias("base"), F.coalesce("terms", F.array().cast(PLACES)).alias("terms"))


def _all(base: Column, terms: Column) -> Column:
    return F.array_sort(F.concat(base, F.transform(terms, lambda t: F.struct(t["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), t["end"].alias("end")))))


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, (*KINDS, TERM)))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    """Of find(): doc_id, numbers of each kind, base_sha256, spans."""
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    return found.select("doc_id", *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(_all(F.col("base"), F.col("terms"))).alias("spans"))


def sanitise(docs: DataFrame, disclosure: float = DISCLOSURE, chance: float = CHANCE) -> DataFrame:
    """docs with entities and disclosing terms in text replaced by labels such as [EMAIL] and [TERM]; all columns stay.

    Of overlapping spans the part not yet covered is replaced. Texts without spans, null ones included, stay as they are.
    """
    found = find(docs, disclosure, chance).select("key_id", "key_hash", _all(F.col("base"), F.col("terms")).alias("_spans")).where(F.size("_spans") > 0).dropDuplicates(["key_id", "key_hash"])
    w = Window.partitionBy("key_id", "key_hash").orderBy("start", "kind", "end")
    rows = found.select("key_id", "key_hash", F.explode("_spans").alias("s")).select("key_id", "key_hash", "s.*").withColumn("from", F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))).where(F.col("end") > F.col("from"))
    cuts = rows.groupBy("key_id", "key_hash").agg(F.array_sort(F.collect_list(F.struct("from", F.greatest("start", "from").alias("start"), "end", "kind"))).alias("_cuts"))
    labels = F.array(*(F.lit(f"[{k.upper()}]") for k in (*KINDS, TERM)))
    keys = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("key_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key_hash"))
    joined, text = keys.join(cuts, ["key_id", "key_hash"], "left"), F.col("row").getField("text")
    part = F.transform("_cuts", lambda c: F.concat(F.substring(text, (c["from"] + 1).cast("int"), (c["start"] - c["from"]).cast("int")), F.get(labels, c["kind"])))
    rest = F.substring(text, (F.element_at("_cuts", -1)["end"] + 1).cast("int"), F.length(text))
    clean = F.when(F.col("_cuts").isNull(), text).otherwise(F.concat(F.array_join(part, ""), rest))
    return joined.select(*(clean.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(find(read(spark, sf_dir, "documents")))
