"""Personal data, and the terms that give it away (native).

Emails, IP addresses, payment cards and phone numbers are found by pattern (and card numbers by
their check digit). They are protected entities twice over: each by itself, and by the wider
one that it belongs to and that more texts share: an email's domain, the first two parts of an
address, a card's issuer (six digits), a phone number without its last seven digits. Masking them is not enough where other words
reveal them all the same, so the corpus says how strongly each term does: with documents as
events, the pointwise mutual information of a term and an entity is compared to the information
content of the entity, and a term whose PMI reaches ``DISCLOSURE`` of it discloses the entity.
Co-occurrence means within one document, however far apart; a term inside of an entity does not
co-occur with that one, nor with the wider one. A term needs ``SUPPORT`` distinct
texts with the entity, so that one text and its copies give nothing away. A disclosing term becomes
a span of kind ``term`` wherever it stands outside of entities, in documents without its entity too; ``sanitised``
generalises terms and entities to their kind; what overlaps is generalised as one.

Patterns are anchored where a run begins and are possessive, so that long runs of digits or
letters cost no more than their length; they match what the plain patterns match. Counts cover all
documents: term frequencies are partial sums before their shuffle, and pairs are dealt by entity
and term, so that a frequent term or entity is spread over its partners. An entity in fewer than
``SUPPORT`` texts can have no pair with so many and is left out before pairs are made; where no
entity is left, terms aren't counted at all. Entities and terms of each distinct text with entities are checkpointed.

Null texts count as empty. Repeated rows count as documents each and get the same spans. Other
columns pass through; columns named as a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlake.llm.common import cut, fingerprint, let
from flowlake.llm.spans import SPAN, masked, matches, spans

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9]){11,}+"  # chains of 12 digits and more, taken whole
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
TERM = r"\p{L}{4,}+"
SUPPORT = 3
DISCLOSURE = 0.9
BROADCAST_ROWS = 100_000
KINDS = ("email", "ip", "card", "phone", "term")


def digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the check digit of a string of digits is right."""

    def value(d: Column, i: Column) -> Column:
        twice = d * (1 + i % 2)
        return twice - F.when(twice > 9, 9).otherwise(0)

    back = F.transform(F.filter(F.split(F.reverse(number), ""), lambda c: c != ""), lambda c: c.cast("int"))
    return F.aggregate(F.transform(back, value), F.lit(0), lambda a, x: a + x) % 10 == 0


def is_card(found: Column) -> Column:
    return let(digits(found), lambda d: F.length(d).between(12, 19) & luhn(d))


BASE = (
    ("email", EMAIL, None),
    ("ip", IP, lambda f: f.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")),
    ("card", CARD, is_card),
    ("phone", PHONE, lambda f: F.length(digits(f)).between(9, 15)),
)


def base_spans(body: Column) -> Column:
    """Emails, addresses, cards and phones of a text."""
    return F.concat(*[spans(body, kind, at, pattern, 0, keep) for at, (kind, pattern, keep) in enumerate(BASE)])


def terms_of(body: Column) -> Column:
    """The distinct terms of a text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(body), F.lit(TERM), F.lit(0)))


def small(frame: DataFrame) -> DataFrame:
    """``frame``, broadcast in joins when it has few rows; ``frame`` is checkpointed, so its size isn't known to Spark."""
    return F.broadcast(frame) if frame.count() <= BROADCAST_ROWS else frame


def entities_of(body: Column, s: Column) -> Column:
    """What a span protects, as hashes: its own text and the wider entity that it belongs to."""

    def both(found: Column) -> Column:
        number = digits(found)
        wider = F.when(s["kind"] == "email", F.substring_index(found, "@", -1)).when(s["kind"] == "ip", F.substring_index(found, ".", 2))
        wider = wider.when(s["kind"] == "card", F.substring(number, 1, 6)).otherwise(F.substring(number, F.lit(1), F.length(number) - 7))
        return F.array(F.xxhash64(s["kind"], found), F.xxhash64(F.concat(s["kind"], F.lit("~")), wider))

    return let(F.lower(F.substring(body, s["start"] + 1, s["end"] - s["start"])), both)


def owned_terms(body: Column, found: Column) -> Column:
    """(term, owners) of a text: its terms outside of entities, and those inside of one with what it protects."""
    term = lambda t, owners: F.struct(t.alias("term"), owners.alias("owners"))
    inside = lambda s: F.transform(terms_of(F.substring(body, s["start"] + 1, s["end"] - s["start"])), lambda t: term(t, entities_of(body, s)))
    outside = F.transform(terms_of(masked(body, found, lambda s: F.lit(" "))), lambda t: term(t, F.lit(None).cast("array<long>")))
    return F.array_union(outside, F.flatten(F.transform(found, inside)))


def disclosing(rows: DataFrame, held: DataFrame, entities: DataFrame, disclosure: float, support: int) -> DataFrame:
    """entity, term: the pairs whose term discloses the entity.

    ``rows``: body; ``held``: print, docs, entities, owned, one row for each distinct text;
    ``entities``: e, with_entity, those in texts enough.
    """
    keys = held.select("print", "docs", F.explode("entities").alias("entity"))
    keys = cut(keys.join(entities.select(F.col("e").alias("entity")), "entity", "left_semi"))
    other = F.filter("owned", lambda o: o["owners"].isNull() | ~F.array_contains(o["owners"], F.col("entity")))
    pairs = held.select("print", "owned").join(small(keys), "print").select("entity", "docs", F.explode(F.array_distinct(F.transform(other, lambda o: o["term"]))).alias("term"))
    pairs = pairs.groupBy("entity", "term").agg(F.sum("docs").alias("both"), F.count(F.lit(1)).alias("texts"))
    pairs = pairs.where(F.col("texts") >= support)
    terms = rows.select(F.explode(terms_of(F.col("body"))).alias("t"))
    terms = terms.groupBy("t").agg(F.count(F.lit(1)).alias("with_term"))
    total = rows.agg(F.count(F.lit(1)).alias("n"))
    known = pairs.join(entities, F.col("entity") == F.col("e")).join(terms, F.col("term") == F.col("t")).join(F.broadcast(total))
    pmi = F.log2(F.col("both").cast("double") * F.col("n") / (F.col("with_term").cast("double") * F.col("with_entity")))
    content = F.log2(F.col("n").cast("double") / F.col("with_entity"))
    return known.where((content > 0) & (pmi >= disclosure * content)).select("entity", "term")


def find_personal(docs: DataFrame, text: str = "text", disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """Every row with ``base_spans`` and ``spans``: arrays of (start, end, at, kind)."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.drop("base_spans", "spans").withColumn("base_spans", base_spans(body))
    plain = docs.select(F.col(text).alias("text")).select(fingerprint(F.col("text")).alias("print"), F.coalesce("text", F.lit("")).alias("body"))
    held = plain.withColumn("found", base_spans(F.col("body"))).where(F.size("found") > 0)
    protected = F.array_distinct(F.flatten(F.transform("found", lambda s: entities_of(F.col("body"), s))))
    held = held.select("print", protected.alias("entities"), owned_terms(F.col("body"), F.col("found")).alias("owned"))
    held = cut(held.groupBy("print").agg(F.count(F.lit(1)).alias("docs"), F.first("entities").alias("entities"), F.first("owned").alias("owned")))
    entities = held.select("docs", F.explode("entities").alias("e")).groupBy("e").agg(F.sum("docs").alias("with_entity"), F.count(F.lit(1)).alias("texts"))
    entities = cut(entities.where(F.col("texts") >= support).drop("texts"))
    if entities.isEmpty():
        return rows.withColumn("spans", F.col("base_spans"))
    told = cut(disclosing(plain, held, entities, disclosure, support).select(F.col("term").alias("t")).distinct())
    if told.isEmpty():
        return rows.withColumn("spans", F.col("base_spans"))
    held = plain.select("print", F.explode(terms_of(F.col("body"))).alias("term")).join(small(told), F.col("term") == F.col("t"))
    held = cut(held.select("print", "term").distinct())
    few = held.count() <= BROADCAST_ROWS
    held = held.groupBy(F.col("print").alias("__p")).agg(F.collect_set("term").alias("__terms"))
    rows = rows.withColumn("__print", fingerprint(F.col(text))).join(F.broadcast(held) if few else held, F.col("__print") == F.col("__p"), "left")
    span = lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(len(BASE)).alias("at"), F.lit("term").alias("kind"))
    covered = lambda m: F.exists("base_spans", lambda s: (s["start"] <= m["start"]) & (m["end"] <= s["end"]))
    places = F.transform(F.filter(matches(body, TERM), lambda m: F.array_contains("__terms", F.lower(m["found"])) & ~covered(m)), span)
    places = F.when(F.col("__terms").isNotNull(), places).otherwise(F.array().cast(SPAN))
    return rows.withColumn("spans", F.concat("base_spans", places)).drop("__print", "__p", "__terms")


def sanitised(text: Column, found: Column) -> Column:
    """The text with every span generalised to its kind."""
    return masked(text, found, lambda s: F.concat(F.lit("<"), s["kind"], F.lit(">")))
