"""Source divergence audit over the terms that an iceberg refinement of prefixes keeps.

A term is a run of letters (bytes A-Z, a-z and all above ASCII; A-Z in lower case). Of each language
the terms in ``LEAST`` documents or more are kept. They are found level by level: documents count,
once each, the prefixes of ``FIRST`` bytes of their terms; prefixes in fewer than ``LEAST``
documents are discarded, and the others are extended to twice as many bytes, until no term is
longer. A term that is no longer than the level is complete and is kept or discarded there. A rare
term is dropped with its rare prefix, and long rare terms never travel whole.

Each level is one pass over the texts: a task counts the prefixes that reach beyond the last level, drops
those without a survivor of the last level, and the rest is summed. A task's table is sent on whenever
it has ``ENTRIES`` entries or has read ``READ_BYTES``. Tasks have a bitmap of a fixed size with the hashes
of the survivors (in the last pass, of the kept terms), which spares most rows of rare terms; the
rows left are joined to the survivors, which decides.

The audit compares smoothed shares, in whole numbers: p = 1 + floor(10^9 (count + 1) / (N + V)), where
count is a kept term's occurrences in a group (a language's source), N their sum and V the kept terms.
f = floor((p - q)^2 / q). For each group, ``pair`` rows have every other source of the language (q its p)
with the sum of f over all kept terms, and ``term`` rows the terms of which the group has more than
the language (q the language's p), the first ``TOP`` of them.

Most terms of most pairs are in neither or one source only. Their f depends on a count alone, so
groups give histograms of their counts, and only terms that several sources share give pairs. The counts
of a term lie together when they are summed, so each term becomes one row with its sources there.

Null text, language and source are read as ''. A group without terms takes part with p of no count;
a language without kept terms has pairs of value 0 and no terms. Repeated rows are documents of their own.
Other columns don't matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlake.llm.common import cut
from flowlake.llm.superkmers import blocks

LEAST = 3
TOP = 200
FIRST = 4
UNITS = 1_000_000_000
LONG = 9_000_000_000  # counts below stay within a long when multiplied by UNITS
ENTRIES = 500_000
READ_BYTES = 64 << 20
BITS = 1 << 25  # of the bitmap, 4 MB
BROADCAST_ROWS = 50_000
#: Letters in lower case and bytes above ASCII stay, all else parts terms.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(LETTERS).split()


def tallied(keys: list[str], of: Callable[[bytes], list[bytes]], bitmap: bytes | None = None, size: int | None = None):
    """Counts of what ``of`` gives for each text, by the columns ``keys``: rows (*keys, item, n), several for one item.

    With ``bitmap`` only items whose first ``size`` bytes (all without) have their hash's bit set.
    """
    bits = np.frombuffer(bitmap or b"", np.uint8)

    def sent(tables: dict[tuple, Counter]) -> Iterator[pa.RecordBatch]:
        for key, table in tables.items():
            items = list(table)
            if bitmap is not None:
                at = np.fromiter((crc32(x[:size]) for x in items), np.int64, len(items)) % BITS
                items = [items[k] for k in np.flatnonzero(bits[at >> 3] >> (at & 7) & 1).tolist()]
            if items:
                columns = [pa.array([k] * len(items), pa.string()) for k in key]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(items, pa.binary()), pa.array(map(table.__getitem__, items), pa.int64())], [*keys, "item", "n"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[tuple, Counter] = {}
        read = 0
        for batch in blocks(batches):
            for *key, text in zip(*(batch[k].to_pylist() for k in keys), batch["text"].cast(pa.binary()).to_pylist()):
                table = tables.get(tuple(key))
                if table is None:
                    table = tables[tuple(key)] = Counter()
                table.update(of(text))
            read += batch["text"].nbytes
            if read >= READ_BYTES or sum(map(len, tables.values())) >= ENTRIES:
                yield from sent(tables)
                tables, read = {}, 0
        yield from sent(tables)

    return work


def prefixes(level: int, before: int) -> Callable[[bytes], set[bytes]]:
    """The distinct items of a text: complete terms of up to ``level`` bytes, and prefixes of longer ones, which end in a space."""
    distinct = set if before < 8 else iter  # few terms are longer

    def of(text: bytes) -> set[bytes]:
        return {t if len(t) <= level else t[:level] + b" " for t in distinct(terms_of(text)) if len(t) > before}

    return of


def sized(frame: DataFrame) -> DataFrame:
    """The rows, marked for broadcast when they are counted to be few; they must be cut before."""
    return F.broadcast(frame) if frame.count() <= BROADCAST_ROWS else frame


def bitmap_of(items: DataFrame) -> bytes:
    """``BITS`` bits, those of the items' hashes set."""
    at = (F.pmod(F.crc32("item"), F.lit(BITS)) + 1).alias("at")
    part = items.select(at).groupBy(F.bitmap_bucket_number("at").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    parts = {r.part: bytes(r.bits) for r in part.collect()}
    return b"".join(parts.get(k + 1, bytes(4096)) for k in range(BITS // 32768))


def counted(rows: DataFrame, keys: list[str], of: Callable[[bytes], list[bytes]], only: DataFrame | None, size: int | None = None) -> DataFrame:
    """The sums of ``tallied``, of items whose first ``size`` bytes are in ``only`` (lang, item; cut before)."""
    schema = ", ".join(f"{k} string" for k in keys) + ", item binary, n long"
    found = rows.select(*keys, "text").mapInArrow(tallied(keys, of, None if only is None else bitmap_of(only), size), schema)
    if only is not None:
        named = only.select(F.col("lang").alias("of"), F.col("item").alias("only")).hint("shuffle_hash")
        item = F.col("item") if size is None else F.substring("item", 1, size)
        found = found.join(named, (F.col("lang") == F.col("of")) & (item == F.col("only")), "left_semi")
    return found.groupBy(*keys, "item").agg(F.sum("n").alias("n"))


def kept_terms(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, item (a term's bytes): the terms in ``least`` documents or more, from rows (lang, text) without nulls."""
    level, before, open_, complete = FIRST, 0, None, []
    while open_ is None or not open_.isEmpty():
        found = counted(rows, ["lang"], prefixes(level, before), open_, before).where(F.col("n") >= least).drop("n")
        found = cut(found, release=True)
        longer = F.substring("item", -1, 1) == F.lit(b" ")
        complete.append(found.where(~longer))
        open_ = found.where(longer).select("lang", F.substring("item", 1, level).alias("item"))
        level, before = 2 * level, level
    return reduce(DataFrame.union, complete)


def share(count: Column, of_all: str = "of_all") -> Column:
    """p of a count in a group of ``of_all`` occurrences of ``size`` kept terms."""
    whole = (count + 1).cast("decimal(20,0)") * F.lit(UNITS).cast("decimal(10,0)")
    wide = F.call_function("div", whole, (F.col(of_all) + F.col("size")).cast("decimal(20,0)"))
    return F.when(count < LONG, F.call_function("div", (count + 1) * UNITS, F.col(of_all) + F.col("size"))).otherwise(wide) + 1


def gap(p: Column, q: Column) -> Column:
    """f in whole numbers; p and q are below 2^30, or 10^9 + 1 at most."""
    return F.call_function("div", (p - q) * (p - q), q)


def ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank."""
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))))
    kept = cut(kept_terms(rows, least))
    # A row for each term, with its sources in order: the counts lie by language and term already.
    order = Window.partitionBy("lang", "item").orderBy("source")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = counted(rows, ["lang", "source"], terms_of, kept)
    found = found.withColumns({"of_": F.collect_list(F.struct("source", "n")).over(whole), "total": F.sum("n").over(whole), "k": F.row_number().over(order)})
    found = cut(found.where("k = 1").select("lang", F.col("item").cast("string").alias("term"), "total", "of_"), release=True)
    each = found.select("lang", "term", "total", F.inline("of_"))
    # Groups and their languages, with their sums and what a term without count gets.
    sums = each.groupBy(F.col("lang").alias("l"), F.col("source").alias("s")).agg(F.sum("n").alias("sum"), F.count(F.lit(1)).alias("terms"))
    sizes = kept.groupBy(F.col("lang").alias("of")).agg(F.count(F.lit(1)).alias("size"))
    groups = rows.select("lang", "source").distinct().join(sums, (F.col("lang") == F.col("l")) & (F.col("source") == F.col("s")), "left")
    groups = groups.join(sizes, F.col("lang") == F.col("of"), "left")
    none = F.lit(0).cast("long")
    groups = groups.select("lang", "source", *(F.coalesce(c, none).alias(n) for c, n in (("sum", "of_all"), ("size", "size"), ("terms", "terms"))))
    groups = groups.withColumns({"zero": F.when(F.col("size") > 0, share(none)).otherwise(1), "of_lang": F.sum("of_all").over(Window.partitionBy("lang"))})
    groups = cut(groups)
    facts = sized(groups)
    # Terms against the language.
    against = each.join(facts, ["lang", "source"]).withColumns({"p": share(F.col("n")), "q": share(F.col("total"), "of_lang")}).where("p > q")
    against = against.select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    terms = ranked(against, "term").where(F.col("rank") <= top)
    # Sources against each other: counts in one of them by histogram, terms of both by pairs.
    other = groups.select(F.col("lang").alias("of"), F.col("source").alias("b"), F.col("zero").alias("zero_b"), F.col("terms").alias("terms_b"))
    apart = (F.col("lang") == F.col("of")) & (F.col("source") != F.col("b"))
    pairs = groups.join(other, apart).select("lang", F.col("source").alias("a"), "b", ((F.col("size") - F.col("terms") - F.col("terms_b")) * gap(F.col("zero"), F.col("zero_b"))).alias("x"))
    histogram = each.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("m")).join(facts, ["lang", "source"]).select("lang", "source", share(F.col("n")).alias("p"), "m")
    single = histogram.join(other, apart).select("lang", "source", "b", (F.col("m") * gap(F.col("p"), F.col("zero_b"))).alias("x"), (F.col("m") * gap(F.col("zero_b"), F.col("p"))).alias("y"))
    first = found.where(F.size("of_") > 1).select("lang", "of_", F.posexplode("of_").alias("k", "x"))
    both = first.select("lang", "x", F.explode(F.expr("slice(of_, k + 2, size(of_))")).alias("y"))
    both = both.groupBy("lang", F.col("x.source").alias("a"), F.col("y.source").alias("b"), F.col("x.n").alias("n_a"), F.col("y.n").alias("n_b")).agg(F.count(F.lit(1)).alias("m"))
    both = both.join(facts.select("lang", F.col("source").alias("a"), "of_all", "size", "zero"), ["lang", "a"])
    both = both.join(facts.select("lang", F.col("source").alias("b"), F.col("of_all").alias("of_all_b"), F.col("zero").alias("zero_b")), ["lang", "b"])
    both = both.withColumns({"p": share(F.col("n_a")), "q": share(F.col("n_b"), "of_all_b")})
    excess = lambda p, zero, q, zero_b: gap(p, q) - gap(p, zero_b) - gap(zero, q) + gap(zero, zero_b)
    p, zero, q, zero_b = (F.col(c) for c in ("p", "zero", "q", "zero_b"))
    both = both.groupBy("lang", "a", "b").agg(F.sum(F.col("m") * excess(p, zero, q, zero_b)).alias("x"), F.sum(F.col("m") * excess(q, zero_b, p, zero)).alias("y"))
    mirrored = lambda rows, a: [rows.select("lang", F.col(a).alias("a"), "b", "x"), rows.select("lang", F.col("b").alias("a"), F.col(a).alias("b"), F.col("y").alias("x"))]
    pairs = reduce(DataFrame.union, [pairs, *mirrored(single, "source"), *mirrored(both, "a")])
    pairs = pairs.groupBy("lang", F.col("a").alias("source"), F.col("b").alias("item")).agg(F.sum("x").alias("value"))
    return ranked(pairs, "pair").union(terms)
