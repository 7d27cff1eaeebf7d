"""Mixing sources to target weights by Pareto order sampling (native).

Sources, in code point order with null last, weigh ``weights`` in turn and share the words of the
whole corpus by weight. No target exceeds ``max_copies`` times its source; what exceeds is shared
again by weight among the others until none is above (the level at which that ends is found from
running sums over the sources, ordered by when they fill up). Within a source a document's expected
copies grow with its measure, the root of its words rounded up, as long texts say more but not in
proportion; they are the measure times the source's level, ``max_copies`` at most, so that the
expected words are the target. The whole part is taken for certain; the fraction is the document's
own inclusion probability p of one copy more. Documents are ranked by u/(1-u) over p/(1-p) with u
uniform from a hash of id, text and seed, and taken from the lowest rank on; a document that has more
words than the target still wants is passed over, until none fits. So the sample has a fixed size in
words, up to less than the shortest document left; the end of the list thus favours short documents.

All before the first document that doesn't fit are taken by running sums. What is left to fill then
is less than that document, so of the rest with w words each only the lowest gap / w ranks can matter:
so few for each source, whatever its rows (gap * log gap), that one fold walks them. The level comes
from sums by source and measure, of which a source has no more than the root of its longest text.

Ranks and running sums are computed over range partitions with partition totals, never over a
source as one group. The order of sources uses the same. Range-partitioned rows are checkpointed,
since another run could draw other bounds; they hold ids and numbers, no texts.

Equal rows (source, id and text) are one unit and get the same number of copies. Null texts have
size 0 and get a target of 0 when alone; a source of size 0 has the target 0. A null id is an id.
Results don't depend on partitioning. Other columns pass through; result names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlake.llm.common import cut, n_words

WEIGHTS = (1, 2, 3)
MAX_COPIES = 3
SEED = "mix-1"


def dealt(frame: DataFrame, order: list[Column]) -> DataFrame:
    """The rows, range-partitioned by ``order``, with their partition's number in ``part``."""
    return cut(frame.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))


def running(frame: DataFrame, order: list[Column], value: Column, name: str, by: str | None = None) -> DataFrame:
    """``name``: the sum of ``value`` over the rows up to each (within ``by``), for rows from ``dealt``."""
    keys = ["part"] + [by] * bool(by)
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*[by] * bool(by)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = frame.groupBy(*keys).agg(F.sum(value).alias("total"))
    totals = totals.select(*[F.col(k).alias(f"at_{k}") for k in keys], F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before"))
    rows = frame.withColumn("within", F.sum(value).over(window))
    same = F.col("part") == F.col("at_part")
    if by:
        same &= F.col(by).eqNullSafe(F.col(f"at_{by}"))
    rows = rows.join(totals, same).withColumn(name, F.col("within") + F.col("before"))
    return rows.drop("within", "before", *[f"at_{k}" for k in keys])


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """source, source_size, target, from one row (source, source_size) for each source."""
    by_name = [F.col("source").asc_nulls_last()]
    ranked = running(dealt(sizes, by_name), by_name, F.lit(1), "rank").drop("part")
    weight = F.get(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights)).cast("int"))
    ranked = ranked.select("source", "source_size", weight.cast("long").alias("weight"), (max_copies * F.col("source_size")).alias("most"))
    by_fill = [(F.col("most") / F.col("weight")).asc(), F.col("source").asc_nulls_last()]
    filled = dealt(ranked, by_fill)
    filled = running(filled, by_fill, F.col("most"), "most_to")
    filled = running(filled, by_fill, F.col("weight"), "weight_to")
    whole = filled.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weights"))
    level = (F.col("words") - (F.col("most_to") - F.col("most"))).cast("double") / (F.col("weights") - (F.col("weight_to") - F.col("weight"))).cast("double")
    rows = filled.join(F.broadcast(whole)).withColumn("level", level)
    open_ = F.col("level") * F.col("weight") <= F.col("most")
    final = rows.where(open_).agg(F.min_by("level", F.struct(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")).alias("final"))
    rows = rows.drop("level").join(F.broadcast(final))
    target = F.least(F.col("most").cast("double"), F.coalesce(F.col("final"), F.lit(float("inf"))) * F.col("weight"))
    return rows.select("source", "source_size", F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(target).alias("target"))


def measure(size: Column) -> Column:
    return F.ceil(F.sqrt(size.cast("double"))).cast("long")


def levels(units: DataFrame, goals: DataFrame, max_copies: int) -> DataFrame:
    """of, level: each source's expected copies of a document of measure 1, where it isn't all taken ``max_copies`` times.

    ``units``: source, size, words; ``goals``: of, target.
    """
    bulk = units.groupBy("source", measure(F.col("size")).alias("x")).agg(F.sum("words").alias("words"))
    longer = Window.partitionBy("source").orderBy(F.col("x").desc()).rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    bulk = bulk.withColumns(
        {
            "full": F.coalesce(F.sum("words").over(longer), none), "weighed": F.coalesce(F.sum(F.col("x") * F.col("words")).over(longer), none),
            "all": F.sum(F.col("x") * F.col("words")).over(Window.partitionBy("source")),
        }
    )
    rows = bulk.join(goals, F.col("source").eqNullSafe(F.col("of"))).where("x > 0")
    level = (F.col("target") - max_copies * F.col("full")) / (F.col("all") - F.col("weighed")).cast("double")
    rows = rows.withColumn("level", level).where(F.col("level") * F.col("x") <= max_copies)
    return rows.groupBy("of").agg(F.max_by("level", "x").alias("level"))


def copies(units: DataFrame, goals: DataFrame, max_copies: int, seed: str = SEED) -> DataFrame:
    """source, id, print, copies: how often each unit is taken.

    ``units``: source, id, print, size, words (all its rows' together); ``goals``: from ``targets``.
    """
    goals = goals.select(F.col("source").alias("of"), "target")
    goals = cut(goals.join(levels(units, goals, max_copies).withColumnRenamed("of", "at"), F.col("of").eqNullSafe(F.col("at")), "left").drop("at"))
    rows = units.join(goals, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    expected = F.least(F.lit(float(max_copies)), F.coalesce("level", F.lit(float("inf"))) * F.greatest(measure(F.col("size")), F.lit(1)))
    expected = F.when((F.col("size") == 0) | (F.col("target") == 0), F.lit(0.0)).otherwise(expected)
    rows = rows.withColumn("expected", expected).withColumn("sure", F.floor("expected"))
    rows = rows.withColumn("p", F.col("expected") - F.col("sure"))
    name = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("null")), F.col("print"))
    u = (F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52))
    odds = F.when(F.col("p") > 0, (u / (1 - u)) / (F.col("p") / (1 - F.col("p"))))
    rows = rows.select("source", "id", "print", "words", "sure", "target", odds.alias("rank"))
    order = [F.col("source").asc_nulls_last(), F.col("rank").asc_nulls_last(), F.col("id").asc_nulls_last(), F.col("print").asc()]
    rows = dealt(rows, order)
    want = (F.max("target") - F.sum(F.col("sure") * F.col("words"))).alias("gap")
    gaps = cut(rows.groupBy(F.col("source").alias("of")).agg(want))
    unit = ["source", "id", "print"]
    fit = rows.where("rank is not null").select(*unit, "words", "rank", "part").join(gaps, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    fit = cut(running(fit, order, F.col("words"), "upto", by="source").withColumn("now", F.col("upto") <= F.col("gap")).drop("upto"))
    got = fit.groupBy(F.col("source").alias("of")).agg((F.max("gap") - F.sum(F.when(F.col("now"), F.col("words")).otherwise(0))).alias("open"))
    left = fit.where("not now and words > 0").join(got, F.col("source").eqNullSafe(F.col("of"))).where("words <= open")
    alike = Window.partitionBy("source", "words").orderBy("rank", F.col("id").asc_nulls_last(), "print")
    left = left.withColumn("at", F.row_number().over(alike)).where("at * words <= open")
    place = F.struct("rank", F.col("id").isNull().alias("none"), "id", "print", "words").alias("d")
    lists = left.select("source", "open", place).groupBy("source").agg(F.max("open").alias("open"), F.sort_array(F.collect_list("d")).alias("d"))

    def walk(acc: Column, d: Column) -> Column:
        fits = d["words"] <= acc["open"]
        kept = F.when(fits, F.array_append(acc["taken"], d)).otherwise(acc["taken"])
        return F.struct(F.when(fits, acc["open"] - d["words"]).otherwise(acc["open"]).alias("open"), kept.alias("taken"))

    begin = F.struct("open", F.filter("d", lambda d: F.lit(False)).alias("taken"))
    walked = lists.select("source", F.explode(F.aggregate("d", begin, walk, lambda acc: acc["taken"])).alias("d")).select("source", "d.id", "d.print")
    taken = cut(fit.where("now").select(*unit).union(walked))
    extra = taken.select(*[F.col(c).alias(f"t_{c}") for c in unit])
    same = F.col("source").eqNullSafe(F.col("t_source")) & F.col("id").eqNullSafe(F.col("t_id")) & (F.col("print") == F.col("t_print"))
    rows = rows.join(extra, same, "left")
    return rows.select(*unit, (F.col("sure") + F.col("t_print").isNotNull().cast("long")).alias("copies"))


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    max_copies: int = MAX_COPIES,
    seed: str = SEED,
) -> DataFrame:
    """Every row with ``size``, ``source_size``, ``target`` and ``copies`` (0 to ``max_copies``)."""
    result = ["size", "source_size", "target", "copies"]
    rows = docs.drop(*result).withColumns({"size": n_words(F.col(text)), "__print": F.md5(F.coalesce(F.col(text), F.lit("")))})
    units = rows.select(F.col(source).alias("source"), F.col(doc_id).alias("id"), F.col("__print").alias("print"), "size")
    units = cut(units.groupBy("source", "id", "print", "size").agg((F.count(F.lit(1)) * F.col("size")).alias("words")))
    goals = targets(units.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_copies)
    goals = cut(goals)
    found = copies(units, goals, max_copies, seed)
    found = found.select(F.col("source").alias("__s"), F.col("id").alias("__i"), F.col("print").alias("__p"), "copies")
    goals = goals.withColumnRenamed("source", "__g")
    same = F.col(source).eqNullSafe(F.col("__s")) & F.col(doc_id).eqNullSafe(F.col("__i")) & (F.col("__print") == F.col("__p"))
    rows = rows.join(found, same).join(goals, F.col(source).eqNullSafe(F.col("__g")))
    return rows.drop("__print", "__s", "__i", "__p", "__g")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the columns of ``docs``, each row as often as it is taken."""
    rows = mix(docs, **options)
    rows = rows.where("copies > 0").withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return rows.select(*docs.columns)
