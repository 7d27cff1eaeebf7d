"""Running totals, moving levels and as-of times over long keys, in blocks.

A camera lives for years, so nothing here sorts one key in one task. Rows are worked on within
blocks (of time, or of frames); each block gives one row; ``FAN`` of these make a block of the
second level, which gives one row again; and the third level is as long as a key has second-level
blocks (with blocks of a minute or an hour: 17 hours or six weeks each). What a level finds is
carried back to the one below by a join.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlake.functions.geometry import EPS

FAN = 1024
HOUR = 3600.0
MINUTE = 60.0
TEN = 600.0  # seconds whose rows are folded at once


def settled(frame: DataFrame) -> DataFrame:
    """The rows, written once to the shared checkpoint folder where several steps go on from them.

    The folder is that of the session or of ``spark.checkpoint.dir``. A local session without one takes a
    temporary folder; on a cluster without one the rows are made anew for each step.
    """
    spark = frame.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not (context.master == "local" or context.master.startswith("local[")):
                return frame
            named = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(named)
    return frame.checkpoint(eager=True)


def block_of(time: Column, size: float = HOUR) -> Column:
    return F.floor(time / size)


def above(block: Column | str) -> Column:
    """The block of the next level."""
    return F.floor((F.col(block) if isinstance(block, str) else block) / FAN)


def running_totals(rows: DataFrame, key: list[str], order: Sequence[str], block: Column, values: dict[str, Column], whole: bool = False) -> DataFrame:
    """The rows with the sum of each value (null: 0) over the rows of the key up to each; ``block`` must grow with ``order``.

    With ``whole`` also the sum over all rows of the key, as ``of_`` and the name.
    """
    names = list(values)
    zero = lambda c: F.coalesce(c, F.lit(0))
    within = Window.partitionBy(*key, "__block").orderBy(*order)
    rows = rows.withColumn("__block", block).withColumns({f"__{n}": zero(v) for n, v in values.items()})
    sums = [F.sum(f"__{n}").alias(f"__{n}") for n in names]
    blocks = rows.groupBy(*key, "__block").agg(*sums).withColumn("__above", above("__block"))
    levels = blocks.groupBy(*key, "__above").agg(*sums)
    before = lambda w: {f"__to_{n}": zero(F.sum(f"__{n}").over(w.rowsBetween(Window.unboundedPreceding, -1))) for n in names}
    whole_ = [F.sum(f"__{n}").over(Window.partitionBy(*key)).alias(f"of_{n}") for n in names] if whole else []
    levels = levels.withColumns(before(Window.partitionBy(*key).orderBy("__above"))).select(*key, "__above", *whole_, *[F.col(f"__to_{n}").alias(f"__far_{n}") for n in names])
    blocks = blocks.withColumns(before(Window.partitionBy(*key, "__above").orderBy("__block"))).join(levels, [*key, "__above"])
    blocks = blocks.select(*key, "__block", *[f"of_{n}" for n in names if whole], *[(F.col(f"__to_{n}") + F.col(f"__far_{n}")).alias(f"__to_{n}") for n in names])
    rows = rows.withColumns({f"__{n}": F.sum(f"__{n}").over(within) for n in names}).join(blocks, [*key, "__block"])
    rows = rows.withColumns({n: F.col(f"__{n}") + F.col(f"__to_{n}") for n in names})
    return rows.drop("__block", *[f"__{n}" for n in names], *[f"__to_{n}" for n in names])


def last_known(rows: DataFrame, key: list[str], order: Sequence[str], block: Column, value: str, name: str) -> DataFrame:
    """The rows with the last value of the key that is not null, up to each row."""
    rows = rows.withColumn("__block", block)
    last = lambda w, c: F.last(c, ignorenulls=True).over(w)
    within = Window.partitionBy(*key, "__block").orderBy(*order)
    newest = F.max_by(value, F.struct(*order)).alias("__v")
    blocks = rows.where(F.col(value).isNotNull()).groupBy(*key, "__block").agg(newest)
    asked = rows.select(*key, "__block").distinct().join(blocks, [*key, "__block"], "left").withColumn("__above", above("__block"))
    levels = asked.groupBy(*key, "__above").agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), F.col("__block"))).alias("__v"))
    levels = levels.select(*key, "__above", last(Window.partitionBy(*key).orderBy("__above").rowsBetween(Window.unboundedPreceding, -1), "__v").alias("__far"))
    near = last(Window.partitionBy(*key, "__above").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1), "__v")
    asked = asked.withColumn("__near", near).join(levels, [*key, "__above"]).select(*key, "__block", F.coalesce("__near", "__far").alias("__before"))
    rows = rows.withColumn("__here", last(within.rowsBetween(Window.unboundedPreceding, 0), value)).join(asked, [*key, "__block"])
    return rows.withColumn(name, F.coalesce("__here", "__before")).drop("__block", "__here", "__before")


def first_times(clock: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """The first time of each block with one: by (key, __above) those of up to ``FAN`` blocks, by key those of second-level blocks.

    Lists of (at, first) in order, in ``__near`` and ``__far``: a row for 42 days of a key, and one for a key.
    """
    firsts = clock.groupBy(*key, block_of(F.col("ts")).alias("at")).agg(F.min("ts").alias("first"))
    item = F.struct("at", "first")
    near = firsts.groupBy(*key, above("at").alias("__above")).agg(F.sort_array(F.collect_list(item)).alias("__near"))
    far = near.select(*key, F.col("__above").alias("at"), F.get("__near", F.lit(0))["first"].alias("first")).groupBy(*key).agg(F.sort_array(F.collect_list(item)).alias("__far"))
    return near, far


def after_block(rows: DataFrame, clock: DataFrame, key: list[str], found: str) -> DataFrame:
    """``found``, where null: the first time in a later block than ``__block``, of the same second-level block or of a later one."""
    later = lambda times, at: F.get(F.filter(times, lambda t: t["at"] > at), F.lit(0))["first"]
    near, far = first_times(clock, key)
    rows = rows.withColumn("__above", above("__block")).join(near, [*key, "__above"], "left").join(far, key, "left")
    return rows.withColumn(found, F.coalesce(found, later(F.col("__near"), F.col("__block")), later(F.col("__far"), F.col("__above")))).drop("__above", "__near", "__far")


def next_time(rows: DataFrame, clock: DataFrame, key: list[str], time: str, name: str) -> DataFrame:
    """``name``: the first time ``ts`` of the key's clock at or after ``time`` (null: null), however far ahead.

    Asked times and the clock are sorted together within each hour; where an hour has none left, the
    next hour with one is looked up among the hours' first times. The cost follows the rows, not the gaps.
    """
    hours = clock.select(*key, F.col("ts").alias("__t"), F.lit(1).alias("__kind"), F.col("ts").alias("__clock"), block_of(F.col("ts")).alias("__block"))
    asked = F.col(time) - EPS
    asked = rows.withColumns({"__t": asked, "__kind": F.lit(0), "__clock": F.lit(None).cast("double"), "__block": block_of(asked)})
    later = Window.partitionBy(*key, "__block").orderBy("__t", "__kind").rowsBetween(0, Window.unboundedFollowing)
    found = asked.unionByName(hours, allowMissingColumns=True).withColumn(name, F.first("__clock", ignorenulls=True).over(later)).where("__kind = 0")
    found = after_block(found.drop("__t", "__kind", "__clock"), clock, key, name).drop("__block")
    return found.withColumn(name, F.when(F.col(time).isNotNull(), F.col(name)))


def next_of(clock: DataFrame, key: list[str], name: str) -> DataFrame:
    """The clock (key, ts) with the time that follows each."""
    rows = clock.select(*key, "ts", block_of(F.col("ts")).alias("__block"))
    rows = rows.withColumn(name, F.lead("ts").over(Window.partitionBy(*key, "__block").orderBy("ts")))
    return after_block(rows, clock, key, name).drop("__block")


def moving_levels(rows: DataFrame, key: list[str], order: Sequence[str], block: Column, values: dict[str, Column], weight: Column, start: float | None = None) -> DataFrame:
    """The rows with level = weight * value + (1 - weight) * level before, for each value, by name.

    A step is an affine map, and maps compose: each block folds its rows into one map, blocks into one
    for the next level; the level before a block is its predecessors' map of the start, and the rows of
    a block go on from there. The start is ``start``, or where it is None the key's first value, which then is
    the first level. Weights are above 0.
    """
    names, own = list(values), rows.columns
    keep, add = F.lit(1.0) - weight.cast("double"), {n: weight.cast("double") * v.cast("double") for n, v in values.items()}
    rows = rows.select(*own, block.alias("__block"), keep.alias("keep"), *[a.alias(f"__{n}") for n, a in add.items()], *[v.cast("double").alias(f"__of_{n}") for n, v in values.items()])
    maps = ["keep", *[F.col(f"__{n}").alias(n) for n in names]]

    def composed(steps: Column) -> Column:
        """The map of all steps (keep: the share of the level before, and what is added to it)."""
        step = lambda acc, s: F.struct((acc["keep"] * s["keep"]).alias("keep"), *[(s[n] + s["keep"] * acc[n]).alias(n) for n in names])
        return F.aggregate(steps, F.struct(F.lit(1.0).alias("keep"), *[F.lit(0.0).alias(n) for n in names]), step)

    def before(frame: DataFrame, by: list[str], at: str) -> DataFrame:
        """(by, at, map of what comes before at within by) and the map of all, from one list of each ``by``."""
        listed = frame.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(at, "keep", *names))).alias("s"))
        blank = F.struct(F.lit(1.0).alias("keep"), *[F.lit(0.0).alias(n) for n in names], F.filter("s", lambda _: F.lit(False)).alias("out"))

        def step(acc: Column, x: Column) -> Column:
            told = F.struct(x[at].alias(at), acc["keep"].alias("keep"), *[acc[n].alias(n) for n in names])
            return F.struct((acc["keep"] * x["keep"]).alias("keep"), *[(x[n] + x["keep"] * acc[n]).alias(n) for n in names], F.array_append(acc["out"], told).alias("out"))

        return listed.select(*by, F.aggregate("s", blank, step).alias("f"))

    item = F.struct(F.struct(*order).alias("at"), F.struct(*own).alias("row"), *maps, *[f"__of_{n}" for n in names])
    blocks = rows.groupBy(*key, "__block").agg(F.sort_array(F.collect_list(item)).alias("s"))
    ends = blocks.select(*key, "__block", composed(F.col("s")).alias("f")).select(*key, "__block", above("__block").alias("__above"), "f.*")
    second = before(ends, [*key, "__above"], "__block")
    third = before(second.select(*key, "__above", "f.keep", *[f"f.{n}" for n in names]), key, "__above")
    far = third.select(*key, F.inline("f.out")).withColumnsRenamed({"keep": "__far"} | {n: f"__far_{n}" for n in names})
    carry = second.select(*key, "__above", F.inline("f.out")).join(far, [*key, "__above"])
    carry = carry.select(*key, "__block", (F.col("keep") * F.col("__far")).alias("__keep"), *[(F.col(n) + F.col("keep") * F.col(f"__far_{n}")).alias(f"__to_{n}") for n in names])
    if start is None:
        first = rows.groupBy(*key).agg(*[F.min_by(f"__of_{n}", F.struct(*order)).alias(f"__start_{n}") for n in names])
        carry = carry.join(first, key)
        alone = (F.col("__keep") == 1) & (F.col(f"__to_{names[0]}") == 0)  # nothing before
        level = lambda n: F.when(~alone, F.col(f"__to_{n}") + F.col("__keep") * F.col(f"__start_{n}"))
    else:
        level = lambda n: F.col(f"__to_{n}") + F.col("__keep") * F.lit(float(start))
    carry = carry.select(*key, "__block", F.struct(*[level(n).alias(n) for n in names]).alias("__level"))

    def step(acc: Column, s: Column) -> Column:
        now = {n: F.when(acc[n].isNull(), s[f"__of_{n}"]).otherwise(s[n] + s["keep"] * acc[n]) for n in names}
        told = F.struct(s["row"].alias("row"), *[v.alias(n) for n, v in now.items()])
        return F.struct(*[v.alias(n) for n, v in now.items()], F.array_append(acc["out"], told).alias("out"))

    none = F.transform(F.filter("s", lambda _: F.lit(False)), lambda s: F.struct(s["row"].alias("row"), *[s[n].alias(n) for n in names]))
    blank = F.struct(*[F.col("__level")[n].alias(n) for n in names], none.alias("out"))
    found = blocks.join(carry, [*key, "__block"]).select(F.inline(F.aggregate("s", blank, step, lambda acc: acc["out"])))
    return found.select("row.*", *names)
