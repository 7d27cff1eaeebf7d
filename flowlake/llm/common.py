"""Column helpers shared by the training-data operators."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the operators call a word: a run of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    spaced = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def n_words(text: Column) -> Column:
    """How many words a text has; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def fingerprint(text: Column) -> Column:
    """128 bits that stand for a whole text; null and the empty text are told apart."""
    return F.unhex(F.md5(F.when(text.isNull(), F.lit("\x00null")).otherwise(text)))


def checkpoint_dir(spark: SparkSession) -> None:
    """Keep the cluster's checkpoint folder; set one only where none is named and the session is local."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        named = tempfile.mkdtemp(prefix="checkpoint-")
    context.setCheckpointDir(named)


def cut(frame: DataFrame, release: bool = False) -> DataFrame:
    """Write the rows to the shared checkpoint folder and go on from there.

    With ``release``, shuffle files of what came before are freed now. Spark frees them when the
    driver collects its garbage, which an idle driver puts off while the executors' disks fill.
    """
    checkpoint_dir(frame.sparkSession)
    kept = frame.checkpoint(eager=True)
    if release:
        jvm = frame.sparkSession.sparkContext._jvm
        del frame
        gc.collect()
        jvm.System.gc()
    return kept


def small_batches(batches: Iterator, rows: int) -> Iterator:
    """Arrow arrays cut to ``rows`` at most, so that what is made of each stays small."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)
