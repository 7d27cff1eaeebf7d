"""N-gram Jaccard join through a token-group matrix: exact components of similar documents.

A document's set holds hashes of its word shingles (ASCII letters in lower case). Texts with equal
sets are one class. Sets are ordered by hash; similar sets, the smaller of m tokens, share at least
``1 + m // EXTRA`` of their first ``n - ceil(t n) + 1 + n // EXTRA`` tokens (the prefix), so that
classes with fewer prefix tokens that others have too are done. For the others:

1. Each prefix token has as head the class that shares the largest part of its prefix; a class is
   compared to the ``HEADS`` heads that most of its tokens name. Pairs that are similar link, and
   the components of these links begin the partition.
2. A class can only link outside of its component with tokens that another component has too; it
   stays open if a share ``t`` of its whole set are such tokens, counted twice, the second time
   among the open classes alone.
3. Open classes are laid out by size, component and smallest token and cut into groups of a bounded
   number of tokens: similar documents lie together. A group keeps the union of its tokens as rows.
4. The tokens of open classes are ordered by how many classes hold them. Similar sets share a token
   among the ``n - ceil(t n) + 1`` rarest of each, so the matrix of these tokens and groups proposes
   to a class the groups of like size (a factor ``t``) that hold a larger component. The class's
   whole set is intersected with the unions of the proposed groups, and only a group with a share
   ``t`` of it is opened, for no member can overlap more; its members are then compared, one link
   for each component of the group being enough.

So no link between different components is lost, and what links within one is not enumerated.
Tokens are 64-bit hashes, class keys 128-bit digests of sets. Classes go by half of their key; where
two classes share that half, one of them takes another. The text is read once for prefixes, and the
texts of proposed classes once more. Tables of proposals are broadcast only when counted below
``BROADCAST_ROWS``.

Null and blank texts have no set and are components of their own (``component_id`` is their id).
Texts below the shingle length are one shingle. Repeated rows share class and component. A null id
is in its component but names none. Only id and text are read; other columns don't matter.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlake.llm.common import WORD, cut, fingerprint, small_batches
from flowlake.llm.components import components
from flowlake.llm.mixing import dealt, running

SHINGLE = 5
PERCENT = 80
EXTRA = 10
HEADS = 2
GROUP_TOKENS = 1 << 14
QUERIES_PER_TASK = 256
BROADCAST_ROWS = 50_000
CACHED = 100_000
BATCH = 512  # texts worked on at once
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


class WordHashes(dict):
    """Words to 64-bit hashes, kept for those met before."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def mixed_bits(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def token_set(text: str | None, hashes: WordHashes, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.empty(0, np.int64)
    if len(words) < shingle:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64).view(np.int64)
    at = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = len(words) - shingle + 1
    mix = np.zeros(n, np.uint64)
    for k in range(shingle):
        mix = mixed_bits(mix + np.uint64(0x9E3779B97F4A7C15)) + at[k : k + n]
    return np.unique(mixed_bits(mix).view(np.int64))


def prefix_length(n: int, percent: int) -> int:
    return min(n, n - (n * percent + 99) // 100 + 1 + n // EXTRA)


def needed(n: Column, percent: int) -> Column:
    """How many prefix tokens a set shares at least with any similar one, be it the smallest."""
    return F.floor(F.floor((n * percent + 99) / 100) / EXTRA) + 1


def lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int64)
    flat = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))


def sketch(text: Column, percent: int, shingle: int, whole: bool) -> Column:
    """key, n and tokens: the whole set, or its prefix."""

    @F.arrow_udf("key binary, n long, tokens array<bigint>")
    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes = WordHashes()
        for batch in small_batches(batches, BATCH):
            keys, sizes, tokens = [], [], []
            for value in batch:
                found = token_set(value.as_py(), hashes, shingle)
                keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                sizes.append(len(found))
                tokens.append(found if whole else found[: prefix_length(len(found), percent)].copy())
            yield pa.StructArray.from_arrays([pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), lists(tokens)], ["key", "n", "tokens"])

    return work.asNondeterministic()(text)  # else filters on the result run it once more, on all rows


def class_id(key: Column) -> Column:
    return F.xxhash64(key)


def with_class(rows: DataFrame, clashing: DataFrame | None) -> DataFrame:
    """``rows`` with ``cid``; ``clashing``: the keys that give way to another key with their id."""
    rows = rows.withColumn("cid", class_id(F.col("key")))
    if clashing is None:
        return rows
    rows = rows.join(F.broadcast(clashing), F.col("key") == F.col("yields"), "left")
    return rows.withColumn("cid", F.when(F.col("yields").isNull(), F.col("cid")).otherwise(F.xxhash64("key", F.lit("other")))).drop("yields")


def clashes(rows: DataFrame) -> DataFrame | None:
    """``yields``: of two keys with one id the larger; None, as nearly always, where there are none."""
    keys = rows.groupBy("cid").agg(F.min("key").alias("low"), F.max("key").alias("yields"))
    found = cut(keys.where("low <> yields").select("yields"))
    return None if found.isEmpty() else found


def sized(frame: DataFrame) -> DataFrame:
    """The rows, marked for broadcast when they are counted to be few; they must be cut before."""
    return F.broadcast(frame) if frame.count() <= BROADCAST_ROWS else frame


def similar(a: Column, b: Column, percent: int) -> Column:
    both = F.size(F.array_intersect(a, b))
    return 100 * both >= percent * (F.size(a) + F.size(b) - both)


def open_groups(percent: int):
    """Links between the queries and the members of one opened group."""

    def links(group: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(group) and len(queries):
            sets = [np.asarray(t) for t in group["tokens"]]
            sizes, comps, ids = np.array([len(s) for s in sets]), group["comp"].to_numpy(), group["cid"].to_numpy()
            flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            for q, comp, tokens in zip(queries["query"], queries["own"], queries["asked"]):
                tokens = np.asarray(tokens)
                low, high = np.searchsorted(flat, tokens, "left"), np.searchsorted(flat, tokens, "right")
                hit = np.concatenate([owner[a:b] for a, b in zip(low, high)])
                both = np.bincount(hit, minlength=len(sets))
                good = np.flatnonzero((100 * both >= percent * (sizes + len(tokens) - both)) & (comps != comp))
                _, first = np.unique(comps[good], return_index=True)
                found += [(q, ids[good[k]]) for k in first]
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return links


def size_class(n: Column, percent: int) -> Column:
    """Similar sets are in the same or in neighbouring size classes (a little wider than the share)."""
    return F.floor(F.log(n.cast("double")) / math.log(100 / (percent - 1))).cast("int")


def token_groups(classes: DataFrame) -> DataFrame:
    """cid, comp, n, band, group: bounded groups of neighbours by size, component and smallest token.

    ``classes``: cid, comp, n, band (the size class), least (the smallest token).
    """
    heads = classes.groupBy("comp").agg(F.min("least").alias("head")).withColumnRenamed("comp", "of")
    rows = classes.join(heads, F.col("comp") == F.col("of")).drop("of")
    order = [F.col("band"), F.col("head"), F.col("comp"), F.col("least"), F.col("cid")]
    placed = running(dealt(rows, order), order, F.col("n"), "upto")
    number = F.floor((F.col("upto") - F.col("n")) / GROUP_TOKENS)
    return placed.select("cid", "comp", "n", "band", F.xxhash64("band", number).alias("group"))


def twice(rows: DataFrame) -> DataFrame:
    """The tokens that two classes or more have."""
    return rows.groupBy("token").agg(F.min("cid").alias("low"), F.max("cid").alias("high")).where("low <> high").select("token")


def shared_hits(base: DataFrame, percent: int) -> DataFrame:
    """cid, n, m, token: the prefix tokens that classes share, of classes that share enough of them.

    Twice, as tokens that only classes without enough of them share don't count.
    """
    prefixes = base.select("cid", "n", F.explode("tokens").alias("token"))
    hits = cut(prefixes.join(sized(cut(twice(prefixes), release=True)), "token").distinct(), release=True)
    enough = lambda rows: rows.groupBy("cid", "n").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= needed(F.col("n"), percent)).select("cid", "m")
    hits = cut(hits.join(sized(cut(enough(hits))).select("cid"), "cid", "left_semi"), release=True)
    hits = hits.join(sized(cut(twice(hits))), "token", "left_semi")
    return cut(hits.join(sized(cut(enough(hits))), "cid"))


def open_tokens(held: DataFrame, percent: int) -> DataFrame:
    """cid, comp, n, token: the tokens that two components hold, of classes whose sets are such to a share."""
    shared = held.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("token")
    crossing = cut(held.join(sized(cut(shared, release=True)), "token", "left_semi"), release=True)
    enough = crossing.groupBy("cid", "n").agg(F.count(F.lit(1)).alias("m")).where(100 * F.col("m") >= percent * F.col("n"))
    return cut(crossing.join(sized(cut(enough.select("cid"))), "cid", "left_semi"))


def between_components(classes: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between classes of different components: one at least for each pair of linked components.

    ``classes``: cid, comp, n, tokens; steps 2 to 4.
    """
    held = open_tokens(classes.select("cid", "comp", "n", F.explode("tokens").alias("token")), percent)
    held = open_tokens(held, percent)
    chosen = sized(cut(held.select("cid").distinct()))
    opened = cut(classes.join(chosen, "cid", "left_semi").withColumn("band", size_class(F.col("n"), percent)))
    sizes = opened.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
    groups = token_groups(opened.select("cid", "comp", "n", "band", F.get("tokens", F.lit(0)).alias("least")))
    groups = cut(groups.join(sizes, "comp").select("cid", "comp", "band", "group", F.struct("size", "comp").alias("rank")))
    # The rarest of the tokens that other components have; all that none has come before them.
    df = sized(cut(held.groupBy("token").agg(F.count(F.lit(1)).alias("df"))))
    rarest = Window.partitionBy("cid").orderBy("df", "token")
    ranked = held.join(df, "token").withColumns({"at": F.row_number().over(rarest), "m": F.count(F.lit(1)).over(Window.partitionBy("cid"))})
    rare = ranked.where(F.col("at") <= F.col("m") - F.ceil(F.col("n") * percent / 100) + 1).select("cid", "token")
    rare = cut(rare.join(groups, "cid"))
    matrix = rare.groupBy("token", "band", "group").agg(F.max("rank").alias("top"))
    near = F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1)).alias("near")
    asks = rare.select("cid", F.col("token").alias("of"), F.col("rank").alias("own"), near)
    asked = asks.join(matrix, (F.col("of") == F.col("token")) & (F.col("near") == F.col("band")) & (F.col("top") > F.col("own")))
    asked = cut(asked.select("cid", F.col("group").alias("goal")).distinct(), release=True)
    # A query's overlap with a group's union bounds its overlap with each member.
    tokens = held.select("cid", "n", "token")
    unions = held.join(groups.select("cid", "group"), "cid").select(F.col("group").alias("at_group"), F.col("token").alias("in_union")).distinct()
    inside = asked.join(tokens, "cid").join(unions, (F.col("goal") == F.col("at_group")) & (F.col("token") == F.col("in_union")))
    bound = inside.groupBy("cid", "goal", "n").agg(F.count(F.lit(1)).alias("both")).where(100 * F.col("both") >= percent * F.col("n"))
    opening = cut(bound.select("cid", "goal"), release=True)
    blocks = cut(opening.groupBy("goal").agg(F.floor((F.count(F.lit(1)) - 1) / QUERIES_PER_TASK).cast("int").alias("last")))
    whole = opened.select("cid", "tokens").join(groups.select("cid", "comp", "group"), "cid")
    members = whole.join(blocks, F.col("group") == F.col("goal")).select("group", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("block"), "cid", "comp", "tokens")
    part = F.pmod(F.xxhash64("cid"), F.col("last") + 1).cast("int").alias("part")
    queries = opening.join(blocks, "goal").select("cid", "goal", part).join(whole.drop("group"), "cid")
    queries = queries.select("goal", "part", F.col("cid").alias("query"), F.col("comp").alias("own"), F.col("tokens").alias("asked"))
    found = members.groupBy("group", "block").cogroup(queries.groupBy("goal", "part")).applyInPandas(open_groups(percent), "a long, b long")
    return cut(found)


def labelled(docs: DataFrame, doc_id: str, text: str, percent: int, shingle: int) -> DataFrame:
    """id, print (of the text), n (of tokens), label, class (of the component): one row for each row of ``docs``."""
    plain = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    base = plain.select("id", fingerprint(F.col("text")).alias("print"), sketch(F.col("text"), percent, shingle, False).alias("s"))
    base = cut(with_class(base.select("id", "print", "s.*"), None))
    clashing = clashes(base)
    base = base if clashing is None else cut(with_class(base.drop("cid"), clashing))
    hits = shared_hits(base, percent)
    # The classes that share the most are the heads of the tokens; each class proposes itself to two.
    heads = hits.groupBy("token").agg(F.max(F.struct((F.col("m") / F.col("n")).alias("share"), "cid")).alias("h"), F.count(F.lit(1)).alias("df"))
    hits = cut(hits.join(heads.select("token", "df", F.col("h.cid").alias("head")), "token"), release=True)
    to = hits.where("cid <> head").groupBy("cid", "head").agg(F.count(F.lit(1)).alias("k"))
    best = Window.partitionBy("cid").orderBy(F.col("k").desc(), "head")
    to = to.withColumn("at", F.row_number().over(best)).where(F.col("at") <= HEADS).groupBy("cid").agg(F.collect_list("head").alias("heads"))
    # The whole sets of these classes.
    named = cut(hits.select("cid").distinct())
    wanted = cut(base.join(sized(named), "cid", "left_semi").groupBy("cid").agg(F.min("id").alias("at")))
    chosen = plain.join(sized(cut(wanted.select("at").distinct())), F.col("id").eqNullSafe(F.col("at")), "left_semi")
    sets = chosen.select(sketch(F.col("text"), percent, shingle, True).alias("s")).select("s.*")
    sets = with_class(sets, clashing)
    sets = sets.join(sized(named), "cid", "left_semi").groupBy("cid").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    sets = cut(sets.join(to, "cid", "left"), release=True)
    # 1. Links to the heads.
    pairs = sets.select(F.col("cid").alias("a"), F.col("tokens").alias("ta"), F.explode("heads").alias("b"))
    asked = sized(cut(pairs.select(F.col("b").alias("of")).distinct()))
    right = cut(sets.join(asked, F.col("cid") == F.col("of"), "left_semi").select(F.col("cid").alias("b"), F.col("tokens").alias("tb")))
    links = cut(pairs.join(right, "b").where(similar(F.col("ta"), F.col("tb"), percent)).select("a", "b"), release=True)
    begun = components(links).withColumnsRenamed({"node": "of", "root": "comp"})
    classes = sets.join(begun, F.col("cid") == F.col("of"), "left").withColumn("comp", F.coalesce("comp", "cid"))
    more = between_components(cut(classes.select("cid", "comp", "n", "tokens"), release=True), percent)
    joined = components(links.union(more)).withColumnRenamed("node", "cid")
    # Labels: a component's least id, through its classes.
    labels = base.where("n > 0").groupBy("cid").agg(F.min("id").alias("least")).join(joined, "cid", "left")
    labels = labels.withColumn("root", F.coalesce("root", "cid"))
    names = labels.groupBy(F.col("root").alias("of")).agg(F.min("least").alias("name"))
    labels = labels.join(names, F.col("root") == F.col("of")).select(F.col("cid").alias("of_class"), F.col("root").alias("class"), F.col("name").alias("label"))
    final = base.select("id", "print", "n", F.when(F.col("n") > 0, F.col("cid")).alias("cid")).join(labels, F.col("cid") == F.col("of_class"), "left")
    return final.select("id", "print", "n", F.when(F.col("n") > 0, F.col("label")).otherwise(F.col("id")).alias("label"), "class")


def similar_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each row of ``docs``."""
    rows = labelled(docs, doc_id, text, percent, shingle)
    return rows.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), F.col("label").alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """One row of each component, that of its smallest id (null ids last); all rows without words."""
    rows = labelled(docs, doc_id, text, percent, shingle).where("n > 0")
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "print")).alias("best")
    rows = rows.groupBy("class").agg(best).select(F.col("best.id").alias("__id"), F.col("best.print").alias("__p"), F.lit(True).alias("__best"))
    kept = docs.withColumn("__print", fingerprint(F.col(text)))
    kept = kept.join(rows, F.col(doc_id).eqNullSafe(F.col("__id")) & (F.col("__print") == F.col("__p")), "left")
    blank = ~F.coalesce(F.col(text), F.lit("")).rlike(WORD)
    kept = kept.where(F.col("__best") | blank).drop("__id", "__p")
    repeated = cut(kept.where("__best").groupBy(F.col(doc_id).alias("__id"), F.col("__print").alias("__p")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    if not repeated.isEmpty():
        same = F.col(doc_id).eqNullSafe(F.col("__id")) & (F.col("__print") == F.col("__p")) & F.col("__best")
        kept = kept.join(repeated, same, "left_anti").union(kept.join(repeated, same, "left_semi").dropDuplicates([doc_id, "__print"]))
    return kept.select(*docs.columns)
