"""Approximate nearest neighbours by a hash-prefix forest.

Vectors are dealt by hash to shards of about ``SHARD_ROWS`` rows, each with its own forest, built
once. A tree's hash string names the axes of a randomly rotated vector by size, with their signs, the
largest first (a long cross-polytope hash); a tree is the sorted array of its strings. A query finds
its longest matching prefix in every tree by bisection, then ascends in all trees at once, a letter
at a time up to the first letter, until the matches hold ``SHARE`` of the shard (``PER_NEIGHBOUR``
vectors for each neighbour at least); where not even ``FEWEST`` for each neighbour match, all trees
ascend to their root, the whole shard. Those that match the most letters over all trees, as many as
wanted, are the candidates; their distances are computed on the original vectors in double
precision. A shard returns its nearest for each query; the best over all shards are the result.

A task reads the vectors of its shards and then the queries, which stream past the forest in Arrow
batches; the table is shuffled once, the queries once for each shard. Equal vectors are one entry
with its ``k + 1`` smallest ids, chosen before any shuffle, so a vector shared by very many rows
costs no more than a few. Vectors are centred by their shard's mean.

Ids are whole numbers. Vectors that are null, empty or zero, or hold null or non-finite components,
take no part, neither do rows without an id. Vectors of different lengths aren't compared. Equal rows
with one id count as rows each; a query skips one row with its own id. Queries with equal id and
vector are one query; those with one id and different vectors share one ranking. Ties go to smaller
ids. Only id and vector are read. Measured recall is in the README.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlake.llm.common import cut

K = 10
SHARD_ROWS = 32_768
TREES = 128
LETTERS = 6
SHARE = 0.2
PER_NEIGHBOUR = 20
FEWEST = 10
SEED = 20


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


class Forest:
    """Sorted hash strings of one shard."""

    def __init__(self, vectors: np.ndarray, trees: int = TREES, letters: int = LETTERS, seed: int = SEED):
        self.size, dim = vectors.shape
        self.mean, self.base = vectors.mean(axis=0), 2 * dim
        self.letters = max(1, min(letters, dim, int(62 / math.log2(self.base))))  # a string fits one number
        self.turns = np.random.default_rng(seed).standard_normal((trees, dim, dim)).astype(np.float32)
        self.order = np.empty((trees, self.size), np.int32)
        self.sorted = np.empty((trees, self.size), np.int64)
        plain = (vectors - self.mean).astype(np.float32)
        for tree in range(trees):
            codes = self.strings(plain, tree)
            self.order[tree] = np.argsort(codes, kind="stable")
            self.sorted[tree] = codes[self.order[tree]]

    def strings(self, plain: np.ndarray, tree: int) -> np.ndarray:
        """The strings of centred vectors in one tree: the letters as digits of one number."""
        turned = plain @ self.turns[tree]
        size = -np.abs(turned)
        n = self.letters
        axes = np.argpartition(size, n - 1, axis=1)[:, :n] if n < size.shape[1] else np.tile(np.arange(n), (len(size), 1))
        axes = np.take_along_axis(axes, np.argsort(np.take_along_axis(size, axes, 1), axis=1, kind="stable"), 1)
        letters = 2 * axes + (np.take_along_axis(turned, axes, 1) > 0)
        return letters @ (self.base ** np.arange(n - 1, -1, -1, dtype=np.int64))

    def ranges(self, asked: np.ndarray) -> np.ndarray:
        """(level, tree, query, 2): where the strings with each prefix of a query's string lie; level 0 is the whole string."""
        plain = (asked - self.mean).astype(np.float32)
        found = np.empty((self.letters, len(self.turns), len(asked), 2), np.int32)
        for tree in range(len(self.turns)):
            codes = self.strings(plain, tree)
            for cutoff in range(self.letters):
                step = self.base**cutoff
                low = codes // step * step
                found[cutoff, tree] = np.searchsorted(self.sorted[tree], np.stack([low, low + step], 1))
        return found

    def candidates(self, ranges: np.ndarray, wanted: int, least: int = 0) -> np.ndarray:
        """The vectors that match best, from the ``ranges`` of one query: (level, tree, 2)."""
        letters = np.zeros(self.size, np.int32)
        for level in ranges:
            for tree, (a, b) in enumerate(level.tolist()):
                if a < b:
                    letters[self.order[tree, a:b]] += 1
            found = np.flatnonzero(letters)
            if len(found) >= wanted:
                break
        if len(found) < min(wanted, least):
            return np.arange(self.size)  # the root
        if len(found) > wanted:
            found = found[np.argpartition(-letters[found], wanted - 1)[:wanted]]
        return found


def nearest_of(vectors: np.ndarray, ids: list, forest: Forest, queries: list, asked: np.ndarray, k: int, share: float) -> list[tuple]:
    """(query_id, vec_id, score) of the nearest in one shard."""
    out, wanted = [], max(PER_NEIGHBOUR * k, int(share * len(vectors)))
    ranges = forest.ranges(asked)
    for n, query in enumerate(queries):
        found = forest.candidates(ranges[:, :, n], wanted, FEWEST * k)
        far = np.sqrt(((vectors[found] - asked[n]) ** 2).sum(axis=1))
        edge = np.partition(far, k)[k] if len(far) > k else np.inf  # one more: the query may be among them
        near = []
        for at in np.flatnonzero(far <= edge):
            skipped = False
            for m in ids[found[at]]:
                if m == query and not skipped:
                    skipped = True
                else:
                    near.append((far[at], m))
        near.sort()
        out += [(query, m, score) for score, m in near[:k]]
    return out


def search_shards(k: int, share: float):
    """Reads shard after shard, vectors before queries; returns each query's nearest in each shard."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, vectors, ids, forest, table = None, [], [], None, None
        for batch in batches:
            for key, part in batch.groupby(["dim", "shard"], sort=False):
                if key != shard:
                    shard, vectors, ids, forest, table = key, [], [], None, None
                entries, asked = part[~part["query"]], part[part["query"]]
                vectors += [np.asarray(x, np.float64) for x in entries["vector"]]
                ids += list(entries["ids"])
                for at in range(0, len(asked) if vectors else 0, 256):
                    if forest is None:
                        table = np.stack(vectors)
                        forest = Forest(table)
                    some = asked.iloc[at : at + 256]
                    found = nearest_of(table, ids, forest, some["query_id"].tolist(), np.stack(some["vector"].to_numpy()).astype(np.float64), k, share)
                    yield pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return search


def nearest(
    rows: DataFrame,
    queries: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    k: int = K,
    shard_rows: int = SHARD_ROWS,
    share: float = SHARE,
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` nearest found among ``rows``."""

    def read(frame: DataFrame) -> DataFrame:
        frame = frame.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("vector"))
        return frame.where(F.col("id").isNotNull() & usable(F.col("vector")))

    first = Window.partitionBy("print", "vector").orderBy("id")
    entries = read(rows).withColumn("print", F.xxhash64("vector")).withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    entries = entries.groupBy("print", "vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    entries = cut(entries.select("vector", "ids", F.size("vector").alias("dim"), F.xxhash64("print").alias("deal")))
    asked = cut(read(queries).distinct().select(F.col("id").alias("query_id"), "vector", F.size("vector").alias("dim")))
    shards = max(1, -(-entries.count() // shard_rows))
    left = entries.select("dim", F.pmod("deal", F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("query"), F.lit(None).cast("long").alias("query_id"), "ids", "vector")
    each = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    right = asked.select("dim", each, F.lit(True).alias("query"), "query_id", F.lit(None).cast("array<bigint>").alias("ids"), "vector")
    dealt = left.union(right).repartition(shards, "dim", "shard").sortWithinPartitions("dim", "shard", "query", "query_id", "ids")
    found = dealt.mapInPandas(search_shards(k, share), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
