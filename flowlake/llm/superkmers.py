"""Substring dedup by super-k-mers: words in a window that an earlier document holds too go.

A window is ``WINDOW`` consecutive words of a document. Its minimiser is the least hash of the runs of
``MINIMISER`` words in it. Consecutive windows of a document that share a minimiser travel as one
packed string of words (a super-k-mer) to the minimiser's bucket, so that a word is shipped about
three times and not thirteen. Equal windows have equal minimisers and meet in one bucket; there the
windows are sorted by hash, compared byte by byte, and each one that a smaller id holds is marked.

1. The windows of all documents are counted by their minimiser's bucket, of which there are ``BUCKETS``
   for each shuffle partition. A bucket with over a quarter of a partition's mean is hot; there are at
   most four of these for each partition, so that each task can know them.
2. Super-k-mers are dealt by bucket; what a task has for a bucket is compressed together. Those of
   hot buckets are cut into single windows, dealt by the window's own hash; each task sends of equal
   ones only those of its smallest id, as all others are known to go. So neither a frequent run of
   words nor a passage of many copies gathers in a task.
3. Marked stretches of words are gathered by document, and its words are kept or dropped.

Windows are judged on the input: what goes does not depend on what else went. Rows of equal id are
one document, and don't remove each other's words; null ids come after all others (as the largest
long would). Integer ids are used as they are, others by their rank. Null and blank texts and texts
below a window keep all words. Repeated rows fare alike. Other columns pass through; columns named
as a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlake.llm.common import cut
from flowlake.llm.mixing import dealt, running

WINDOW = 13
MINIMISER = 2
BUCKETS = 16
PART = 1024
BATCH_BYTES = 2 << 20  # texts worked on at once
FLUSH_BYTES = 32 << 20  # packed words that a task gathers before it compresses and sends them
HOT_WINDOWS = 200_000  # hot windows that a task remembers
LAST = (1 << 63) - 1  # null ids
ODD = 0x9E3779B97F4A7C15
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
MARKS = pa.schema([("id", pa.int64()), ("print", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])
SENT = pa.schema([("bucket", pa.int32()), ("size", pa.int32()), ("strings", pa.binary()), ("marks", pa.binary())])


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut to a bounded number of bytes, or to one row."""
    for batch in batches:
        part = np.cumsum(pc.binary_length(batch["text"]).to_numpy(), dtype=np.int64) // BATCH_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(batch)]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


class Polynomial:
    """64-bit hashes of stretches of bytes: a polynomial over them, from running sums."""

    powers = inverse = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        if len(data) >= len(self.powers):
            n = max(len(data) + 1, BATCH_BYTES)
            Polynomial.powers = np.cumprod(np.full(n, ODD, np.uint64))
            Polynomial.inverse = np.cumprod(np.full(n, pow(ODD, -1, 1 << 64), np.uint64))
        self.upto = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data + np.uint64(1)) * self.powers[: len(data)], out=self.upto[1:])

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        mixed = (self.upto[high] - self.upto[low]) * self.inverse[low]
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        return mixed ^ (mixed >> np.uint64(29))


class Windows:
    """The super-k-mers of some texts, in flat arrays.

    Of each: hash of its minimiser, text, place of its first word in the text, number of windows, and
    where its words (with a space between) begin and end in ``joined``.
    """

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary())
        ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        solid = ~SPACE[data]
        first = np.zeros(len(data) + 1, bool)
        first[ends] = True
        begin = np.flatnonzero(solid & (first[:-1] | ~np.concatenate([[False], solid[:-1]])))
        end = np.flatnonzero(solid & (first[1:] | ~np.concatenate([solid[1:], [False]]))) + 1
        count = np.diff(np.searchsorted(begin, ends))
        owner = np.repeat(np.arange(len(count)), count)
        if len(begin) < WINDOW:
            begin = end = np.zeros(WINDOW, np.int64)
            owner = -np.arange(WINDOW)  # no window lies in one text
        word = Polynomial(data).of(begin, end)
        # Runs of words, then the least of each window by doubling spans.
        m = len(word) - MINIMISER + 1
        run = np.zeros(m, np.uint64)
        for k in range(MINIMISER):
            run = run * np.uint64(ODD) + word[k : k + m]
        run = (run ^ (run >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        least, span, whole = run ^ (run >> np.uint64(29)), 1, WINDOW - MINIMISER + 1
        while span < whole:
            step = min(span, whole - span)
            least = np.minimum(least[:-step], least[step:])
            span += step
        here = np.flatnonzero(owner[: len(owner) - WINDOW + 1] == owner[WINDOW - 1 :])
        mini, own = least[here], owner[here]
        new = np.flatnonzero(np.concatenate([[True], (mini[1:] != mini[:-1]) | (own[1:] != own[:-1])])[: len(here)])
        self.mini, self.text, self.begin = mini[new], own[new], here[new]
        self.n = np.diff(np.append(new, len(here)))
        self.at = self.begin - (np.cumsum(count) - count)[self.text]
        self._data, self._solid, self._words = data, solid, (begin, end)

    def strings(self) -> None:
        """Set ``joined``, ``starts`` (of words), ``low`` and ``high``."""
        begin, end = self._words
        keep = self._solid.copy()
        keep[end[end < len(keep)]] = True
        self.joined = np.where(self._solid, self._data, np.uint8(32))[keep].tobytes()
        place = np.cumsum(keep) - 1
        self.starts, self.stops = place[begin], place[end - 1] + 1
        self.low, self.high = self.starts[self.begin], self.stops[self.begin + self.n + WINDOW - 2]


def counted(buckets: int):
    """Windows by bucket: rows of ``PART`` counters (part, counts) for each task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(-(-buckets // PART) * PART, np.int64)
        for batch in blocks(batches):
            found = Windows(batch["text"])
            np.add.at(total, (found.mini % np.uint64(buckets)).astype(np.int64), found.n)
        counts = total.reshape(-1, PART)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(counts)), pa.int32()), pa.array(list(counts), pa.list_(pa.int64()))], ["part", "counts"])

    return work


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, n) from all tasks' rows of the parts that are here."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch["part"].to_pylist(), batch["counts"].flatten().to_numpy().reshape(-1, PART)):
            total[part] = total.get(part, 0) + counts
    for part, counts in total.items():
        yield pa.RecordBatch.from_arrays([pa.array(part * PART + np.arange(PART)), pa.array(counts)], ["bucket", "n"])


class Smallest:
    """Of equal windows those of the smallest id met so far; the others are marked."""

    def __init__(self):
        self.held: dict[bytes, list[tuple[int, int, int]]] = {}
        self.marked: list[tuple[int, int, int]] = []

    def offer(self, window: bytes, row: tuple[int, int, int]) -> None:
        held = self.held.get(window)
        if held is None:
            self.held[window] = [row]
        elif row[0] == held[0][0]:
            held.append(row)
        elif row[0] > held[0][0]:
            self.marked.append(row)
        else:
            self.marked += held
            self.held[window] = [row]


class Parcels:
    """Strings and marks that a task gathers by bucket; each is sent compressed."""

    codec = pa.Codec("zstd", compression_level=1)

    def __init__(self, buckets: int):
        self.buckets, self.held, self.parts = buckets, 0, []

    def add(self, bucket: np.ndarray, ids, prints, at, n, strings: list[bytes]) -> None:
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        numbers = [np.asarray(x)[order] for x in (ids, prints, at, n)]
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)]):
            words = b" ".join([strings[k] for k in order[a:b].tolist()])
            self.parts.append((int(bucket[order[a]]), [x[a:b] for x in numbers], words))
            self.held += len(words) + 40

    def rows(self) -> Iterator[pa.RecordBatch]:
        gathered: dict[int, list] = {}
        for bucket, *part in self.parts:
            gathered.setdefault(bucket, []).append(part)
        self.parts, self.held, sizes, blobs = [], 0, [], []
        for parts in gathered.values():
            ids, prints, at, n = (np.concatenate([p[0][k] for p in parts]) for k in range(4))
            data = b"".join([np.int64(len(ids)).tobytes(), np.diff(ids, prepend=0).tobytes(), prints.tobytes(), at.astype(np.int32).tobytes(), n.astype(np.int32).tobytes(), b" ".join(p[1] for p in parts)])
            sizes.append(len(data))
            blobs.append(self.codec.compress(data, asbytes=True))
        if sizes:
            yield pa.RecordBatch.from_arrays([pa.array(gathered, pa.int32()), pa.array(sizes, pa.int32()), pa.array(blobs, pa.binary()), pa.nulls(len(sizes), pa.binary())], schema=SENT)

    @classmethod
    def opened(cls, blob: bytes, size: int) -> tuple[np.ndarray, ...]:
        """ids, prints, at, n and the bytes of the words."""
        data = cls.codec.decompress(blob, size, asbytes=True)
        m = int(np.frombuffer(data, np.int64, 1)[0])
        ids, prints = np.frombuffer(data, np.int64, 2 * m, 8).reshape(2, m)
        at, n = np.frombuffer(data, np.int32, 2 * m, 8 + 16 * m).reshape(2, m)
        return np.cumsum(ids), prints, at, n, np.frombuffer(data, np.uint8, offset=8 + 24 * m)


def packed(buckets: int, hot: list[int]):
    """Parcels of super-k-mers; those of hot counters as windows; windows known to go as marks."""

    def windows(smallest: Smallest, parcels: Parcels) -> Iterator[pa.RecordBatch]:
        rows = [(*row, w) for w, held in smallest.held.items() for row in held]
        for a in range(0, len(rows), HOT_WINDOWS):
            ids, prints, at, strings = zip(*rows[a : a + HOT_WINDOWS])
            bucket = np.array([xxhash.xxh3_64_intdigest(w) % buckets for w in strings])
            parcels.add(bucket, np.array(ids, np.int64), np.array(prints, np.int64), np.array(at), np.ones(len(at), np.int32), strings)
            yield from parcels.rows()
        smallest.held = {}

    def marks(smallest: Smallest) -> Iterator[pa.RecordBatch]:
        if smallest.marked:
            found = np.array(sorted(smallest.marked), np.int64)
            smallest.marked = []
            bucket = (found[:, 0] ^ found[:, 1]) % buckets
            used = np.unique(bucket)
            columns = [pa.array(used, pa.int32()), pa.array([0] * len(used), pa.int32()), pa.nulls(len(used), pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([found[bucket == b].tobytes() for b in used], pa.binary())], schema=SENT)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parcels, smallest, warm = Parcels(buckets), Smallest(), np.array(sorted(hot), np.int64)
        for batch in blocks(batches):
            found = Windows(batch["text"])
            if not len(found.n):
                continue
            found.strings()
            ids, prints = batch["id"].to_numpy()[found.text], batch["print"].to_numpy()[found.text]
            bucket = (found.mini % np.uint64(buckets)).astype(np.int64)
            cold = ~np.isin(bucket, warm)
            for k in np.flatnonzero(~cold).tolist():
                b, i, p, a = int(found.begin[k]), int(ids[k]), int(prints[k]), int(found.at[k])
                for w in range(int(found.n[k])):
                    smallest.offer(found.joined[found.starts[b + w] : found.stops[b + w + WINDOW - 1]], (i, p, a + w))
            strings = [found.joined[a:b] for a, b in zip(found.low[cold].tolist(), found.high[cold].tolist())]
            parcels.add(bucket[cold], ids[cold], prints[cold], found.at[cold], found.n[cold], strings)
            if parcels.held >= FLUSH_BYTES:
                yield from parcels.rows()
            if len(smallest.held) >= HOT_WINDOWS:
                yield from windows(smallest, parcels)
            yield from marks(smallest)
        yield from windows(smallest, parcels)
        yield from parcels.rows()

    return work


def equal_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the stretches of ``size`` bytes from ``a`` and from ``b`` are equal."""
    out = np.ones(len(a), bool)
    for k in range(0, len(a), 1 << 15):
        s = size[k : k + (1 << 15)]
        ends = np.cumsum(s)
        within = np.arange(ends[-1]) - np.repeat(ends - s, s)
        same = data[np.repeat(a[k : k + len(s)], s) + within] == data[np.repeat(b[k : k + len(s)], s) + within]
        out[k : k + len(s)] = np.minimum.reduceat(same, ends - s)
    return out


def stretches(ids: np.ndarray, prints: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Windows that go, in order of document and place, as stretches of words."""
    new = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (prints[1:] != prints[:-1]) | (at[1:] < at[:-1]) | (at[1:] > at[:-1] + WINDOW)])[: len(ids)])
    last = np.append(new[1:], len(ids))[: len(new)] - 1
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[new], prints[new], at[new].astype(np.int32), (at[last] + WINDOW).astype(np.int32))], schema=MARKS)


def window_keys(data: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return Polynomial(data).of(low, high)


def later(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """The stretches of a whole bucket's strings whose windows a smaller id holds too."""
    ids, prints, at, n = (np.concatenate([p[k] for p in parts]) for k in range(4))
    data = np.concatenate([x for p in parts for x in (p[4], np.array([32], np.uint8))])
    # Each string has its windows and twelve more words; a space ends each word.
    ends = np.flatnonzero(data == 32)
    begins = np.concatenate([[0], ends[:-1] + 1])
    first = np.cumsum(n + WINDOW - 1) - (n + WINDOW - 1)
    owner = np.repeat(np.arange(len(n)), n)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    word = first[owner] + within
    low, high = begins[word], ends[word + WINDOW - 1]
    key = window_keys(data, low, high)
    order = np.argsort(key, kind="stable")
    new = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0]))
    size = np.diff(np.append(new, len(order)))
    many = size > 1
    picks = order[np.repeat(many, size)]  # windows whose hash recurs
    new, size = np.cumsum(size[many]) - size[many], size[many]
    gone = np.zeros(len(key), bool)
    if len(picks):
        held = ids[owner[picks]]
        head = np.repeat(picks[new], size)
        same = (high - low)[picks] == (high - low)[head]
        same[same] = equal_bytes(data, low[picks[same]], low[head[same]], (high - low)[picks[same]])
        gone[picks] = held > np.repeat(np.minimum.reduceat(held, new), size)
        for run in np.flatnonzero(~np.logical_and.reduceat(same, new)):  # unequal windows of one hash
            least: dict[bytes, int] = {}
            for judge in (False, True):
                for k in picks[new[run] : new[run] + size[run]]:
                    text, own = data[low[k] : high[k]].tobytes(), int(ids[owner[k]])
                    if judge:
                        gone[k] = own > least[text]
                    else:
                        least[text] = min(own, least.get(text, own))
    here = np.flatnonzero(gone)
    return stretches(ids[owner[here]], prints[owner[here]], at[owner[here]] + within[here])


def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches that go, from parcels that are sorted by bucket; a bucket's are worked on together."""
    bucket, parts = None, []
    for batch in batches:
        for number, size, blob, marks in zip(*(batch[k].to_pylist() for k in SENT.names)):
            if blob is None:
                yield stretches(*np.frombuffer(marks, np.int64).reshape(-1, 3).T)
                continue
            if number != bucket and parts:
                yield later(parts)
                parts = []
            bucket = number
            parts.append(Parcels.opened(blob, size))
    if parts:
        yield later(parts)


def marked(rows: DataFrame) -> DataFrame:
    """id, print, start, stop: stretches of words that go, from rows (id, print, text)."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = BUCKETS * partitions
    totals = rows.select("text").mapInArrow(counted(buckets), "part int, counts array<long>").repartition("part").mapInArrow(summed, "bucket long, n long")
    totals = cut(totals)
    mean = (totals.agg(F.sum("n")).first()[0] or 0) / partitions
    hot = [r.bucket for r in totals.where(4 * F.col("n") > mean).collect()] if mean else []  # four a partition at most
    sent = rows.mapInArrow(packed(buckets, hot), "bucket int, size int, strings binary, marks binary")
    dealt_ = sent.repartitionById(partitions, F.col("bucket") % partitions).sortWithinPartitions("bucket")
    return dealt_.mapInArrow(judged, "id long, print long, start int, stop int")


def without(text: Column, gone: Column) -> Column:
    """n_words, n_removed, removed (stretches of words) and kept (the other words, joined by spaces)."""

    @F.arrow_udf("n_words long, n_removed long, removed array<struct<start:int,stop:int>>, kept string")
    def work(texts: pa.Array, gone: pa.Array) -> pa.Array:
        total, removed, spans, kept = [], [], [], []
        for value, stretches in zip(texts, gone):
            words = (value.as_buffer().to_pybytes() if value.is_valid else b"").split()
            drop = np.zeros(len(words) + 1, bool)
            for x in stretches.as_py() or ():
                drop[x["start"] : x["stop"]] = True
            edges = np.flatnonzero(np.diff(np.concatenate([[False], drop]).astype(np.int8))).reshape(-1, 2)
            total.append(len(words))
            removed.append(int(drop.sum()))
            spans.append([{"start": a, "stop": b} for a, b in edges.tolist()])
            kept.append(b" ".join(w for w, d in zip(words, drop.tolist()) if not d) if removed[-1] else b" ".join(words))
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        columns = [pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary()).cast(pa.string())]
        return pa.StructArray.from_arrays(columns, ["n_words", "n_removed", "removed", "kept"])

    return work.asNondeterministic()(text, gone)


def ordered_ids(docs: DataFrame, doc_id: str) -> tuple[DataFrame, Column]:
    """The documents and their ids as longs in the same order."""
    if docs.schema[doc_id].dataType.typeName() in ("byte", "short", "integer", "long"):
        return docs, F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST))
    order = [F.col("__of")]
    ids = dealt(docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("__of")).distinct(), order)
    ranks = running(ids, order, F.lit(1), "__rank").select("__of", F.col("__rank").cast("long").alias("__rank"))
    return docs.join(ranks, F.col(doc_id) == F.col("__of"), "left").drop("__of"), F.coalesce("__rank", F.lit(LAST))


def dedup_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with the words that stay in ``text`` (null stays null), ``n_words``, ``n_removed`` and ``removed``.

    ``removed`` has the stretches (start, stop) of words that went, in order and apart.
    """
    result = ["n_words", "n_removed", "removed"]
    ranked, number = ordered_ids(docs.drop(*[c for c in result if c not in (doc_id, text)]), doc_id)
    several = ranked.groupBy(number.alias("id")).agg(F.min(F.xxhash64(F.col(text))).alias("a"), F.max(F.xxhash64(F.col(text))).alias("b")).where("a <> b")
    print_ = F.lit(0).cast("long") if several.isEmpty() else F.xxhash64(F.col(text))  # needed only where an id has several texts
    rows = ranked.withColumns({"__id": number, "__print": print_})
    plain = rows.where(F.col(text).isNotNull()).select(F.col("__id").alias("id"), F.col("__print").alias("print"), F.col(text).alias("text"))
    spans = cut(marked(plain), release=True).groupBy("id", "print").agg(F.collect_set(F.struct("start", "stop")).alias("__spans"))
    spans = spans.withColumnsRenamed({"id": "__i", "print": "__p"})
    rows = rows.join(spans, (F.col("__id") == F.col("__i")) & (F.col("__print") == F.col("__p")), "left")
    rows = rows.withColumn("__new", without(F.col(text), F.col("__spans")))
    new = {c: F.col(f"__new.{c}") for c in result} | {text: F.when(F.col(text).isNotNull(), F.col("__new.kept"))}
    return rows.withColumns(new).drop("__id", "__print", "__rank", "__i", "__p", "__spans", "__new")
