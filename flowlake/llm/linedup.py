"""Line dedup by pairwise alignment.

A text is cut into lines at line breaks and, as whole paragraphs often stand on one line, after
sentences and clauses; the pieces joined give the text again. Lines are compared by a 64-bit hash of
the trimmed line; lines without a word are passed over. A passage is a run of neighbouring lines with
a word that hold ``MIN_WORDS`` words or more in all.

1. Lines that two texts or more hold are counted; a document goes on with such lines only.
2. Its runs of such lines give keys: from each line the shortest passage that begins there, and the
   shortest that ends there. Any passage that two texts share is covered by keys of both.
3. Each key proposes its first document to all others, so that proposals grow as the keys do and
   never as the pairs within a group: whatever passage an earlier document shares, its first holder
   has it too.
4. Each proposed pair is aligned by patience diff: common first and last lines, then the longest
   ordered run of lines that are unique in both, then what lies between, likewise. Aligned passages
   are deleted from the later document (the larger id; null ids last), with the wordless lines after each.
   Only passages with a line that alignment can't settle, as it crosses what is aligned or stands
   several times in a document, are then looked up by their keys.

So a line goes exactly if it is part of a passage that an earlier text holds. Equal texts are one
document: all rows but those of its smallest id lose all their lines. Rows with equal id and text are
the same document and fare alike. Only line hashes are shuffled for the search; texts go by their
128-bit print. A frequent first document, or line, is a hot key of a join only, between tables that
the adaptive skew join can split.

Ids may have any type that can be ordered. Null and empty texts have no keys and are left as they
are. Other columns pass through; columns named as a result are replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlake.llm.common import cut, fingerprint, let, small_batches

MIN_WORDS = 20
BROADCAST_ROWS = 100_000
ODD = np.uint64(0x9E3779B97F4A7C17)
BATCH = 512  # texts worked on at once
BREAK = r"(?<=[\n\x20])(?<=\n|[.!?,;:]\x20)"
ENDS = r"\n|[.!?,;:]\x20"  # as many as there are breaks
PIECE = re.compile(rb"[^\n.!?,;:]*(?:[.!?,;:](?!\x20)[^\n.!?,;:]*)*(?:\n|[.!?,;:]\x20|\Z)")
BROKEN = (b"\n", b". ", b"! ", b"? ", b", ", b"; ", b": ")


def line_pieces(text: Column) -> Column:
    """The lines of a text with their ends; joined they are the text."""
    return F.split(F.coalesce(text, F.lit("")), BREAK, -1)


def byte_pieces(data: bytes) -> list[bytes]:
    """``line_pieces`` of a text in UTF-8."""
    found = PIECE.findall(data)
    if len(found) > 1 and not found[-2].endswith(BROKEN):
        found.pop()
    return found


def unique_run(a: list[int], b: list[int], la: int, ha: int, lb: int, hb: int) -> list[tuple[int, int]]:
    """The longest run, in order in both ranges, of lines that are unique in both."""

    def once(lines: list[int], low: int, high: int) -> dict[int, int]:
        seen: dict[int, int] = {}
        for k in range(low, high):
            seen[lines[k]] = -1 if lines[k] in seen else k
        return {x: k for x, k in seen.items() if k >= 0 and x}

    in_b = once(b, lb, hb)
    pairs = [(k, in_b[x]) for x, k in once(a, la, ha).items() if x in in_b]
    pairs.sort()
    tops: list[int] = []  # the smallest end of a run of each length
    ends: list[int] = []
    back: list[int] = []
    for n, (_, j) in enumerate(pairs):
        at = bisect_left(tops, j)
        back.append(ends[at - 1] if at else -1)
        tops[at : at + 1], ends[at : at + 1] = [j], [n]
    run, n = [], ends[-1] if ends else -1
    while n >= 0:
        run.append(pairs[n])
        n = back[n]
    return run[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """The aligned lines of two documents, in order."""
    found, open_ = [], [(0, len(a), 0, len(b))]
    while open_:
        la, ha, lb, hb = open_.pop()
        while la < ha and lb < hb and a[la] == b[lb]:
            found.append((la, lb))
            la, lb = la + 1, lb + 1
        while la < ha and lb < hb and a[ha - 1] == b[hb - 1]:
            ha, hb = ha - 1, hb - 1
            found.append((ha, hb))
        if la < ha and lb < hb:
            run = unique_run(a, b, la, ha, lb, hb)
            anchors = set(run)
            for i, j in [*run, (ha, hb)] if run else []:
                # From each anchor the lines before it that fit belong to it too.
                ei, ej = i, j
                while ei > la and ej > lb and a[ei - 1] == b[ej - 1]:
                    ei, ej = ei - 1, ej - 1
                    found.append((ei, ej))
                open_.append((la, ei, lb, ej))
                if i < ha:
                    found.append((i, j))
                la, lb = i + 1, j + 1
                while la < ha and lb < hb and a[la] == b[lb] and (la, lb) not in anchors:
                    found.append((la, lb))
                    la, lb = la + 1, lb + 1
    return sorted(set(found))


def passages(words: np.ndarray, least: int = MIN_WORDS) -> np.ndarray:
    """(first, last) of the shortest passages from each line on and up to each line."""
    upto = np.concatenate([[0], np.cumsum(words)])
    n = len(words)
    firsts = np.arange(n)
    lasts = np.searchsorted(upto, upto[:-1] + least) - 1
    on = np.stack([firsts, lasts], 1)[lasts < n]
    ends = np.flatnonzero(upto[1:] >= least)
    up = np.stack([np.searchsorted(upto, upto[ends + 1] - least, "right") - 1, ends], 1)
    both = np.unique(np.concatenate([on[:, 0] * n + on[:, 1], up[:, 0] * n + up[:, 1]]))
    return np.stack([both // max(n, 1), both % max(n, 1)], 1)


def stretches(mask: np.ndarray, words: np.ndarray, least: int = MIN_WORDS) -> list[tuple[int, int]]:
    """(start, end) of the runs of marked lines that hold enough words."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))).reshape(-1, 2)
    upto = np.concatenate([[0], np.cumsum(words)])
    return [(a, b) for a, b in edges[upto[edges[:, 1]] - upto[edges[:, 0]] >= least].tolist()]


def run_keys(lines: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the lines of each run: a polynomial over their hashes, from running sums."""
    powers = np.cumprod(np.full(len(lines) + 1, ODD, np.uint64))
    inverse = np.cumprod(np.full(len(lines) + 1, pow(int(ODD), -1, 1 << 64), np.uint64))
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(lines.view(np.uint64) * powers[:-1])])
    return ((upto[runs[:, 1] + 1] - upto[runs[:, 0]]) * inverse[runs[:, 0]]).view(np.int64)


def beyond(a: np.ndarray, b: np.ndarray, pairs: list[tuple[int, int]]) -> np.ndarray:
    """The lines of ``b`` that alignment can't settle: repeated in either document, or crossing what is aligned."""
    lines, first, times = np.unique(a, return_index=True, return_counts=True)
    at = np.searchsorted(lines, b)
    at[at == len(lines)] = 0
    known = lines[at] == b
    own, back, repeats = np.unique(b, return_inverse=True, return_counts=True)
    odd = known & ((times[at] > 1) | (repeats[back] > 1))
    if pairs:
        i, j = np.array(pairs).T
        place = first[at]
        # Aligned lines lie in order in both, so a line crosses one of them if it lies between other ones in ``a`` than in ``b``.
        crossing = np.searchsorted(i, place) != np.searchsorted(j, np.arange(len(b)))
        odd |= known & crossing & ~np.isin(np.arange(len(b)), j)
    return odd


def common_blocks(a: np.ndarray, b: np.ndarray, words_a: np.ndarray, words_b: np.ndarray, least: int = MIN_WORDS) -> list[int]:
    """The lines of ``b`` in passages of ``a``, with the wordless lines (hash 0) after each."""
    at, words = np.append(np.flatnonzero(b), len(b)), words_b[b != 0]
    a, b, words_a = a[a != 0], b[b != 0], words_a[a != 0]
    gone = np.zeros(len(b), bool)
    run: list[int] = []
    before = (-2, -2)
    pairs = patience(a.tolist(), b.tolist())
    for i, j in [*pairs, (-9, -9)]:
        if (i, j) != (before[0] + 1, before[1] + 1):
            if run and words[run[0] : run[-1] + 1].sum() >= least:
                gone[run] = True
            run = []
        run.append(j)
        before = (i, j)
    # What stands in another order, or several times, is found by the keys of its passages.
    odd = beyond(a, b, pairs)
    held = None
    for x, y in stretches(np.isin(b, a), words, least) if odd.any() else []:
        if odd[x:y].any() and not gone[x:y].all():
            held = run_keys(a, passages(words_a, least)) if held is None else held
            runs = passages(words[x:y], least) + x
            for p, q in runs[np.isin(run_keys(b, runs), held)].tolist():
                if odd[p : q + 1].any():
                    gone[p : q + 1] = True
    return [p for k in np.flatnonzero(gone) for p in range(int(at[k]), int(at[k + 1]))]


def arrays(column: pa.Array) -> Iterator[np.ndarray]:
    flat, ends = column.flatten().to_numpy(), np.cumsum([0, *column.value_lengths().to_pylist()])
    return (flat[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist()))


def lists(parts: list, kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int64)
    flat = np.concatenate([np.asarray(p, kind.to_pandas_dtype()) for p in parts]) if parts else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))


def aligned(earlier: Column, later: Column, words_a: Column, words_b: Column) -> Column:
    """``common_blocks`` as a column."""

    @F.arrow_udf("array<int>")
    def align(a: pa.Array, b: pa.Array, wa: pa.Array, wb: pa.Array) -> pa.Array:
        found = [common_blocks(x, y, u, v) for x, y, u, v in zip(arrays(a), arrays(b), arrays(wa), arrays(wb))]
        return pa.array(found, pa.list_(pa.int32()))

    return align(earlier, later, words_a, words_b)


def hashed_text(text: str | None) -> tuple[np.ndarray, list[int]]:
    """Each line's hash (0 without a word) and how many words it has."""
    pieces = byte_pieces((text or "").encode("utf-8", "surrogatepass"))
    count = [len(x.split()) for x in pieces]
    hash_ = xxhash.xxh3_64_intdigest
    return np.fromiter((hash_(x.strip()) if n else 0 for x, n in zip(pieces, count)), np.uint64, len(pieces)).view(np.int64), count


def hashed(text: Column) -> Column:
    """lines and words: each line's hash (0 without a word) and how many words it has."""

    @F.arrow_udf("lines array<bigint>, words array<int>")
    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in small_batches(batches, BATCH):
            lines, words = zip(*[hashed_text(value.as_py()) for value in batch]) if len(batch) else ([], [])
            yield pa.StructArray.from_arrays([lists(lines, pa.int64()), lists(words, pa.int32())], ["lines", "words"])

    return work.asNondeterministic()(text)


def passage_keys(lines: Column, words: Column, shared: Column) -> Column:
    """The keys of a document's passages that consist of ``shared`` lines."""

    @F.arrow_udf("array<bigint>")
    def work(lines: pa.Array, words: pa.Array, shared: pa.Array) -> pa.Array:
        row = np.arange(len(lines), dtype=np.uint64)
        mixed = lambda hashes, of: hashes.view(np.uint64) ^ (of * ODD)
        owner = np.repeat(row, lines.value_lengths().to_numpy(zero_copy_only=False))
        asked = np.repeat(row, shared.value_lengths().to_numpy(zero_copy_only=False))
        h, w = lines.flatten().to_numpy(), words.flatten().to_numpy()
        owner, w, h = owner[h != 0], w[h != 0], h[h != 0]
        mask = np.isin(mixed(h, owner), mixed(shared.flatten().to_numpy(), asked))
        # A stretch of shared lines ends where the row does.
        begins = mask & np.concatenate([[True], ~mask[:-1] | (owner[1:] != owner[:-1])])[: len(mask)]
        stretch, h, owner = np.cumsum(begins)[mask], h[mask], owner[mask]
        runs = passages(w[mask])
        runs = runs[stretch[runs[:, 0]] == stretch[runs[:, 1]]]
        order = np.lexsort((keys := run_keys(h, runs), of := owner[runs[:, 0]].astype(np.int64)))
        of, keys = of[order], keys[order]
        new = np.concatenate([[True], (of[1:] != of[:-1]) | (keys[1:] != keys[:-1])])[: len(keys)]
        ends = np.searchsorted(of[new], np.arange(len(lines) + 1))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys[new], pa.int64()))

    return work(lines, words, shared)


def sized(frame: DataFrame) -> DataFrame:
    """The rows, marked for broadcast when they are counted to be few; they must be cut before."""
    return F.broadcast(frame) if frame.count() <= BROADCAST_ROWS else frame


def removals(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """print, first, gone: for each text that loses lines its smallest id and their places."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    rows = rows.select("id", fingerprint(F.col("text")).alias("print"), hashed(F.col("text")).alias("p"))
    rows = rows.select("id", "print", "p.lines", "p.words")
    texts = rows.groupBy("print").agg(
        F.min("id").alias("id"), F.max("id").alias("top"), F.max(F.col("id").isNull()).alias("nameless"), F.first("lines").alias("lines"), F.first("words").alias("words")
    )
    twice = F.coalesce(F.col("id") != F.col("top"), F.lit(False)) | (F.col("id").isNotNull() & F.col("nameless"))
    texts = cut(texts.withColumn("twice", twice).drop("top", "nameless"), release=True)
    # 1. Lines that two texts hold.
    held = texts.select("print", F.explode(F.array_distinct("lines")).alias("h")).where("h <> 0")
    shared = cut(held.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1").select("h"))
    lines = held.join(sized(shared), "h").groupBy("print").agg(F.collect_list("h").alias("shared"))
    # 2. Their passages.
    keys = lines.withColumnRenamed("print", "of").join(texts, F.col("print") == F.col("of"))
    keys = keys.select("print", F.col("id").isNull().alias("none"), "id", passage_keys(F.col("lines"), F.col("words"), F.col("shared")).alias("keys"))
    keys = cut(keys.select("print", "none", "id", F.explode("keys").alias("key")), release=True)
    # 3. Pairs.
    heads = keys.groupBy("key").agg(F.count(F.lit(1)).alias("df"), F.min(F.struct("none", "id", "print")).alias("head")).where("df > 1")
    heads = sized(cut(heads.select("key", F.col("head.print").alias("early"))))
    pairs = cut(keys.join(heads, "key").where("print <> early").select("early", F.col("print").alias("late")).distinct(), release=True)
    # 4. Alignment.
    early = texts.select(F.col("print").alias("early"), F.col("lines").alias("a"), F.col("words").alias("wa"))
    late = texts.select(F.col("print").alias("late"), F.col("lines").alias("b"), F.col("words").alias("wb"))
    found = pairs.join(early, "early").join(late, "late").select(F.col("late"), aligned(F.col("a"), F.col("b"), F.col("wa"), F.col("wb")).alias("gone"))
    gone = found.select("late", F.explode("gone").alias("line")).groupBy("late").agg(F.collect_set("line").alias("gone"))
    out = texts.select("print", "twice", F.col("id").alias("first")).join(gone, F.col("print") == F.col("late"), "left")
    return out.where("late is not null or twice").select("print", "first", F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with its remaining text, ``n_lines``, ``n_removed`` and the places ``removed``."""
    result = ["n_lines", "n_removed", "removed"]
    found = cut(removals(docs, doc_id, text), release=True).withColumnsRenamed({"print": "__p", "first": "__first", "gone": "__gone"})
    rows = docs.drop(*[c for c in result if c not in (doc_id, text)]).withColumn("__print", fingerprint(F.col(text)))
    rows = rows.join(found, F.col("__print") == F.col("__p"), "left")
    body, none = F.coalesce(F.col(text), F.lit("")), F.array().cast("array<int>")
    copy = ~F.col(doc_id).eqNullSafe(F.col("__first")) & (body != "")

    def without(pieces: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(pieces) - 1)
        out = F.when(copy, places).otherwise(F.array_sort("__gone"))
        kept = lambda o: F.array_join(F.transform(F.array_except(places, o), lambda k: F.get(pieces, k)), "")
        return let(out, lambda o: F.struct(o.alias("out"), kept(o).alias("kept")))

    touched = F.col("__p").isNotNull() & (copy | (F.size("__gone") > 0))
    rows = rows.withColumn("__new", F.when(touched, let(line_pieces(F.col(text)), without)))
    rows = rows.withColumns(
        {
            "n_lines": (F.regexp_count(body, F.lit(ENDS)) + 1).cast("long"),
            "n_removed": F.when(F.col("__new").isNull(), 0).otherwise(F.size("__new.out")).cast("long"),
            "removed": F.coalesce(F.col("__new.out"), none),
            text: F.coalesce(F.col("__new.kept"), F.col(text)),
        }
    )
    return rows.drop("__print", "__p", "__first", "__gone", "__new")
