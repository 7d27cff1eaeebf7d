"""Source divergence against plain counting, and its defined cases."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from flowlake.llm import iceberg

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, least=3, top=200):
    docs = [(lang or "", source or "", terms(text)) for lang, source, text in docs]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = sorted(t for t, n in df.items() if n >= least)
        counts = {s: Counter(t for d in own if d[1] == s for t in d[2] if df[t] >= least) for s in {d[1] for d in own}}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(sum(counts.values(), Counter()))
        for s in counts:
            found = [("pair", o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in counts if o != s]
            found.sort(key=lambda x: (-x[2], x[1].encode()))
            single = [("term", t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if counts[s][t] and p[s][t] > q[t]]
            single.sort(key=lambda x: (-x[2], x[1].encode()))
            out += [(lang, s, *x, k + 1) for rows in (found, single[:top]) for k, x in enumerate(rows)]
    return sorted(out)


def got(frame, **more):
    return sorted(tuple(r) for r in iceberg.divergence(frame, **more).collect())


def test_random_documents_match_brute_force(spark):
    draw = random.Random(3)
    pool = ["the", "The", "ab", "abc", "abcd", "abcde", "abcdefgh", "abcdefghi", "straße", "über", "naïve", "日本語", "日本語学", "x" * 40, "x" * 41, "x" * 300, "İx"]
    pool += ["".join(draw.choice("abé") for _ in range(draw.randrange(1, 12))) for _ in range(200)]
    docs = [
        (draw.choice(["en", "fr", "xx"]), draw.choice(["s", "t", "u", "ü", "é"]), draw.choice([" ", "-", "1"]).join(draw.choice(pool[: draw.choice([20, 217])]) for _ in range(draw.randrange(30))))
        for _ in range(120)
    ]
    for top in (200, 5):
        assert got(spark.createDataFrame(docs, "lang string, source string, text string").repartition(5), top=top) == brute(docs, top=top)


def test_levels_keep_what_counting_keeps(spark, monkeypatch):
    """Small tables, a full bitmap and joins by shuffle; terms as long as a level, one byte more, and long ones kept or not."""
    monkeypatch.setattr(iceberg, "ENTRIES", 10)
    monkeypatch.setattr(iceberg, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(iceberg, "bitmap_of", lambda items: bytes([255]) * (iceberg.BITS // 8))
    long = "y" * 5_000
    texts = ["abcd abcde abcdefgh abcdefghi " + long, "abcd abcdf abcdefgh abcdefghi " + long, "abcd abcdg abcdefgh abcdefghj " + long, "abcdefghi " + long + "z", "a a a", "A"]
    rows = spark.createDataFrame([("en", t) for t in texts], "lang string, text string")
    assert {r.item.decode() for r in iceberg.kept_terms(rows).collect()} == {"abcd", "abcdefgh", "abcdefghi", long}


def test_odd_rows(spark):
    """Nulls read as '', groups without terms, a language without kept terms, repeated rows, clashing columns."""
    docs = [(None, None, "same words here"), ("", "", "same words"), (None, "s", "same Same"), ("de", "a", None), ("de", "b", ""), ("de", "c", "eins zwei"), ("fr", "only", "un un un")]
    docs += [("es", "x", "hola que tal " * 9), ("es", "x", "hola que tal " * 9), ("es", "y", "hola"), ("es", "z", "123 ..."), ("es", "w", "hola " * 50_000)]
    frame = spark.createDataFrame([(*d, 1, "v") for d in docs], "lang string, source string, text string, n int, item string")
    assert got(frame) == brute(docs)
    assert got(frame.limit(0)) == []
    assert {x[4] for x in got(frame) if x[0] == "de"} == {0}


def test_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("lang", "source", "text")
    assert got(rows) == brute([tuple(r) for r in rows.collect()])


def test_shares_of_any_count(spark):
    """Counts that a long can't hold times UNITS are divided as decimals, with the same result."""
    counts = [0, 1, iceberg.LONG - 1, iceberg.LONG, 9 * 10**15]
    rows = spark.createDataFrame([(c, 3 * c + 7, 5) for c in counts], "n long, of_all long, size long")
    assert {r.n: r.p for r in rows.select("n", iceberg.share(F.col("n")).alias("p")).collect()} == {c: 1 + 10**9 * (c + 1) // (3 * c + 12) for c in counts}
