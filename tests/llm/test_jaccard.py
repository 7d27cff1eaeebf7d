"""Components of similar documents against all pairs."""

import random

from pyspark.sql import functions as F

from flowlake.llm import jaccard
from flowlake.llm.components import components


def shingles(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ")
    words = [w for w in words if w]
    if not words:
        return set()
    return {tuple(words)} if len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(docs):
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


def got(frame):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_components(frame).collect()}


def near_copies(seed, n, base_words, edits, vocabulary=400):
    """Groups of copies with as many random edits, some of them sharing a passage."""
    draw = random.Random(seed)
    word = lambda: f"w{draw.randrange(vocabulary)}"
    passage, out = [word() for _ in range(60)], []
    for g in range(4):
        base = [word() for _ in range(base_words)]
        for _ in range(n):
            copy = list(base)
            for _ in range(draw.randrange(edits)):
                copy[draw.randrange(len(copy))] = word()
            if draw.random() < 0.3:
                copy[:0] = passage
            out.append(" ".join(copy))
    draw.shuffle(out)
    return list(enumerate(out))


def test_near_copies_match_brute_force(spark):
    for seed, n, words, edits in ((1, 60, 120, 9), (2, 40, 40, 4)):
        docs = near_copies(seed, n, words, edits)
        want = brute(docs)
        assert 4 < len({c for _, c in want.values()}) < len(docs)
        assert got(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)) == want


def test_small_groups_and_blocks(spark, monkeypatch):
    """Groups of a few tokens and blocks of two queries give the same components."""
    monkeypatch.setattr(jaccard, "GROUP_TOKENS", 300)
    monkeypatch.setattr(jaccard, "QUERIES_PER_TASK", 2)
    monkeypatch.setattr(jaccard, "HEADS", 1)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    docs = near_copies(7, 40, 100, 9)
    assert got(spark.createDataFrame(docs, "doc_id long, text string")) == brute(docs)


def test_classes_that_share_half_a_key(spark, monkeypatch):
    """Two sets whose class ids are equal stay apart."""
    monkeypatch.setattr(jaccard, "class_id", lambda key: F.pmod(F.xxhash64(key), F.lit(2_000)))
    docs = near_copies(3, 25, 30, 3)
    assert got(spark.createDataFrame(docs, "doc_id long, text string")) == brute(docs)


def test_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert got(rows) == brute([tuple(r) for r in rows.collect()])


def test_odd_rows(spark):
    docs = [(3, "One Two three"), (1, "one two THREE"), (5, ""), (6, None), (7, " \n "), (8, "one two three four"), (9, "É a"), (2, "é a")]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, label string")
    assert got(frame) == brute(docs)
    twice = spark.createDataFrame([(4, "a b c d e f"), (4, "a b c d e f"), (None, "a b c d e f")], "doc_id long, text string")
    assert {r.component_id for r in jaccard.similar_components(twice).collect()} == {4}
    assert sorted(r.doc_id for r in jaccard.keep_one(twice).collect()) == [4]
    nameless = spark.createDataFrame([(None, "a b c d e f"), (None, "A b c d e f"), (None, None), (7, " ")], "doc_id long, text string")
    assert [r.doc_id for r in jaccard.keep_one(nameless).orderBy("text").collect()] in ([None, 7, None], [None, None, 7], [7, None, None])
    assert jaccard.keep_one(nameless).where("text like '% b %'").count() == 1
    assert jaccard.similar_components(frame.limit(0)).count() == 0


def test_components(spark):
    links = [(k, k + 1) for k in range(1, 30)] + [(100, 50), (70, 50), (200, 200)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {found[k] for k in range(1, 31)} == {1} and {found[k] for k in (50, 70, 100)} == {50}
    assert components(spark.createDataFrame(links, "a long, b long").where(F.lit(False))).count() == 0
