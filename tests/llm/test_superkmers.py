"""Substring dedup against all windows, and its defined cases."""

import random

import numpy as np
import pytest

from flowlake.llm import superkmers


def brute(docs, window=superkmers.WINDOW):
    """(n_words, n_removed, text) of each row; ids that are None come last."""
    order = lambda i: (i is None, i if i is not None else 0)
    split = [(i, (t or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ")) for i, t in docs]
    split = [(i, [w for w in ws if w]) for i, ws in split]
    least = {}
    for i, ws in split:
        for a in range(len(ws) - window + 1):
            key = tuple(ws[a : a + window])
            least[key] = min(least.get(key, order(i)), order(i))
    out = []
    for (i, ws), (_, t) in zip(split, docs):
        gone = {a + k for a in range(len(ws) - window + 1) if least[tuple(ws[a : a + window])] < order(i) for k in range(window)}
        out.append((i, len(ws), len(gone), None if t is None else " ".join(w for k, w in enumerate(ws) if k not in gone)))
    return sorted(out, key=str)


def got(frame):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in superkmers.dedup_windows(frame).collect()), key=str)


def prose(seed, n, vocabulary=300):
    draw = random.Random(seed)
    word = lambda: f"w{int(draw.paretovariate(0.7)) % vocabulary}"
    passages = [[word() for _ in range(draw.randrange(8, 60))] for _ in range(6)]
    docs = []
    for k in range(n):
        words = []
        for _ in range(draw.randrange(5)):
            words += [word() for _ in range(draw.randrange(20))] + (draw.choice(passages) if draw.random() < 0.5 else [])
        docs.append((draw.randrange(n), draw.choice([" ", "\n", " \t "]).join(words)))
    return docs


def test_random_documents_match_brute_force(spark):
    for seed in (1, 2):
        docs = prose(seed, 150)
        want = brute(docs)
        assert sum(x[2] > 0 for x in want) > 20
        assert got(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)) == want


def test_hot_minimisers_are_cut_to_windows(spark, monkeypatch):
    """One passage in most documents, a frequent run of words in other contexts, and one long repetitive text."""
    monkeypatch.setattr(superkmers, "BUCKETS", 1)
    passage = " ".join(f"p{k}" for k in range(40))
    docs = [(k, f"own{k} a{k} {passage} b{k} c{k}") for k in range(60)]
    docs += [(100 + k, " ".join(f"x{k * 7 + j} the same few" for j in range(12))) for k in range(20)]
    docs += [(200, "so on " * 3_000), (201, "so on " * 10), (202, "on so on so " * 5)]
    assert got(spark.createDataFrame(docs, "doc_id long, text string").repartition(7)) == brute(docs)


@pytest.mark.parametrize("counter", [True, False])
def test_windows_of_one_hash_stay_apart(spark, monkeypatch, counter):
    """Sorting proposes by hash; bytes decide."""
    if counter:
        monkeypatch.setattr(superkmers, "window_keys", lambda data, low, high: (high - low).astype("uint64"))
    words = b" ".join(b"%s%d" % (c, k) for c in (b"a", b"b", b"a") for k in range(15))
    numbers = [np.array(x) for x in ([5, 6, 7], [0] * 3, [4] * 3, [3] * 3)]
    found = superkmers.later([(*numbers, np.frombuffer(words, np.uint8))])
    assert found.to_pylist() == [{"id": 7, "print": 0, "start": 4, "stop": 19}]


def test_odd_rows(spark):
    text = " ".join(f"v{k}" for k in range(20))
    long = " ".join(f"y{k % 5000}" for k in range(60_000))
    docs = [(3, text), (3, text + " more"), (None, text), (None, text), (1, None), (2, ""), (4, " \n\t "), (5, "few words"), (6, long), (7, long + " end")]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, removed string, n_words int")
    assert got(frame) == brute(docs)
    rows = {(r.doc_id, r.n_words): r.removed for r in superkmers.dedup_windows(frame).collect()}
    assert [tuple(s) for s in rows[None, 20]] == [(0, 20)] and rows[3, 21] == [] and [tuple(s) for s in rows[7, 60_001]] == [(0, 60_000)]
    assert superkmers.dedup_windows(frame.limit(0)).count() == 0
    named = frame.selectExpr("cast(doc_id as string) as doc_id", "text", "1 as id", "2 as print", "3 as __rank_")
    assert [x[1:] for x in got(named)] == [x[1:] for x in brute([(None if i is None else str(i), t) for i, t in docs])]
    assert {"id", "print"} <= set(superkmers.dedup_windows(named).columns)


def test_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert got(rows) == brute([tuple(r) for r in rows.collect()])
