"""Line dedup against an all-pairs alignment, and its defined cases."""

import random
import re

from pyspark.sql import functions as F

from flowlake.llm import linedup

A = "Alpha beta gamma delta one two three four five six. "
B = "Seven eight nine ten eleven twelve thirteen fourteen fifteen. "
C = "Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod. "
D = "Ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi. "


def pieces(text):
    return re.split(r"(?<=\n)|(?<=[.!?,;:]\x20)", text) if text else [""]


def runs(text):
    """The lines with a word, and (first, last) of every run of them with enough words."""
    lines = [(k, x.strip(), len(x.split())) for k, x in enumerate(pieces(text)) if x.strip()]
    found = []
    for a in range(len(lines)):
        total = 0
        for b in range(a, len(lines)):
            total += lines[b][2]
            if total >= linedup.MIN_WORDS:
                found.append((a, b))
                break  # longer runs from here are covered by the shortest ones that end at each line
    for b in range(len(lines)):
        total = 0
        for a in range(b, -1, -1):
            total += lines[a][2]
            if total >= linedup.MIN_WORDS:
                found.append((a, b))
                break
    return lines, found


def brute(docs):
    """Texts left when every passage that an earlier document holds goes."""
    out, seen, known = {}, set(), set()
    for i, t in sorted(docs):
        if t and t in seen:
            out[i] = ""
            continue
        seen.add(t)
        lines, found = runs(t)
        gone = set()
        for a, b in found:
            if tuple(x[1] for x in lines[a : b + 1]) in known:
                gone |= set(range(a, b + 1))
        starts = [x[0] for x in lines] + [len(pieces(t))]
        places = {p for k in gone for p in range(starts[k], starts[k + 1])}
        out[i] = "".join(p for k, p in enumerate(pieces(t)) if k not in places) if places else t
        known |= {tuple(x[1] for x in lines[a : b + 1]) for a, b in found}
    return out


def test_patience():
    assert linedup.patience([1, 2, 3], [1, 2, 3]) == [(0, 0), (1, 1), (2, 2)]
    assert linedup.patience([1, 9, 2, 3], [8, 2, 3, 1]) == [(2, 1), (3, 2)] or linedup.patience([1, 9, 2, 3], [8, 2, 3, 1]) == [(0, 3)]
    assert linedup.patience([], [1]) == []
    assert linedup.patience([5, 5, 1, 5], [5, 1, 5, 5]) != []


def test_planted_passages(spark):
    docs = [
        (1, f"Own start of one. {A}{B}{C}Own end of one."),
        (2, f"Other words here. {A}{B}{C}Another end."),
        (3, "Clean text of its own, nothing shared at all. Really."),
        (4, f"Own start of one. {A}{B}{C}Own end of one."),
        (5, f"{A}{A[:20]}. Short share only."),
        (6, f"Six starts.\n{D}{C}{B}\nsix ends."),
        (7, f"Seven starts.\n{D}{C}{B}\nseven ends."),
        (8, f"Eight {A}{B}{C}. {D}{C}{B}"),
        (9, ""),
        (10, None),
    ]
    got = {r.doc_id: r.text for r in linedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs)
    assert got[2] == "Other words here. Another end." and got[4] == "" and got[3] == docs[2][1] and got[10] is None
    assert got[7] == "Seven starts.\nseven ends."


def test_table_matches_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = [tuple(r) for r in rows.collect()]
    got = {r.doc_id: r.text for r in linedup.dedup_lines(rows).collect()}
    assert got == brute(docs)
    assert sum(got[i] != t for i, t in docs) > 5


def test_repeats_nulls_and_clashing_columns(spark):
    rows = [(1, A + B + C, "x", 1), (1, A + B + C, "x", 1), (None, A + B + C, "y", 2), (2, None, "z", 3), (2, None, "z", 3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, print string, removed long")
    got = linedup.dedup_lines(frame)
    assert [r.text for r in got.where("doc_id = 1").collect()] == [A + B + C] * 2
    assert [r.text for r in got.where("doc_id is null").collect()] == [""]
    assert got.where("doc_id = 2").count() == 2 and "print" in got.columns
    assert linedup.dedup_lines(frame.limit(0)).count() == 0


def test_large_group_keeps_one_copy_of_a_passage(spark):
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("Start "), F.col("id"), F.lit(". " + A + B + C + D), F.lit("End "), F.col("id"), F.lit(".")).alias("text"))
    got = linedup.dedup_lines(docs).where(F.col("text").contains("Lorem ipsum")).collect()
    assert [r.doc_id for r in got] == [0]


def test_passage_with_blank_lines_between(spark):
    passage = "\n\n".join(x.strip() for x in (A, B, C, D))
    docs = [(1, f"Start one.\n\n{passage}\n\nend one."), (2, f"Start two.\n\n{passage}\n\nend two.")]
    got = {r.doc_id: r.text for r in linedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs) and "Lorem" in got[1] and "Lorem" not in got[2]


def test_key_of_many_documents_whose_first_holder_has_only_a_piece(spark):
    """Documents 50 and 51 share a block of which others hold pieces."""
    lines = [f"line {n} " + " ".join(f"w{n}{k}" for k in range(10)) + ". " for n in range(4)]
    docs = [(k, f"Start {k}. {lines[k % 4]}{lines[(k + 1) % 4]}end {k}.") for k in range(24)]
    docs += [(50, f"Fifty. {''.join(lines)}done."), (51, f"Other. {''.join(lines)}over.")]
    got = {r.doc_id: r.text for r in linedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs) and got[51] == "Other. over."


def test_passages_in_other_order_and_repeated_in_the_first_holder(spark):
    docs = [(1, f"One. {A}{B}{C}{A}{B}{C}end."), (2, f"Two. {C}{D}{A}{B}{C}end."), (3, f"Three. {A}{B}{C}last."), (4, f"Four. {C}{A}{B}last.")]
    got = {r.doc_id: r.text for r in linedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs) and got[3] == "Three. last."


def test_random_documents_match_brute_force(spark):
    """Few lines in many orders, blank lines between, some lines frequent."""
    draw = random.Random(5)
    pool = [" ".join(f"v{n}x{k}" for k in range(draw.randrange(2, 9))) + draw.choice([".", ",", "!"]) for n in range(40)]
    docs = [(k, "".join(draw.choice(pool[:: draw.choice([4, 8])]) + draw.choice([" ", " ", "\n", "\n\n"]) for _ in range(draw.randrange(30)))) for k in range(150)]
    got = {r.doc_id: r.text for r in linedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()}
    assert got == brute(docs)
    assert 20 < sum(got[k] != t for k, t in docs)


def test_alignment_decides(spark, monkeypatch):
    """Without alignment, passages in order stay: on planted documents and on the given table."""
    import numpy as np

    lines = [f"line {n} " + " ".join(f"w{n}{k}" for k in range(10)) + ". " for n in range(6)]
    a, b = (np.arange(1, 7) * s for s in (1, 1))
    words = np.full(6, 12)
    assert linedup.common_blocks(a, b, words, words) == list(range(6))
    crossed = np.array([4, 5, 6, 1, 2, 3])
    assert linedup.common_blocks(a, crossed, words, words) == list(range(6))
    twice = np.array([1, 2, 3, 9, 1, 2, 3])
    assert linedup.common_blocks(a, twice, words, np.full(7, 12)) == [0, 1, 2, 4, 5, 6]
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = [tuple(r) for r in rows.collect()] + [(10**6, "".join(lines)), (10**6 + 1, "Own. " + "".join(lines) + "End.")]
    texts = sorted(docs)
    seen = {t: i for i, t in reversed(texts)}
    pairs = [(x, y) for x in texts[:60] + texts[-2:] for y in texts if x[0] < y[0] and seen[x[1]] == x[0] and seen[y[1]] == y[0] and x[1] and y[1]]
    sides = {t: linedup.hashed_text(t) for _, t in docs if t}
    found = lambda: sum(len(linedup.common_blocks(*(np.array(sides[t][0]) for t in (x[1], y[1])), *(np.array(sides[t][1]) for t in (x[1], y[1])))) for x, y in pairs)
    whole = found()
    monkeypatch.setattr(linedup, "patience", lambda a, b: [])
    assert found() < whole


def test_text_ids_and_long_texts(spark):
    passage = A + B + C
    long = " ".join(f"x{k}" for k in range(60_000))
    docs = [("b", f"B own. {passage}"), ("a", f"A own. {passage}"), ("c", long), ("d", f"{long}. {passage}"), ("e", ". " * 50_000)]
    got = {r.doc_id: r.text for r in linedup.dedup_lines(spark.createDataFrame(docs, "doc_id string, text string")).collect()}
    assert got["b"] == "B own. " and got["a"] == docs[1][1] and got["c"] == long and got["d"] == f"{long}. " and got["e"] == docs[4][1]
