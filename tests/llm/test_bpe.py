"""The segment-tree encoder against the tokenizers library."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowlake.llm import bpe, queries

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

ODD = [
    "", " ", "a", "It's we'll THEY'RE  don't", "<|endoftext|>", "x<|startoftext|>y<|endoftext|", "ΟΔΟΣ Σ ΣΣ", "İstanbul ﬁne Å é",
    "日本語のテキスト", "😀😃 é", "a\x1cb\x1db\x85c d​e　f", "1234½²", "a" * 5000, "ab" * 3000 + "!" * 999, "\n\t\r\x0b\x0c", "𝐀𝔘 ß ẞ ŉ",
]


@pytest.fixture(scope="module")
def both():
    path = public_tokenizers.path("word_bpe_49k.json")
    return tokenizers.Tokenizer.from_file(path), bpe.Vocabulary(path)


def check(both, text):
    theirs, ours = both
    ids = theirs.encode(text, add_special_tokens=False).ids
    packed = ours.encode(text)
    assert np.frombuffer(packed, dtype="<u4").tolist() == ids, text[:80]
    assert ours.decode(packed) == theirs.decode(ids, skip_special_tokens=False)


def test_odd_texts(both):
    for text in ODD:
        check(both, text)


def test_every_character(both):
    chars = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(chars), 50):
        check(both, " a".join(chars[k : k + 50]))


def test_random_texts(both):
    draw = random.Random(5)
    for _ in range(300):
        check(both, "".join(draw.choice("aAbet'sdl l\n19é!ñΣ<|>") for _ in range(draw.randrange(80))))


def test_whole_table(spark, both):
    sf_dir = "/root/testdata/sf0.001"
    theirs = both[0]
    rows = {r.doc_id: r for r in queries.op7_bpe(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = theirs.encode(d.text or "", add_special_tokens=False).ids
        assert rows[d.doc_id].n_tokens == len(ids)
        assert rows[d.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert rows[d.doc_id].decoded_sha256 == hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_nulls_repeats_and_clashing_columns(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = spark.createDataFrame([(1, None, "x"), (2, "a cat", "y"), (2, "a cat", "y")], "doc_id long, text string, ids string")
    got = bpe.decode(bpe.encode(rows, path), path).orderBy("doc_id").collect()
    assert got[0].ids == b"" and got[0].decoded == ""
    assert bpe.round_trip(rows, path).orderBy("doc_id").collect() == got
    assert got[1] == got[2] and got[1].decoded == "a</w> cat</w>"
    assert bpe.encode(rows.limit(0), path).count() == 0


def test_waiting_workers_keep_no_pieces(spark):
    """Python workers outlive their tasks; what they know of pieces must not stay beside the executor's heap."""
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.range(0, 64, 1, 8).select("id", F.concat_ws(" ", F.lit("waiting workers keep"), F.col("id").cast("string")).alias("text"))
    assert bpe.encode(docs, path).where(F.octet_length("ids") > 0).count() == 64

    def held(batches):
        import time

        time.sleep(0.3)  # so that all workers get a part
        for _ in batches:
            known = bpe.vocabulary(path).known if bpe.vocabulary.cache_info().currsize else {}
            yield pa.RecordBatch.from_pydict({"pieces": pa.array([len(known)], pa.int64())})

    assert spark.range(0, 64, 1, 8).mapInArrow(held, "pieces long").agg(F.max("pieces")).first()[0] == 0
