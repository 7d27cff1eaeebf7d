"""The registered queries against their DuckDB equivalents, and the pipeline's stages."""

import hashlib
import re

import duckdb
import pytest

import corpus_pipeline
from flowlake.llm.queries import ORACLES, QUERIES
from flowlake.llm.queries import word_bpe
from tests.llm import test_jaccard, test_linedup
from tests.llm.test_native import repeated
from tests.test_queries import plain

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert plain(QUERIES[name](spark, SF).toPandas()) == plain(con.execute(ORACLES[name]).df())


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        rows = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert rows.columns == docs.columns, name
        rows.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append(docs.count())
    assert kept[0] >= kept[1] >= kept[2] > 0 and kept[3] == kept[4]
    assert corpus_pipeline.run(spark, SF).count() == kept[4]


def by_rules(rows):
    """Stage 1 by plain loops: texts without frequent lines, of the documents that stay."""
    word = r"[^\x20\x09-\x0D]+"
    norm = lambda x: re.sub("[0-9]+", "0", re.sub(r"[\x20\x09-\x0D]+", " ", x.lower())).strip(" ")
    texts, holders = {}, {}
    for r in rows:
        texts.setdefault(r["source"], set()).add(r["text"])
    for source, held in texts.items():
        for t in held:
            for x in {norm(x) for x in (t or "").split("\n") if re.search(word, x)}:
                holders[source, x] = holders.get((source, x), 0) + 1
    out = []
    for r in rows:
        lines, n = (r["text"] or "").split("\n"), len(re.findall(word, r["text"] or ""))
        often = [bool(re.search(word, x)) and (k := holders[r["source"], norm(x)]) > 10 and k > 0.1 * len(texts[r["source"]]) for x in lines]
        lost = sum(len(re.findall(word, x)) for x, o in zip(lines, often) if o)
        if n >= 50 and 100 * repeated(r["text"]) <= 50 * n and n - lost >= 0.3 * n:
            out.append((r["doc_id"], "\n".join(x for x, o in zip(lines, often) if not o)))
    return sorted(out)


def test_pipeline_stages_match_brute_force(spark, tmp_path):
    """Each stage's rows, from what its predecessor kept, against plain loops, SQL or the library."""
    import tokenizers

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rule, lines, near, mix, pieces = (stage for _, stage in corpus_pipeline.STAGES)
    texts = lambda frame: sorted((r.doc_id, r.text) for r in frame.collect())

    def written(frame, name):
        frame.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    first = written(rule(spark, docs, SF), "1")
    assert texts(first) == by_rules([r.asDict() for r in docs.collect()])
    second = written(lines(spark, first, SF), "2")
    left = test_linedup.brute(texts(first))
    was = dict(texts(first))
    assert texts(second) == sorted((i, t) for i, t in left.items() if t == was[i] or re.search(r"[^\x20\x09-\x0D]", t))
    third = written(near(spark, second, SF), "3")
    found = test_jaccard.brute(texts(second))
    assert texts(third) == [(i, t) for i, t in texts(second) if found[i][1] == i]
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/3/*.parquet'")
    copies = {r.doc_id: r.copies for r in con.execute(ORACLES["op2_source_mix"]).df().itertuples()}
    fourth = written(mix(spark, third, SF), "4")
    assert texts(fourth) == sorted((i, t) for i, t in texts(third) for _ in range(copies[i]))
    library = tokenizers.Tokenizer.from_file(word_bpe())
    library.no_truncation(), library.no_padding()
    for r in pieces(spark, fourth, SF).join(fourth.select("doc_id", "text").distinct(), "doc_id").collect():
        ids = library.encode(r.text, add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_pipeline_on_odd_rows(spark):
    """Null ids, texts and sources, empty, repeated and very long texts, and no rows at all."""
    long = " ".join(f"w{k}" for k in range(30_000))
    mid = " ".join(f"m{k}" for k in range(80))
    rows = [(1, long, "en", "s", 1), (1, long, "en", "s", 1), (2, None, None, None, None), (None, mid, "en", None, 2), (None, mid, "en", None, 2), (3, "", "en", "s", 0), (4, mid + " x", "en", "t", 3)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for frame in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        docs = frame
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == frame.columns
        got = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
        assert {r.doc_id for r in got} <= {1, 4, None} and bool(got) == bool(frame.count())
