"""Defined cases of the native operators: nulls, empty texts, repeats, clashing columns, empty tables."""

import math
import re

import pytest
from pyspark.sql import functions as F

from flowlake.llm import mixing, pii, quality, secrets, sharding, urls
from flowlake.llm.common import words

DOCS = "doc_id long, text string, source string, host string, spans string, size string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "h", "x", "y") for i, t, s in rows], DOCS)


def prose(n, tag="w"):
    return " ".join(f"{tag}{k}" for k in range(n))


def letters(k):
    return "abcdefghij"[k // 10] + "abcdefghij"[k % 10]


def repeated(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    return len({i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)})


def test_base_measures(spark):
    texts = [None, "", "  ", "a", "a b c a b c d", "x y z x y z x y z x", "l1\nl2\nl1\n\n \nl1", "a#b $ <c>|", prose(60), "é b \x1c d"]
    got = {r.doc_id: r for r in quality.quality_rules(docs(spark, [(k, t, "s") for k, t in enumerate(texts)])).collect()}
    for k, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        assert (got[k].n_words, got[k].word_chars, got[k].n_repeat_words) == (len(w), sum(map(len, w)), repeated(t)), t
    assert got[6].n_dup_lines == 2 and got[7].n_symbols == 5
    assert [got[k].kept for k in (0, 1, 8)] == [False, False, True]
    assert spark.range(1).select(words(F.lit(" a\tb\x0bc\r\n")).alias("w")).first().w == ["a", "b", "c"]


def test_frequent_lines_reject_depleted_documents(spark):
    common = prose(45, "menu")
    rows = [(k, f"{common} {k}\nown {prose(8, letters(k))}", "a") for k in range(30)]  # digits fold: one line in all
    rows += [(100 + k, f"{common} {k}\n{prose(80, letters(k))}", "b") for k in range(30)]
    rows += [(200 + k, f"copied {prose(70, 'same')}\nline", "a") for k in range(30)] + [(300, prose(60, "null"), None)]
    got = {r.doc_id: r for r in quality.quality_rules(docs(spark, rows), cleaned=True).collect()}
    assert not any(got[k].kept for k in range(30)) and all(got[100 + k].kept for k in range(30))
    assert all(got[200 + k].kept for k in range(30)) and got[300].kept  # copies of one text are no boilerplate
    assert "menu" not in got[105].text and got[105].n_frequent_words == 46
    assert quality.quality_rules(docs(spark, rows).limit(0)).count() == 0


def test_mix_is_near_targets_and_repeatable(spark):
    rows = [(k, prose(20 + 7 * (k % 13)), f"s{k % 5}") for k in range(600)] + [(900 + k, prose(5), "tiny") for k in range(4)]
    rows += [(950, None, None), (951, "one two", None), (951, "one two", None)]
    frame = docs(spark, rows)
    got = mixing.mix(frame).collect()
    assert len(got) == len(rows) and max(r.copies for r in got) <= 3
    taken, goal = {}, {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.copies * r.size
        goal[r.source] = (r.target, r.source_size)
    for s, (t, size) in goal.items():
        assert t <= 3 * size + 1e-9 and abs(taken[s] - t) <= max(0.02 * t, 4), (s, taken[s], t)
    assert sum(t for t, _ in goal.values()) == pytest.approx(sum(s for _, s in goal.values()))
    again = mixing.mix(frame.repartition(7)).collect()
    assert sorted((r.doc_id, r.copies) for r in got) == sorted((r.doc_id, r.copies) for r in again)
    assert mixing.mixed(frame).count() == sum(r.copies for r in got)
    assert mixing.mix(frame.limit(0)).count() == 0


def test_inclusion_follows_each_documents_probability(spark):
    """Over many seeds, documents of unequal size are taken as often as their expected copies say."""
    frame = docs(spark, [(k, prose(4 + 3 * (k % 12)), f"s{k // 120}") for k in range(360)])
    seeds, mean, p = 24, {}, {}
    for n in range(seeds):
        for r in mixing.mix(frame, seed=f"seed-{n}").collect():
            mean.setdefault((r.source, r.size), []).append(r.copies)
    for source in ("s0", "s1", "s2"):
        rates = {size: sum(v) / len(v) for (s, size), v in mean.items() if s == source}
        unit = sum(rates.values()) / sum(math.ceil(math.sqrt(size)) for size in rates)
        assert len(set(rates.values())) > 4
        if max(rates.values()) < 2.9:  # none at the most copies
            for size, rate in rates.items():
                assert rate == pytest.approx(unit * math.ceil(math.sqrt(size)), abs=0.17), (source, size)


def test_url_rules_and_propagation(spark):
    page = "page_id long, url string, html string, rule string, host string"
    rows = [
        (1, "http://a.COM/x?q#f", None), (2, "http://example.com/en/1", ""), (3, "http://www.example.com/en/1", ""), (4, "http://b.net/es/1", "<a href='http://c.org/'>"),
        (5, "http://b.net/de/1", "<a href=\"/x\">"), (6, None, None), (7, "nothing", ""), (8, "http://c.org", ""), (9, "http://d.org/p", "<a href=http://b.net/es/2>"), (10, "http://notcom/", ""),
    ]
    frame = spark.createDataFrame([(*r, "r", "h") for r in rows], page)
    got = {r.page_id: r for r in urls.filter_urls(frame).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.com", "/x", "com/", "allow")
    assert (got[2].rule, got[2].verdict, got[3].rule, got[3].verdict) == ("example.com/en/", "block", "www.example.com/en/", "allow")
    assert (got[4].rule, got[4].verdict, got[5].rule, got[5].verdict) == ("net/es/", "block", None, "block")
    assert (got[6].host, got[6].path, got[6].verdict, got[7].host, got[10].rule) == ("", "", "allow", "", None)
    assert got[9].verdict == "block" and got[9].distrust > 0 and got[8].verdict == "allow"  # distrust runs against the links
    assert urls.filter_urls(frame.limit(0)).count() == 0


def test_shard_table(spark):
    owner = sharding.fill()
    counts = [owner.count(k) for k in range(len(sharding.SHARDS))]
    assert min(owner) == 0 and max(counts) - min(counts) <= 1 and len(owner) == sharding.SLOTS
    fewer = sharding.fill(sharding.SHARDS[:-1])
    moved = sum(a != b for a, b in zip(owner, fewer) if a != len(sharding.SHARDS) - 1)
    assert moved < 0.2 * sharding.SLOTS
    turns = [[] for _ in range(5)]  # brute force: turns over whole preference lists
    names, slots, left = tuple("abcde"), 13, set(range(13))
    lists = [[(sharding.digest(f"start:{s}") + j * (sharding.digest(f"step:{s}") % (slots - 1) + 1)) % slots for j in range(slots)] for s in names]
    while left:
        for k in range(5):
            if left:
                slot = next(x for x in lists[k] if x in left)
                turns[k].append(slot)
                left.discard(slot)
    assert sharding.fill(names, slots) == [next(k for k in range(5) if s in turns[k]) for s in range(slots)]
    with pytest.raises(ValueError):
        sharding.fill(names, 12)
    rows = docs(spark, [(1, "a", None), (1, "a", None), (None, "b", "s"), (None, None, "s")]).withColumn("slot", F.lit("x"))
    got = sharding.shard(rows).collect()
    assert len(got) == 4 and len({r.shard for r in got if r.doc_id == 1}) == 1 and all(isinstance(r.slot, int) for r in got)
    assert sharding.shard(rows.limit(0)).count() == 0


ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", re.ASCII)


def secrets_in(t):
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return out + [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]


def test_secrets(spark):
    texts = [
        None, "", "password = hunter2x, TOKEN:'abc' Api_Key=\"abcdefgh\"", "é😀 AKIA" + "B" * 16 + " AKIAAKIA" + "C" * 15, "0" * 23 + "g" + "a1" * 12, "password=token = abcdefgh",
        "secret token: abcdef" * 300, "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a" * 36, "pass word=abcdefg", "tokentoken=abcdef",
    ]
    rows = secrets.scan_secrets(docs(spark, [(k, t, "s") for k, t in enumerate(texts)])).withColumn("masked", secrets.masked_text(F.coalesce("text", F.lit("")), F.col("spans")))
    got = {r.doc_id: r for r in rows.collect()}
    for k, t in enumerate(texts):
        assert sorted((s.start, s.at, s.end, s.kind) for s in got[k].base_spans) == sorted(secrets_in(t or "")), t
    assert [s.kind for s in got[7].spans] == ["pem"] and "forge" in [s.kind for s in got[8].spans]
    assert got[2].masked == "[ASSIGN], TOKEN:'abc' [ASSIGN]\"" and got[7].masked == "[PEM]"
    assert secrets.scan_secrets(rows.limit(0)).count() == 0


def test_trigram_queries_never_miss():
    for r in secrets.RULES:
        for text in ("token: abcdefg", "apikey=abcdefg", "API_KEY = abcdefg", "AKIA" + "Z" * 16, "-----BEGIN EC PRIVATE KEY-----", "xoxb-0123456789", "eyJabcdefgh.eyJabcdefgh.abcdefghi"):
            query = secrets.trigram_query(r.pattern)
            if re.search(r.pattern, text) and query:
                assert any(all(g in text.lower() for g in way) for way in query), (r.kind, text)


def personal_in(t):
    luhn = lambda d: sum((x := int(c) * (1 + i % 2)) - 9 * (x > 9) for i, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda x: re.sub("[^0-9]", "", x)
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]


def test_personal_data(spark):
    texts = [
        None, "", "a@b.c@d.e x_y@z.co.uk. a@b", "é 1.2.3.4.5.6.7.8 300.1.1.1 007.0255.1.2 1.2.3.00000000000000000255", "4111 1111 1111 1111, 4111-1111-1111-1112 0 4111111111111111", "+49 (30) 1234-567 +1 2 +12345678901234567",
        "a.b@c.d_x@e.f", "12 " * 5000, "x" * 60000 + "@y.zz", "....@-.-", "1" * 30000, "+1" * 200 + " 555 000 1234",
    ]
    got = {r.doc_id: r for r in pii.find_personal(docs(spark, [(k, t, "s") for k, t in enumerate(texts)])).collect()}
    for k, t in enumerate(texts):
        assert sorted((s.start, s.at, s.end) for s in got[k].base_spans) == sorted(personal_in(t or "")), (t or "")[:60]


def test_disclosing_terms(spark):
    rows = [(k, f"report {k} by zweigart of the common office, mail joe@acme.org or call", "s") for k in range(4)]
    rows += [(10 + k, f"another common report {k} of the office by mail or call {prose(5, letters(k))}", "s") for k in range(40)]
    rows += [(60, "lonely person kim@solo.org unusualword", "s"), (61, "lonely person kim@solo.org unusualword", "s")]
    out = pii.find_personal(docs(spark, rows)).withColumn("clean", pii.sanitised(F.col("text"), F.col("spans")))
    got = {r.doc_id: r for r in out.collect()}
    terms = lambda r: {r.text[s.start : s.end] for s in r.spans if s.kind == "term"}
    assert all(terms(got[k]) == {"zweigart"} for k in range(4))
    assert got[0].clean == "report 0 by <term> of the common office, mail <email> or call"
    assert terms(got[60]) == set() and terms(got[10]) == set()
    assert pii.find_personal(docs(spark, rows).limit(0)).count() == 0


def test_disclosing_terms_far_from_the_entity(spark):
    far = prose(60, "ab ")
    rows = [(k, f"joe@acme.org {far} {letters(k)} zweigart", "s") for k in range(4)]  # 180 code points apart and more
    rows += [(10, "zweigart without an entity", "s"), (11, f"joe@acme.org {far} nobody", "s")]
    rows += [(20 + k, f"another text {far} {letters(k)}", "s") for k in range(60)]
    got = {r.doc_id: r for r in pii.find_personal(docs(spark, rows)).collect()}
    terms = lambda r: [r.text[s.start : s.end] for s in r.spans if s.kind == "term"]
    assert all(terms(got[k]) == ["zweigart"] for k in (0, 1, 2, 3, 10))
    assert not any(terms(got[k]) for k in (11, 20, 79))


def test_disclosing_terms_of_a_domain(spark):
    """Every address stands in one text only; their domain is what the term gives away."""
    rows = [(k, f"write {letters(k)} to {letters(k)}@acme.org at the zweigart branch", "s") for k in range(4)]
    rows += [(20 + k, f"write another text at the branch {letters(k)}", "s") for k in range(60)]
    got = {r.doc_id: r for r in pii.find_personal(docs(spark, rows)).collect()}
    terms = lambda r: [r.text[s.start : s.end] for s in r.spans if s.kind == "term"]
    assert all(terms(got[k]) == (["zweigart"] if k < 4 else []) for k in got)


def test_overlapping_spans_are_masked_as_one(spark):
    row = pii.find_personal(docs(spark, [(1, "see 1.2.3.4@corp.com now, a@b.cc", "s")])).withColumn("clean", pii.sanitised(F.col("text"), F.col("spans"))).first()
    assert row.clean == "see <ip> now, <email>"


def test_host_edges_through_domains_without_pages(spark):
    rows = [(1, "http://blog.x.example.net/", "<a href='//cdn.other.org/a'>"), (2, "http://m.x.example.net/", None), (3, "http://10.0.0.1/", None), (4, "http://example.net/", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("__host", urls.host_of(F.col("url")))
    got = {tuple(r) for r in urls.host_edges(pages, pages.select(F.col("__host").alias("host"))).collect()}
    up = {("blog.x.example.net", "x.example.net"), ("m.x.example.net", "x.example.net"), ("x.example.net", "example.net")}
    assert got == up | {(b, a) for a, b in up} | {("blog.x.example.net", "cdn.other.org")}


def test_edges_decide_verdicts_on_the_given_table(spark, monkeypatch):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    whole = {r.page_id: r.verdict for r in urls.filter_urls(pages).collect()}
    none = spark.createDataFrame([], "src string, dst string")
    monkeypatch.setattr(urls, "host_edges", lambda *a: none)
    alone = {r.page_id: (r.verdict, r.trust, r.distrust) for r in urls.filter_urls(pages).collect()}
    assert 0 < sum(whole[k] != v[0] for k, v in alone.items()) < len(whole)
    assert {v[1] for v in alone.values()} | {v[2] for v in alone.values()} - {0}  # hosts without edges keep their seeds


def test_repeated_pages_and_hot_hosts_join_alike(spark, monkeypatch):
    rows = [(k % 40, f"http://h{k % 3}.y.net/{'es' if k % 2 else 'de'}/", None) for k in range(80)] + [(99, None, None), (99, None, None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    few = sorted(map(tuple, urls.filter_urls(frame).fillna("-").collect()))
    monkeypatch.setattr(urls, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, urls.filter_urls(frame).fillna("-").collect())) == few and len(few) == 82


def test_written_shards_hold_every_row_once(spark, tmp_path):
    frame = docs(spark, [(k, f"text {k}", "s") for k in range(300)] + [(None, "a", "s"), (None, "a", "s"), (7, None, "s")])
    sharding.write_shards(frame, str(tmp_path / "out"), files_per_shard=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    want = sorted((str(r.doc_id), str(r.text), r["shard"]) for r in sharding.shard(frame).collect())
    assert sorted((str(r.doc_id), str(r.text), r["shard"]) for r in back.collect()) == want
