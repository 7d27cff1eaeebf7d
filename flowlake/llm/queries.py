"""The registered queries of the training-data operators, and their DuckDB equivalents.

Each query applies its operator, with production parameters, to the whole table and derives the
contract's columns from the operator's own results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.llm import ann, bpe, iceberg, jaccard, linedup, mixing, pii, quality, secrets, sharding, superkmers, urls, whitening
from flowlake.llm.common import table
from flowlake.llm.spans import joined

QUERIES = {}
ORACLES: dict[str, str] = {}


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.quality_rules(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_frequent_words"
    )


QUERIES["op1_quality_rules"] = op1_quality_rules
ORACLES["op1_quality_rules"] = r"""
with d as (
  select doc_id, source, text, coalesce(text, '') as t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
  from documents
), grams as (
  select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 1, 1)::bigint)) as i from d)
), again as (
  select doc_id, i from grams qualify count(*) over (partition by doc_id, g) >= 2
), covered as (
  select doc_id, count(distinct i + k) as n from again, (select unnest([0, 1, 2]) as k) group by doc_id
), line as (
  select doc_id, source, text, unnest(string_split(t, chr(10))) as x from d
), dup as (
  select doc_id, count(*) - count(distinct x) as n from line where regexp_matches(x, '[^\x20\x09-\x0D]') group by doc_id
), norm as (
  select doc_id, source, text, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) as n,
         trim(regexp_replace(regexp_replace(lower(x), '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]+', '0', 'g')) as x
  from line where regexp_matches(x, '[^\x20\x09-\x0D]')
), hosts as (
  select source, count(distinct text) + max((text is null)::int) as n_docs from documents group by source
), often as (
  select norm.source, x from norm join hosts on norm.source is not distinct from hosts.source
  group by norm.source, x having count(distinct text) > 10 and count(distinct text) > 0.1::double * max(n_docs)
), lost as (
  select doc_id, sum(n) as n from norm join often on norm.source is not distinct from often.source and norm.x = often.x group by doc_id
), m as (
  select d.doc_id, len(w)::bigint as n_words, len(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols, coalesce(dup.n, 0)::bigint as n_dup_lines,
         coalesce(covered.n, 0)::bigint as n_repeat_words, coalesce(lost.n, 0)::bigint as n_frequent_words
  from d left join dup on d.doc_id = dup.doc_id left join covered on d.doc_id = covered.doc_id left join lost on d.doc_id = lost.doc_id
), v as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select *, not base_failed and n_words - n_frequent_words >= 0.3::double * n_words as kept from v
"""


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(table(spark, sf_dir, "documents"))
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return rows.select("doc_id", "size", "source_size", "target", taken, "copies")


QUERIES["op2_source_mix"] = op2_source_mix
ORACLES["op2_source_mix"] = r"""
with recursive d as (
  select doc_id, source, md5(coalesce(text, '')) as print,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size
  from documents
), s as (
  select source, sum(size)::bigint as source_size, [1, 2, 3][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight
  from d group by source
), f as (
  select *, 3 * source_size as most, sum(source_size) over () as words, sum(weight) over () as weights,
         sum(3 * source_size) over o as most_to, sum(weight) over o as weight_to
  from s window o as (order by 3 * source_size / weight, source nulls last rows unbounded preceding)
), l as (
  select *, (words - (most_to - most))::double / (weights - (weight_to - weight))::double as level from f
), t as (
  select source, source_size,
         case when source_size = 0 then 0.0::double
              else least(most::double, (select arg_min(level, (most / weight, source is null, source)) from l where level * weight <= most) * weight) end as target
  from l
), bulk as (
  select source, ceil(sqrt(size::double))::bigint as x, sum(size)::bigint as words from d where size > 0 group by all
), sums as (
  select *, coalesce(sum(words) over longer, 0) as full_, coalesce(sum(x * words) over longer, 0) as weighed, sum(x * words) over (partition by source) as all_
  from bulk window longer as (partition by source order by x desc rows between unbounded preceding and 1 preceding)
), steps as (
  select sums.source, x, (target - 3 * full_::double) / (all_ - weighed)::double as level from sums join t on sums.source is not distinct from t.source
), lambda_ as (
  select source, arg_max(level, x) as level from steps where level * x <= 3 group by source
), e as (
  select d.*, source_size, target, case when size = 0 then 0.0::double else least(3.0::double, coalesce(level, 'inf'::double) * ceil(sqrt(size::double))) end as expected
  from d join t on d.source is not distinct from t.source left join lambda_ on d.source is not distinct from lambda_.source
), r as (
  select *, floor(expected)::bigint as sure, expected - floor(expected) as p,
         ((('0x' || substr(md5('mix-1:' || coalesce(doc_id::varchar, 'null') || ':' || print), 1, 13))::bigint) + 0.5::double) / 4503599627370496.0::double as u
  from e
), ranked as (
  select source, doc_id, print, size, row_number() over (partition by source order by (u / (1 - u)) / (p / (1 - p)), doc_id nulls last, print) as k
  from r where p > 0
), want as (
  select source, max(target) - sum(sure * size)::double as want from r group by source
), walk as (
  select source, want, 0::bigint as k, 0::bigint as got, false as took from want
  union all
  select w.source, want, w.k + 1, case when w.got + size <= want then w.got + size else w.got end, w.got + size <= want
  from walk w join ranked on ranked.source is not distinct from w.source and ranked.k = w.k + 1
), extra as (
  select ranked.source, doc_id, print from ranked join walk on ranked.source is not distinct from walk.source and ranked.k = walk.k where took
)
select r.doc_id, r.size, source_size, target, (sure + (extra.print is not null)::int)::bigint * r.size as taken, (sure + (extra.print is not null)::int)::bigint as copies
from r left join extra on r.source is not distinct from extra.source and r.doc_id is not distinct from extra.doc_id and r.print = extra.print
"""


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = urls.filter_urls(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "host", "path", "rule", "verdict", "trust", "distrust")


def step_sql(k: int) -> str:
    return f"""
), x{k + 1} as materialized (
  select kind, host, sum(x)::bigint as x from (
    select w.kind, b as host, sum(x // n) * {urls.DAMPING} // 100 as x from x{k} join ways w on w.kind = x{k}.kind and host = a group by w.kind, b
    union all select kind, host, x * {100 - urls.DAMPING} // 100 from x0
  ) group by kind, host"""


QUERIES["op5_url_filter"] = op5_url_filter
ORACLES["op5_url_filter"] = (
    r"""
with p as (
  select page_id, html, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) as path
  from pages
), rules(h, p, v) as (
  values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), ruled as (
  select page_id, any_value(html) as html, any_value(p.host) as host, any_value(p.path) as path, arg_max(h || rules.p, len(h || rules.p)) as rule, arg_max(v, len(h || rules.p)) as ruled
  from p left join rules on (p.host = h or ends_with(p.host, '.' || h)) and starts_with(p.path, rules.p) group by page_id
), hosts as (
  select host, count(*) filter (ruled = 'allow') * 1000000000 // count(*) as trust, count(*) filter (ruled = 'block') * 1000000000 // count(*) as distrust
  from ruled where host <> '' group by host
), up as (
  select array_to_string(l[i:], '.') as src, array_to_string(l[i + 1:], '.') as dst
  from (select l, unnest(range(1, len(l) - 1)) as i from (select string_split(host, '.') as l from hosts where not regexp_matches(host, '^[0-9.]+(:[0-9]*)?$')))
), edges as materialized (
  select distinct src, dst from (
    select host as src, translate(unnest(regexp_extract_all(coalesce(html, ''), '(?i)href\s*=\s*["'']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''\s>]+)', 1)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as dst
    from ruled union all select src, dst from up union all select dst, src from up
  ) where src <> dst and src <> '' and dst <> ''
), moving as (
  select 'trust' as kind, src as a, dst as b, count(*) over (partition by src) as n from edges
  union all select 'distrust', dst, src, count(*) over (partition by dst) from edges
), nodes as (
  select src as host from edges union select dst from edges union select host from hosts
), ends as (
  select kind, host from nodes, (values ('trust'), ('distrust')) as k(kind) where (kind, host) not in (select kind, a from moving)
), ways as materialized (
  select * from moving
  union all select e.kind, e.host, m.a, count(*) over (partition by e.kind, e.host) from ends e join moving m on m.kind = e.kind and m.b = e.host
  union all select kind, host, host, 1 from ends where (kind, host) not in (select kind, b from moving)
), x0 as (
  select 'trust' as kind, host, trust as x from hosts where trust > 0 union all select 'distrust', host, distrust from hosts where distrust > 0"""
    + "".join(map(step_sql, range(urls.STEPS)))
    + f"""
), scores as (
  select host, coalesce(sum(x) filter (kind = 'trust'), 0)::bigint as trust, coalesce(sum(x) filter (kind = 'distrust'), 0)::bigint as distrust from x{urls.STEPS} group by host
)
select page_id, r.host, r.path, r.rule, coalesce(s.trust, 0)::bigint as trust, coalesce(s.distrust, 0)::bigint as distrust,
       coalesce(ruled, case when coalesce(s.distrust, 0) >= {urls.FLOOR} and coalesce(s.distrust, 0) > coalesce(s.trust, 0) then 'block' else 'allow' end) as verdict
from ruled r left join scores s on r.host = s.host
"""
)


def op8_shard_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents")).select("doc_id", "slot", "shard")


QUERIES["op8_shard_lookup"] = op8_shard_lookup
ORACLES["op8_shard_lookup"] = f"""
with d as (
  select doc_id, ('0x' || substr(md5(coalesce(doc_id::varchar, md5(coalesce(text, '')))), 1, 13))::bigint % {sharding.SLOTS} as slot
  from documents
)
select doc_id, slot, printf('shard-%03d', {sharding.fill()}[slot + 1]) as shard from d
"""


def spans_sql(kind: str, at: int, pattern: str, group: int = 0, keep: str = "true") -> str:
    """The spans of one kind over ``d(doc_id, t)``."""
    quoted = pattern.replace("'", "''")
    return f"""
  select doc_id, '{kind}' as kind, {at} as ord_, s as start_, s + len(hit) as end_, found from (
    select doc_id, hits[k] as hit, founds[k] as found,
           (coalesce(list_sum(list_transform(gaps[1:k], lambda x: len(x))), 0) + coalesce(list_sum(list_transform(hits[1:k - 1], lambda x: len(x))), 0))::bigint as s
    from (select *, unnest(range(1, len(hits) + 1)) as k from (
      select doc_id, string_split_regex(t, '{quoted}') as gaps, regexp_extract_all(t, '{quoted}') as hits, regexp_extract_all(t, '{quoted}', {group}) as founds
      from d where regexp_matches(t, '{quoted}')))
  ) where {keep}"""


def spans_result(base: int) -> str:
    """Digest columns from ``found(doc_id, kind, at, start_, end_)``; the first ``base`` kinds are base spans."""
    text = "kind || ':' || start_ || ':' || end_"
    return f"""
  coalesce(sha256(string_agg({text}, ',' order by start_, ord_) filter (ord_ < {base})), sha256('')) as base_sha256,
  coalesce(string_agg({text}, ',' order by start_, ord_), '') as spans"""


def digest_columns(rows: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    def count(kind: str):
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in kinds]
    base = F.sha2(F.encode(joined(F.col("base_spans")), "UTF-8"), 256).alias("base_sha256")
    return rows.select("doc_id", *counts, base, joined(F.col("spans")).alias("spans"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    return digest_columns(rows, tuple(r.kind for r in secrets.RULES if r.base))


QUERIES["op9_secret_scan"] = op9_secret_scan
ORACLES["op9_secret_scan"] = (
    "with d as (select doc_id, coalesce(text, '') as t from documents), found as ("
    + " union all ".join(spans_sql(r.kind, at, r.pattern, r.group, f"len(found) >= {r.least}") for at, r in enumerate(secrets.RULES))
    + """)
select d.doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,"""
    + spans_result(3)
    + " from d left join found on d.doc_id = found.doc_id group by d.doc_id"
)


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.find_personal(table(spark, sf_dir, "documents"))
    return digest_columns(rows, tuple(kind for kind, _, _ in pii.BASE))


LUHN = """len(regexp_replace(found, '[^0-9]', '', 'g')) between 12 and 19 and list_sum(list_transform(
  list_reverse(string_split(regexp_replace(found, '[^0-9]', '', 'g'), '')),
  lambda c, i: case when i % 2 = 1 then c::int when c::int >= 5 then c::int * 2 - 9 else c::int * 2 end)) % 10 = 0"""

QUERIES["op10_personal_data"] = op10_personal_data
ORACLES["op10_personal_data"] = (
    "with d as (select doc_id, coalesce(text, '') as t from documents), base as ("
    + spans_sql("email", 0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
    + " union all "
    + spans_sql("ip", 1, r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", keep="list_bool_and(list_transform(string_split(found, '.'), lambda x: x::hugeint <= 255))")
    + " union all "
    + spans_sql("card", 2, r"[0-9](?:[\x20-]?[0-9])+", keep=LUHN)
    + " union all "
    + spans_sql("phone", 3, r"\+[0-9][\x20().0-9-]+[0-9]", keep="len(regexp_replace(found, '[^0-9]', '', 'g')) between 9 and 15")
    + rf"""), ranked as (
  select base.doc_id, kind, ord_, start_, end_, lower(found) as found, md5(t) as text_id, max(end_) over (partition by base.doc_id order by start_, end_ rows between unbounded preceding and 1 preceding) as before,
         case kind when 'email' then split_part(lower(found), '@', 2) when 'ip' then regexp_extract(found, '^[0-9]+\.[0-9]+') when 'card' then regexp_replace(found, '[^0-9]', '', 'g')[:6] else regexp_replace(found, '[^0-9]', '', 'g')[:-8] end as wider
  from base join d on base.doc_id = d.doc_id
), kept as (
  select distinct doc_id, text_id, unnest([kind || ':' || found, kind || '~' || wider]) as entity from ranked
), part as (
  select r.doc_id, substr(t, coalesce(before, 0) + 1, greatest(start_ - coalesce(before, 0), 0)) as part from ranked r join d on r.doc_id = d.doc_id
  union all select d.doc_id, substr(t, last_ + 1) from d join (select doc_id, max(end_) as last_ from base group by 1) e on d.doc_id = e.doc_id
), owned as (
  select distinct doc_id, unnest(regexp_extract_all(lower(part), '\p{{L}}{{4,}}')) as term, []::varchar[] as owners from part
  union all select distinct doc_id, unnest(regexp_extract_all(found, '\p{{L}}{{4,}}')), [kind || ':' || found, kind || '~' || wider] from ranked
), entities as (
  select entity, count(distinct doc_id) as ne from kept group by 1 having count(distinct text_id) >= {pii.SUPPORT}
), pairs as (
  select kept.entity, term, count(distinct kept.doc_id) as co from kept join entities on kept.entity = entities.entity join owned on kept.doc_id = owned.doc_id and not list_contains(owners, kept.entity)
  group by 1, 2 having count(distinct text_id) >= {pii.SUPPORT}
), within as (
  select distinct doc_id, unnest(regexp_extract_all(lower(t), '\p{{L}}{{4,}}')) as term from d
), terms as (
  select term, count(*) as nt from within group by term
), told as (
  select distinct pairs.term from pairs join entities using (entity) join terms using (term), (select count(*) as n from d)
  where log2(n::double / ne) > 0 and log2(co::double * n / (nt::double * ne)) >= {pii.DISCLOSURE}::double * log2(n::double / ne)
), telling as (
  select doc_id, t from d where doc_id in (select doc_id from within join told using (term))
), named as (
  with d as (select * from telling) {spans_sql("term", 4, pii.TERM.rstrip("+"), keep="lower(found) in (select term from told)")}
), found as (
  select doc_id, kind, ord_, start_, end_ from base
  union all select doc_id, kind, ord_, start_, end_ from named n where not exists (select 1 from base b where b.doc_id = n.doc_id and b.start_ <= n.start_ and n.end_ <= b.end_)
)
select d.doc_id, count(*) filter (kind = 'email') as n_email, count(*) filter (kind = 'ip') as n_ip, count(*) filter (kind = 'card') as n_card, count(*) filter (kind = 'phone') as n_phone,"""
    + spans_result(4)
    + " from d left join found on d.doc_id = found.doc_id group by d.doc_id"
)


def word_bpe() -> str:
    """The vocabulary file's path on this installation."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), word_bpe())
    decoded = F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256")
    return rows.select("doc_id", bpe.n_tokens(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), decoded)


QUERIES["op7_bpe"] = op7_bpe


def op6_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_components(table(spark, sf_dir, "documents"))


QUERIES["op6_jaccard_components"] = op6_jaccard_components
ORACLES["op6_jaccard_components"] = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents
), s as (
  select distinct doc_id, unnest(case when len(w) = 0 then []::varchar[] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as g
  from d
), n as (
  select d.doc_id, count(g) as n from d left join s on d.doc_id = s.doc_id group by d.doc_id
), pairs as (
  select a.doc_id as a, b.doc_id as b, count(*) as m from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2
), links as (
  select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * m >= 80 * (x.n + y.n - m)
), reach as (
  select doc_id as a, doc_id as b from d union select reach.a, links.b from reach join links on reach.b = links.a
)
select doc_id, n as n_shingles, (select min(b) from reach where reach.a = n.doc_id) as component_id from n
"""


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = linedup.dedup_lines(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_removed", "removed", "text")


QUERIES["op3_line_dedup"] = op3_line_dedup


def op4_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.nearest(rows, rows.where("vec_id % 100 = 0"))


QUERIES["op4_hash_prefix_forest"] = op4_hash_prefix_forest


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iceberg.divergence(table(spark, sf_dir, "documents"))


QUERIES["op12_source_divergence"] = op12_source_divergence
ORACLES["op12_source_divergence"] = rf"""
with d as (
  select row_number() over () as row_, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents
), term as (
  select row_, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d
), kept as materialized (
  select lang, term from term group by all having count(distinct row_) >= {iceberg.LEAST}
), counts as (
  select lang, source, term, count(*) as n from term semi join kept using (lang, term) group by all
), whole as (
  select lang, source, term, coalesce(n, 0) as n from (select distinct lang, source from d) g join kept using (lang) left join counts using (lang, source, term)
), shares as materialized (
  select *, (1 + {iceberg.UNITS}::hugeint * (n + 1) // (sum(n) over (partition by lang, source) + count(*) over (partition by lang, source)))::hugeint as p from whole
), totals as (
  select lang, term, (1 + {iceberg.UNITS}::hugeint * (sum(n) + 1) // (sum(sum(n)) over (partition by lang) + count(*) over (partition by lang)))::hugeint as q from shares group by lang, term
), pair as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value
  from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
), groups as (
  select distinct lang, source from d
), found as (
  select g.lang, g.source, 'pair' as part, h.source as item, coalesce(value, 0)::bigint as value
  from groups g join groups h on g.lang = h.lang and g.source <> h.source left join pair on pair.lang = g.lang and pair.source = g.source and pair.item = h.source
  union all
  select lang, source, 'term', term, ((p - q) * (p - q) // q)::bigint from shares join totals using (lang, term) where n > 0 and p > q
)
select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from found
qualify part = 'pair' or rank <= {iceberg.TOP}
"""


def op13_super_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = superkmers.dedup_windows(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256")
    return rows.select("doc_id", "n_words", "n_removed", kept)


QUERIES["op13_super_kmers"] = op13_super_kmers
ORACLES["op13_super_kmers"] = f"""
with d as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents
), window_ as (
  select doc_id, i, array_to_string(w[i:i + {superkmers.WINDOW - 1}], ' ') as g
  from (select doc_id, w, unnest(range(1, greatest(len(w) - {superkmers.WINDOW - 2}, 1)::bigint)) as i from d)
), first_ as (
  select g, min(doc_id) as least from window_ group by g
), gone as (
  select distinct doc_id, i + k as i from window_ join first_ using (g), (select unnest(range({superkmers.WINDOW})) as k) where least < doc_id
), word as (
  select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as i from d
), kept as (
  select doc_id, string_agg(x, ' ' order by i) as t, count(*) as n from word anti join gone using (doc_id, i) group by doc_id
)
select d.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from d left join kept on d.doc_id = kept.doc_id
"""


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES["op11_whitening"] = op11_whitening
