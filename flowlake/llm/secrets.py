"""Secret scans through a trigram inverted index (native).

For each rule a Boolean query over lower-case trigrams is derived from its regex: every literal
piece that a match must hold gives its trigrams (AND), alternatives give alternatives (OR). The
index has a posting (trigram, document) for each trigram that some rule mentions and that a text
holds. A rule's candidates are the documents that have all trigrams of one of its alternatives;
only these are verified by the regex. Rules without a mandatory trigram scan every text.

Postings are rows, never lists, so that a frequent trigram stays spread; they are intersected by
counting, for each document and alternative, how many of its trigrams the document has. Documents
are known by the print of their text, so copies are indexed once. The queries only skip texts in
which the rule cannot match.

Null texts count as empty. Repeated rows get the same spans. Other columns pass through; columns
named as a result are replaced. ``masked_text`` replaces what was found.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlake.llm.common import fingerprint, let
from flowlake.llm.spans import SPAN, masked, spans


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    least: int = 0  # code points of the group
    base: bool = False


RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", base=True),  # runs of 20 and more, taken whole
    Rule("hex", r"[0-9a-f]{24,}", base=True),  # runs of 24 and more, taken whole
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("webtoken", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge", r"(?:ghp|gho|ghs|ghr)_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
MOST = 64  # alternatives; a regex with more counts as having no mandatory trigram


def literals(pattern: str) -> list[list[str]]:
    """The alternatives of a regex, each the literal pieces that a match must hold, lower case."""

    def walk(items) -> list[list[str]]:
        ways = [[""]]  # each way: pieces; the last one may still grow
        for op, arg in items:
            if op is C.LITERAL:
                step = [[chr(arg).lower()]]
            elif op is C.SUBPATTERN:
                step = walk(arg[-1])
            elif op is C.BRANCH:
                step = [w for branch in arg[1] for w in walk(branch)]
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and arg[0] == 0 and arg[1] == 1:
                step = [[""]] + walk(arg[2])
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and arg[0] >= 1:
                step = [[*w, ""] for w in walk(arg[2])]
            elif op in (C.AT, C.ASSERT, C.ASSERT_NOT):
                continue
            else:
                step = [["", ""]]
            ways = [[*a[:-1], a[-1] + b[0], *b[1:]] for a, b in itertools.product(ways, step)]
            if len(ways) > MOST:
                return [["", ""]]
        return ways

    return walk(_parser.parse(pattern))


def trigram_query(pattern: str) -> list[list[str]]:
    """Alternatives of trigrams that a match must hold all of; empty when some match needs none."""
    found = []
    for way in literals(pattern):
        grams = sorted({p[i : i + 3] for p in way for i in range(len(p) - 2) if p[i : i + 3].isascii()})
        if not grams:
            return []
        found.append(grams)
    return [list(x) for x in sorted(set(map(tuple, found)))]


def folded(text: Column) -> Column:
    """ASCII letters in lower case, for the index; other letters don't matter to it."""
    return F.lower(text)


def postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """trigram, print: one row for each of ``grams`` that a distinct text holds."""
    low = folded(F.col("text"))
    held = let(low, lambda t: F.array_compact(F.array(*[F.when(t.contains(g), F.lit(g)) for g in grams])))
    return docs.select("print", F.explode(held).alias("trigram")).distinct()


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """print, kinds: the rules whose trigram query a text satisfies. ``docs``: print, text."""
    wanted = [(r.kind, k, len(grams), g) for r in rules for k, grams in enumerate(trigram_query(r.pattern)) for g in grams]
    grams = sorted({w[3] for w in wanted})
    query = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(k).alias("way"), F.lit(n).alias("needs"), F.lit(g).alias("gram")) for kind, k, n, g in wanted])
    index = postings(docs, grams)
    asked = index.select("print", F.explode(F.filter(query, lambda q: q["gram"] == F.col("trigram"))).alias("q")).select("print", "q.*")
    full = asked.groupBy("print", "kind", "way", "needs").agg(F.count(F.lit(1)).alias("has")).where("has = needs")
    return full.groupBy("print").agg(F.collect_set("kind").alias("kinds"))


def scan_secrets(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row with ``spans`` and ``base_spans``: arrays of (start, end, at, kind)."""
    rows = docs.drop("spans", "base_spans").withColumn("__print", fingerprint(F.col(text)))
    indexed = tuple(r for r in rules if trigram_query(r.pattern))
    if indexed:
        found = candidates(rows.select(F.col("__print").alias("print"), F.coalesce(F.col(text), F.lit("")).alias("text")), indexed)
        rows = rows.join(found.select(F.col("print").alias("__p"), F.col("kinds").alias("__kinds")), F.col("__print") == F.col("__p"), "left")
    body = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast(SPAN)
    by_rule = []
    for at, r in enumerate(rules):
        keep = (lambda g, n=r.least: F.length(g) >= n) if r.least else None
        one = spans(body, r.kind, at, r.pattern, r.group, keep)
        by_rule.append((r, F.when(F.array_contains("__kinds", r.kind), one).otherwise(none) if r in indexed else one))
    rows = rows.withColumn("base_spans", F.concat(none, *[c for r, c in by_rule if r.base]))
    rows = rows.withColumn("spans", F.concat(F.col("base_spans"), *[c for r, c in by_rule if not r.base]))
    return rows.drop("__print", "__p", "__kinds")


def masked_text(text: Column, found: Column) -> Column:
    """The text with its secrets replaced by their kind."""
    return masked(text, found, lambda s: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
