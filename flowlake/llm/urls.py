"""URL filters: rules first, then trust and distrust propagated over the host link graph (native).

A rule is a host and a path prefix; it fits the host and its subdomains when the url's path starts
with the prefix, and the longest fitting rule decides. Urls without a rule take their host's
verdict. Host edges are the absolute and protocol-relative links in the pages' html, and both ways
between each domain and the one above it, up to the one of two labels, with or without pages of their
own (numeric addresses have no such domains); so hosts of one registered domain vouch for each other.
Trust is personalised PageRank along the edges from hosts that have allowed pages; distrust is the
same against the edges from hosts that have blocked pages. A host seeds with the share of its pages
that a rule decides. A host that no edge leaves gives its score back along the edges that enter it, and
one without any edge keeps it, so that none is lost. A host is blocked when its distrust reaches ``FLOOR`` and exceeds its trust; hosts that nothing reaches are
allowed.

Scores are whole numbers (a unit is ``SCALE``), so that sums don't depend on the order in which
partitions arrive and a recomputed partition is the same. ``STEPS`` iterations, after which at most
``DAMPING`` to their power of a seed is still to move (4 %), are joins and partial sums over distinct
host pairs. Scores are broadcast when counted below ``BROADCAST_ROWS``; else they are joined from a
checkpoint, so that the adaptive skew join can split a hub's edges or a hot host's pages. Edges,
seeds and, every ``CUT`` steps, the scores are checkpointed.

Null urls, and urls without ``://``, have an empty host and path, match no rule and are allowed.
Null html has no links. Repeated rows count twice in a host's shares and keep their own rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlake.llm.common import cut

RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
SCALE = 1_000_000_000
DAMPING = 85  # percent
STEPS = 20
CUT = 5
FLOOR = SCALE // 10
BROADCAST_ROWS = 50_000
PACKED = 8  # partitions of so few rows
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"://([^/?#]*)([^?#]*)"
LINK = r"""(?i)href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""

NUMERIC = r"^[0-9.]+(?::[0-9]*)?$"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule's text and verdict, null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame, hosts: DataFrame, html: str = "html") -> DataFrame:
    """Distinct host pairs: src, dst. ``pages`` has ``__host``; ``hosts`` has ``host``."""
    links = F.transform(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(LINK), F.lit(1)), lambda x: F.translate(x, UPPER, LOWER))
    linked = pages.select(F.col("__host").alias("src"), F.explode(F.array_distinct(links)).alias("dst"))
    labels = F.split("host", r"\.")
    name = lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    up = F.transform(F.sequence(F.lit(1), F.size(labels) - 2), lambda i: F.struct(name(i).alias("src"), name(i + 1).alias("dst")))
    chain = hosts.where((F.size(labels) > 2) & ~F.col("host").rlike(NUMERIC)).select(F.inline(up))
    return linked.union(chain).union(chain.select("dst", "src")).where("src <> dst and src <> '' and dst <> ''").distinct()


def sized(frame: DataFrame) -> DataFrame:
    """The rows, marked for broadcast when they are counted to be few; they must be cut before."""
    return F.broadcast(frame) if frame.count() <= BROADCAST_ROWS else frame


def propagate(seeds: DataFrame, edges: DataFrame, steps: int = STEPS) -> DataFrame:
    """host, trust, distrust, from seeds (host, trust, distrust) and edges (src, dst)."""
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    into = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("n"))
    along = edges.join(out, "src").select(F.lit("trust").alias("way"), F.col("src").alias("a"), F.col("dst").alias("b"), "n")
    against = edges.join(into, "dst").select(F.lit("distrust").alias("way"), F.col("dst").alias("a"), F.col("src").alias("b"), "n")
    nodes = edges.select(F.col("src").alias("host")).union(edges.select("dst")).union(seeds.select("host")).distinct()
    ends = nodes.join(F.broadcast(nodes.sparkSession.range(2).select(F.when(F.col("id") == 0, "trust").otherwise("distrust").alias("way"))))
    moving = along.union(against)
    at = lambda a, b: (F.col("way") == F.col("w")) & (F.col(a) == F.col(b))
    left = ends.join(moving.select(F.col("way").alias("w"), F.col("a").alias("h")).distinct(), at("host", "h"), "left_anti")
    entered = moving.groupBy(F.col("way").alias("w"), F.col("b").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    left = cut(left.join(entered, at("host", "h"), "left").select("way", "host", "n"))
    source = moving.select(F.col("way").alias("w"), F.col("a").alias("from"), F.col("b").alias("h"))
    back = left.join(source, at("host", "h")).select("way", F.col("host").alias("a"), F.col("from").alias("b"), "n")
    alone = left.where("n is null").select("way", "host", F.col("host").alias("b"), F.lit(1).cast("long").alias("n"))
    ways = cut(moving.union(back).union(alone))
    base = seeds.select("host", F.explode(F.create_map(F.lit("trust"), F.col("trust"), F.lit("distrust"), F.col("distrust"))).alias("kind", "x"))
    base = cut(base.where("x > 0"))
    few = nodes.count() <= BROADCAST_ROWS
    packed = lambda rows: rows.coalesce(PACKED) if few else rows
    none = F.lit(0).cast("long")
    restart = packed(base).select("kind", F.col("host"), none.alias("m"), F.expr(f"x * {100 - DAMPING} div 100").alias("r"))
    ways, state = packed(ways), base
    for step in range(steps):
        moved = ways.join(F.broadcast(state) if few else state, (F.col("kind") == F.col("way")) & (F.col("host") == F.col("a")))
        moved = moved.select("kind", F.col("b").alias("host"), F.expr("x div n").alias("m"), none.alias("r"))
        state = moved.union(restart).groupBy("kind", "host").agg((F.expr(f"sum(m) * {DAMPING} div 100") + F.sum("r")).alias("x"))
        if step % CUT == CUT - 1:
            state = cut(state)
    scored = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("x")).otherwise(0))
    return state.groupBy("host").agg(scored("trust").alias("trust"), scored("distrust").alias("distrust"))


def filter_urls(pages: DataFrame, url: str = "url", html: str = "html", rules: tuple[tuple[str, str, str], ...] = RULES, steps: int = STEPS) -> DataFrame:
    """Every row with ``host``, ``path``, ``rule``, ``trust``, ``distrust`` and ``verdict``."""
    result = ["host", "path", "rule", "trust", "distrust", "verdict"]
    rows = pages.drop(*[c for c in result if c not in (url, html)])
    rows = rows.withColumns({"__host": host_of(F.col(url)), "__path": path_of(F.col(url))})
    rule, verdict = rule_of(F.col("__host"), F.col("__path"), rules)
    rows = rows.withColumns({"__rule": rule, "__ruled": verdict})
    share = lambda v: F.expr(f"count_if(__ruled = '{v}') * {SCALE} div count(1)")
    hosts = cut(rows.where("__host <> ''").groupBy(F.col("__host").alias("host")).agg(share("allow").alias("trust"), share("block").alias("distrust")))
    edges = cut(host_edges(rows, hosts, html))
    scores = cut(propagate(hosts, edges, steps).withColumnsRenamed({"host": "__h", "trust": "__t", "distrust": "__d"}))
    rows = rows.join(sized(scores), F.col("__host") == F.col("__h"), "left")
    zero = F.lit(0).cast("long")
    trust, distrust = F.coalesce("__t", zero), F.coalesce("__d", zero)
    blocked = (distrust >= FLOOR) & (distrust > trust)
    told = F.coalesce("__ruled", F.when(blocked, "block").otherwise("allow"))
    new = {"host": F.col("__host"), "path": F.col("__path"), "rule": F.col("__rule"), "trust": trust, "distrust": distrust, "verdict": told}
    return rows.withColumns(new).drop("__host", "__path", "__rule", "__ruled", "__h", "__t", "__d")
