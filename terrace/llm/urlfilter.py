"""URL filters: path rules, and trust and distrust propagated over the graph of hosts.

Hosts link to the hosts that their pages' absolute links name, and to their parent domain,
step by step up to two labels. Two personalised PageRanks run together over these edges in
Spark. Trust starts at hosts by the share of their pages that rules allow and follows the
edges; distrust starts at hosts by the share of their pages that rules block, or in full at
hosts that a table of blocked hosts lists, and follows the edges backwards, to those who
link there and to their subdomains. Ranks are whole numbers of a unit, one seed's own, so
they depend neither on the order of sums nor on the number of seeds. A host is blocked,
wherever no rule says otherwise, if its distrust is more than half a whole seed's and more
than its trust: a host with few blocked pages among others, and no bad neighbours, is not.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucketed, drop_bucketed, drop_written, table, written

#: First `://`, then host and path.
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?i)(?:href|src)[\x20\x09-\x0D]*=[\x20\x09-\x0D]*["']?(?:https?:)?//([^/?#"'\x20\x09-\x0D>:]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Restart probability, rounds, distrust in whole seeds beyond which a host may be blocked, and the ratio to its trust beyond which it is.
RESTART, ROUNDS, THRESHOLD, RATIO = 0.15, 15, 0.5, 1.0
#: Rank that a whole seed gives itself each round.
UNIT = 10**12


@dataclass(frozen=True)
class PathRule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (PathRule("block", "com", "/en/"), PathRule("allow", "example.com", "/en/7"), PathRule("allow", "net", "/de/"), PathRule("block", "example.net", "/de/8"), PathRule("block", "org", "/es/"))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def _fits(rule: PathRule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def rule_for(host: Column, path: Column, rules: tuple[PathRule, ...]) -> Column:
    """struct<rule, verdict> of the longest rule that fits; null where none does."""
    out = F.when(F.lit(False), F.lit(None).cast("struct<rule:string,verdict:string>"))
    for rule in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        out = out.when(_fits(rule, host, path), F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict")))
    return out


def judged(pages: DataFrame, rules: tuple[PathRule, ...]) -> DataFrame:
    """page_id, url's host and path, and the rule that fits."""
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return parts.withColumn("r", rule_for(F.col("host"), F.col("path"), rules))


def parent_steps(host: Column) -> Column:
    """array<struct<src, dst>>: each step from the host up its parent domains, down to two labels; null where there is none."""
    labels, n = F.split(host, r"\."), F.size(F.split(host, r"\."))
    above = lambda i: F.array_join(F.slice(labels, i + 1, n), ".")
    steps = F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: F.struct(above(i).alias("src"), above(i + 1).alias("dst")))
    return F.when(n >= 3, steps)


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, weight: links between different hosts, counted by page and target, and one edge for each step up the whole chain of parent domains."""
    linked = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1)))).alias("dst"))
    links = linked.select("src", F.translate("dst", UPPER, LOWER).alias("dst")).groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    hosts = pages.select(host_of(F.col("url")).alias("host")).distinct().unionAll(links.select("dst")).distinct()
    up = hosts.select(F.explode(parent_steps(F.col("host"))).alias("s")).select("s.src", "s.dst").distinct().withColumn("weight", F.lit(1.0))
    return links.unionAll(up).where((F.col("src") != F.col("dst")) & (F.col("src") != "") & (F.col("dst") != "")).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def seeds(judged_pages: DataFrame, edges: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """kind (trust or distrust), host, mass in UNITs: the share of the host's pages that rules allow or block. Hosts in the table `blocked` (host) are distrusted in full and never trusted."""
    share = lambda verdict: F.floor(F.avg(F.coalesce(F.col("r.verdict") == verdict, F.lit(False)).cast("double")) * UNIT)
    shares = judged_pages.where("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    if blocked is not None:
        hosts = judged_pages.select("host").unionAll(edges.select("src")).unionAll(edges.select("dst")).where("host <> ''").distinct()
        listed = hosts.join(blocked.select(F.translate("host", UPPER, LOWER).alias("host")), "host", "left_semi").withColumn("listed", F.lit(True))
        shares = shares.join(listed, "host", "full").select("host", F.when(F.col("listed"), 0).otherwise(F.col("trust")).alias("trust"), F.when(F.col("listed"), UNIT).otherwise(F.col("distrust")).alias("distrust"))
    masses = F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(kind).cast("bigint").alias("mass")) for kind in ("trust", "distrust")))
    return shares.select("host", F.explode(masses).alias("m")).select("m.kind", "host", "m.mass").where("mass > 0")


def propagate(edges: DataFrame, start: DataFrame, rounds: int = ROUNDS, restart: float = RESTART) -> DataFrame:
    """kind, host, rank after a fixed number of rounds; each round a host keeps its own mass and sends on (1 - restart) of its rank by weight, rounded down.

    A seed alone has its mass as its rank. What reaches a host without further edges ends there.
    """
    spark = edges.sparkSession
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "weight").unionAll(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    out = both.groupBy("kind", "src").agg(F.sum("weight").alias("out"))
    moves, name = bucketed(both.join(out, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.col("weight") / F.col("out") * (1 - restart)).alias("share")), "moves", "kind", "host")
    start = written(start.select("kind", "host", F.col("mass").alias("rank")), "start")
    now = start
    for _ in range(rounds):
        sent = now.join(moves, ["kind", "host"]).select("kind", F.col("dst").alias("host"), F.floor(F.col("rank") * F.col("share")).alias("rank"))
        after = written(sent.unionAll(start).groupBy("kind", "host").agg(F.sum("rank").alias("rank")), "rank")
        if now is not start:
            drop_written(now)
        now = after
    drop_bucketed(spark, name)
    return now


def host_scores(pages: DataFrame, rules: tuple[PathRule, ...] = RULES, blocked: DataFrame | None = None) -> DataFrame:
    """host, trust, distrust (1 is what a whole seed alone has) and verdict."""
    edges = written(host_edges(pages), "edges")
    ranks = propagate(edges, seeds(judged(pages, rules), edges, blocked))
    sums = ranks.groupBy("host").agg(*(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("rank"))), F.lit(0)).alias(k) for k in ("trust", "distrust")))
    bad = (F.col("distrust") > THRESHOLD * UNIT) & (F.col("distrust") > RATIO * F.col("trust"))
    return sums.select("host", (F.col("trust") / UNIT).alias("trust"), (F.col("distrust") / UNIT).alias("distrust"), F.when(bad, "block").otherwise("allow").alias("host_verdict"))


def url_verdicts(pages: DataFrame, rules: tuple[PathRule, ...] = RULES, blocked: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every row.

    A null url, or one without `://`, has an empty host and path, fits no rule and is allowed,
    as are hosts that nothing reaches. Null html has no links. Repeated rows each get a row
    and count as so many pages; an empty table gives none. Further columns are not read.
    """
    found = judged(pages, rules).join(host_scores(pages, rules, blocked), "host", "left")
    verdict = F.coalesce("r.verdict", "host_verdict", F.lit("allow"))
    return found.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def op5_link_graph(spark, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"))


def _sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    lower = lambda x: f"translate({x}, '{UPPER}', '{LOWER}')"
    ordered = sorted(RULES, key=lambda r: (-len(r.text), r.text))
    case = lambda value: "CASE " + " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{value(r)}'" for r in ordered) + " END"
    turn = lambda k: f"""r{k + 1} AS (SELECT kind, host, sum(rank)::BIGINT AS rank FROM (SELECT kind, dst AS host, floor(rank * share)::BIGINT AS rank FROM r{k} JOIN moves USING (kind, host)
  UNION ALL SELECT * FROM r0) GROUP BY kind, host)"""  # noqa: E731
    return f"""
WITH parts AS (SELECT page_id, coalesce(html, '') AS html, {lower(f"coalesce(regexp_extract(url, {quoted(URL)}, 1), '')")} AS host, coalesce(regexp_extract(url, {quoted(URL)}, 2), '') AS path FROM pages),
j AS MATERIALIZED (SELECT *, {case(lambda r: r.text)} AS rule, {case(lambda r: r.verdict)} AS said FROM parts),
links AS (SELECT host AS src, {lower("dst")} AS dst, count(*)::DOUBLE AS weight FROM (SELECT host, unnest(list_distinct(regexp_extract_all(html, {quoted(LINK)}, 1))) AS dst FROM j) GROUP BY ALL),
hosts AS (SELECT DISTINCT string_split(host, '.') AS l FROM (SELECT host FROM j UNION ALL SELECT dst FROM links)),
up AS (SELECT DISTINCT array_to_string(l[i + 1:], '.') AS src, array_to_string(l[i + 2:], '.') AS dst, 1.0::DOUBLE AS weight FROM (SELECT l, unnest(range(0, len(l) - 2)) AS i FROM hosts)),
edges AS MATERIALIZED (SELECT src, dst, sum(weight) AS weight FROM (SELECT * FROM links UNION ALL SELECT * FROM up) WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY src, dst),
both_ways AS (SELECT 'trust' AS kind, src AS host, dst, weight FROM edges UNION ALL SELECT 'distrust', dst, src, weight FROM edges),
moves AS MATERIALIZED (SELECT kind, host, dst, weight / sum(weight) OVER (PARTITION BY kind, host) * {1 - RESTART!r} AS share FROM both_ways),
shares AS (SELECT host, floor(avg((coalesce(said, '') = 'allow')::INT) * {UNIT})::BIGINT AS trust, floor(avg((coalesce(said, '') = 'block')::INT) * {UNIT})::BIGINT AS distrust FROM j WHERE host <> '' GROUP BY host),
r0 AS MATERIALIZED (SELECT * FROM (SELECT 'trust' AS kind, host, trust AS rank FROM shares UNION ALL SELECT 'distrust', host, distrust FROM shares) WHERE rank > 0),
{", ".join(turn(k) for k in range(ROUNDS))},
s AS (SELECT host, coalesce(sum(rank) FILTER (kind = 'trust'), 0)::BIGINT AS trust, coalesce(sum(rank) FILTER (kind = 'distrust'), 0)::BIGINT AS distrust FROM r{ROUNDS} GROUP BY host)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN distrust > {THRESHOLD * UNIT!r} AND distrust > {RATIO!r} * trust THEN 'block' END, 'allow') AS verdict,
  coalesce(trust, 0)::DOUBLE / {UNIT} AS trust, coalesce(distrust, 0)::DOUBLE / {UNIT} AS distrust
FROM j LEFT JOIN s USING (host)
"""


OP5_SQL = _sql()
