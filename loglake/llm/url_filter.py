"""URL filters: allow and block rules, and trust propagated over the links between hosts. DataFrame functions only.

Rules decide the urls they fit. For the rest the host decides. Hosts are linked by the absolute links in their pages
(a link to the own host does not count), each host passing its score on in proportion to its pages' links. Trust is
personalised PageRank along links from hosts with pages that allow rules fit; distrust is the same against the direction
of links, from hosts with pages that block rules fit: who links to a blocked host is suspect. Either starts from one unit
in all, dealt by pages, and what reaches a host without links onward goes back to the start, which only scales the scores:
they are divided by their sum. A host whose distrust exceeds its trust is blocked, any other allowed.

What is still on its way is passed on round by round and added up, until TOLERANCE of the unit is left: it falls by the
damping each round, so there are at most rounds() of them, and none is saved by a switch. Differences within TOLERANCE
count as ties.

Scores are aggregated before each shuffle. Edges are distinct pairs of hosts, so a host with a third of all pages is one
row. Joins whose rows may crowd on one host (its pages, its links) take the hosts with more than a share of the rows apart
(common.crowded): they are joined by broadcast, or their links dealt to several salts.

Defined cases: a null url or one without `://` has empty host and path, fits no rule and is blocked, as nothing vouches
for it; a null html has no links, a very long one is read whole; repeated rows each count; a host without seeds or links
has neither score and is allowed; ties are allowed; an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake.llm import common
from loglake.llm.common import crowded, joined, materialise, settled, table

# The rules, as (host and path, verdict).
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"://([^/?#]*)([^?#]*)"
LINK = r"""[hH][rR][eE][fF]\s*=\s*["']?(?:[hH][tT][tT][pP][sS]?:)?//([^/?#"'\s>]+)"""
DAMPING = 0.85
TOLERANCE = 1e-6


def rounds(damping: float = DAMPING, tolerance: float = TOLERANCE) -> int:
    """After so many rounds at most `tolerance` of a unit is on its way."""
    return math.ceil(math.log(tolerance) / math.log(damping))


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_of(rules=RULES) -> Column:
    """The longest rule that fits columns host and path; null where none does."""
    out = None
    for rule, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        h, p = rule.split("/", 1)
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith("/" + p)
        out = F.when(fits, rule) if out is None else out.when(fits, rule)
    return out if out is not None else F.lit(None).cast("string")


def said(rules=RULES) -> Column:
    """The verdict of column rule; null without one."""
    out = F.lit(None).cast("string")
    for rule, verdict in rules:
        out = F.when(F.col("rule") == rule, verdict).otherwise(out)
    return out


def edges(pages: DataFrame) -> DataFrame:
    """(source, target, share): distinct links between hosts, shares of a source adding up to 1. Columns host and html."""
    links = pages.where(F.col("html").contains("//") & (F.col("host") != ""))
    links = links.select(F.col("host").alias("source"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("target"))
    links = links.withColumn("target", F.translate("target", UPPER, LOWER)).where("source <> target")
    counted = materialise(links.groupBy("source", "target").agg(F.count("*").alias("n")), "links")
    total = counted.groupBy("source").agg(F.sum("n").alias("total"))
    return joined(counted, total, "source").select("source", "target", (F.col("n") / F.col("total")).alias("share"))


def seeds(judged: DataFrame) -> DataFrame:
    """(kind, host, start): trust and distrust that pages give their hosts. Columns host and said."""
    kinds = judged.where("said is not null").select(F.when(F.col("said") == "allow", "trust").otherwise("distrust").alias("kind"), "host")
    counted = kinds.groupBy("kind", "host").agg(F.count("*").alias("n"))
    total = counted.groupBy("kind").agg(F.sum("n").alias("total"))
    return counted.join(F.broadcast(total), "kind").select("kind", "host", (F.col("n") / F.col("total")).alias("start"))  # two rows


def flows(links: DataFrame) -> DataFrame:
    """(kind, host, salt, next, next_salts, share): where a host's trust and distrust go. A crowded host's rows are dealt to
    salts; next_salts says how many the next host has."""
    links = materialise(links, "edges")
    incoming = links.groupBy("target").agg(F.sum("share").alias("total"))
    back = joined(links, incoming, "target").select(F.lit("distrust").alias("kind"), F.col("target").alias("host"), F.col("source").alias("next"), (F.col("share") / F.col("total")).alias("share"))
    both = materialise(links.select(F.lit("trust").alias("kind"), F.col("source").alias("host"), F.col("target").alias("next"), "share").union(back), "both")
    return dealt(dealt(both, "next", "next_salts").withColumn("next_salts", F.coalesce("next_salts", F.lit(1))), "host", "salts", both).select(
        "kind", "host", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("next"), F.col("salts"))).cast("int").alias("salt"), "next", "next_salts", "share"
    )


def dealt(rows: DataFrame, host: str, name: str, links: DataFrame | None = None) -> DataFrame:
    """rows with the number of salts that the kind's host in column `host` has by its links, null for one."""
    hot = crowded(links or rows, "kind", "host").select(F.col("kind").alias("_kind"), F.col("host").alias("_host"), F.ceil(F.col("n") / common.LEAST_CROWD).cast("int").alias(name))
    return rows.join(F.broadcast(hot), (F.col("kind") == F.col("_kind")) & (F.col(host) == F.col("_host")), "left").drop("_kind", "_host")


def propagate(start: DataFrame, links: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(kind, host, score) of (kind, host, start) along (source, target, share); scores of a kind add up to 1."""
    spark = start.sparkSession
    start = materialise(start, "seeds")
    on = settled(spark, "flows", lambda: flows(links))
    own = on.where("salt > 0").groupBy("kind", "host").agg((F.max("salt") + 1).alias("salts"))  # of crowded hosts
    first = start.join(F.broadcast(own), ["kind", "host"], "left")
    moving = materialise(first.select("kind", "host", (F.col("start") * (1 - damping)).alias("score"), F.coalesce("salts", F.lit(1)).alias("salts")), "moving")
    parts = [moving]
    for _ in range(rounds(damping, tolerance)):
        left = moving.agg(F.sum("score")).first()[0]
        if left is None or left <= tolerance:
            break
        spread = moving.select("kind", "host", "score", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        passed = spread.join(on, ["kind", "host", "salt"]).groupBy("kind", F.col("next").alias("host"))
        moving = materialise(passed.agg(F.sum(F.col("score") * F.col("share") * damping).alias("score"), F.max("next_salts").alias("salts")), "moving")
        parts.append(moving)
        if len(parts) == 8:  # few tables to add up, and to read again
            parts = [_added(spark, parts)]
    score = _added(spark, parts)
    whole = score.groupBy("kind").agg(F.sum("score").alias("whole"))
    return score.join(F.broadcast(whole), "kind").select("kind", "host", (F.col("score") / F.col("whole")).alias("score"))  # two rows


def _added(spark: SparkSession, parts: list[DataFrame]) -> DataFrame:
    every = parts[0].select("kind", "host", "score")
    for p in parts[1:]:
        every = every.union(p.select("kind", "host", "score"))
    return materialise(every.groupBy("kind", "host").agg(F.sum("score").alias("score")), "scores")


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    named = pages.select("page_id", "html", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    ruled = named.withColumn("rule", rule_of(rules)).withColumn("said", said(rules))

    def leads() -> DataFrame:
        score = propagate(seeds(ruled), edges(named))
        return score.groupBy("host").agg(F.sum(F.when(F.col("kind") == "trust", F.col("score")).otherwise(-F.col("score"))).alias("lead"))

    found = joined(ruled.drop("html"), settled(pages.sparkSession, "leads", leads), "host")
    by_host = F.when((F.col("host") == "") | (F.coalesce("lead", F.lit(0.0)) < -TOLERANCE), "block").otherwise("allow")
    return found.select("page_id", "host", "path", "rule", F.coalesce("said", by_host).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def oracle(rules=RULES, damping: float = DAMPING, tolerance: float = TOLERANCE) -> str:
    """The same in DuckDB SQL: all rounds(), one recursive step each."""
    text = lambda s: "'" + s.replace("'", "''") + "'"
    fits = []
    for rule, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        h, p = rule.split("/", 1)
        fits.append(f"WHEN (host = {text(h)} OR ends_with(host, {text('.' + h)})) AND starts_with(path, {text('/' + p)}) THEN {text(rule)}")
    verdicts = " ".join(f"WHEN {text(r)} THEN {text(v)}" for r, v in rules)
    return f"""
WITH RECURSIVE named AS (
  SELECT page_id, html, coalesce(translate(regexp_extract(url, {text(URL)}, 1), '{UPPER}', '{LOWER}'), '') AS host, coalesce(regexp_extract(url, {text(URL)}, 2), '') AS path FROM pages
), ruled AS (
  SELECT *, CASE rule {verdicts} END AS said FROM (SELECT *, CASE {' '.join(fits)} END AS rule FROM named)
), links AS (
  SELECT source, target, count(*) AS n FROM (SELECT host AS source, translate(unnest(regexp_extract_all(html, {text(LINK)}, 1)), '{UPPER}', '{LOWER}') AS target FROM named WHERE host <> '')
  WHERE source <> target GROUP BY ALL
), edges AS (SELECT source, target, n / sum(n) OVER (PARTITION BY source) AS share FROM links),
flows AS MATERIALIZED (
  SELECT 'trust' AS kind, source AS host, target AS next, share FROM edges
  UNION ALL SELECT 'distrust', target, source, share / sum(share) OVER (PARTITION BY target) FROM edges
), counted AS (
  SELECT CASE said WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, count(*) AS n FROM ruled WHERE said IS NOT NULL GROUP BY ALL
), moving(round, kind, host, score) AS (
  SELECT 0, kind, host, n / sum(n) OVER (PARTITION BY kind) * {1 - damping!r} FROM counted
  UNION ALL SELECT m.round + 1, m.kind, f.next, sum(m.score * f.share * {damping!r}) FROM moving m JOIN flows f USING (kind, host) WHERE m.round < {rounds(damping, tolerance)} GROUP BY m.round, m.kind, f.next
), scores AS (SELECT kind, host, sum(score) AS score FROM moving GROUP BY ALL),
lead AS (SELECT host, sum(CASE kind WHEN 'trust' THEN share ELSE -share END) AS lead FROM (SELECT kind, host, score / sum(score) OVER (PARTITION BY kind) AS share FROM scores) GROUP BY host)
SELECT page_id, ruled.host, path, rule, coalesce(said, CASE WHEN ruled.host = '' OR coalesce(lead.lead, 0) < -{tolerance!r} THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled LEFT JOIN lead ON lead.host = ruled.host
"""
