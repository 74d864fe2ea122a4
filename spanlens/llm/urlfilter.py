"""URL rules, and for URLs without one, trust and distrust spread over links between hosts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, lower_ascii, materialise

SMALL_ROWS = 200_000
TOLERANCE, LIMIT = 1e-9, 1000
#: Rounds of a job.
_ROUNDS = 4


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))

#: A link's host, or nothing for one inside its host; other schemes are no links.
_LINK = r"""(?i)(?:href|src)\s*=\s*["']?\s*(?:(?:https?:)?//([^"'/?#\s<>]+)|(?![a-z][a-z0-9+.-]*:|//)[^"'\s<>])"""


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1))


def path(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def rule_of(h: Column, p: Column, rules: tuple[Rule, ...]) -> Column:
    """The place of the longest rule that fits, else null; of equally long ones the first."""
    out = F.lit(None).cast("int")
    for i in sorted(range(len(rules)), key=lambda i: (len(rules[i].text), -i)):
        fits = ((h == rules[i].host) | F.endswith(h, F.lit("." + rules[i].host))) & F.startswith(p, F.lit(rules[i].path))
        out = F.when(fits, F.lit(i)).otherwise(out)
    return out


def edges(pages: DataFrame) -> DataFrame:
    """src, dst, n: links of pages (url, html) between hosts. A link without a host leads to the page's own; and a host
    and the domain that it is a part of (down to two labels) are tied both ways once, as one is run by the other."""
    links = pages.select(host(F.col("url")).alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_LINK), F.lit(1))).alias("to"))
    links = links.select("src", F.when(F.col("to") == "", F.col("src")).otherwise(lower_ascii(F.col("to"))).alias("dst")).where("src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))
    hosts = pages.select(host(F.col("url")).alias("h")).distinct().where("h <> ''").withColumn("l", F.split("h", r"\."))
    depth = F.explode(F.sequence(F.lit(0), F.size("l") - 3)).alias("i")
    up = hosts.where(F.size("l") >= 3).select("l", depth).select(*[F.array_join(F.slice("l", F.col("i") + d, F.size("l")), ".").alias(c) for c, d in (("src", 1), ("dst", 2))]).where("src <> '' and dst <> ''").distinct()
    both = up.union(up.select("dst", "src")).withColumn("n", F.lit(1).cast("long"))
    return links.unionByName(both).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def propagate(links: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int | None = 12) -> DataFrame:
    """node and rank of the personalised PageRank over links (src, dst, n) that starts from seeds (node, seed).

    Seeds are scaled to sum 1; a node passes damping of its rank on, dealt over its links by n, and a node without links
    keeps none of it. Nodes out of reach have no row. A very popular node is an aggregate, so it is never gathered.
    Without rounds, ranks are passed on until no node is new and none changes by more than TOLERANCE of itself; so small
    ranks, far from the seeds, are as exact as large ones.

    A node's links to itself are solved for, not passed on round by round: what it keeps of its rank in all rounds is a
    geometric series. Some rounds make one job.
    """
    total = seeds.agg(F.sum("seed").alias("s")).first()["s"]
    if not total:
        return seeds.select("node", F.lit(0.0).alias("rank")).limit(0)
    out = links.groupBy("src").agg(F.sum("n").alias("all"))
    every = links.join(out, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("share"))
    # 1 / (1 - damping * share of links to itself)
    loops = materialise(every.where("src = dst").select(F.col("src").alias("loop"), (F.lit(1.0) / (F.lit(1.0) - F.lit(damping) * F.col("share"))).alias("factor")))
    factor = F.coalesce("factor", F.lit(1.0))
    start = materialise(seeds.where("seed > 0").join(loops, F.col("node") == F.col("loop"), "left").select("node", (F.col("seed") / F.lit(total)).alias("seed"), factor.alias("factor")))
    share = materialise(every.where("src <> dst").join(loops, F.col("dst") == F.col("loop"), "left").select("src", "dst", (F.col("share") * factor * F.lit(damping)).alias("share")))
    base = start.select("node", (F.col("seed") * (1 - damping) * F.col("factor")).alias("rank"))
    if share.isEmpty():
        return base
    rank = start.select("node", F.col("seed").alias("rank"))

    def dealt(ranks: DataFrame) -> DataFrame:
        return ranks.join(share, ranks["node"] == share["src"]).select(F.col("dst").alias("node"), (F.col("rank") * F.col("share")).alias("rank")).union(base)

    after, done, most = None, 0, LIMIT if rounds is None else rounds
    while done < most:
        n = min(_ROUNDS, most - done)
        for _ in range(n - 1):
            rank = dealt(rank).groupBy("node").agg(F.sum("rank").alias("rank"))
        held = rank.select("node", F.lit(None).cast("double").alias("rank"), F.col("rank").alias("was"))
        before, after = after, materialise(dealt(rank).withColumn("was", F.lit(None).cast("double")).union(held).groupBy("node").agg(F.sum("rank").alias("rank"), F.max("was").alias("was")))
        discard(before)
        rank, done = after.select("node", "rank"), done + n
        if rounds is None and after.where(F.col("was").isNull() | (F.abs(F.col("rank") - F.col("was")) > TOLERANCE * F.col("rank"))).isEmpty():
            break
    else:
        if rounds is None:
            raise RuntimeError(f"ranks of hosts did not settle in {LIMIT} rounds")
    return rank


def host_verdicts(pages: DataFrame, judged: DataFrame, damping: float = 0.85, rounds: int | None = None, ratio: float = 1.0) -> DataFrame:
    """host, trust, distrust, verdict for each host that either reaches. A written table.

    judged has the host and rule verdict of each page. A host is a trusted seed with as much weight as it has pages that a
    rule allows, and a blocked one with as much as a rule blocks; it may be both. Trust follows links; distrust goes
    against them, to hosts that link to what is blocked. A host is blocked if its distrust exceeds ratio times its trust.
    """
    counts = judged.where("verdict is not null and host <> ''").groupBy("host").agg(F.count_if(F.col("verdict") == "allow").alias("good"), F.count_if(F.col("verdict") == "block").alias("bad"))
    counts = materialise(counts)
    good, bad = (counts.where(F.col(c) > 0).select(F.col("host").alias("node"), F.col(c).cast("double").alias("seed")) for c in ("good", "bad"))
    links = materialise(edges(pages))
    total = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("good", "bad")]).first()
    # ranks sum to 1 each; times their seeds' weight, one allowed page and one blocked page weigh the same
    trust = propagate(links, good, damping, rounds).select(F.col("node").alias("host"), (F.col("rank") * total["good"]).alias("trust"))
    distrust = propagate(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"), bad, damping, rounds).select(F.col("node").alias("host"), (F.col("rank") * total["bad"]).alias("distrust"))
    both = trust.join(distrust, "host", "full").select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    out = materialise(both.withColumn("verdict", F.when(F.col("distrust") > ratio * F.col("trust"), "block").otherwise("allow")))
    discard(counts, links)
    return out


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, **how: float) -> DataFrame:
    """A row for each row of pages (page_id, url, html), repeated ones too: page_id, host, path, rule (the longest that
    fits, else null), verdict (the rule's, else the host's by its ranks; allow for hosts that neither trust nor distrust
    reaches, and for null or malformed urls). A null html has no links. Other columns are not read."""
    h, p = host(F.col("url")), path(F.col("url"))
    rows = pages.select("page_id", h.alias("host"), p.alias("path"))
    rows = rows.withColumn("i", rule_of(F.col("host"), F.col("path"), rules))
    names, verdicts = (F.array(*[F.lit(x) for x in xs]) for xs in ([r.text for r in rules], [r.verdict for r in rules]))
    rows = rows.select("page_id", "host", "path", F.get(names, F.col("i")).alias("rule"), F.get(verdicts, F.col("i")).alias("verdict"))
    known = host_verdicts(pages, rows.select("host", "verdict"), **how).where("verdict = 'block'").select(F.col("host").alias("of_host"), F.col("verdict").alias("by_host"))
    known = F.broadcast(known) if known.count() <= SMALL_ROWS else known
    out = rows.join(known, rows["host"] == known["of_host"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", "by_host", F.lit("allow")).alias("verdict"))
