"""URL rules completed by link-graph propagation, in DataFrame functions only.

Rules judge the pages they fit. Every other page is judged by its host: trust
flows along host links from hosts whose pages the rules allow, distrust flows
against the links from hosts whose pages the rules block (who links to blocked
hosts is suspect), both as personalised PageRank.

Null, empty or malformed urls have an empty host and path, fit no rule and are
allowed. Null or empty html has no links. Repeated rows are judged alike and
each is returned. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.session import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Targets of absolute and protocol-relative links; relative links stay on their host.
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""
DAMPING = 0.85
ITERATIONS = 10
THRESHOLD = 0.5


def ascii_lower(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty without ``://``."""
    text = F.coalesce(url, F.lit(""))
    at = F.instr(text, "://")
    after = F.when(at > 0, F.substr(text, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(after, F.length(host) + 1), r"^[^?#]*", 0)
    return ascii_lower(host), path


def best_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as ``struct(action, rule)``, null if none fits.

    ``rules`` is a short configured list; it is compiled into one literal array.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    table = F.array(*[F.struct(F.lit(a).alias("action"), F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(h + p).alias("rule")) for a, h, p in ordered])
    fits = F.filter(
        table,
        lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"]),
    )
    return F.get(fits, 0)


def host_links(pages: DataFrame) -> DataFrame:
    """Distinct links between different hosts: ``src, dst, n`` (pages with that link)."""
    targets = F.array_distinct(F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(LINK), 1))
    return (
        pages.select(F.col("host").alias("src"), F.explode(targets).alias("dst"))
        .select("src", ascii_lower(F.col("dst")).alias("dst"))
        .where((F.col("src") != "") & (F.col("dst") != F.col("src")))
        .groupBy("src", "dst")
        .agg(F.count("*").alias("n"))
    )


def transitions(links: DataFrame) -> DataFrame:
    """``kind, src, dst, weight``: kind 0 forward for trust, kind 1 reversed for distrust."""
    both = links.select(F.lit(0).alias("kind"), "src", "dst", "n").unionByName(
        links.select(F.lit(1).alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    )
    out = both.groupBy("kind", "src").agg(F.sum("n").alias("total"))
    return both.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("total")).alias("weight"))


def propagate(seeds: DataFrame, steps: DataFrame, iterations: int = ITERATIONS, damping: float = DAMPING) -> DataFrame:
    """Scores ``kind, host, score`` after ``iterations`` rounds of restart and spread.

    A round is one join and one sum; hubs are pre-summed before the shuffle and
    split by the adaptive skew join. Every fifth round is written to the shared folder.
    """
    restart = seeds.select("kind", "host", (F.col("score") * (1 - damping)).alias("score"))
    scores = restart
    for i in range(1, iterations + 1):
        sent = scores.withColumnRenamed("host", "src").join(steps, ["kind", "src"]).select(
            "kind", F.col("dst").alias("host"), (F.col("score") * F.col("weight") * damping).alias("score")
        )
        scores = restart.unionByName(sent).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        if i % 5 == 0 and i < iterations:
            scores = stage(scores, "hostrank")
    return scores


def judge_urls(
    pages: DataFrame, rules: list[tuple[str, str, str]], threshold: float = THRESHOLD, iterations: int = ITERATIONS, damping: float = DAMPING
) -> DataFrame:
    """Per page ``page_id, host, path, rule, verdict, trust, distrust``.

    A host's restart weight is the share of its pages that rules allow (trust)
    or block (distrust). A page without rule is blocked when distrust minus
    trust of its host reaches ``threshold``; hosts nobody vouches for or accuses
    are allowed.
    """
    host, path = split_url(F.col("url"))
    judged = pages.select("page_id", "html", host.alias("host"), path.alias("path")).withColumn("fit", best_rule(F.col("host"), F.col("path"), rules))
    hosts = judged.groupBy("host").agg(
        F.count("*").alias("pages"),
        F.count_if(F.col("fit.action") == "allow").alias("allowed"),
        F.count_if(F.col("fit.action") == "block").alias("blocked"),
    )
    seeds = stage(
        hosts.where((F.col("host") != "") & (F.col("allowed") + F.col("blocked") > 0)).select(
            F.explode(
                F.array(
                    F.struct(F.lit(0).alias("kind"), "host", (F.col("allowed") / F.col("pages")).alias("score")),
                    F.struct(F.lit(1).alias("kind"), "host", (F.col("blocked") / F.col("pages")).alias("score")),
                )
            ).alias("s")
        ).select("s.*").where("score > 0"),
        "hostseeds",
    )
    links = stage(host_links(judged), "hostlinks")
    if links.isEmpty():  # nothing to walk along: the restart is the answer
        scores = seeds.select("kind", "host", (F.col("score") * (1 - damping)).alias("score"))
    else:
        scores = propagate(seeds, stage(transitions(links), "hoststeps"), iterations, damping)
    by_host = scores.groupBy("host").agg(
        F.round(F.sum(F.when(F.col("kind") == 0, F.col("score")).otherwise(0.0)) / (1 - damping), 9).alias("trust"),
        F.round(F.sum(F.when(F.col("kind") == 1, F.col("score")).otherwise(0.0)) / (1 - damping), 9).alias("distrust"),
    )
    # A page matched by a rule needs no score; only the others meet the host table.
    scored = judged.drop("html").join(by_host, "host", "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    found = F.when(F.round(distrust - trust, 9) >= threshold, "block").otherwise("allow")
    return scored.select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.action"), found).alias("verdict"), trust.alias("trust"), distrust.alias("distrust")
    )
