"""URL filter by empirical-Bayes host reputation.

Labelled page outcomes (good or not) are counted by host, registered domain and suffix. Each level's
good share is shrunk toward the level above by a beta-binomial prior whose strength is estimated from
the spread of the data at that level; a host is allowed when the lower bound of its posterior good
share reaches a threshold. Rules of hosts and paths come first, the longest one that fits wins.

Only DataFrame functions are used. Hosts are aggregated before anything is shuffled by host, and the
table of reputations is written, so the join back to the pages can be split where one host is hot.

A url that is null or lacks ``://`` has the empty host and path. Pages without a labelled outcome count
for nothing and get the reputation of their host, or of the nearest level that has outcomes; without
any outcome at all the good share is ``start``. Repeated pages are repeated outcomes; of several outcomes
of one page the worst holds. Columns named like a result are replaced; others are dropped. An empty table gives no rows.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.sources.scratch import materialize

LEVELS = ("suffix", "domain", "host")
# Public suffixes of two labels under which many owners register; others can be given.
SUFFIXES = (
    "ac.uk", "co.uk", "gov.uk", "ltd.uk", "me.uk", "net.uk", "nhs.uk", "org.uk", "plc.uk", "sch.uk", "com.au", "edu.au", "gov.au", "net.au",
    "org.au", "co.nz", "govt.nz", "net.nz", "org.nz", "co.jp", "ac.jp", "ne.jp", "or.jp", "go.jp", "co.kr", "or.kr", "com.br", "gov.br", "org.br",
    "com.cn", "edu.cn", "gov.cn", "net.cn", "org.cn", "com.tw", "com.hk", "com.sg", "co.in", "net.in", "org.in", "co.za", "org.za", "com.mx",
    "com.ar", "com.co", "com.tr", "com.pl", "com.ua", "co.il", "com.my", "co.th", "co.id", "com.ph", "com.vn", "com.sa", "com.eg", "com.ng",
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def rule_column(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does.

    A rule is a text ``host/path`` with a verdict; it fits its host and all subdomains.
    """
    name = verdict = F.lit(None).cast("string")
    for text, said in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        base, slash, rest = text.partition("/")
        fits = ((host == base) | host.endswith("." + base)) & path.startswith(slash + rest)
        name, verdict = F.when(fits, F.lit(text)).otherwise(name), F.when(fits, F.lit(said)).otherwise(verdict)
    return name, verdict


def host_levels(host: Column, suffixes: Sequence[str] = SUFFIXES) -> dict[str, Column]:
    """Host, its registered domain and its suffix.

    The suffix is one of ``suffixes`` or the last label, the domain that and one label more. Both leave out a
    port. An IP address is its own domain and suffix.
    """
    bare = F.regexp_replace(host, r":\d*$", "")
    address = bare.rlike(r"^(\d+\.){3}\d+$|^\[")
    ends = "|".join([*(s.replace(".", r"\.") for s in suffixes), "[^.]*"])
    return {
        "suffix": F.when(address, bare).otherwise(F.regexp_extract(bare, rf"(?:^|\.)({ends})$", 1)),
        "domain": F.when(address, bare).otherwise(F.regexp_extract(bare, rf"(?:^|\.)((?:[^.]*\.)?(?:{ends}))$", 1)),
        "host": host,
    }


def reputations(outcomes: DataFrame, start: float, top_strength: float, deviations: float, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """For each host of ``outcomes`` (host, good 0/1 or null): the lower bound of its good share.

    ``top_strength`` is the weight, in pages, of the share over all pages when it is shrunk to
    ``start``. Between levels the prior's strength follows from the moments of the children's shares:
    with intra-class correlation rho, estimated from their weighted spread and held within
    0.001..0.5, it is 1 / rho - 1.
    """
    counts = materialize(
        outcomes.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("g"))
        .select(*(c.alias(k) for k, c in host_levels(F.col("host"), suffixes).items()), "n", "g"))
    whole = counts.agg(
        ((F.coalesce(F.sum("g"), F.lit(0)) + top_strength * start) / (F.coalesce(F.sum("n"), F.lit(0)) + top_strength)).alias("m"))
    table, mean, above = None, whole.scalar(), None
    for level in LEVELS:
        parent = LEVELS[LEVELS.index(level) - 1] if level != LEVELS[0] else None
        keys = [k for k in (parent, level) if k]
        own = counts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("g").alias("g"))
        own = materialize(own.join(above, parent) if parent else own.withColumn("prior", mean))
        spread = own.where("n > 0").agg(
            F.sum(F.col("n") * F.pow(F.col("g") / F.col("n") - F.col("prior"), 2) / (F.col("prior") * (1 - F.col("prior")))).alias("s"),
            F.count("*").alias("k"), F.sum("n").alias("t"))
        rho = F.when(F.col("t") > F.col("k"), (F.col("s") - F.col("k")) / (F.col("t") - F.col("k")))
        strength = spread.select((1 / F.least(F.greatest(F.coalesce(rho, F.lit(0.5)), F.lit(1e-3)), F.lit(0.5)) - 1).alias("x")).scalar()
        a = F.col("g") + strength * F.col("prior")
        b = F.col("n") - F.col("g") + strength * (1 - F.col("prior"))
        shrunk = own.select(*keys, "n", "g", (a / (a + b)).alias("share"), (a + b).alias("total"))
        shrunk = materialize(shrunk)  # each level once; the next ones and their scalars read it
        if level == "host":
            table = shrunk
        else:
            above = shrunk.select(level, F.col("share").alias("prior"))
    bound = F.col("share") - deviations * F.sqrt(F.col("share") * (1 - F.col("share")) / (F.col("total") + 1))
    return table.select("host", F.col("n").alias("labelled"), "share", bound.alias("bound"))


def judge_urls(
    pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], *, least: float = 0.5,
    start: float = 0.5, top_strength: float = 2.0, deviations: float = 1.645, suffixes: Sequence[str] = SUFFIXES,
) -> DataFrame:
    """page_id, host, path, rule, verdict, labelled, bound for every page.

    ``outcomes`` has page_id and good (0/1, or null where unlabelled).
    """
    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    seen = parts.join(outcomes.where("good IS NOT NULL").groupBy("page_id").agg(F.min("good").alias("good")), "page_id", "left")
    known = materialize(reputations(seen.select("host", "good"), start, top_strength, deviations, suffixes))
    rule, said = rule_column(F.col("host"), F.col("path"), rules)
    judged = F.when(F.col("bound") >= least, "allow").otherwise("block")
    return parts.join(known, "host", "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(said, judged).alias("verdict"),
        "labelled", F.round("bound", 6).alias("bound"))
