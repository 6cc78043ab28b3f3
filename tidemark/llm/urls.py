"""URL filters: fixed rules first, then an empirical-Bayes reputation of hosts. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Fixed values: (verdict, host, path prefix).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

#: Labels under which names are registered below a country's two letters; any other suffix is the last label.
SECOND_LEVELS = ("ac", "co", "com", "edu", "go", "gov", "mil", "ne", "net", "or", "org", "sch")
ADDRESS = r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path. A null url, or one without "://", has both empty."""
    rest = F.when(F.instr(F.col(url), "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)"))
    return pages.withColumns(
        {
            "host": F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.lit("")),
            "path": F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit("")),
        }
    )


def rule_of(rules=RULES):
    """(rule, verdict) columns of the longest rule that fits host and path; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, host, path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        name, verdict = F.when(fits, f"{host}{path}").otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def with_domains(hosts: DataFrame) -> DataFrame:
    """Adds the registered domain and the suffix of a host without its port. Addresses have no domain above them."""
    bare = F.regexp_replace("host", r":[0-9]*$", "")
    two, last = F.substring_index(bare, ".", -2), F.substring_index(bare, ".", -1)
    address, long = bare.rlike(ADDRESS), last.rlike("^[a-z]{2}$") & F.substring_index(two, ".", 1).isin(*SECOND_LEVELS)
    suffix = F.when(address, "ip").when(long, two).otherwise(last)
    domain = F.when(address, bare).when(long, F.substring_index(bare, ".", -3)).otherwise(two)
    return hosts.withColumns({"domain": domain, "suffix": suffix})


def _strength(groups: DataFrame, parent: str, least: float, most: float) -> DataFrame:
    """(parent, k): how many outcomes the parent's rate is worth, by moments of its children's rates (n, bad)."""
    usable = groups.where("n > 0").groupBy(parent).agg(
        F.sum("n").cast("double").alias("sn"), F.sum("bad").cast("double").alias("sb"), F.count("*").cast("double").alias("m"),
        F.sum(F.col("bad") * F.col("bad") / F.col("n").cast("double")).alias("sq"), F.sum(F.col("n") * F.col("n")).cast("double").alias("nn"),
    )
    rate = F.col("sb") / F.col("sn")
    spread = rate * (1 - rate)
    # Weighted between-group sum of squares against what binomial noise alone would give.
    between = F.col("sq") - F.col("sn") * rate * rate - (F.col("m") - 1) * spread
    scale = F.col("sn") - F.col("nn") / F.col("sn")
    variance = F.when((scale > 0) & (between > 0), between / scale)
    k = F.when(variance.isNull() | (spread <= 0), F.lit(most)).otherwise(F.least(F.greatest(spread / variance - 1, F.lit(least)), F.lit(most)))
    return usable.select(F.col(parent).alias(f"{parent}_key"), F.round(k, 3).alias("k"))


def reputation(outcomes: DataFrame, *, least: float = 2.0, most: float = 500.0) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The beta posterior of the bad rate of each host from labelled outcomes (host, bad 0/1), and the priors above it.

    Counts are shrunk along global rate, suffix, registered domain and host: each level's rate is a beta-binomial prior of
    the next, worth as many outcomes as the spread of its children's rates says, between ``least`` and ``most``. Returns
    (host, n, bad, alpha, beta), (domain, mu, k), (suffix, mu, k) and the one line (mu, k) for suffixes not met. Hosts
    without labelled outcomes are not in the first; their prior is that of the nearest level that is there. What a single
    suffix says of others is worth ``least`` only.
    """
    counted = F.sum("n").alias("n"), F.sum("bad").alias("bad")
    hosts = with_domains(outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"))).where("n > 0")
    domains = hosts.groupBy("domain", "suffix").agg(*counted)
    suffixes = domains.groupBy("suffix").agg(*counted).withColumn("top", F.lit(0))
    total = suffixes.groupBy("top").agg(F.sum("n").alias("all_n"), F.sum("bad").alias("all_bad"))

    def prior(rates: DataFrame, children: DataFrame, name: str) -> DataFrame:
        return rates.join(_strength(children, name, least, most), F.col(name) == F.col(f"{name}_key")).select(name, "mu", "k")

    def shrunk(level: DataFrame, parent: str, up: DataFrame, name: str) -> DataFrame:
        return level.join(up, parent).select(name, ((F.col("bad") + F.col("k") * F.col("mu")) / (F.col("n") + F.col("k"))).alias("mu"))

    root = prior(total.select("top", (F.col("all_bad") / F.col("all_n")).alias("mu")), suffixes, "top")
    by_suffix = prior(shrunk(suffixes, "top", root, "suffix"), domains, "suffix")
    by_domain = prior(shrunk(domains, "suffix", by_suffix, "domain"), hosts, "domain")
    found = hosts.join(by_domain, "domain")
    found = found.select("host", "n", "bad", (F.col("bad") + F.col("k") * F.col("mu")).alias("alpha"), (F.col("n") - F.col("bad") + F.col("k") * (1 - F.col("mu"))).alias("beta"))
    lone = suffixes.agg(F.count("*").alias("m"))
    anywhere = root.join(F.broadcast(lone)).select("mu", F.when(F.col("m") < 2, F.lit(least)).otherwise(F.col("k")).alias("k"))  # one line
    return found, by_domain, by_suffix, anywhere


def judge(pages: DataFrame, outcomes: DataFrame, *, rules=RULES, block_above: float = 0.35, z: float = 1.645) -> DataFrame:
    """Every page with (host, path, rule, verdict, n_labelled, n_bad): the rule's verdict, else the reputation's.

    ``outcomes`` has (page_id, bad 0/1) for some pages. A host is blocked where the lower posterior bound of its bad rate
    is above ``block_above``: its mean less z standard deviations, which stands for the lower quantile of the beta
    distribution and is close to it where the posterior is worth ten outcomes or more. A host without outcomes is judged by
    the prior of its registered domain, else of its suffix, else by the global one. Empty hosts, and all hosts where there
    are no outcomes at all, are allowed.

    * a null url, or one without "://", has an empty host and path, no rule and is allowed;
    * null outcomes and outcomes of null or unknown pages do not count; several outcomes of a page count each;
    * repeated pages stay repeated and count each; an empty table gives an empty result; further columns of pages are
      ignored; a bound that equals ``block_above`` does not block; urls of any length are read whole.
    * ports are no part of the domain; a host of four numbers is its own domain, of the suffix "ip";
    * of suffixes of several labels only those of SECOND_LEVELS below a country are known: names under others, as of a
      hosting service or a town, are one domain. A host of any share of all pages is in no one task.
    """
    parts = with_parts(pages.select("page_id", "url"))
    labelled = outcomes.where("page_id IS NOT NULL AND bad IS NOT NULL").select(F.col("page_id").alias("labelled_id"), "bad")
    known = parts.where("host <> ''").join(labelled, F.col("page_id") == F.col("labelled_id")).select("host", "bad")
    total = F.col("alpha") + F.col("beta")
    mean = F.col("alpha") / total
    bound = mean - z * F.sqrt(mean * (1 - mean) / (total + 1))
    found, by_domain, by_suffix, anywhere = reputation(known)
    hosts = with_domains(parts.groupBy("host").agg(F.count("*").alias("n_pages"))).join(found, "host", "left")
    for level, prior in (("domain", by_domain), ("suffix", by_suffix)):
        hosts = hosts.join(prior.select(level, F.col("mu").alias(f"{level}_mu"), F.col("k").alias(f"{level}_k")), level, "left")
    hosts = hosts.join(F.broadcast(anywhere.select(F.col("mu").alias("any_mu"), F.col("k").alias("any_k"))), how="left")  # one line
    mu, k = (F.coalesce(f"domain_{x}", f"suffix_{x}", f"any_{x}") for x in ("mu", "k"))
    hosts = hosts.withColumns({"alpha": F.coalesce("alpha", k * mu), "beta": F.coalesce("beta", k * (1 - mu))})
    hosts = common.checkpointed(hosts.select("host", "n_pages", "n", "bad", F.when(F.col("host") != "", bound > block_above).alias("blocked")))
    rule, verdict = rule_of(rules)
    judged = common.joined_by_key(parts, hosts, "host", "n_pages")
    return judged.select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_labelled"), F.coalesce("bad", F.lit(0)).cast("long").alias("n_bad"),
    )
