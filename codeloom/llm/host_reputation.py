"""URL verdicts: rules first, else the empirical-Bayes reputation of the host.

Labelled page outcomes (bad or not) are counted per host, registered domain and
suffix. Each level's bad rate has a beta prior whose mean is the parent's posterior
mean and whose strength is estimated from the data: the overdispersion of the
level's counts around their parents' means (method of moments) is the intra-unit
correlation rho of a beta-binomial, and the prior counts for ``1 / rho - 1`` pages.
A host without outcomes has its domain's rate, a domain without any its suffix's.
A page is blocked if the lower bound of its host's bad rate exceeds ``max_bad``.

Built-in column functions only; what the driver reads is four sums per level.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import Scratch, counted_broadcast

MAX_BAD = 0.2
Z = 1.645
# Bounds of the correlation, so that the prior counts for 1 page at least and 9999 at most.
RHO = (0.0001, 0.5)

# Suffixes of two labels under which names are registered unless others are given: a part of the public ones, the same as in the query's SQL.
TWO_LABEL_SUFFIXES = (
    "ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.nz", "co.za", "com.br", "com.cn", "co.in", "co.jp", "ne.jp",
    "or.jp", "co.kr", "com.mx", "com.tr", "com.tw", "com.ar",
)

_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; '' without it or for null."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _CAPITALS, _SMALL), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _name(host: Column) -> Column:
    """The host without user, port and final dot."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), "(:[0-9]*)?\\.?$", "")


def _last(labels: Column, n: int) -> Column:
    return F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), F.lit(n)), ".")


def _levels(host: Column, suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and suffix of a host; an address of numbers is its own.

    A suffix of two labels that is not among ``suffixes`` counts as a domain.
    """
    name = _name(host)
    labels = F.split(name, "\\.")
    number = name.rlike("^[0-9.]+$")
    two = _last(labels, 2).isin(*suffixes)
    domain = F.when(number, name).when(two, _last(labels, 3)).otherwise(_last(labels, 2))
    suffix = F.when(number, name).when(two, _last(labels, 2)).otherwise(_last(labels, 1))
    return domain, suffix


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest of the rules (verdict, host, path) that fits, as struct (name, verdict); null if none does.

    A rule fits its host and all subdomains if the path starts with the rule's. Of
    equally long ones the longer host wins, then block. ``rules`` is a list the
    driver holds; it becomes a constant of the plan.
    """
    if not rules:
        return F.lit(None).cast("struct<name:string,verdict:string>")
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "block", r[1], r[2]))
    known = F.array(*(
        F.struct(F.lit(h + p).alias("name"), F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit("." + h).alias("under"), F.lit(p).alias("path"))
        for v, h, p in ranked))
    fits = F.filter(known, lambda r: ((host == r["host"]) | host.endswith(r["under"])) & path.startswith(r["path"]))
    best = F.get(fits, F.lit(0))
    return F.when(best.isNotNull(), F.struct(best["name"].alias("name"), best["verdict"].alias("verdict")))


def _shrunk(units: DataFrame, mean: Column) -> tuple[DataFrame, float]:
    """``units`` (n, x, …) with the posterior ``mean`` under priors of the given means, and the strength of the priors."""
    spread = F.col("n") * F.col("_m") * (1 - F.col("_m"))
    at = units.withColumn("_m", mean)
    over, plain, weight = at.agg(
        F.sum((F.col("x") - F.col("n") * F.col("_m")) * (F.col("x") - F.col("n") * F.col("_m"))),
        F.sum(spread), F.sum((F.col("n") - 1) * spread)).first()
    rho = (over - plain) / weight if weight else RHO[0]
    strength = 1 / min(max(rho, RHO[0]), RHO[1]) - 1
    return at.withColumn("mean", (F.lit(strength) * F.col("_m") + F.col("x")) / (F.lit(strength) + F.col("n"))).drop("_m"), strength


def host_reputation(outcomes: DataFrame, scratch: Scratch, z: float = Z, suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """(host, n, mean, low) for the hosts of ``outcomes`` (host, bad); rows with a null ``bad`` only name a host.

    ``low`` is the lower bound of the host's bad rate: posterior mean less ``z`` standard deviations.
    """
    domain, suffix = _levels(F.col("host"), suffixes)
    hosts = scratch.keep(
        outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum(F.col("bad").cast("bigint")), F.lit(0)).alias("x"))
        .withColumns({"domain": domain, "suffix": suffix}))
    total, bad = hosts.agg(F.sum("n"), F.sum("x")).first()
    sums = lambda df, *keys: df.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    domains = sums(hosts, "domain", "suffix")
    overall = ((bad or 0) + 0.5) / ((total or 0) + 1.0)
    by_suffix, _ = _shrunk(sums(domains, "suffix"), F.lit(overall))
    above = by_suffix.select("suffix", F.col("mean").alias("above"))
    by_domain, _ = _shrunk(domains.join(above, "suffix"), F.col("above"))
    by_domain = scratch.keep(by_domain.select("domain", F.col("mean").alias("above")))
    by_host, strength = _shrunk(hosts.join(by_domain, "domain"), F.col("above"))
    size = F.lit(strength) + F.col("n")
    deviation = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (size + 1))
    return scratch.keep(by_host.select("host", "n", "mean", (F.col("mean") - F.lit(z) * deviation).alias("low")))


def judge_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: list[tuple[str, str, str]] = (),
    max_bad: float = MAX_BAD,
    z: float = Z,
    id_col: str = "page_id",
    url_col: str = "url",
    suffixes: Sequence[str] = TWO_LABEL_SUFFIXES,
) -> DataFrame:
    """(id, host, path, rule, verdict, n_labelled, bad_mean, bad_low) for every row of ``pages``.

    ``outcomes`` has the id and a boolean ``bad``; every row counts, those with a null
    id or a null ``bad`` don't. ``verdict`` is the rule's, else ``block`` if ``bad_low``
    exceeds ``max_bad`` and ``allow`` if not; the last two columns are rounded to six
    places. A null url, or one without ``://``, has the host ''. Repeated rows are
    judged, and their outcomes counted, as often as they come. Hosts under a suffix of
    two labels that is not among ``suffixes`` (say com.sg, of those not in the default)
    share its prior as if it were one registered domain.
    """
    scratch = Scratch(pages.sparkSession, "reputation")
    url = F.col(url_col)
    places = pages.select(F.col(id_col).alias("_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    labelled = outcomes.select(F.col(id_col).alias("_of"), "bad").filter("bad is not null")
    seen = places.select("_id", "host").join(labelled, F.col("_id") == F.col("_of"), "left").select("host", "bad")
    reputation = host_reputation(seen, scratch, z, suffixes).withColumnRenamed("host", "_host")
    judged = places.join(counted_broadcast(reputation), F.col("host") == F.col("_host")).withColumn(
        "rule", matching_rule(F.col("host"), F.col("path"), list(rules)))
    by_bound = F.when(F.col("low") > max_bad, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(
        F.col("_id").alias(id_col), "host", "path", F.col("rule.name").alias("rule"), F.coalesce(F.col("rule.verdict"), by_bound).alias("verdict"),
        F.col("n").alias("n_labelled"), F.round("mean", 6).alias("bad_mean"), F.round("low", 6).alias("bad_low"))
