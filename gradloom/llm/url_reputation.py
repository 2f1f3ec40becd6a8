"""URL filter by empirical-Bayes host reputation (DataFrame functions only).

Labelled pages give each host a number of trials and of bad outcomes. A host's bad rate is
shrunk towards its registered domain's, that one towards its suffix's and that one towards
the corpus rate, each through a beta-binomial prior whose strength is fitted by the method
of moments from how far apart siblings are. Parents are taken without the child's own
outcomes, so evidence is counted once. A host is blocked when the lower bound of its
posterior bad rate exceeds a threshold. Explicit rules come first; the longest wins.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no
rule and is judged as the host ''; hosts without labels get their domain's prior; several
labels of one page count as bad if one of them is; repeated pages are judged (and counted)
row by row; with no labels at all every page without a rule is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradloom.llm.common import cut

#: (rule, verdict): a host and a path prefix.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
#: Suffixes of two labels under which names are registered; any other host's suffix is its last label.
#: The reserved example domains host everybody's sites in the test tables, as a shared host does.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "com.br", "co.jp", "co.in", "example.com", "example.net", "example.org")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    rx = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, rx, 1), _UPPER, _LOWER), F.regexp_extract(url, rx, 2)


def _matching(host: Column, path: Column, rules, pick) -> Column:
    """``pick`` of the longest rule that fits, null if none does."""
    out = None
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        value = F.lit(pick(rule, verdict))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("string")


def parents(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and suffix of a host; userinfo and port do not count."""
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    two, one = F.substring_index(name, ".", -2), F.substring_index(name, ".", -1)
    number = name.rlike(r"^[0-9.]+$|^\[")
    suffix = F.when(number, name).when(two.isin(*suffixes), two).otherwise(one)
    domain = F.when(number, name).when(two.isin(*suffixes), F.substring_index(name, ".", -3)).otherwise(two)
    return domain, suffix


def outcomes(pages: DataFrame, labels: DataFrame, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """``host, domain, suffix, n, k``: labelled pages and bad ones of each host.

    ``pages`` has page_id and host; ``labels`` has doc_id (the page), quality and toxic.
    """
    bad = labels.groupBy(F.col("doc_id").alias("page_id")).agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("long")).alias("bad"))
    per_host = pages.join(bad, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
    domain, suffix = parents(F.col("host"), suffixes)
    return per_host.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "k")


def _strength(children: DataFrame, low: float = 1.0, high: float = 1000.0) -> float:
    """The prior's strength in pseudo-trials: 1/rho - 1, rho the intra-class correlation of
    siblings by analysis of variance. ``children``: n, k and their parent's pn, pk, with n > 0."""
    p, q = F.col("k") / F.col("n"), F.col("pk") / F.col("pn")
    r = children.agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("c"), F.sum(1 / F.col("siblings")).alias("p"),
        F.sum(F.col("n") * (p - q) * (p - q)).alias("between"), F.sum(F.col("n") * p * (1 - p)).alias("within"), F.sum(F.col("n") * F.col("n") / F.col("pn")).alias("squares"),
    ).first()  # one row
    if not r["n"]:
        return high
    parents_, free, inner = round(r["p"]), r["c"] - round(r["p"]), r["n"] - r["c"]
    if free <= 0 or inner <= 0:
        return low if parents_ else high
    between, within, size = r["between"] / free, r["within"] / inner, max((r["n"] - r["squares"]) / free, 1e-9)
    bottom = between + (size - 1) * within
    rho = (between - within) / bottom if bottom > 0 else 0.0
    return high if rho <= 0 else min(high, max(low, 1 / rho - 1))


def _level(stats: DataFrame, child: str, parent: str) -> DataFrame:
    """Labelled children with their parent's totals."""
    some = stats.where("n > 0")
    up = some.groupBy(parent).agg(F.sum("n").alias("pn"), F.sum("k").alias("pk"), F.count(F.lit(1)).alias("siblings"))
    return some.select(child, parent, "n", "k").join(cut(up, "parents"), parent)


def reputation(stats: DataFrame, z: float = 1.64, block_above: float = 0.5) -> DataFrame:
    """``host, n, k, bad_rate, bad_low, verdict`` for every host of ``stats`` (see :func:`outcomes`).

    The children of a hot suffix are many rows with one key; parents are read from written
    tables, so that Spark can split such a join or broadcast a side whose size it knows.
    """
    stats = cut(stats, "hosts")
    domains = cut(stats.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "domains")
    suffixes = cut(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).withColumn("root", F.lit("")), "suffixes")
    total = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k")).first()  # one row
    mean = (total["k"] + 0.5) / (total["n"] + 1.0) if total["n"] else 0.0
    s_suffix, s_domain, s_host = _strength(_level(suffixes, "suffix", "root")), _strength(_level(domains, "domain", "suffix")), _strength(_level(stats, "host", "domain"))
    # a prior is as strong as siblings are alike, and no stronger than what is known of their parent
    least = lambda strength, known: 1 / (1 / F.lit(strength) + 1 / known)
    s_eff = least(s_suffix, total["n"] - F.col("n") + F.lit(1.0))
    up = suffixes.select("suffix", F.col("n").alias("sn"), F.col("k").alias("sk"), s_eff.alias("s_eff"))
    rest = F.col("sn") - F.col("n") + F.col("s_eff")
    d = domains.join(up, "suffix").select("domain", F.col("n").alias("dn"), F.col("k").alias("dk"), ((F.col("sk") - F.col("k") + F.col("s_eff") * mean) / rest).alias("m_suffix"), least(s_domain, rest).alias("d_eff"))
    h = stats.join(cut(d, "domain-priors"), "domain")
    known = F.col("dn") - F.col("n") + F.col("d_eff")
    m_domain = (F.col("dk") - F.col("k") + F.col("d_eff") * F.col("m_suffix")) / known
    h_eff = least(s_host, known)
    h = h.withColumn("a", F.col("k") + h_eff * m_domain).withColumn("ab", F.col("n") + h_eff)
    rate = F.col("a") / F.col("ab")
    bad_low = F.greatest(F.lit(0.0), rate - z * F.sqrt(rate * (1 - rate) / (F.col("ab") + 1)))
    return h.select("host", "n", "k", rate.alias("bad_rate"), bad_low.alias("bad_low"), F.when(bad_low > block_above, "block").otherwise("allow").alias("verdict"))


def judge(pages: DataFrame, labels: DataFrame, url_col: str = "url", rules=RULES, z: float = 1.64, block_above: float = 0.5, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """``page_id, host, path, rule, verdict`` and the host's labelled outcomes, for every row of ``pages``.

    ``suffixes`` are those of two labels under which names are registered. The priors are fitted when this is called."""
    host, path = split_url(F.col(url_col))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = cut(reputation(outcomes(split, labels, suffixes), z, block_above).select("host", "n", "k", F.col("verdict").alias("by_host")), "reputation")
    rule = _matching(F.col("host"), F.col("path"), rules, lambda r, v: r)
    ruled = _matching(F.col("host"), F.col("path"), rules, lambda r, v: v)
    return split.join(known, "host", "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(ruled, F.col("by_host"), F.lit("allow")).alias("verdict"),
        F.coalesce("n", F.lit(0)).cast("long").alias("host_labelled"), F.coalesce("k", F.lit(0)).cast("long").alias("host_bad"),
    )


def op2(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract of ``op2_url_reputation``."""
    return judge(pages, labels)
