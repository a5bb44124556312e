"""URL filters: rules first, else the reputation of the host by empirical Bayes.

Outcomes of labelled pages are counted per host. A host's share of bad pages is
shrunk towards its registered domain's, that one towards its suffix's, and that
one towards the share of all: each level is the mean of a beta prior for the
level below, and how strong the prior is follows from how much the counts of the
level below scatter beyond chance (moments of the beta-binomial). A host is
blocked where the lower bound of its posterior lies above what is allowed, so
little evidence alone never blocks. All of it is DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.llm.common import cut

#: (verdict, host, path): a rule fits its host and all below it where the path begins with the rule's.
Rule = tuple[str, str, str]
#: The rules of the query.
RULES: tuple[Rule, ...] = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Public suffixes of two labels; any other suffix is the last label.
TWO_LABELS = ("ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "com.br", "co.in", "co.jp", "co.kr", "co.nz", "com.mx", "com.tr", "co.za")
#: A share of bad pages above this is not allowed; the one-sided bound lies so many deviations below the mean.
MOST_BAD, DEVIATIONS = 0.3, 1.645
#: Least and greatest strength of a prior, in pages, and what is taken where no two pages can be compared.
WEAKEST, STRONGEST, UNKNOWN = 2.0, 1000.0, 10.0
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/ ? #``, A-Z lower-cased; '' without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``? #``; '' without a host."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def registered_name(host: Column) -> Column:
    """A host without user, port and a dot at the end: what reputation goes by."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"\.?(:[0-9]*)?$", "")


def domain_of(name: Column, two_labels: Sequence[str] = TWO_LABELS) -> Column:
    """Suffix and one label more; names of one label and addresses are their own domain."""
    longer = "|".join(x.replace(".", r"\.") for x in two_labels)
    found = F.regexp_extract(name, rf"[^.]+\.(?:{longer + '|' if longer else ''}[^.]+)$", 0)
    return F.when((found == "") | name.rlike(r"^[0-9.]+$|^\["), name).otherwise(found)


def suffix_of(domain: Column) -> Column:
    return F.when(domain.rlike(r"^[0-9.]+$|^\["), domain).otherwise(F.regexp_replace(domain, r"^[^.]+\.", ""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct<rule, verdict> of the longest rule that fits, of equally long ones the first by name; null if none fits."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    by_name = sorted(rules, key=lambda r: r[1] + r[2], reverse=True)
    for verdict, of, begins in sorted(by_name, key=lambda r: len(r[1] + r[2])):  # what comes later wins
        fits = ((host == of) | F.endswith(host, F.lit(f".{of}"))) & F.startswith(path, F.lit(begins))
        out = F.when(fits, F.struct(F.lit(of + begins).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_counts(hosts: DataFrame, outcomes: DataFrame, key: str = "record") -> DataFrame:
    """(name, n, bad) of every host: labelled pages, and bad ones among them.

    ``hosts`` has a row per page: name, and the key by which ``outcomes`` (key,
    bad as 0 or 1, one row a key) knows it, or null. Equal pairs are counted
    before they move.
    """
    met = hosts.groupBy("name", key).agg(F.count("*").alias("pages"))
    known = met.filter(F.col(key).isNotNull()).join(outcomes, key).select("name", F.col("pages").alias("n"), (F.col("pages") * F.col("bad")).alias("bad"))
    none = met.select("name", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("bad"))
    return known.unionByName(none).groupBy("name").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))


def _strength(members: DataFrame, share: Column) -> float:
    """Strength of the prior above the members of a level, from how their counts scatter around their parents' shares."""
    chance, scatter, n = share * (1 - share), F.col("bad") - F.col("n") * share, F.col("n")
    found, expected, pairs = members.filter("n > 0").agg(F.sum(scatter * scatter), F.sum(n * chance), F.sum(n * (n - 1) * chance)).first()  # three numbers
    if not pairs:
        return UNKNOWN
    return 1 / min(max((found - expected) / pairs, 1 / (1 + STRONGEST)), 1 / (1 + WEAKEST)) - 1


def _with_parents(lower: DataFrame, upper: DataFrame, by: str) -> DataFrame:
    return lower.join(upper.select(by, F.col("n").alias("all_n"), F.col("bad").alias("all_bad")), by)


def host_reputation(counts: DataFrame, two_labels: Sequence[str] = TWO_LABELS, deviations: float = DEVIATIONS) -> DataFrame:
    """(name, n, bad, mean, bound) of every host of ``counts`` (name, n, bad): the posterior's mean, and its lower bound.

    Shares of parents come with the priors of their own parents; each level is
    one row per member, joined by Spark as their sizes are. Without any outcome
    every mean is one half and the bound says nothing.
    """
    domain = domain_of(F.col("name"), two_labels)
    hosts = cut(counts.select("name", "n", "bad", domain.alias("domain"), suffix_of(domain).alias("suffix")))
    total = lambda df, *by: df.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = cut(total(hosts, "domain", "suffix"))
    suffixes = total(domains, "suffix")
    n, bad = (x or 0 for x in suffixes.agg(F.sum("n"), F.sum("bad")).first())
    of_parent = F.col("all_bad") / F.col("all_n")
    strengths = [
        _strength(suffixes, F.lit(bad / n if n else 0.0)), _strength(_with_parents(domains, suffixes, "suffix"), of_parent),
        _strength(_with_parents(hosts, domains, "domain"), of_parent),
    ]
    shrunk = lambda prior, k: (F.col("bad") + prior * k) / (F.col("n") + k)
    of_suffix = suffixes.select("suffix", shrunk(F.lit((bad + 0.5) / (n + 1)), strengths[0]).alias("of_suffix"))
    of_domain = domains.join(of_suffix, "suffix").select("domain", shrunk(F.col("of_suffix"), strengths[1]).alias("of_domain"))
    pages = F.col("n") + F.lit(strengths[2])
    mean = shrunk(F.col("of_domain"), strengths[2])
    spread = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (pages + 1))
    found = hosts.join(of_domain, "domain").select("name", "n", "bad", mean.alias("mean"))
    return found.select("name", "n", "bad", "mean", (F.col("mean") - deviations * spread).alias("bound"))


def judge_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    record: Column,
    rules: Sequence[Rule] = RULES,
    most_bad: float = MOST_BAD,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """Per row of ``pages``: page_id, host, path, rule, verdict, and n, bad, mean, bound of its host's reputation.

    ``outcomes`` are (record, bad): records of labelled pages, and whether they
    are bad; ``record`` is the expression that gives a page's record from host
    and path. Where no rule fits, a page is blocked if its host's bound exceeds
    ``most_bad``. Defined cases: urls that are null or without ``://`` have an
    empty host and path, and are judged as pages of a host without a name;
    records that are null or unknown are no outcome; of several outcomes of one
    record the worst counts, null ones don't; without outcomes nothing is
    blocked but by rule; ids may be null or repeat; an empty table gives an
    empty one; other columns are ignored. Pages move once, as id and url parts,
    to meet their host: a host with very many of them is split by the engine's
    skew join.
    """
    split = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    named = split.withColumn("name", registered_name(F.col("host")))
    known = outcomes.select(F.col(outcomes.columns[0]).cast("long").alias("record"), F.col(outcomes.columns[1]).cast("long").alias("bad"))
    known = known.filter("record IS NOT NULL AND bad IS NOT NULL").groupBy("record").agg(F.max("bad").alias("bad"))
    counts = host_counts(named.select("name", record.cast("long").alias("record")), known)
    rated = named.join(host_reputation(counts), "name")
    rule = rule_of(F.col("host"), F.col("path"), rules)
    by_host = F.when(F.col("bound") > most_bad, "block").otherwise("allow")
    return rated.withColumn("_rule", rule).select(
        "page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", by_host).alias("verdict"), "n", "bad", "mean", "bound"
    )
