"""URL filters: parts of urls and rules against plain Python, reputation against sums by hand and planted hosts."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quillmere.llm import reputation as rep

URLS = [
    None, "", "no scheme", "http://", "http:///path", "HTTP://WWW.Example.NET/EN/1", "http://a.example.net/en/5?x=/de/#y", "http://example.net/en/5", "http://badexample.net/en/5",
    "http://example.net", "http://x.net?q", "http://net/", "http://.net/", "a://b://c/d", "http://user@Example.com:80/de/7.html", "http://EXAMPLE.com/de/7#top", "http://m.example.com/de",
    "http://example.org/fr/", "http://org/fr/x", "http://ÄÖ.org/fr/é", "ftp://example.com\n/de/3", "http://1.2.3.4:8080/9", "http://a.b.co.uk./x", "//example.net/en/", "http://example.net/EN/2",
]


def slow(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fitting = [(len(h + p), h + p, v) for v, h, p in rep.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule = max(fitting, default=(0, None, None))
    return host, path, rule[1], rule[2] or "allow"


def pages(spark, urls):
    return spark.createDataFrame([(k, u, "a", 1, 2) for k, u in enumerate(urls)], "page_id long, url string, host string, rule int, n int")


def outcomes(spark, rows):
    return spark.createDataFrame(rows, "key long, bad int")


RECORD = lambda: F.regexp_extract("path", r"/([0-9]+)(?:/|\.[a-z]+)?$", 1).try_cast("long")


def test_hosts_paths_and_rules(spark):
    none = outcomes(spark, [])
    found = rep.judge_urls(pages(spark, URLS), none, RECORD())
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in found.collect()} == {k: slow(u) for k, u in enumerate(URLS)}
    assert rep.judge_urls(pages(spark, URLS).limit(0), none, RECORD()).collect() == []
    twice = rep.judge_urls(pages(spark, URLS).union(pages(spark, URLS)), none, RECORD())
    assert twice.count() == 2 * len(URLS)


def test_of_rules_that_fit_the_longest_wins(spark):
    rules = [("block", "b.c", "/x/y"), ("allow", "a.b.c", "/x/"), ("allow", "c", "/"), ("block", "c", "/x")]
    rows = [("a.b.c", "/x/y"), ("b.c", "/x/y"), ("z.c", "/xy"), ("c", "/"), ("d", "/")]
    got = spark.createDataFrame(rows, "host string, path string").select(rep.rule_of(F.col("host"), F.col("path"), rules).alias("r")).collect()
    # a.b.c/x/ and b.c/x/y are equally long: the first by name
    assert [(r.r.rule, r.r.verdict) if r.r else None for r in got] == [("a.b.c/x/", "allow"), ("b.c/x/y", "block"), ("c/x", "block"), ("c/", "allow"), None]


def test_names_domains_and_suffixes(spark):
    expected = {
        "a.b.example.net": ("a.b.example.net", "example.net", "net"), "x@a.b.co.uk.:80": ("a.b.co.uk", "b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk", "uk"),
        "localhost:80": ("localhost", "localhost", "localhost"), "1.2.3.4:80": ("1.2.3.4", "1.2.3.4", "1.2.3.4"), "": ("", "", ""),
    }
    df = spark.createDataFrame([(x,) for x in expected], "host string").withColumn("name", rep.registered_name(F.col("host")))
    df = df.withColumn("domain", rep.domain_of(F.col("name"))).withColumn("suffix", rep.suffix_of(F.col("domain")))
    assert {r.host: (r.name, r.domain, r.suffix) for r in df.collect()} == expected


def slow_reputation(counts):
    """{name: (mean, bound)} of {name: (n, bad)}; names of three labels, one suffix label."""
    tops = [lambda x: ".".join(x.split(".")[-2:]), lambda x: x.split(".")[-1], lambda x: ""]
    levels = [dict(counts)]
    for top in tops:
        up = {}
        for k, (n, b) in levels[-1].items():
            a = up.setdefault(top(k), [0, 0])
            a[0], a[1] = a[0] + n, a[1] + b
        levels.append({k: tuple(v) for k, v in up.items()})
    strengths = []
    for lower, upper, top in zip(levels, levels[1:], tops):
        found = expected = pairs = 0.0
        for k, (n, b) in lower.items():
            if n:
                all_n, all_b = upper[top(k)]
                m = all_b / all_n
                found, expected, pairs = found + (b - n * m) ** 2, expected + n * m * (1 - m), pairs + n * (n - 1) * m * (1 - m)
        strengths.append(1 / min(max((found - expected) / pairs, 1 / 1001), 1 / 3) - 1 if pairs else 10.0)
    n, b = levels[3][""]
    mean = {"": (b + 0.5) / (n + 1)}
    for level, top, k in zip(reversed(levels[:3]), reversed(tops), reversed(strengths)):
        mean = {x: (b + mean[top(x)] * k) / (n + k) for x, (n, b) in level.items()}
    return {x: (m, m - 1.645 * math.sqrt(m * (1 - m) / (counts[x][0] + strengths[0] + 1))) for x, m in mean.items()}


@pytest.mark.parametrize("seed", range(3))
def test_reputation_equals_plain_python(spark, seed):
    rng = random.Random(seed)
    counts = {}
    for k in range(60):
        n = rng.choice([0, 1, 3, 10, 200]) if seed else 0
        counts[f"h{k}.d{k % 7}.{'xyz'[k % 3]}"] = (n, sum(rng.random() < 0.1 + 0.8 * (k % 7 == 2) for _ in range(n)))
    rows = spark.createDataFrame([(k, *v) for k, v in counts.items()], "name string, n long, bad long")
    expected = slow_reputation(counts)
    for r in rep.host_reputation(rows).collect():
        assert (r.mean, r.bound) == pytest.approx(expected[r.name], abs=1e-9)


def test_bad_hosts_are_blocked_and_others_are_not(spark):
    """Hosts of one domain: two with mostly bad pages, one of them unlabelled but for a page; the rest with few."""
    rng = random.Random(5)
    urls, known = [], []
    for k in range(3000):
        host = rng.choice(["spam.example.com", "a.example.com", "b.example.com", "c.example.org"])
        urls.append(f"http://{host}/{k}")
        if k % 2:
            known.append((k, int(rng.random() < (0.9 if host.startswith("spam") else 0.05))))
    urls += ["http://new.example.org/0", "http://once.example.org/5000"]
    known += [(5000, 1), (5000, 0), (None, 1), (7, None), (99_999, 1)]
    found = rep.judge_urls(pages(spark, urls), outcomes(spark, known), RECORD())
    verdicts = {r.host: r.verdict for r in found.collect()}
    assert verdicts == {"spam.example.com": "block", "a.example.com": "allow", "b.example.com": "allow", "c.example.org": "allow", "new.example.org": "allow", "once.example.org": "allow"}
    assert {r.host: (r.n, r.bad) for r in found.collect()}["once.example.org"] == (1, 1)  # one bad page alone does not block


def test_the_main_path_runs_no_python(spark):
    plan = rep.judge_urls(pages(spark, URLS), outcomes(spark, [(1, 1)]), RECORD())._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
