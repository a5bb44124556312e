"""The source divergence audit against exact integers in plain Python, on odd rows and on chunks of any width."""

import collections
import random
import re

import numpy as np
import pytest

from quillmere.llm import divergence

COLUMNS = "doc_id long, text string, lang string, source string, n long, term string, value long, part string, chunk int"


def slow(rows, ranks=200):
    """{(lang, source, part): [(item, value), ...]} by the definition."""
    docs = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for text, lang, source in rows]
    out = {}
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = collections.Counter(t for d in own for t in set(d[2]))
        kept = sorted((t for t in df if df[t] >= 3), key=lambda t: t.encode())
        groups = {s: collections.Counter(t for d in own if d[1] == s for t in d[2] if df[t] >= 3) for s in {d[1] for d in own}}
        whole = sum(groups.values(), collections.Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in groups.items()}, share(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in groups:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in groups if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if groups[s][t] and p[s][t] > q[t]]
            order = lambda found: sorted(found, key=lambda x: (-x[1], x[0].encode()))
            out[lang, s, "pair"], out[lang, s, "term"] = order(pairs), order(terms)[:ranks]
    return {k: v for k, v in out.items() if v}


def found(df):
    out = collections.defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.lang, r.source, r.part, r["rank"])):
        out[r.lang, r.source, r.part].append((r.item, r.value))
        assert r["rank"] == len(out[r.lang, r.source, r.part])
    return dict(out)


def table(spark, rows, parts=3):
    return spark.createDataFrame([(k, *r, 1, "x", 2, "y", 3) for k, r in enumerate(rows)], COLUMNS).repartition(parts)


ODD = [
    (None, None, None), ("", "en", "a"), ("The the THE cat", "en", "a"), ("the cat!", "en", "b"), ("the dog's cat9dog", "en", None), ("the dog's cat9dog", "en", None),
    ("é É ß straße Äpfel", "de", "a"), ("é É ß straße", "de", "b"), ("é É ß \u0085 x\u0000y", "de", "b"), ("日本 \U0001f600", "ja", "a"), ("only here", "fr", "s"),
    ("only here", "fr", "s"), ("long words " * 30_000, "en", "c"), ("x" * 3_000_000, "en", "c"),
]


@pytest.mark.parametrize("width, block, segment", [(4096, 1 << 21, 1 << 20), (2, 5, 7)])
def test_odd_rows_and_small_chunks(spark, monkeypatch, width, block, segment):
    monkeypatch.setattr(divergence, "WIDTH", width)
    rows = ODD if width > 2 else [r for r in ODD if len(r[0] or "") < 100]
    if width == 2:  # workers read the module again, so the block is set where it is used
        monkeypatch.setattr(divergence, "SEGMENT", segment)
        for text in (t for t, *_ in rows if t):
            assert sum(divergence._tokens(text), []) == [x.encode() for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))]
    assert found(divergence.source_divergence(table(spark, rows))) == slow(rows)


def test_random_rows_with_many_ties(spark, monkeypatch):
    monkeypatch.setattr(divergence, "WIDTH", 7)
    rng = random.Random(3)
    words = ["".join(rng.choice("aábcdé") for _ in range(rng.randrange(1, 4))) for _ in range(80)]
    rows = [(" ".join(rng.choices(words, k=rng.randrange(0, 25))), rng.choice(["x", "y", "z"]), rng.choice("abcd")) for _ in range(150)]
    expected = slow(rows, ranks=5)
    assert found(divergence.source_divergence(table(spark, rows, 7), ranks=5)) == expected and len(expected) == 24


def test_a_language_without_kept_terms_and_an_empty_table(spark):
    rows = [("one", "en", "a"), ("two", "en", "b"), ("three", "de", "a")]
    assert found(divergence.source_divergence(table(spark, rows))) == {("en", "a", "pair"): [("b", 0)], ("en", "b", "pair"): [("a", 0)]}
    assert divergence.source_divergence(table(spark, rows).limit(0)).collect() == []


def test_missing_columns_count_as_empty(spark):
    rows = spark.createDataFrame([("a b",), ("a",), ("a",)], "text string")
    assert divergence.source_divergence(rows).collect() == []  # one group, which has no other source and no share above its language


def test_shares_are_exact_where_products_leave_the_longs():
    rng = random.Random(1)
    counts = [0, 1, 10**9, 10**13, *(rng.randrange(10**15) for _ in range(200))]
    sums = [c + 1 + rng.randrange(10**15) for c in counts]
    got = divergence.shares(np.array(counts), np.array(sums))
    assert got.tolist() == [1 + 10**9 * (c + 1) // n for c, n in zip(counts, sums)]
