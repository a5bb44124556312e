"""Fill-in-the-middle against plain Python, and round trips of whatever text."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmere.llm import infill

TEXTS = [None, "", "word", "two words", "é日本 \U0001f600x\u0085y", "has <P> in it", "ends <", "<S", "S> M> <M <<<", "a" * 200_000, "very long text, " * 30_000, " \n\t "]


def slow(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    spm = h[3] % 100 < 20
    return len(units), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def test_rows_equal_plain_python(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS * 12)] + [(None, "no id"), (3, "again"), (3, "again"), (-7, "below zero")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, output string").repartition(3)
    found = infill.infill_documents(docs)
    back = infill.restored(F.col("output"), F.col("form")).alias("back")
    got = sorted(map(repr, (tuple(r) for r in found.select("*", back).collect())))
    assert got == sorted(repr((i, *slow(i, t), t or "")) for i, t in rows)
    assert {r.form for r in found.collect()} == {"plain", "psm", "spm"}
    empty = infill.infill_documents(docs.limit(0))
    assert empty.collect() == [] and empty.columns == found.columns


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aZ<>PSM é日\U0001f600\n")), st.integers(0, 10**6))
def test_any_text_equals_plain_python(text, doc_id):
    assert infill.rearranged(doc_id, text) == slow(doc_id, text)


def test_other_marks_and_shares(spark):
    docs = spark.createDataFrame([(k, f"some text <P> {k}") for k in range(50)], "doc_id long, text string")
    marks = ("[pre]", "[suf]", "[mid]")
    found = infill.infill_documents(docs, seed=9, marks=marks, share=100, suffix_first=50)
    rows = found.select("*", infill.restored(F.col("output"), F.col("form"), marks).alias("back")).collect()
    assert {r.form for r in rows} == {"psm", "spm"} and {(r.doc_id, r.back) for r in rows} == {(k, f"some text <P> {k}") for k in range(50)}
    for bad in (("a", "a", "b"), ("", "x", "y"), ("ab", "bc", "d"), ("aba", "x", "y"), ("abc", "b", "x")):
        with pytest.raises(ValueError):
            infill.infill_documents(docs, marks=bad)
