"""Stupid-backoff scores, computed relationally over the whole corpus.

Relations, by hash of the n-gram: the exploded n-grams (group of documents,
n-gram, occurrences), the count table (n-gram, count), and their join, which
tells every group the counts of its own n-grams; they are then looked up for
each position and summed per document.

Exploded n-grams are distinct within a group of documents before they move, so
a frequent n-gram is one row per group and no key is hot. Rows of a group that
go to the same range of hashes travel as one packed row (sorted hashes as byte
planes, which compress), and the answer is just the counts in that order.

Rows equal in id and text are in one group by their hash. Where some of them
are more than a group may hold, equal rows are merged before they move, count
as often as they are there, and are copied again at the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.llm.common import column_or_null, cut
from quillmere.llm.fingerprint import words_of

#: Weight of a lower order, the least count with which an n-gram of more than one word is in the table, and the usual highest order.
BACKOFF, LEAST_COUNT, ORDER = 0.4, 2, 2
#: Bytes of text in a group of documents and behind a range of hashes. They bound what a task holds.
GROUP_BYTES, RANGE_BYTES = 8 << 20, 16 << 20
#: Copies of a merged row that one row of the plan stands for when they are written out.
COPIES = 65_536
_PAIR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def unigrams(words: list[bytes]) -> np.ndarray:
    """XXH64 of each word."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def ngrams(one: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the n-grams of orders 1 to ``order`` that start at each word."""
    out = [one]
    for k in range(1, order):
        both = (out[-1][:-1] * _PAIR + one[k:]) * _MIX if len(one) > k else np.empty(0, np.uint64)
        out.append(both ^ (both >> np.uint64(29)))
    return out


def _planes(values: np.ndarray) -> bytes:
    """Fixed-size integers byte plane by byte plane: the high bytes of sorted numbers, and of small ones, compress."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()


def _unplaned(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _hashes(texts: pa.ChunkedArray) -> list[np.ndarray]:
    return [unigrams(words_of(text)) for chunk in texts.chunks for at in range(0, len(chunk), 256) for text in chunk.slice(at, 256).to_pylist()]


def _distinct(ones: list[np.ndarray], order: int, inverse: bool):
    """Sorted distinct hashes of all n-grams, and their counts or where each occurrence is: by order, then by document."""
    every = [ngrams(x, order) for x in ones]
    both = np.concatenate([*(x[k] for k in range(order) for x in every), np.empty(0, np.uint64)])
    return np.unique(both, return_counts=not inverse, return_inverse=inverse)


def _sizes(ones: list[np.ndarray], order: int) -> np.ndarray:
    """How many n-grams of each order, by row, each document, by column, has."""
    return np.array([[max(0, len(x) - k) for x in ones] for k in range(order)], np.int64)


def _ranges(keys: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """The ranges of hashes that sorted keys are in, and where each of these starts, and the end."""
    if ranges == 1 or not len(keys):
        return np.arange(min(1, len(keys))), np.array([0, len(keys)])
    own, starts = np.unique(keys // np.uint64(-(-(1 << 64) // ranges)), return_index=True)
    return own, np.r_[starts, len(keys)]


def _explode(groups: DataFrame, order: int, ranges: int) -> DataFrame:
    """(range, group, grams, counts): the distinct n-grams of each group, packed by range of hashes."""

    def run(table: pa.Table) -> pa.Table:
        ones, times = _hashes(table.column("text")), table.column("times").to_numpy()
        keys, counts = _distinct(ones, order, inverse=bool((times > 1).any()))
        if (times > 1).any():
            counts = np.bincount(counts, np.repeat(np.tile(times, order), _sizes(ones, order).ravel()), len(keys))
        kind = np.uint32 if counts.max(initial=0) < 1 << 32 else np.uint64
        own, edges = _ranges(keys, ranges)
        parts = list(zip(edges, edges[1:]))
        return pa.table(
            {
                "range": pa.array(own, pa.int32()),
                "group": pa.array([table.column("group")[0].as_py()] * len(own), pa.int32()),
                "grams": pa.array([_planes(keys[a:b]) for a, b in parts], pa.binary()),
                "counts": pa.array([_planes(counts[a:b].astype(kind)) for a, b in parts], pa.binary()),
            }
        )

    return groups.groupBy("group").applyInArrow(run, "range int, group int, grams binary, counts binary")


def _join_counts(exploded: DataFrame) -> DataFrame:
    """(range, group, totals): the count table of each range, joined to the groups' n-grams in their order."""

    def run(table: pa.Table) -> pa.Table:
        grams = [_unplaned(x, np.uint64) for x in table.column("grams").to_pylist()]
        keys, place = np.unique(np.concatenate(grams), return_inverse=True)
        packed = zip(table.column("counts").to_pylist(), grams)
        counts = np.concatenate([_unplaned(x, np.uint32 if len(x) == 4 * len(g) else np.uint64) for x, g in packed])
        found = np.bincount(place, counts, len(keys)).astype(np.uint64)[place]
        parts = np.split(found, np.cumsum([len(x) for x in grams])[:-1])
        return pa.table({"range": table.column("range"), "group": table.column("group"), "totals": pa.array([_planes(x) for x in parts], pa.binary())})

    return exploded.groupBy("range").applyInArrow(run, "range int, group int, totals binary")


_SUMS = "doc_id long, times long, n_words long, n_backed long, n_single long, log_sum double"


def backoff_scores(known: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Per word of a document the log score and the order it was taken from, given the counts of its n-grams by order.

    Scores of order 1 lack the division by the corpus size.
    """
    n, order = len(known[0]), len(known)
    score, used = np.log(known[0]), np.ones(n, np.int64)
    for k in range(2, order + 1):
        seen = known[k - 1] >= LEAST_COUNT  # of the n-gram that ends at word k - 1 + place
        ends = np.nonzero(seen)[0] + k - 1
        score[ends], used[ends] = np.log(known[k - 1][seen] / known[k - 2][: len(seen)][seen]), k
    highest = np.minimum(np.arange(n) + 1, order)  # the first words have no longer history
    return score + (highest - used) * np.log(BACKOFF), used


def _sum(groups: DataFrame, totals: DataFrame, order: int) -> DataFrame:
    """Per document: words, how many have a lower order than the highest, how many the lowest, and the sum of log scores without the corpus size."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        ones = _hashes(docs.column("text"))
        keys, place = _distinct(ones, order, inverse=True)
        if len(keys):
            rank = np.argsort(answers.column("range").to_numpy())
            parts = answers.column("totals").to_pylist()
            known = np.concatenate([_unplaned(parts[k], np.uint64) for k in rank]).astype(float)[place]
        else:
            known = np.empty(0)
        sizes = _sizes(ones, order)
        starts = np.r_[0, np.cumsum(sizes.ravel())[:-1]].reshape(sizes.shape) if sizes.size else sizes
        out = []
        for d, one in enumerate(ones):
            if not len(one):
                out.append((0, 0, 0, 0.0))
                continue
            score, used = backoff_scores([known[starts[k, d] : starts[k, d] + sizes[k, d]] for k in range(order)])
            out.append((len(one), int((used < order).sum()), int((used == 1).sum()), float(score.sum())))
        columns = zip(*out) if out else ([], [], [], [])
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        names = ("n_words", "n_backed", "n_single", "log_sum")
        return pa.table({"doc_id": docs.column("doc_id"), "times": docs.column("times"), **{n: pa.array(list(c), t) for n, c, t in zip(names, columns, kinds)}})

    return groups.groupBy("group").cogroup(totals.groupBy("group")).applyInArrow(run, _SUMS)


def _merged(rows: DataFrame) -> tuple[DataFrame, int, bool]:
    """(doc_id, text, times), the bytes of all texts, and whether equal rows are one: they are where some make up more than a group.

    Only hashes and sizes move to find that out, combined before.
    """
    alike = rows.groupBy(F.xxhash64("doc_id", "text").alias("key")).agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("n"))
    size, largest = alike.agg(F.sum("bytes"), F.max(F.when(F.col("n") > 1, F.col("bytes")))).first()
    hot = (largest or 0) > GROUP_BYTES
    if hot:
        return rows.groupBy("doc_id", "text").agg(F.count("*").alias("times")), size, hot
    return rows.withColumn("times", F.lit(1).cast("long")), size or 0, hot


def _copied(sums: DataFrame) -> DataFrame:
    """Every row as often as ``times`` says, dealt over tasks in parts of COPIES."""
    parts = sums.withColumn("part", F.explode(F.sequence(F.lit(0), F.expr(f"(times - 1) div {COPIES}").cast("int")))).repartition("doc_id", "part")
    left = F.least(F.lit(COPIES).cast("long"), F.col("times") - F.col("part") * F.lit(COPIES))
    return parts.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), left))).drop("part", "copy")


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """(doc_id, n_words, n_backed, score): the mean log stupid-backoff score of each document under all documents.

    A word scores c(h w) / c(h) after the longest history h of up to
    ``order`` - 1 words with which it is in the table, times BACKOFF for each
    word that was left out of the history; without any, c(w) / N. ``n_backed``
    counts words with a history shorter than ``order`` - 1. Words are cut at
    white space, with A-Z lower-cased. N-grams are known by 64-bit hashes: two
    of 10**9 different ones share theirs with a chance of some 3 %. Defined
    cases: documents without words have a null score; rows that repeat count
    and are scored each; ids may be null or repeat; an empty table gives an
    empty one; other columns are ignored.
    """
    wanted = docs.select(column_or_null(docs, id_col, "long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows, size, hot = _merged(wanted.filter(worded))
    groups, ranges = max(1, -(-size // GROUP_BYTES)), max(1, -(-size // RANGE_BYTES))
    dealt = rows.withColumn("group", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int"))
    sums = cut(_sum(dealt, _join_counts(_explode(dealt, order, ranges)), order))
    corpus = sums.agg(F.sum(F.col("n_words") * F.col("times"))).first()[0] or 1
    sums = _copied(sums) if hot else sums
    score = (F.col("log_sum") - F.col("n_single") * F.lit(float(np.log(corpus)))) / F.col("n_words")
    none = wanted.filter(~worded).select("doc_id", *(F.lit(0).cast("long").alias(c) for c in ("n_words", "n_backed")), F.lit(None).cast("double").alias("score"))
    return sums.select("doc_id", "n_words", "n_backed", score.alias("score")).unionByName(none)
