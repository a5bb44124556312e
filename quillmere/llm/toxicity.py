"""Toxicity by multiple-instance learning: a document is toxic if one of its sentences is.

Each sentence has a probability, the logistic function of the weights of its
words; a document's is the noisy-or of its sentences, 1 - prod(1 - p). Only
document labels are known, and the gradient of the noisy-or tells how far each
sentence accounts for its document, so sentences are scored without ever being
labelled, and offending ones can be located.

A word counts by itself and by its beginnings, so that inflected forms of an
offensive stem share what is learned about it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.llm.common import map_rows

#: By default the classifier is fitted on at most so many labelled documents of either class, those with the lowest hashes.
TOXIC_DOCS, CLEAN_DOCS = 4000, 6000
#: At most so many word features get a weight: those whose share of toxic documents is the least likely by chance,
#: and only those for which twice the log likelihood ratio of that share reaches LEAST_RATIO.
FEATURES, LEAST_TOXIC_DOCS, LEAST_RATIO = 20_000, 3, 20.0
#: Lengths of the word beginnings that are features.
BEGINNINGS = range(4, 10)
RATE, RIDGE = 0.2, 0.003
#: Training ends when the loss falls in so many rounds by less than this share of what it was at first, or after the most rounds.
SETTLED, WINDOW, MOST_ROUNDS = 1e-4, 25, 1000
#: Words whose weights a worker keeps.
MEMO_ENTRIES = 200_000

_BREAK = re.compile(r"[.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")


def sentences(text: str | None) -> Iterator[tuple[int, int]]:
    """(start, end) of each sentence in code points; one empty sentence for a text without any."""
    text, at, some = text or "", 0, False
    for stop in [*_BREAK.finditer(text), None]:
        end = stop.start() if stop else len(text)
        if end > at:
            some = True
            yield at, end
        at = stop.end() if stop else end
    if not some:
        yield 0, 0


def words(sentence: str) -> set[str]:
    return set(_WORD.findall(sentence.lower()))


def features(word: str) -> list[str]:
    """The word with an end mark, and its beginnings."""
    return [word + "$", *(word[:n] for n in BEGINNINGS if n <= len(word))]


@dataclass
class Detector:
    """Weights of word features and the bias of a sentence."""

    weights: dict[str, float]
    bias: float
    memo: dict[str, float] = field(default_factory=dict)

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "memo": {}}

    def _weight(self, word: str) -> float:
        if len(self.memo) >= MEMO_ENTRIES:
            self.memo.clear()
        found = self.memo[word] = sum(self.weights.get(f, 0.0) for f in features(word))
        return found

    def logits(self, text: str | None) -> tuple[list[tuple[int, int]], np.ndarray]:
        """Sentences and their logits."""
        text = text or ""
        spans, out, known = list(sentences(text)), [], self.memo.get
        for start, end in spans:
            total = self.bias
            for word in words(text[start:end]):
                weight = known(word)
                total += self._weight(word) if weight is None else weight
            out.append(total)
        return spans, np.array(out)

    def score(self, text: str | None) -> tuple[float, int, int, int]:
        """(score, offending sentences, start and end of the worst one)."""
        spans, z = self.logits(text)
        worst = int(np.argmax(z))
        return noisy_or(z), int((z >= 0).sum()), *spans[worst]

    def locate(self, text: str | None, least: float = 0.5) -> list[tuple[int, int, float]]:
        """(start, end, probability) of the sentences that are toxic by themselves."""
        spans, z = self.logits(text)
        p = 1 / (1 + np.exp(-z))
        return [(a, b, float(x)) for (a, b), x in zip(spans, p) if x >= least]


def noisy_or(z: np.ndarray) -> float:
    """1 - prod(1 - sigmoid(z)), in logarithms."""
    return float(-np.expm1(-np.logaddexp(0, z).sum()))


def _sample(docs: DataFrame, labels: DataFrame, toxic_docs: int, clean_docs: int) -> DataFrame:
    """(doc_id, text, toxic) of the labelled documents to learn from; of rows that share an id, the one whose text has the lowest hash."""
    def lowest(kind: int, most: int) -> DataFrame:
        return labels.filter(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    chosen = lowest(1, toxic_docs).unionByName(lowest(0, clean_docs))
    rows = docs.join(F.broadcast(chosen), "doc_id")  # toxic_docs + clean_docs ids
    first = F.min(F.struct(F.xxhash64("text").alias("hash"), "text", "toxic")).alias("row")
    return rows.groupBy("doc_id").agg(first).select("doc_id", "row.text", "row.toxic")


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    toxic_docs: int = TOXIC_DOCS,
    clean_docs: int = CLEAN_DOCS,
    most_features: int = FEATURES,
) -> Detector:
    """Learn from the labelled rows that are passed; without toxic ones among them every score is near 0.

    Of several labels of one document the highest counts; rows without id or
    label teach nothing; of several texts under one id one is taken, in every
    run the same. ``toxic_docs``, ``clean_docs`` and ``most_features`` bound what
    the driver holds, with the number of sentences that differ in their features.
    """
    known = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
        .filter("doc_id IS NOT NULL AND toxic IN (0, 1)")
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    count = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    if not count.get(1):
        return Detector({}, -20.0)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id IS NOT NULL")
    sample = _sample(texts, known, toxic_docs, clean_docs).persist()
    vocabulary = _vocabulary(sample, most_features)
    shared = sample.sparkSession.sparkContext.broadcast(vocabulary)

    def rows(doc_id, text, toxic):
        return toxic, *sentence_kinds(text, shared.value)

    schema = "toxic int, empty int, times array<int>, kinds array<string>"
    learned = map_rows(sample.select("doc_id", "text", "toxic").orderBy("doc_id"), rows, schema).toArrow()
    sample.unpersist()
    return _train(learned, vocabulary, count)


def sentence_kinds(text: str | None, vocabulary: dict[str, int]) -> tuple[int, list[int], list[str]]:
    """What training needs of a document: the number of sentences without a chosen feature, and how often each kind of
    other sentences is there. A kind is one set of features, their numbers joined by commas."""
    kinds = Counter(
        ",".join(map(str, sorted(vocabulary[f] for w in words((text or "")[start:end]) for f in features(w) if f in vocabulary)))
        for start, end in sentences(text)
    )
    empty = kinds.pop("", 0)
    return empty, list(kinds.values()), list(kinds)


def _vocabulary(sample: DataFrame, most: int) -> dict[str, int]:
    """The features whose toxic share exceeds the expected beyond chance, numbered."""
    def one(text, toxic):
        return toxic, list({f for start, end in sentences(text) for w in words((text or "")[start:end]) for f in features(w)})

    found = map_rows(sample.select("text", "toxic"), one, "toxic int, features array<string>")
    share = sample.agg(F.avg("toxic")).first()[0] or 0.0
    counts = (
        found.select("toxic", F.explode("features").alias("feature"))
        .groupBy("feature")
        .agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n"))
        .filter(F.col("toxic") >= LEAST_TOXIC_DOCS)
        .withColumn("ratio", 2 * F.col("toxic") * F.ln(F.col("toxic") / (F.col("n") * F.lit(share))))
        .filter(F.col("ratio") >= LEAST_RATIO)
        .orderBy(F.desc("ratio"), "feature")
        .limit(most)
    )
    return {r.feature: i for i, r in enumerate(counts.collect())}


@dataclass
class Bags:
    """Documents as bags of sentences, in flat arrays.

    Per document its label, weight and number of sentences without features;
    per entry a document, a kind of sentence and how often it is there; per
    feature of a kind that kind. Kinds are told apart over all documents, so
    that what is costly is done once for each.
    """

    label: np.ndarray
    weight: np.ndarray
    empty: np.ndarray
    doc: np.ndarray
    entry: np.ndarray
    times: np.ndarray
    kind: np.ndarray
    feature: np.ndarray
    kinds: int

    @staticmethod
    def of(rows: pa.Table, count: dict[int, int]) -> Bags:
        """Clean documents weigh as in all labels."""
        label = rows.column("toxic").to_numpy().astype(float)
        times, kinds = (rows.column(c).combine_chunks() for c in ("times", "kinds"))
        doc = np.repeat(np.arange(len(label)), np.diff(times.offsets.to_numpy()))
        coded = kinds.flatten().dictionary_encode()
        names = coded.dictionary.to_pylist()
        feature = np.array([int(i) for x in names for i in x.split(",")], np.int64)
        weight = np.where(label == 1, count[1] / max(1.0, label.sum()), count.get(0, 0) / max(1.0, (1 - label).sum()))
        weight *= len(label) / max(1e-300, weight.sum())
        return Bags(
            label, weight, rows.column("empty").to_numpy().astype(float), doc, coded.indices.to_numpy().astype(np.int64),
            times.flatten().to_numpy().astype(float), np.repeat(np.arange(len(names)), [x.count(",") + 1 for x in names]).astype(np.int64), feature, len(names),
        )

    def loss(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        """Weighted log loss of the noisy-or with a ridge on the weights, and its gradient; the last of ``x`` is the bias."""
        sigmoid = lambda z: 1 / (1 + np.exp(-z))
        z = x[-1] + np.bincount(self.kind, x[self.feature], self.kinds)
        none = np.bincount(self.doc, self.times * np.logaddexp(0, z)[self.entry], len(self.label)) + self.empty * np.logaddexp(0, x[-1])  # -log(1 - P)
        none = np.clip(none, 1e-9, 500)
        toxic = self.label == 1
        loss = (self.weight * np.where(toxic, -np.log(-np.expm1(-none)), none)).sum() + RIDGE / 2 * (x[:-1] ** 2).sum()
        pull = self.weight * np.where(toxic, -1 / np.expm1(none), 1.0)
        by_kind = np.bincount(self.entry, pull[self.doc] * self.times, self.kinds) * sigmoid(z)
        gradient = np.empty_like(x)
        gradient[:-1] = np.bincount(self.feature, by_kind[self.kind], len(x) - 1) + RIDGE * x[:-1]
        gradient[-1] = by_kind.sum() + (pull * self.empty).sum() * sigmoid(x[-1])
        return float(loss), gradient


def _train(rows: pa.Table, vocabulary: dict[str, int], count: dict[int, int]) -> Detector:
    """Minimise the loss by Adam until it has settled."""
    bags = Bags.of(rows, count)
    if not bags.label.sum():
        return Detector({}, -20.0)
    x = np.zeros(len(vocabulary) + 1)
    x[-1] = -4.0
    first, second, losses = np.zeros_like(x), np.zeros_like(x), []
    for step in range(1, MOST_ROUNDS + 1):
        loss, gradient = bags.loss(x)
        losses.append(loss)
        if step > WINDOW and losses[-1 - WINDOW] - loss < SETTLED * losses[0]:
            break
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        x -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Detector({f: float(x[i]) for f, i in vocabulary.items() if abs(x[i]) > 1e-4}, float(x[-1]))


def score_documents(docs: DataFrame, detector: Detector, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted, n_offending, worst_start, worst_end) of every whole text, without a shuffle.

    Defined cases: null and empty texts are one empty sentence; ids may be null
    or repeat; of equally bad sentences the first is the worst; an empty table
    gives an empty one; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(detector)

    def one(doc_id, text):
        score, *rest = shared.value.score(text)
        return doc_id, score, int(score >= 0.5), *rest

    schema = "doc_id long, score double, predicted int, n_offending int, worst_start int, worst_end int"
    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), one, schema)


def locate_sentences(docs: DataFrame, detector: Detector, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start_at, end_at, probability) of each sentence that is toxic by itself, places in code points.

    Defined cases: documents without such a sentence, null and empty ones among
    them, give no row; ids may be null or repeat, and repeated rows give their
    sentences each; an empty table gives an empty one; other columns are
    ignored. Whole texts are read, without a shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(detector)

    def one(doc_id, text):
        return doc_id, [dict(zip(("start_at", "end_at", "probability"), x)) for x in shared.value.locate(text)]

    schema = "doc_id long, found array<struct<start_at: int, end_at: int, probability: double>>"
    wanted = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(wanted, one, schema).select("doc_id", F.inline("found"))
