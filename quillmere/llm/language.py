"""Language identification: the lowest length-normalised cross-entropy, with calibrated rejection."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmere.llm.charlm import GROUP, CharModels, grams, symbols
from quillmere.llm.common import SLICE, map_rows

UNKNOWN = "und"
#: The classifier is fitted on at most so many labelled documents of each language, those with the lowest hashes.
DOCS_PER_LANGUAGE = 1000
#: One in so many of them, never the first ones, sets the rejection limit and counts for nothing else.
CALIBRATE_ONE_IN = 5
#: Texts are short below so many symbols; beginnings of half that length calibrate them along with short texts.
SHORT = 120
#: Share of calibration documents within the limit before it is widened, and by how much it is.
KEEP, SLACK = 0.999, 2.0
#: Calibrated limits are kept between these: numbers and keys in a short text, or a few odd calibration documents, move
#: them too far else. With fewer calibration texts of a language and length class than ENOUGH it is USUAL_LIMIT,
#: one nat per symbol over long texts.
ENOUGH, LEAST_LIMIT, USUAL_LIMIT = 30, 9.0, 14.0
#: Length at which the spread of cross-entropies stops to shrink, in symbols.
LONG = 200


@dataclass
class Identifier:
    """Models and, per language, the usual cross-entropy and the rejection limits of short and of longer texts."""

    models: CharModels
    usual: np.ndarray
    limit: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, accepted); ``und``, 0 and False without a letter or a model."""
        found = symbols(text)
        if not len(found) or not self.models.languages:
            return UNKNOWN, 0.0, False
        entropy = self.models.cross_entropy(found)
        best = int(np.argmin(entropy))
        gaps = np.minimum((entropy - entropy[best]) * len(found), 700.0)
        excess = distance(entropy[best], self.usual[best], len(found)) / self.limit[best, int(len(found) >= SHORT)]
        score = 1 / np.exp(-gaps).sum() / (1 + np.exp(min(60.0, 8 * (excess - 1))))
        return self.models.languages[best], float(score), bool(excess <= 1)


def distance(entropy, usual, length):
    """How far a cross-entropy lies above the usual one, in units that suit short texts as well as long ones."""
    return (entropy - usual) * np.sqrt(length / (1 + length / LONG))


def held_out(id_col: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text has that remainder; rows without an id count as held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % modulus == remainder, F.lit(True))


def _sample(docs: DataFrame, per_language: int) -> DataFrame:
    """(lang, text, rank) of a bounded number of documents per language.

    Ids and languages are read first, without texts. Hashes under a share of
    their range, twice the bound over the number of different ids of the
    language (estimated by a sketch), leave some two times the bound of each;
    those are ranked. Rows that share an id are ranked by the hash of their text.
    """
    counts = docs.groupBy("lang").agg(F.approx_count_distinct("id", 0.02).alias("n"))  # a row per language
    unit = F.shiftrightunsigned(F.xxhash64("id"), 12) * F.lit(2.0**-52)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    few = docs.select("id", "lang").join(F.broadcast(counts), "lang").filter(unit * F.col("n") < 2.0 * per_language + 50).select("id", "lang").distinct()
    ids = few.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_language)
    rows = docs.join(F.broadcast(ids), ["id", "lang"])  # per_language ids of each language
    again = Window.partitionBy("lang").orderBy("rank", F.xxhash64("text"), "text")
    return rows.select("lang", "text", F.row_number().over(again).alias("rank")).filter(F.col("rank") <= per_language)


def _counts(sample: DataFrame) -> DataFrame:
    """(lang, gram, n): counts of packed n-grams, combined before the shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                by: dict[str, list[np.ndarray]] = {}
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    by.setdefault(lang, []).append(grams(symbols(text)))
                for lang, found in by.items():
                    keys, n = np.unique(np.concatenate(found), return_counts=True)
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(keys), pa.string()), "gram": keys.view(np.int64), "n": n})

    return sample.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _models(counts: DataFrame) -> CharModels:
    """Tables are built for one group of languages after the other, so that the driver holds the counts of one only."""
    counts = counts.persist()
    languages = [r.lang for r in counts.select("lang").distinct().orderBy("lang").collect()]
    alphabet = counts.select((F.col("gram").bitwiseAND(0xFFFF)).alias("symbol")).distinct().count() + 1
    groups = []
    for at in range(0, len(languages), GROUP):
        own = counts.filter(F.col("lang").isin(languages[at : at + GROUP])).toArrow()
        langs, keys, n = (own.column(k).to_numpy() for k in ("lang", "gram", "n"))
        groups += CharModels.fit({x: (keys[langs == x].view(np.uint64), n[langs == x]) for x in languages[at : at + GROUP]}, alphabet).groups
    counts.unpersist()
    return CharModels(groups)


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int = DOCS_PER_LANGUAGE) -> Identifier:
    """Fit on labelled rows of ``docs``; the caller leaves out what may not be learned from.

    Every language that has a label with a letter in some text is learned. Rows
    without text or language teach nothing; ids may repeat, their rows are
    documents of their own; without any row the result knows no language. What
    is broadcast grows with ``per_language`` and the number of languages.
    """
    labelled = docs.select(
        F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")
    ).filter("id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    sample = _sample(labelled, per_language).persist()
    models = _models(_counts(sample.filter(F.col("rank") % CALIBRATE_ONE_IN != 0)))
    usual, limit = np.zeros(len(models.languages)), np.full((len(models.languages), 2), USUAL_LIMIT)
    if models.languages:
        shared = sample.sparkSession.sparkContext.broadcast(models)

        def entropies(lang, text):
            """Length and cross-entropy of the text, and of its beginning where that is another text."""
            found, out = symbols(text), []
            if lang in shared.value.languages:
                place = shared.value.languages.index(lang)
                for n in {len(found), SHORT // 2} if len(found) > SHORT // 2 else {len(found)} - {0}:
                    out.append({"length": n, "entropy": float(shared.value.cross_entropy(found[:n])[place]), "whole": n == len(found)})
            return lang, out

        schema = "lang string, found array<struct<length: long, entropy: double, whole: boolean>>"
        kept = sample.filter(F.col("rank") % CALIBRATE_ONE_IN == 0).select("lang", "text")
        rows = map_rows(kept, entropies, schema).select("lang", F.inline("found")).collect()  # bounded as the sample is
        for k, lang in enumerate(models.languages):
            own = [r for r in rows if r.lang == lang]
            whole = [(r.entropy, r.length) for r in own if r.whole] or [(np.log(100), 1)]
            e, n = map(np.array, zip(*whole))
            usual[k] = np.average(e, weights=np.minimum(n, LONG))
            for long in (0, 1):
                far = [distance(r.entropy, usual[k], r.length) for r in own if (r.length >= SHORT) == bool(long)]
                calibrated = SLACK * np.quantile(far, KEEP) if far else 0.0
                limit[k, long] = min(USUAL_LIMIT, max(calibrated, USUAL_LIMIT if len(far) < ENOUGH else LEAST_LIMIT))
    sample.unpersist()
    return Identifier(models, usual, limit)


def identify(docs: DataFrame, identifier: Identifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, accepted), one row per row of ``docs``, by one pass without a shuffle.

    Defined cases: a null text or one without a letter gives ``und``, score 0,
    not accepted; equal cross-entropies give the language that sorts first; ids
    may be null or repeat; an empty table gives an empty one; other columns are
    ignored. The models that are broadcast are bounded by the fitting sample.
    """
    shared = docs.sparkSession.sparkContext.broadcast(identifier)

    def one(doc_id, text):
        return doc_id, *shared.value.predict(text)

    wanted = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(wanted, one, "doc_id long, lang_pred string, score double, accepted boolean")


def keep_known(docs: DataFrame, identifier: Identifier, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that are rejected, columns and their types as they are.

    Defined cases: rows whose text is null or has no letter go, and so do all
    where no language is known; repeated rows stay or go together; an empty
    table gives an empty one; other columns, whatever their names, are returned
    as they are. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(identifier)
    place = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                yield part.filter(pa.array([shared.value.predict(x)[2] for x in part.column(place).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
