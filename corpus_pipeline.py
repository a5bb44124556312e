"""From raw documents to token ids in five stages, each over all that the one before kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again for the next
one. All but the last return the columns of ``documents``.

1. language_id    rejects documents without letters and those that no learned language explains
2. simhash_dedup  keeps one document of each near-duplicate group, that with the smallest id (of none, the lowest hash)
3. secrets        replaces secrets by a placeholder; every document stays
4. mixture        repeats or leaves out documents by source, so that sources come near their target weights
5. sentencepiece  gives the piece ids of every document and the text decoded from them
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.llm.common import ensure_checkpoint_dir, table
from quillmere.llm.language import fit, held_out, keep_known
from quillmere.llm.mixture import mixed_documents
from quillmere.llm.pieces import encode_documents
from quillmere.llm.queries import tokenizer_path
from quillmere.llm.secrets import redact_documents
from quillmere.llm.simhash import keep_first


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learned from the same part of the documents as the query of this operator.

    Rows without text or letters go, and so do all where nothing can be
    learned; ids may be null (such rows teach nothing) or repeat. An empty table
    gives an empty one, as in every stage.
    """
    return keep_known(docs, fit(docs.filter(~held_out(F.col("doc_id"), 4, 2)), "doc_id", "text", "lang"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays, also where ids repeat or are null; texts without words are one group."""
    return keep_first(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays; null and clean texts as they are. An empty table gives an empty one."""
    import public_tokenizers

    return redact_documents(docs, tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, each as often as the mix takes at least half of it; texts without words have no part in the mix.

    Rows that differ in any column, or in which one is null, are different
    documents; equal rows count together. An empty table gives an empty one.
    """
    return mixed_documents(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every row; a null text has no ids."""
    return encode_documents(docs, tokenizer_path("piece_bpe_32k.model"), outputs="text")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("secrets", secrets),
    ("mixture", mixture),
    ("sentencepiece", sentencepiece),
]

#: SQL has neither these models nor SentencePiece; tests hold the stages against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table ``documents``.

    What lies between stages is written to the shared checkpoint folder and
    removed once the next stage is there; the input of the last one, which is
    read when the result is, stays.
    """
    ensure_checkpoint_dir(spark)
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")
    folder = f"{folder}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
            if before:
                _remove(spark, before)
            before = f"{folder}/{k}-{name}"
    return docs


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
