"""Rendezvous hashing of stable record keys over weighted shards, with gapless slots.

A record goes to the shard with the least ``-ln(u) / weight``, where u in (0, 1)
hashes key and shard. A shard that is added can only win records for itself, so
few move, and a heavier shard wins in proportion. This is a row expression: no
shuffle. Slots are running counts within a shard in two levels: counts of
``BUCKETS`` hash ranges of each shard, whose number is bounded, and running
counts within a range. The ranges are of whole rows (key, size and checksum), so
rows of one hot key spread over all ranges of its shard.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmere.llm.common import column_or_null

#: Hash ranges of a shard that are numbered apart. Offsets are shards * BUCKETS rows.
BUCKETS = 256
#: Slots that one row gives at once.
PART = 4096


def _scores(key: Column, weights: Sequence[float]) -> Column:
    """Array of (score, shard) for every shard."""
    heavy = F.array(*(F.lit(float(w)) for w in weights))
    hashed = F.xxhash64(F.coalesce(key.cast("string"), F.lit("")))

    def score(shard: Column) -> Column:
        unit = (F.shiftrightunsigned(F.xxhash64(hashed, shard), 12).cast("double") + F.lit(0.5)) * F.lit(2.0**-52)
        return F.struct((-F.ln(unit) / F.element_at(heavy, shard + 1)).alias("score"), shard.alias("shard"))

    return F.transform(F.sequence(F.lit(0), F.lit(len(weights) - 1)), score)


def _with_growth(key: Column, weights: Sequence[float], grown_by: float) -> Column:
    """struct<shard, grown>: the shard among ``weights`` and with one more; every score is taken once."""
    both = lambda scores: F.struct(
        F.array_min(F.slice(scores, 1, len(weights)))["shard"].alias("shard"), F.array_min(scores)["shard"].alias("grown")
    )
    return F.element_at(F.transform(F.array(_scores(key, [*weights, grown_by])), both), 1)


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """Shard number of a key among shards of these positive weights; a null key counts as ''."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    return F.array_min(_scores(key, weights))["shard"]


def shard_records(
    docs: DataFrame,
    weights: Sequence[float],
    grown_by: float = 1.0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Place every row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``grown_shard`` is the shard if one more of weight ``grown_by`` is there.
    Defined cases: a null text has size 16 and a null crc32; a null id is the
    key ''; repeated rows get a slot each; an empty table gives an empty one;
    other columns are ignored. Texts don't move; ids, sizes and checksums
    do, and equal ones are counted before.
    """
    spread = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text_crc32"), F.lit(-1)), "size")
    sized = docs.select(
        column_or_null(docs, id_col, "long").alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 16).alias("size"),
        F.crc32(F.col(text_col).cast("binary")).alias("text_crc32"),
    )
    # rows that are equal so far are one row with a count, however many they are
    distinct = sized.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    placed = distinct.select("*", _with_growth(F.col("doc_id"), weights, grown_by).alias("to"), F.pmod(spread, F.lit(BUCKETS)).alias("bucket")).select(
        "doc_id", "size", "text_crc32", "n", "bucket", F.col("to.shard").alias("shard"), F.col("to.grown").alias("grown_shard")
    )
    counts = placed.groupBy("shard", "bucket").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("offset") + F.coalesce(F.sum("n").over(within), F.lit(0))
    return (
        placed.join(F.broadcast(offsets), ["shard", "bucket"])  # shards * BUCKETS rows at most
        .withColumn("first", first)
        .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {PART}"))))  # no array of all slots of a hot row
        .withColumn("from", F.col("first") + F.col("part") * PART)
        .withColumn("slot", F.explode(F.sequence("from", F.least(F.col("from") + PART, F.col("first") + F.col("n")) - 1)))
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
    )
