"""SimHash near-duplicates by multi-index hashing.

Fingerprints of 64 bits link when they differ in at most two. Each is cut into
two segments of 32 bits. Of two linked fingerprints, either the upper segments
differ in at most one bit or the lower ones are equal (otherwise there would be
two differences above and one below). So every fingerprint looks up the ball of
radius 1 around its upper segment (33 values) and its own lower segment
(1 value) in the tables of segments, and the complete distance of what is found
is verified. That loses no link.

Equal fingerprints are one entry of the tables. A segment value that more than
``dense`` different fingerprints share would make pairs with the square of its
size; there the fingerprints that look it up are compared through the ball of
radius 1 around the *whole* fingerprint: two numbers within distance two share
an element of those balls, and all who share an element are within distance
two. Such a group holds 65 members at most, so this stays linear and exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.llm.common import cut, map_rows, row_key
from quillmere.llm.fingerprint import simhash
from quillmere.llm.graph import connected_components

#: Different fingerprints that may share a segment value before whole balls are used there.
DENSE = 64
_LOW = 0xFFFFFFFF


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp): the signed 64-bit SimHash of each whole text; one row per row of ``docs``."""

    def one(doc_id, text):
        value = simhash(text, width)
        return doc_id, value - (1 << 64) if value >> 63 else value

    return map_rows(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), one, "doc_id long, fp long")


def _segments(fps: DataFrame) -> DataFrame:
    """Table of segments: (seg, value, fp)."""
    return fps.select(
        "fp", F.posexplode(F.array(F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(_LOW)))).alias("seg", "value")
    )


def _probes(fps: DataFrame) -> DataFrame:
    """What each fingerprint looks up: 33 values of segment 0, one of segment 1."""
    upper, lower = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(_LOW))
    entry = lambda seg, value: F.struct(F.lit(seg).alias("seg"), value.alias("value"))
    ball = [entry(0, upper)] + [entry(0, upper.bitwiseXOR(F.lit(1 << i).cast("long"))) for i in range(32)]
    return fps.select(F.col("fp").alias("probe"), F.inline(F.array(*ball, entry(1, lower))))


def near_links(fps: DataFrame, dense: int = DENSE) -> DataFrame:
    """Links (src, dst) that connect exactly the fingerprints at most two bits apart.

    ``fps`` holds different fingerprints in ``fp``. In sparse parts every pair
    is a row; where segments are dense, each fingerprint is linked to the least
    of each group of mutual neighbours instead, which connects the same.
    """
    table = _segments(fps)
    sizes = table.groupBy("seg", "value").agg(F.count("*").alias("n"), F.min("fp").alias("first"))
    entries = table.join(sizes, ["seg", "value"]).filter((F.col("n") <= dense) | (F.col("fp") == F.col("first")))
    found = (
        _probes(fps)
        .join(entries, ["seg", "value"])
        .filter((F.col("n") > dense) | ((F.col("probe") != F.col("fp")) & (F.bit_count(F.col("probe").bitwiseXOR(F.col("fp"))) <= 2)))
        .select("probe", "fp", (F.col("n") > dense).alias("crowded"))
    )
    found = cut(found.distinct())
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    groups = (
        found.filter("crowded")
        .select(F.col("probe").alias("fp"))
        .distinct()
        .select("fp", F.explode(F.concat(F.array("fp"), bits)).alias("near"))
        .groupBy("near")
        .agg(F.collect_set("fp").alias("members"))
        .filter(F.size("members") > 1)
        .select(F.explode("members").alias("src"), F.array_min("members").alias("dst"))
    )
    return found.filter("NOT crowded").select(F.col("probe").alias("src"), F.col("fp").alias("dst")).unionByName(groups)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, dense: int = DENSE
) -> DataFrame:
    """One row per document: doc_id, fp (signed), component_id (smallest doc_id reachable by links, itself included).

    Defined cases: null, empty and blank texts have fingerprint 0 and link like
    any other; repeated rows (also with one id) keep a row each; rows without
    an id get a component but never name one (null if none of it has an id);
    an empty table gives an empty one; other columns of ``docs`` are ignored.
    Whole texts are read once, then only numbers move.
    """
    marked = cut(fingerprints(docs, id_col, text_col, width))
    rooted = _rooted(cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least"))), dense)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def _rooted(classes: DataFrame, dense: int = DENSE) -> DataFrame:
    """``classes``, one row per different ``fp``, with ``root``: the smallest fingerprint reachable by links."""
    roots = connected_components(near_links(classes.select("fp"), dense)).select(F.col("node").alias("fp"), "root")
    return classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``docs`` with exactly one row of each near-duplicate group: one with the smallest id.

    Groups are told apart by their fingerprints, so ids may repeat within and
    across groups. Of rows of a group that share its smallest id, and of groups
    without any id, the row with the lowest hash stays, so reruns keep the
    same. All columns are returned. Rows equal in all columns are one before
    they move.
    """

    def one(doc_id, text, a, b):
        value = simhash(text, width)
        return doc_id, value - (1 << 64) if value >> 63 else value, a, b

    key = row_key(docs)
    wanted = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *key)
    marked = cut(map_rows(wanted, one, "doc_id long, fp long, a long, b long"))
    place = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "a", "b")
    classes = cut(marked.groupBy("fp").agg(F.min(place).alias("first")))
    kept = _rooted(classes).groupBy("root").agg(F.min("first").alias("first")).select("first.a", "first.b")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *key).dropDuplicates(["a", "b"])
    return rows.join(kept, ["a", "b"], "left_semi").select("row.*")
