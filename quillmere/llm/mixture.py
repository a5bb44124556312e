"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Every source is a stream of its documents in hash order, repeated as often as
its target asks, and cut into blocks of ``block`` words. Slot n of the mix
belongs to the source whose part of the cumulative weights holds the golden
ratio point frac(n * phi); slots are ranked per source and slot rank r takes
block r of the stream. So any stretch of the mix comes near the target weights,
and a source gives exactly its target, cut to whole words.

Running sums are taken in two levels (counts of many small parts, then sums
within a part), so a source that holds most documents spreads over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmere.llm.common import cut, row_key

#: Words in a block, hex digits that make the hash ranges of a source's stream, slots ranked at once, and cells of the weight axis.
BLOCK, BUCKET_DIGITS, CHUNK, CELLS = 128, 3, 4096, 4096
#: A hash range with so many rows more than four times what is usual in its source holds a hot id; its rows are cut by so many leading bits of their hashes.
HOT_ROWS, HOT_BITS = 50_000, 8
#: frac(n * phi) in 32 bits; n repeats after 2**31 slots, which keeps products within a long.
_GOLDEN, _PERIOD, _UNIT = 2654435769, 1 << 31, 1 << 32
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def target_table(sized: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(source, number, source_size, target): water-filling of ``share`` of all words under caps.

    Sources by code point, null last, take the weights in turn. Caps fill in
    the order of cap / weight; the level at which the rest shares what is left
    follows from running sums over the sources, one row each.
    """
    totals = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = totals.withColumn("number", F.row_number().over(order) - 1).withColumn(
        "weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("number") % len(weights) + 1).cast("int"))
    )
    cap = F.col("source_size") * F.lit(float(most))
    filled = Window.orderBy(cap / F.col("weight"), "number")
    lower = filled.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.col("wanted") - F.col("capped")) / F.col("open_weight")
    return (
        ranked.withColumns(
            {
                "wanted": F.sum("source_size").over(everything) * F.lit(float(share)),
                "capped": F.coalesce(F.sum(cap).over(lower), F.lit(0.0)),
                "open_weight": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(lower), F.lit(0.0)),
            }
        )
        .withColumn("level", F.max(F.when(level * F.col("weight") <= cap, level)).over(everything))
        .select("source", "number", "source_size", F.least(cap, F.coalesce(F.col("level") * F.col("weight"), cap)).alias("target"))
    )


def _streams(docs: DataFrame, id_col: str, text_col: str, source_col: str, row_hash: Column) -> DataFrame:
    """One row per document with its size and place in hash order; texts stay behind."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
        row_hash.alias("row_hash"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("spread"),
    ).withColumn("bucket", F.substring("spread", 1, BUCKET_DIGITS))


def plan_mixture(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    block: int = BLOCK,
) -> tuple[DataFrame, DataFrame]:
    """(placed, schedule) of a mix of ``share`` of all words.

    placed: every row of ``docs`` as doc_id, source, size, row_hash, number,
    source_size, target, start (its first word in the source's stream).
    schedule: number, slot, block, start, pass, doc words [from_word, to_word)
    - in the order of ``slot`` the mix itself; (number, start) names the row.
    Defined cases: null and blank texts have size 0, a place and no part of the
    mix; a null source is a source; rows that repeat take part each; a source's
    rows are ordered by the MD5 of their id, then by their own hashes, so reruns
    agree; an id may have any number of rows; an empty table gives two empty
    ones; other columns are kept out.
    """
    sized = cut(_streams(docs, id_col, text_col, source_col, F.struct(*row_key(docs))))
    targets = cut(target_table(sized, weights, share, most))
    numbered = sized.join(targets, sized["source"].eqNullSafe(targets["source"])).select(sized["*"], "number", "source_size", "target")
    sums = cut(numbered.groupBy("number", "bucket").agg(F.sum("size").alias("n"), F.count("*").alias("rows")))
    earlier = Window.partitionBy("number").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    usual = F.sum("rows").over(Window.partitionBy("number")) / 16**BUCKET_DIGITS
    offsets = sums.select(
        "number", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"), (F.col("rows") > HOT_ROWS + 4 * usual).alias("hot")
    )
    offered = numbered.join(offsets, ["number", "bucket"])
    within = Window.partitionBy("number", "bucket").orderBy("spread", "doc_id", "row_hash").rowsBetween(Window.unboundedPreceding, -1)
    start = (F.col("offset") + F.coalesce(F.sum("size").over(within), F.lit(0))).alias("start")
    columns = ["number", "doc_id", "source", "size", "row_hash", "source_size", "target"]
    placed = offered.filter("NOT hot").select(*columns, start)
    if not offsets.filter("hot").isEmpty():
        placed = placed.unionByName(_hot_starts(offered.filter("hot")).select(*columns, "start"))
    placed = cut(placed)
    budget = targets.select("number", F.floor("target").cast("long").alias("budget"), "source_size").filter("budget > 0")
    parts = (
        placed.filter("size > 0")
        .join(budget.drop("source_size"), "number")
        .withColumn("pass", F.explode(F.sequence(F.lit(0), F.floor((F.col("budget") - 1) / F.col("source_size")).cast("int"))))
        .withColumn("at", F.col("pass") * F.col("source_size") + F.col("start"))
        .withColumn("until", F.least(F.col("at") + F.col("size"), F.col("budget")))
        .filter("at < until")
        .withColumn("block", F.explode(F.sequence(F.expr(f"at div {block}"), F.expr(f"(until - 1) div {block}"))))
        .select(
            "number", "block", "start", "pass",
            (F.greatest("at", F.col("block") * block) - F.col("at")).alias("from_word"),
            (F.least("until", (F.col("block") + 1) * block) - F.col("at")).alias("to_word"),
        )
    )
    return placed, parts.join(_slots(budget, block), ["number", "block"])


def _hot_starts(rows: DataFrame) -> DataFrame:
    """``start`` in hash ranges where one id has very many rows.

    Equal rows are one with a count before they move; the rows of an id are cut
    by the first bits of their hash into ranges whose sums come first, then
    running sums within. Ranges follow the order of hashes, so the stream is in
    the same order as where nothing is hot.
    """
    keys = ["number", "bucket", "spread", "doc_id", "part"]
    distinct = rows.groupBy(*rows.columns).agg(F.count("*").alias("times")).withColumn("part", F.shiftright("row_hash.a", 64 - HOT_BITS))
    sums = distinct.groupBy(*keys).agg(F.sum(F.col("size") * F.col("times")).alias("n"))
    earlier = Window.partitionBy("number", "bucket").orderBy("spread", "doc_id", "part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*(F.col(c).alias(f"_{c}") for c in keys), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy(*keys).orderBy("row_hash").rowsBetween(Window.unboundedPreceding, -1)
    found = distinct.join(before, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]).withColumn(
        "first", F.col("offset") + F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("times")).over(within), F.lit(0))
    )
    return (
        found.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(times - 1) div {CHUNK}"))))  # no array of all copies of a row
        .withColumn("copy", F.explode(F.sequence(F.col("chunk") * CHUNK, F.least((F.col("chunk") + 1) * CHUNK, "times") - 1)))
        .withColumn("start", F.col("first") + F.col("copy") * F.col("size"))
    )


def _slots(budget: DataFrame, block: int) -> DataFrame:
    """(number, block, slot): slots of the schedule, ranked per source."""
    needed = budget.select("number", F.expr(f"(budget + {block - 1}) div {block}").alias("blocks"))
    upto = Window.orderBy("number")
    shares = needed.withColumns({"high": F.sum("blocks").over(upto), "total": F.sum("blocks").over(Window.partitionBy())})
    shares = cut(
        shares.select(
            "number", "blocks", "total",
            ((F.col("high") - F.col("blocks")) / F.col("total")).alias("low"), (F.col("high") / F.col("total")).alias("high"),
        )
    )
    total = (shares.agg(F.max("total")).first()[0]) or 0
    cells = shares.select(
        "*", F.explode(F.sequence(F.floor(F.col("low") * CELLS), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1)))).alias("cell")
    )
    point = F.col("slot") % _PERIOD * _GOLDEN % _UNIT / F.lit(float(_UNIT))
    drawn = (
        budget.sparkSession.range(total)
        .select(F.col("id").alias("slot"))
        .select("slot", point.alias("point"))
        .withColumn("cell", F.floor(F.col("point") * CELLS))
        .join(cells, "cell")  # sources + CELLS rows, broadcast if they are few; else points are even over cells
        .filter("point >= low AND point < high")
        .select("number", "slot", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    )
    counts = drawn.groupBy("number", "chunk").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("number").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("number", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    within = Window.partitionBy("number", "chunk").orderBy("slot")
    ranked = (
        drawn.join(offsets, ["number", "chunk"])
        .select("number", "slot", (F.col("offset") + F.row_number().over(within) - 1).alias("block"))
        .join(shares.select("number", "blocks"), "number")
        .filter("block < blocks")
        .select("number", "block", "slot")
    )
    # where the points gave a source a few slots less than its target, the rest follows at the end
    got = drawn.groupBy("number").agg(F.count("*").alias("got"))
    rest = (
        shares.join(got, "number", "left")
        .withColumn("got", F.coalesce("got", F.lit(0)))
        .filter("got < blocks")
        .select("number", F.explode(F.sequence("got", F.col("blocks") - 1)).alias("block"))
        .select("number", "block", (F.lit(total) + F.col("block")).alias("slot"))
    )
    return ranked.unionByName(rest)


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target of its source, and the words the mix takes of it.

    Defined cases: those of ``plan_mixture``; rows of size 0 have taken 0, rows
    that repeat a row each, and an empty table gives an empty one.
    """
    placed, schedule = plan_mixture(docs, **options)
    taken = schedule.groupBy("number", "start").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"), F.lit(True).alias("some"))
    return placed.withColumn("some", F.col("size") > 0).join(taken, ["number", "start", "some"], "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix in whole documents: each row of ``docs`` once per pass of which the mix takes at least half.

    All columns are returned, whatever their names. Each source comes near its
    target, to a document per pass. Defined cases: null and blank texts have no
    part in the mix; rows equal in all columns count together, those that differ
    in which column is null are different rows; null ids and sources are values
    like any other; an empty table gives an empty one.
    """
    placed, schedule = plan_mixture(docs, **options)
    passes = schedule.groupBy("number", "start", "pass").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("words"))
    copies = (
        placed.filter("size > 0")
        .join(passes, ["number", "start"])
        .filter("2 * words >= size")
        .groupBy("row_hash")
        .agg(F.count("*").alias("copies"))
    )
    hashed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.struct(*row_key(docs)).alias("row_hash"))
    return (
        hashed.join(copies, "row_hash")
        .dropDuplicates(["row_hash"])
        .select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
        .select("row.*")
    )
