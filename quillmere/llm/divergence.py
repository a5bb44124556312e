"""Source divergence audit: how the word use of each source differs from the others of its language.

Terms are integers. Blocks of documents are dictionary-encoded and counted per
group; the terms that a language keeps are brought into UTF-8 order by a range
exchange and numbered through, so that the order of ids is the order of terms.
Chunks of consecutive ids become dense vectors: in each of them the sorted
array of kept terms turns terms into ids by ``searchsorted``, a bin count per
source gives its counts, and all shares, sums and ties are integer arithmetic
on those vectors. Only chunk sums and the first ranks of a chunk leave it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmere.llm.common import column_or_null, cut

#: Tokens that a task holds before it counts them, and bytes of text that become tokens at once.
BLOCK, SEGMENT = 1 << 21, 1 << 20
#: Terms of a chunk at most, and counts (terms x sources) that a chunk holds at most.
WIDTH, CELLS = 4096, 1 << 20
#: A language keeps terms of so many documents; ranks of terms that are listed; shares are in units of one by this.
LEAST_DOCS, RANKS, UNIT = 3, 200, 1_000_000_000
#: ASCII letters become small, all other ASCII characters blanks; bytes of other characters stay.
_LETTERS = bytes(b if b > 127 or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
_COUNTED = "lang string, source string, term string, n long, df long"


def _tokens(text: str) -> Iterator[list[bytes]]:
    """Terms of a text, a bounded part of it at a time; no term is cut."""
    data, at = text.encode().translate(_LETTERS), 0
    while at < len(data):
        end = at + SEGMENT
        if end < len(data):
            gap = data.rfind(b" ", at, end)
            gap = gap if gap > at else data.find(b" ", end)
            end = gap if gap >= 0 else len(data)
        yield data[at:end].split()
        at = end


class _Block:
    """Documents as arrays of term codes, counted when there are enough."""

    def __init__(self):
        self.encoded: list[pa.DictionaryArray] = []
        self.groups: dict[tuple[str, str], int] = {}
        self.group_of: list[int] = []
        self.lengths: list[int] = []
        self.size = 0

    def add(self, lang: str, source: str, text: str) -> None:
        parts = [pa.array(x, pa.binary()).dictionary_encode() for x in _tokens(text)]
        self.encoded += parts
        self.group_of.append(self.groups.setdefault((lang, source), len(self.groups)))
        self.lengths.append(sum(map(len, parts)))
        self.size += self.lengths[-1] + 1

    def counted(self) -> Iterator[pa.RecordBatch]:
        """Occurrences and documents of each term by group, and a row without a term for each group."""
        names = list(self.groups)
        marks = [[g[0] for g in names], [g[1] for g in names], [""] * len(names), [0] * len(names), [0] * len(names)]
        columns = [pa.array(c, t) for c, t in zip(marks, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()))]
        labels = ["lang", "source", "term", "n", "df"]
        yield pa.RecordBatch.from_arrays(columns, names=labels)
        whole = pa.chunked_array(self.encoded, pa.dictionary(pa.int32(), pa.binary())).unify_dictionaries()
        if not len(whole):
            return
        order = pc.array_sort_indices(whole.chunk(0).dictionary)
        terms, rank = whole.chunk(0).dictionary.take(order), np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        ids = rank[np.concatenate([x.indices.to_numpy() for x in whole.chunks])]
        docs = np.repeat(np.arange(len(self.lengths)), self.lengths)
        in_doc, n = np.unique(docs * len(terms) + ids, return_counts=True)
        cell = np.asarray(self.group_of)[in_doc // len(terms)] * len(terms) + in_doc % len(terms)
        cells, at = np.unique(cell, return_inverse=True)
        group, term = pa.array(cells // len(terms)), pa.array(cells % len(terms))
        found = [columns[0].take(group), columns[1].take(group), terms.take(term).cast(pa.string())]
        yield pa.RecordBatch.from_arrays([*found, pa.array(np.bincount(at, n).astype(np.int64)), pa.array(np.bincount(at))], names=labels)


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, df): occurrences, and rows that hold the term. Each group also has the term '' with zeros."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block()
        for batch in batches:
            for row in range(batch.num_rows):
                block.add(*(batch.column(k)[row].as_py() for k in range(3)))
                if block.size >= BLOCK:
                    yield from block.counted()
                    block = _Block()
        if block.lengths:
            yield from block.counted()

    text = lambda c: F.coalesce(column_or_null(docs, c, "string"), F.lit(""))
    read = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    return read.mapInArrow(run, _COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def _dictionary(counts: DataFrame, least_docs: int) -> DataFrame:
    """A row per kept term, with its counts by source, in UTF-8 order over partitions and rows; '' has all sources of a language."""
    dealt = counts.repartitionByRange("lang", "term").groupBy("lang", "term")
    terms = dealt.agg(F.sum("df").alias("df"), F.collect_list(F.struct("source", "n")).alias("cells")).filter((F.col("df") >= least_docs) | (F.col("term") == ""))
    place = F.monotonically_increasing_id()
    return cut(
        terms.sortWithinPartitions("lang", "term").select(
            "lang", "term", "cells", F.shiftright(place, 33).alias("part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("row")
        )
    )


def _groups(kept: DataFrame) -> DataFrame:
    """(lang, source, n, v, width): all words of kept terms in a group, kept terms of its language, and terms of a chunk there."""
    cells = kept.select("lang", "term", F.explode("cells").alias("cell")).select("lang", "term", "cell.*")
    sums = cells.groupBy("lang", "source").agg(F.sum("n").cast("long").alias("n"))  # '' counts 0 for each
    sources = sums.groupBy("lang").agg(F.count("*").alias("s"))
    sizes = kept.groupBy("lang").agg((F.count("*") - 1).alias("v"))
    width = F.greatest(F.lit(1), F.least(F.lit(WIDTH), F.expr(f"{CELLS} div s"))).alias("width")
    return cut(sums.join(sizes.join(sources, "lang"), "lang").select("lang", "source", "n", "v", width))


def _chunks(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, chunk, term, cells): kept terms by number, chunks of consecutive ones."""
    terms = kept.filter("term <> ''")
    parts = terms.groupBy("lang", "part").agg(F.count("*").alias("rows"), F.min("row").alias("first"))
    before = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    offsets = parts.select("lang", "part", "first", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    placed = offsets.join(groups.select("lang", "width").distinct(), "lang")
    number = F.col("offset") + F.col("row") - F.col("first")
    return terms.join(placed, ["lang", "part"]).select("lang", F.floor(number / F.col("width")).alias("chunk"), "term", "cells")


def shares(counts: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / sum), exact for sums below 9e15: a long division, three digits a step."""
    rest, out = counts + 1, np.zeros(np.broadcast(counts, sums).shape, np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // sums
        rest = rest % sums
    return out + 1


def _places(known: np.ndarray, column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Ids of values in a sorted array of bytes; each different value is looked up once."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    coded = column.cast(pa.binary()).dictionary_encode()
    return np.searchsorted(known, _objects(coded.dictionary))[coded.indices.to_numpy()]


def _objects(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.array([*column.cast(pa.binary()).to_pylist(), None], object)[:-1]  # the None keeps numpy from fixed widths


def _compare(terms: pa.Table, groups: pa.Table, ranks: int) -> pa.Table:
    """What one chunk of a language adds to its pairs of sources, and the first terms of each source in it."""
    lang, groups = groups["of_lang"][0].as_py(), groups.sort_by("source")
    sources, total, v = _objects(groups["source"]), groups["n"].to_numpy(), groups["v"][0].as_py()
    names, rows = groups["source"].combine_chunks(), []

    def add(part: str, who, items: pa.Array, values) -> None:
        who = pa.array(who, pa.int64())
        fixed = [pa.array([x] * len(who), pa.string()) for x in (lang, part)]
        rows.append(pa.table([fixed[0], names.take(who), fixed[1], items, pa.array(values, pa.int64())], schema=_FOUND))

    pairs = np.zeros((len(sources), len(sources)), np.int64)
    if terms.num_rows:
        kept = np.sort(_objects(terms["term"]))
        cells = terms["cells"].combine_chunks()
        term = np.repeat(_places(kept, terms["term"]), pc.list_value_length(cells).to_numpy())
        flat = cells.flatten()
        cell, n = _places(sources, flat.field("source")) * len(kept) + term, flat.field("n").to_numpy()
        binned = lambda weight: np.bincount(cell, weight, len(sources) * len(kept)).astype(np.int64)
        dense = (binned(n & ((1 << 26) - 1)) + (binned(n >> 26) << 26)).reshape(len(sources), -1)  # bins are doubles: exact in halves
        p, q = shares(dense, total[:, None] + v), shares(dense.sum(axis=0), total.sum() + v)
        for other in range(len(sources)):
            d = p - p[other]
            pairs[:, other] = (d * d // p[other]).sum(axis=1)
        d, at = p - q, pa.array(kept.tolist(), pa.binary()).cast(pa.string())
        value = np.where((dense > 0) & (d > 0), d * d // q, -1)
        for who in range(len(sources)):
            some = np.flatnonzero(value[who] >= 0)
            best = some[np.argsort(-value[who, some], kind="stable")[:ranks]]  # equal values stay in the order of ids
            add("term", np.full(len(best), who), at.take(pa.array(best)), value[who, best])
    who, other = np.nonzero(~np.eye(len(sources), dtype=bool))
    add("pair", who, names.take(pa.array(other)), pairs[who, other])
    return pa.concat_tables(rows)


_FOUND = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def source_divergence(
    docs: DataFrame, least_docs: int = LEAST_DOCS, ranks: int = RANKS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source"
) -> DataFrame:
    """(lang, source, part, item, value, rank): pairs of sources of a language, and the terms a source uses more than its language.

    With shares p of a group and q of what it is held against, both in 10**-9
    and smoothed by one, a term's value is floor((p - q)**2 / q). ``pair`` sums
    it over all kept terms against each other source; ``term`` lists the first
    ``ranks`` terms with p > q, against the whole language. Ties go to the
    smaller item in UTF-8 order.

    Defined cases: null texts, languages and sources are empty ones; a language
    without kept terms has pairs of value 0 and no terms; a source alone in its
    language has no pairs; rows that repeat count each, also as documents; an
    empty table gives an empty one; other columns are ignored; the columns may be
    missing. Pairs are as many as sources times sources of a language, which is
    the result itself, so sources are meant to be hundreds, not pages.
    """
    kept = _dictionary(term_counts(docs, text_col, lang_col, source_col), least_docs)
    groups = _groups(kept)
    terms = _chunks(kept, groups)
    every = terms.select("lang", "chunk").distinct().unionByName(groups.select("lang", F.lit(-1).cast("long").alias("chunk")).distinct())
    held = groups.join(every, "lang").select(F.col("lang").alias("of_lang"), F.col("chunk").alias("of_chunk"), "source", "n", "v")  # sources, for each chunk
    found = terms.groupBy("lang", "chunk").cogroup(held.groupBy("of_lang", "of_chunk")).applyInArrow(
        lambda left, right: _compare(left, right, ranks), "lang string, source string, part string, item string, value long"
    )
    found = cut(found)
    pairs = found.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(found.filter("part = 'term'")).filter(F.col("rank") <= ranks))
