"""Exact top-k by inner product over integers, with a pivot-distance index.

Inner products become distances by one more coordinate: with M the largest
squared norm, x' = (x, sqrt(M - |x|^2)) and q' = (q, 0) give
|q' - x'|^2 = |q|^2 + M - 2 q.x, so the nearest x' has the highest product.
Every x' is keyed by its nearest pivot and its distance d to it; the rows of a
pivot, in order of d, are cut into annuli. If |q' - p| = e and the k-th best
distance so far is r, only rows with e - r <= d <= e + r can be nearer.

A query first expands the annuli next to it until they hold k + 1 rows, which
gives r, then visits just the annuli that the bound leaves, and of them the
window of rows that it leaves. Rows and queries meet in bounded blocks: the rows
of a pivot are dealt into parts and the queries into groups. A query travels
once to each part of a pivot, however many annuli it visits there, and to a
group go only the annuli that its queries visit.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.llm.common import cut

#: Pivots follow the root of the number of rows between these; rows of the sample (lowest hashes) for each of them.
PIVOTS, MOST_PIVOTS, SAMPLED = 48, 1024, 16
#: Rows aimed at in an annulus; annuli of a pivot.
ANNULUS, ANNULI = 2048, 16
#: Components held at once by the rows of a part, and by the queries of a group; rows there at least.
CELLS, LEAST_ROWS = 1 << 19, 256
#: Distances are sums of squares of integers, compared with this relative slack.
_SLACK = 1e-9


#: Up to this squared norm, products and their sums are exact in doubles; from the second on they don't fit a long.
_EXACT, _FITS = 2.0**53, 2.0**63


def quantized(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of each component as an integer; null unless all components are finite and the squared norm fits a long."""
    double = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(double, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    square = F.aggregate(double, F.lit(0.0), lambda a, x: a + F.pow(F.abs(x * scale) + 1, F.lit(2.0)))
    whole = F.when(vector.isNotNull() & fine, square)
    return F.when(whole < F.lit(_FITS), F.transform(double, lambda x: F.floor(x * scale).cast("long")))


def _matrix(column: pa.Array | pa.ChunkedArray, width: int, kind=np.float64) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def pivots_for(n: int) -> int:
    """Pivots of an index of n rows."""
    return min(max(PIVOTS, math.isqrt(n) // 8), MOST_PIVOTS)


def _pivot_matrix(rows: DataFrame, largest: float, n: int) -> np.ndarray:
    """Pivots far from each other out of a bounded sample of different vectors, in the larger space.

    A hash threshold leaves some eight times the sample before different
    vectors are told apart; where so many repeat that too few are left, all are.
    """
    unit = F.shiftrightunsigned(F.xxhash64("q"), 12) * F.lit(2.0**-52)
    wanted = pivots_for(n)
    size = SAMPLED * wanted
    lowest = lambda df: df.select("q").distinct().orderBy(F.xxhash64("q"), "q").limit(size).collect()  # noqa: E731  bounded by MOST_PIVOTS
    sample = lowest(rows.filter(unit * n < 8 * size))
    if len(sample) < wanted and n > 8 * size:
        sample = lowest(rows)
    found = _lift(np.array([r.q for r in sample], float), largest)
    chosen = [0]
    nearest = ((found - found[0]) ** 2).sum(axis=1)
    while len(chosen) < min(wanted, len(found)):
        chosen.append(int(np.argmax(nearest)))
        nearest = np.minimum(nearest, ((found - found[chosen[-1]]) ** 2).sum(axis=1))
    return found[chosen]


def _lift(x: np.ndarray, largest: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(0, largest - (x**2).sum(axis=1)))[:, None]])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None] - 2 * a @ b.T))


class _Directory:
    """Annuli by pivot: (pivot, annulus, low, high, rows), at most MOST_PIVOTS * ANNULI of them, and the parts of each pivot."""

    def __init__(self, rows, pivots: np.ndarray, part_rows: int):
        self.pivots = pivots
        self.pivot, self.annulus, self.rows = (np.array([r[k] for r in rows], np.int64) for k in ("pivot", "annulus", "n"))
        self.low, self.high = (np.array([r[k] for r in rows], float) for k in ("low", "high"))
        self.parts = -(-np.bincount(self.pivot, self.rows, len(pivots)).astype(np.int64) // part_rows)

    def least(self, e: np.ndarray) -> np.ndarray:
        """Least possible distance from queries to the rows of each annulus."""
        own = e[:, self.pivot]
        return np.maximum(0, np.maximum(own - self.high, self.low - own))


def top_k(rows: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query with every other row.

    ``is_query`` is a condition on ``rows``. Defined cases: rows without an id
    or with a null, empty or non-finite vector take no part, nor do those whose
    squared norm, in these integers, would not fit a long; a shorter vector
    counts as filled up with zeros; ties go to the smaller id; of rows that
    share an id each is a query with an answer of its own and a candidate of
    others, but they are no candidates of each other; a query with fewer others
    gets all; an empty table gives an empty one; other columns are ignored.
    """
    spark = rows.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    whole = rows.select(F.col(id_col).cast("long").alias("vec_id"), quantized(F.col(vector_col), scale).alias("q"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    whole = whole.filter("vec_id IS NOT NULL AND q IS NOT NULL AND size(q) > 0")
    square = F.aggregate("q", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    width, shortest, largest, asking, n = whole.agg(
        F.max(F.size("q")), F.min(F.size("q")), F.max(square), F.sum(F.col("asks").cast("long")), F.count("*")
    ).first()
    if width is None:
        return spark.createDataFrame([], schema)
    if shortest < width:
        whole = whole.withColumn("q", F.concat("q", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("q"))))
    exact = largest * (1 + 1e-9) < _EXACT  # by Cauchy and Schwarz it bounds every partial sum
    pivots = _pivot_matrix(whole, float(largest), n)
    held = max(LEAST_ROWS, CELLS // width)
    groups = max(1, -(-asking // held))

    def place(batches):
        for all_rows in batches:
            for at in range(0, all_rows.num_rows, 1024):
                batch = all_rows.slice(at, 1024)
                distance = _distances(_lift(_matrix(batch.column(1), width), float(largest)), pivots)
                nearest = distance.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:3], pa.array(nearest, pa.int32()), pa.array(distance[np.arange(len(nearest)), nearest], pa.float64())],
                    names=["vec_id", "q", "asks", "pivot", "distance"],
                )

    # rows are numbered, so that those of one id can be dealt into parts too
    keyed = cut(whole.mapInArrow(place, "vec_id long, q array<long>, asks boolean, pivot int, distance double").withColumn("row", F.monotonically_increasing_id()))
    counts = keyed.groupBy("pivot").agg(F.count("*").alias("n"), F.percentile_approx("distance", [i / ANNULI for i in range(1, ANNULI)]).alias("cuts"))
    step = F.greatest(F.lit(1), F.ceil(F.lit(ANNULI) * F.lit(ANNULUS) / F.col("n"))).cast("int")
    cuts = counts.select("pivot", F.filter("cuts", lambda x, i: (i + 1) % step == 0).alias("cuts"))
    annuli = keyed.join(F.broadcast(cuts), "pivot").withColumn("annulus", F.size(F.filter("cuts", lambda x: x < F.col("distance")))).drop("cuts")
    index = cut(annuli)
    listed = index.groupBy("pivot", "annulus").agg(F.count("*").alias("n"), F.min("distance").alias("low"), F.max("distance").alias("high"))
    directory = _Directory(listed.orderBy("pivot", "annulus").collect(), pivots, held)  # MOST_PIVOTS * ANNULI rows at most
    part = F.pmod(F.xxhash64("vec_id", "row"), F.ceil(F.col("n") / held)).cast("int")
    blocks = index.join(F.broadcast(counts.select("pivot", "n")), "pivot").select("pivot", "annulus", part.alias("part"), "vec_id", "q", "distance")
    queries = index.filter("asks").select(F.col("row").alias("ask"), F.col("vec_id").alias("query_id"), "q", F.pmod(F.xxhash64("vec_id", "row", F.lit(1)), F.lit(groups)).cast("int").alias("group"))

    near = _visits(queries, directory, width, float(largest), k, seeds=True)
    best = _meet(near, blocks, width, k, exact).groupBy("ask").agg(F.sort_array(F.collect_list("score"), asc=False).alias("scores"))
    reach = best.select("ask", F.when(F.size("scores") >= k, F.element_at(F.slice("scores", 1, k), -1)).alias("least"))
    asked = cut(queries.join(reach, "ask", "left"))
    found = _meet(_visits(asked, directory, width, float(largest), k, seeds=False), blocks, width, k, exact)
    # parts give k rows at most, so the lists of a query stay short
    ranked = found.groupBy("ask", "query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id"))), 1, k).alias("best"))
    return ranked.select("query_id", F.posexplode("best").alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.less")).alias("score")
    )


_VISIT = "pivot int, part int, group int, annuli array<int>, ask long, query_id long, q array<long>, low double, high double, least long"


def _visits(queries: DataFrame, directory: _Directory, width: int, largest: float, k: int, seeds: bool) -> DataFrame:
    """A row for each part of a pivot that a query visits, with the annuli there and the window (low, high) of distances that they leave."""
    shared = queries.sparkSession.sparkContext.broadcast(directory)
    wanted = queries if "least" in queries.columns else queries.withColumn("least", F.lit(None).cast("long"))

    def run(batches):
        own = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                x = _matrix(batch.column(1), width)
                e = _distances(np.hstack([x, np.zeros((len(x), 1))]), own.pivots)
                bound = own.least(e)
                if seeds:
                    order = np.argsort(bound, axis=1, kind="stable")
                    before = np.cumsum(own.rows[order], axis=1) - own.rows[order]
                    go = np.zeros(bound.shape, bool)
                    np.put_along_axis(go, order, before < k + 1, axis=1)
                else:
                    least = batch.column(3).to_numpy(zero_copy_only=False).astype(float)  # null becomes nan
                    square = (x**2).sum(axis=1) + largest - 2 * least
                    reach = np.where(np.isnan(least), np.inf, np.sqrt(np.maximum(0, square)) * (1 + _SLACK) + 1e-6 * np.sqrt(largest + 1))
                    go = bound <= reach[:, None]
                who, block = np.nonzero(go)  # by query, then by pivot and annulus
                if not len(who):
                    continue
                pivot = own.pivot[block]
                begin = np.flatnonzero(np.concatenate([[True], (who[1:] != who[:-1]) | (pivot[1:] != pivot[:-1])]))
                annuli = pa.ListArray.from_arrays(pa.array(np.append(begin, len(who)), pa.int32()), pa.array(own.annulus[block], pa.int32()))
                if seeds:
                    low, high = np.minimum.reduceat(own.low[block], begin), np.maximum.reduceat(own.high[block], begin)
                else:
                    middle, far = e[who[begin], pivot[begin]], reach[who[begin]]
                    low, high = middle - far - 1e-6 * (1 + middle), middle + far + 1e-6 * (1 + middle)
                parts = own.parts[pivot[begin]]
                visit = np.repeat(np.arange(len(begin)), parts)
                part = np.arange(len(visit)) - np.repeat(np.cumsum(parts) - parts, parts)
                asks = pa.array(who[begin][visit])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(pivot[begin][visit], pa.int32()), pa.array(part, pa.int32()), batch.column(2).take(asks), annuli.take(pa.array(visit)),
                        batch.column(4).take(asks), batch.column(0).take(asks), batch.column(1).take(asks), pa.array(low[visit]), pa.array(high[visit]),
                        batch.column(3).take(asks),
                    ],
                    names=["pivot", "part", "group", "annuli", "ask", "query_id", "q", "low", "high", "least"],
                )

    return wanted.select("query_id", "q", "group", "least", "ask").mapInArrow(run, _VISIT)


def _meet(visits: DataFrame, blocks: DataFrame, width: int, k: int, exact: bool) -> DataFrame:
    """(ask, query_id, vec_id, score): the best k rows of each visited part within the window of a query, known by its row.

    Products are taken in doubles where these are ``exact``, else in integers.
    """
    kind = np.float64 if exact else np.int64
    keys = ["pivot", "part", "group"]
    # an annulus goes to the groups of queries that visit it
    wanted = visits.select(*(F.col(c).alias(f"to_{c}") for c in keys), F.explode("annuli").alias("to_annulus")).distinct()
    same = [F.col(c) == F.col(f"to_{c}") for c in ("pivot", "part", "annulus")]
    rows = blocks.join(wanted, same).select(*(F.col(f"to_{c}").alias(c) for c in keys), "vec_id", "q", "distance")
    visits = visits.drop("annuli")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if left.num_rows and right.num_rows:
            ids, distance = right.column("vec_id").to_numpy(), right.column("distance").to_numpy()
            rank = np.lexsort((ids, distance))
            ids, distance, x = ids[rank], distance[rank], _matrix(right.column("q"), width, kind)[rank]
            places = np.empty(len(ids), np.int64)
            places[np.argsort(ids, kind="stable")] = np.arange(len(ids))
            ask, asked, first, last = (left.column(c).to_numpy() for c in ("ask", "query_id", "low", "high"))
            least = left.column("least").combine_chunks().fill_null(np.iinfo(np.int64).min).to_numpy()
            low, high = np.searchsorted(distance, first), np.searchsorted(distance, last, "right")
            q = _matrix(left.column("q"), width, kind)
            order = np.lexsort((high, low))
            for at in range(0, len(order), 64):
                some = order[at : at + 64]
                a, b = low[some].min(), high[some].max()
                if a >= b:
                    continue
                score = (q[some] @ x[a:b].T).astype(np.int64)
                inside = (np.arange(a, b)[None] >= low[some, None]) & (np.arange(a, b)[None] < high[some, None])
                inside &= ids[None, a:b] != asked[some, None]
                inside &= ~(score < least[some, None])
                for n, row in enumerate(some):
                    at_row = np.nonzero(inside[n])[0]
                    if len(at_row):
                        own = score[n, at_row]
                        best = at_row[np.lexsort((places[a + at_row], -own))[:k]]
                        out.append((np.full(len(best), ask[row]), np.full(len(best), asked[row]), ids[a + best], score[n, best]))
        columns = [np.concatenate(c) if out else np.empty(0) for c in (zip(*out) if out else ((), (), (), ()))]
        return pa.table({name: pa.array(c.astype(np.int64)) for name, c in zip(("ask", "query_id", "vec_id", "score"), columns)})

    return visits.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(run, "ask long, query_id long, vec_id long, score long")
