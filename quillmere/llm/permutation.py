"""Embedding near-duplicates by a pivot-permutation index.

A vector is described by its nearest reference points. Close vectors see mostly
the same points nearest, so the inverted lists are keyed by what a pair must
share: every two of a vector's first ``prefix`` points are a list, and cosines
of those who meet are computed in double precision. A pair that shares more
points meets in several lists; only that of its two lowest shared points
compares it.

The number of points follows the number of vectors, so that lists stay short,
and they lie far from each other in the sample they are drawn from, seen from
its centre, whatever direction all vectors may share. How many of its nearest points a vector is
listed under is fitted too: on sampled vectors turned just as far as the
threshold allows, the least prefix that finds ``RECALL`` of the pairs again.

Lists travel in units. A unit is all lists whose lower point is the same, so a
vector moves once for each of its points but the highest. Where a point is too
frequent for one task, the unit is a single list, and a long list is dealt into
blocks and worked on as pairs of blocks.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.llm.common import column_or_null, cut
from quillmere.llm.graph import connected_components

#: Points are about so many times the root of the number of vectors, within these bounds, and fewer where they are long.
POINTS_PER_ROOT, LEAST_POINTS, MOST_POINTS, POINT_BYTES = 8, 64, 32_767, 64 << 20
#: Points lie in cells, about as many as the root of their number; the nearest ones are looked for in so many cells nearest to a vector.
PROBED = 24
#: They are drawn from so many times as many sampled vectors, those with the lowest hashes; so many of these test the fit.
SAMPLED, TESTED = 3, 1000
#: Recall aimed at for pairs right at the threshold, and the longest prefix.
RECALL, MOST_PREFIX = 0.95, 14
#: Comparisons that cost as much as one more list of a vector.
LIST_COST = 20
#: Vectors under a point that one task works on, vectors of a block, and numbers that a task holds.
UNIT, BLOCK, TASK_NUMBERS = 8192, 512, 1 << 20
#: A list up to so long is worked on as pairs of rows, a longer one as products of blocks.
SHORT = 40


def _unit(x: np.ndarray) -> np.ndarray:
    """Vectors at unit length; they are brought near one first, so that no square leaves the doubles."""
    _, exponent = np.frexp(np.abs(x).max(axis=1, keepdims=True, initial=0))
    x = np.ldexp(x, -exponent)  # a power of two changes no digit
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


@dataclass
class Points:
    """Reference points in single precision (they only describe), and how many nearest ones a vector is listed under."""

    points: np.ndarray
    centre: np.ndarray
    prefix: int

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """Sorted numbers of the ``prefix`` nearest points of each vector of unit length, cut or filled with zeros to the points' width."""
        width = len(self.centre)
        x = x[:, :width] if x.shape[1] >= width else np.pad(x, ((0, 0), (0, width - x.shape[1])))
        return np.sort(_nearest(_centred(x, self.centre), self.cells, self.prefix), axis=1)

    @cached_property
    def cells(self) -> Cells:
        return Cells(self.points)


class Cells:
    """Points in two levels: each belongs to the nearest of some of them, the first ones, which lie far apart.

    Where there are no more cells than are probed, the nearest points are exact.
    Otherwise they are those in the cells nearest to a vector, the same ones for
    vectors that lie close together.
    """

    def __init__(self, points: np.ndarray):
        self.middles = points[: max(1, round(len(points) ** 0.5))]
        cell = np.concatenate([(points[at : at + 4096] @ self.middles.T).argmax(axis=1) for at in range(0, len(points), 4096)])
        self.order = np.argsort(cell, kind="stable")
        self.ends = np.searchsorted(cell[self.order], np.arange(len(self.middles) + 1))
        self.points, self.n = points[self.order], len(points)


def _centred(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Directions from the centre, in single precision: a direction that all vectors share would make some points near to all."""
    x = x.astype(np.float32) - centre
    return x / np.maximum(1e-12, np.sqrt((x * x).sum(axis=1, keepdims=True)))


def _best(score: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ``most`` highest scores of each row, the highest first, and these scores."""
    best = np.argpartition(-score, most - 1, axis=1)[:, :most] if most < score.shape[1] else np.argsort(-score, axis=1, kind="stable")
    found = np.take_along_axis(score, best, 1)
    order = np.argsort(-found, axis=1, kind="stable")
    return np.take_along_axis(best, order, 1), np.take_along_axis(found, order, 1)


def _nearest(x: np.ndarray, cells: Cells, most: int) -> np.ndarray:
    """The ``most`` nearest points, the nearest first."""
    most = min(most, cells.n)
    out = np.empty((len(x), most), np.int16)
    for at in range(0, len(x), 2048):
        some = x[at : at + 2048]
        if len(cells.middles) <= PROBED:
            out[at : at + 2048] = cells.order[_best(some @ cells.points.T, most)[0]]
            continue
        probes, _ = _best(some @ cells.middles.T, PROBED)
        number = np.zeros((len(some), PROBED * most), np.int64)
        score = np.full((len(some), PROBED * most), -np.inf, np.float32)
        rank = np.argsort(probes, axis=None, kind="stable")  # vectors by the cells that they probe
        ends = np.searchsorted(probes.ravel()[rank], np.arange(len(cells.middles) + 1))
        for cell in np.nonzero(np.diff(ends))[0]:
            who, slot = np.divmod(rank[ends[cell] : ends[cell + 1]], PROBED)
            low, high = cells.ends[cell], cells.ends[cell + 1]
            best, near = _best(some[who] @ cells.points[low:high].T, min(most, high - low))
            places = slot[:, None] * most + np.arange(best.shape[1])
            number[who[:, None], places], score[who[:, None], places] = cells.order[low + best], near
        out[at : at + 2048] = np.take_along_axis(number, _best(score, most)[0], 1)
    return out


def _far_apart(x: np.ndarray, n: int) -> np.ndarray:
    """Numbers of n rows, each the farthest from those before: a crowd gets few, and the first m are such a choice too."""
    chosen, closest = [0], x @ x[0]
    for _ in range(1, n):
        chosen.append(int(np.argmin(closest)))
        np.maximum(closest, x @ x[chosen[-1]], out=closest)
        closest[chosen[-1]] = np.inf
    return np.array(chosen)


def _shares_two(a: np.ndarray, b: np.ndarray, prefix: int, n: int) -> np.ndarray:
    held = np.zeros((len(a), n), bool)
    np.put_along_axis(held, a[:, :prefix].astype(np.int64), True, 1)
    return np.take_along_axis(held, b[:, :prefix].astype(np.int64), 1).sum(axis=1) >= 2


def choose_points(x: np.ndarray, n: int, least: float) -> Points:
    """Points out of sampled unit vectors for n vectors: of the choices that reach RECALL the one with the least work."""
    most = min(len(x), MOST_POINTS, max(LEAST_POINTS, int(POINTS_PER_ROOT * n**0.5)), max(LEAST_POINTS, POINT_BYTES // (4 * x.shape[1])))
    x, centre = x.astype(np.float32), x.mean(axis=0).astype(np.float32)
    if len(x) <= 2:
        centre = np.zeros_like(centre)  # of so few, one could lie right there
    centred = _centred(x, centre)
    order = _far_apart(centred, most)
    rng = np.random.default_rng(0)
    own = x[rng.integers(len(x), size=TESTED)]
    # a neighbour lies in the direction in which two other vectors differ, at just the threshold
    turn = x[rng.integers(len(x), size=TESTED)] - x[rng.integers(len(x), size=TESTED)] + 1e-3 * rng.normal(size=(TESTED, x.shape[1])).astype(np.float32)
    turn = turn - (turn * own).sum(axis=1, keepdims=True) * own
    turned = least * own + (1 - least * least) ** 0.5 * turn / np.maximum(1e-12, np.sqrt((turn * turn).sum(axis=1, keepdims=True)))
    other = x[rng.integers(len(x), size=TESTED)]
    best: tuple[float, Points] | None = None
    size = most
    while best is None or size >= min(LEAST_POINTS, most):
        points = centred[order[:size]]
        cells = Cells(points)
        a, b, c = (_nearest(_centred(v, centre), cells, MOST_PREFIX) for v in (own, turned, other))
        longest = min(MOST_PREFIX, size)
        fits = (p for p in range(min(2, longest), longest + 1) if p == longest or _shares_two(a, b, p, size).mean() >= RECALL)
        prefix = next(fits)
        found = _shares_two(a, b, prefix, size).mean()
        random = np.mean([_shares_two(a, np.roll(c, k, axis=0), prefix, size).mean() for k in range(8)])
        work = LIST_COST * comb(prefix, 2) + n * random + (0 if found >= RECALL else 1e18 * (1 - found))
        if best is None or work < best[0]:
            best = work, Points(points, centre, prefix)
        size //= 2
        if size < 2:
            break
    return best[1]


def _points(classes: DataFrame, n: int, least: float) -> Points | None:
    """Fitted on a bounded sample: SAMPLED * MOST_POINTS vectors at most."""
    wanted = SAMPLED * min(MOST_POINTS, max(LEAST_POINTS, int(POINTS_PER_ROOT * n**0.5)))
    unit = F.shiftrightunsigned(F.xxhash64("vector"), 12) * F.lit(2.0**-52)  # classes are different vectors, but for labels
    some = classes.select("vector").filter(unit * n < 4.0 * wanted) if n > 4 * wanted else classes.select("vector")
    rows = some.orderBy(F.xxhash64("vector"), "vector").limit(wanted).toArrow().column("vector")
    if not len(rows):
        return None
    vectors = rows.combine_chunks()
    lengths = np.diff(vectors.offsets.to_numpy())
    width = int(np.bincount(lengths).argmax())
    return choose_points(_unit(_matrix(vectors.filter(pa.array(lengths == width)), width)), n, least)


def _describe(classes: DataFrame, points: Points) -> DataFrame:
    """(rep, label, n, width, vector, near): the sorted numbers of the nearest points."""
    shared = classes.sparkSession.sparkContext.broadcast(points)  # POINT_BYTES at most

    def run(batches):
        for batch in batches:
            widths = batch.column("width").to_numpy()
            near = np.zeros((batch.num_rows, min(shared.value.prefix, len(shared.value.points))), np.int16)
            for width in np.unique(widths):
                own = np.nonzero(widths == width)[0]
                near[own] = shared.value.nearest(_unit(_matrix(batch.column("vector").take(pa.array(own)), width)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(near), pa.list_(pa.int16()))], names=[*batch.schema.names, "near"])

    return classes.mapInArrow(run, "rep long, label string, n long, width int, vector array<double>, near array<short>")


def _units(described: DataFrame) -> DataFrame:
    """Where vectors meet: (label, width, low, high, i, j, block, rep).

    ``high`` is -1 in a unit of all lists under ``low``; else the unit is the
    blocks i and j of the list (low, high).
    """
    listed = described.select("label", "width", "rep", "near", F.explode(F.slice("near", 1, F.size("near") - 1)).alias("low"))
    keys = ["label", "width", "low"]
    counts = cut(listed.groupBy(*keys).agg(F.count("*").alias("m")).filter("m > 1"))
    whole = listed.join(counts.filter(F.col("m") <= UNIT).select(*keys), keys, "left_semi")
    whole = whole.select(*keys, F.lit(-1).alias("high"), *(F.lit(0).alias(c) for c in ("i", "j", "block")), "rep")
    crowded = counts.filter(F.col("m") > UNIT)
    if crowded.isEmpty():
        return whole
    single = listed.join(crowded.select(*keys), keys, "left_semi").select(
        *keys, F.explode(F.transform(F.filter("near", lambda x: x > F.col("low")), lambda x: x.cast("int"))).alias("high"), "rep"
    )
    sizes = single.groupBy(*keys, "high").agg(F.count("*").alias("m")).filter("m > 1")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    placed = (
        single.join(sizes, [*keys, "high"])
        .withColumn("blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    )
    return whole.unionByName(placed.select(*keys, "high", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep"))


def _counted(a: np.ndarray, b: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether pairs of rows (point numbers a and b) that share a lower point and ``high`` share just one point below it."""
    below = a < high[:, None]
    shared = np.zeros(len(a), np.int64)
    for k in range(b.shape[1]):
        shared += ((a == b[:, k, None]) & below).any(axis=1)
    return shared == 1


def _pairs(lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs within lists of up to SHORT, given the list of each place, in order."""
    at, one, two = np.arange(len(lists)), [], []
    for step in range(1, SHORT):
        same = at[:-step][lists[:-step] == lists[step:]]
        if not len(same):
            break
        one.append(same)
        two.append(same + step)
    none = np.empty(0, np.int64)
    return (np.concatenate(one), np.concatenate(two)) if one else (none, none)


class _Found:
    """Links of a task: weights of vectors, and pairs that connect them."""

    def __init__(self, rep: np.ndarray, n: np.ndarray):
        self.rep, self.n = rep, n
        self.weight = np.zeros(len(rep), np.int64)
        self.ends: list[tuple[np.ndarray, np.ndarray]] = []

    def pairs(self, a: np.ndarray, b: np.ndarray) -> None:
        np.add.at(self.weight, a, self.n[b])
        np.add.at(self.weight, b, self.n[a])
        self.ends.append((a, b))

    def block(self, a: np.ndarray, b: np.ndarray, linked: np.ndarray, same: bool) -> None:
        """A matrix of links of rows a with rows b; of rows with themselves, it holds each link twice."""
        np.add.at(self.weight, a, linked @ self.n[b])
        if not same:
            np.add.at(self.weight, b, linked.T @ self.n[a])
        # each row with its first partner, and partners that follow each other in a row, connect the same as all pairs
        x, y = np.nonzero(linked)
        follows = np.r_[False, x[1:] == x[:-1]] if len(x) else np.empty(0, bool)
        first = ~follows
        self.ends.append((a[x[first]], b[y[first]]))
        both = np.unique(np.stack([y[np.nonzero(follows)[0] - 1], y[follows]]), axis=1) if follows.any() else np.empty((2, 0), np.int64)
        self.ends.append((b[both[0]], b[both[1]]))

    def table(self) -> pa.Table:
        """(rep, weight, root): rows with a link, and the least vector that links of this task connect them with."""
        a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (list(zip(*self.ends)) or ((), ())))
        names, place = np.unique(self.rep, return_inverse=True)  # a vector is there once in each of its units
        a, b = place[a], place[b]
        root = np.arange(len(names))
        while True:
            least = np.minimum(root[a], root[b])
            before = root.copy()
            np.minimum.at(root, a, least)
            np.minimum.at(root, b, least)
            root = root[root]
            if (root == before).all():
                break
        weight = np.bincount(place, self.weight, len(names)).astype(np.int64)
        some = np.zeros(len(names), bool)
        some[a] = some[b] = True
        columns = names[some], weight[some], names[root][some]
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("rep", "weight", "root"), columns)})


def _block_links(found: _Found, a: np.ndarray, b: np.ndarray, x: np.ndarray, near: np.ndarray, low: int, high: int, least: float) -> None:
    """Links of rows a with rows b of one list (the same rows: among them) whose lowest shared points are the list's."""
    same = a is b
    inside = lambda rows: (near[rows] < high) & (near[rows] != low)
    points = np.unique(np.concatenate([near[a][inside(a)], near[b][inside(b)]]))
    held = [np.zeros((len(rows), len(points) + 1), np.float32) for rows in ((a,) if same else (a, b))]
    for rows, matrix in zip((a, b), held):
        r, k = np.nonzero(inside(rows))
        matrix[r, np.searchsorted(points, near[rows][r, k])] = 1
    linked = held[0] @ held[-1].T == 0
    if same:
        np.fill_diagonal(linked, False)
    if linked.any():
        linked &= x[a] @ x[b].T >= least
        if linked.any():
            found.block(a, b, linked, same)


def _work(table: pa.Table, least: float) -> pa.Table:
    """All units of a task."""
    label, width, low, high, i, j, block, rep, n = (table.column(c).to_numpy() for c in ("label", "width", "low", "high", "i", "j", "block", "rep", "n"))
    label = np.unique(label, return_inverse=True)[1]
    found = _Found(rep, n)
    vectors, nears = table.column("vector").combine_chunks(), table.column("near").combine_chunks()
    for size in np.unique(width):
        rows = np.nonzero(width == size)[0]
        x = np.zeros((len(rep), size)) if len(rows) < len(rep) else None
        values = _unit(_matrix(vectors.take(pa.array(rows)), int(size)))
        if x is None:
            x = values
        else:
            x[rows] = values
        near = _matrix(nears, len(nears[0])).astype(np.int64)
        _whole(found, rows[high[rows] < 0], label, low, x, near, least)
        single = rows[high[rows] >= 0]
        order = single[np.lexsort((block[single], j[single], i[single], high[single], low[single], label[single]))]
        keys = np.stack([label, low, high, i, j])[:, order]
        starts = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)]) if len(order) else []
        for start, stop in zip(starts, [*starts[1:], len(order)]):
            own = order[start:stop]
            first = block[own] == i[own[0]]
            a = own[first]
            b = a if i[own[0]] == j[own[0]] else own[~first]
            if len(a) and len(b):
                _block_links(found, a, b, x, near, int(low[own[0]]), int(high[own[0]]), least)
    return found.table()


def _whole(found: _Found, rows: np.ndarray, label, low, x, near, least: float) -> None:
    """Units of all lists under a point: the lists follow from the rows' other points."""
    at, k = np.nonzero(near[rows] > low[rows][:, None])
    own, other = rows[at], near[rows][at, k]
    order = np.lexsort((own, other, low[own], label[own]))
    own, other = own[order], other[order]
    if not len(own):
        return
    lists = np.cumsum(np.r_[False, (label[own][1:] != label[own][:-1]) | (low[own][1:] != low[own][:-1]) | (other[1:] != other[:-1])])
    sizes = np.bincount(lists)
    short = sizes[lists] <= SHORT
    a, b = _pairs(lists[short])
    row, top, step = own[short], other[short], max(1, (1 << 20) // x.shape[1])
    for start in range(0, len(a), 1 << 16):
        one, two, high = row[a[start : start + (1 << 16)]], row[b[start : start + (1 << 16)]], top[a[start : start + (1 << 16)]]
        counts = _counted(near[one], near[two], high)
        one, two = one[counts], two[counts]
        for at in range(0, len(one), step):
            p, q = one[at : at + step], two[at : at + step]
            close = (x[p] * x[q]).sum(axis=1) >= least
            found.pairs(p[close], q[close])
    starts = np.flatnonzero(np.r_[True, lists[1:] != lists[:-1]])
    for number in np.flatnonzero(sizes > SHORT):
        start = starts[number]
        members = own[start : start + sizes[number]]
        parts = [members[at : at + BLOCK] for at in range(0, len(members), BLOCK)]
        for n, a_rows in enumerate(parts):
            for b_rows in parts[n:]:
                _block_links(found, a_rows, b_rows, x, near, int(low[members[0]]), int(other[start]), least)


def _links(described: DataFrame, least: float) -> DataFrame:
    """(rep, weight, root) out of all units; a vector has a row for each task where it has a link."""
    placed = cut(_units(described).withColumn("spread", F.xxhash64("label", "width", "low", "high", "i", "j")))
    rows, width = placed.agg(F.count("*"), F.max("width")).first()
    tasks = max(1, -(-rows * (width or 1) // TASK_NUMBERS))
    joined = placed.join(described.select("rep", F.col("label").alias("own"), F.col("width").alias("size"), "n", "vector", "near"), "rep")
    joined = joined.filter(F.col("own").eqNullSafe(F.col("label")) & (F.col("size") == F.col("width")))
    return (
        joined.select("label", "width", F.col("low").cast("int").alias("low"), "high", "i", "j", "block", "rep", "n", "vector", "near", F.pmod("spread", F.lit(tasks)).alias("task"))
        .groupBy("task")
        .applyInArrow(lambda table: _work(table, least), "rep long, weight long, root long")
    )


def near_vectors(
    rows: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """One row per row of ``rows``: vec_id, n_links, component_id, kept.

    Defined cases: rows with a null label or vector, a zero, empty or non-finite
    vector, or a null component link with nothing: n_links 0 and their own
    component; vectors of different lengths don't link; equal vectors of a label
    are one class, linked within and counted as often as they are there; rows
    that repeat an id are vectors of their own under one name; rows without an
    id link and count, but name no component; an empty table gives an empty
    one; other columns are ignored.
    """
    double = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vector", lambda x: x != 0)
    whole = rows.select(
        column_or_null(rows, id_col, "long").alias("vec_id"), column_or_null(rows, label_col, "string").alias("label"), double.alias("vector")
    ).withColumn("valid", F.coalesce(F.col("label").isNotNull() & fine, F.lit(False)))
    # a row without an id takes part under a number that no id has
    named = cut(whole.withColumn("place", F.coalesce("vec_id", F.lit((1 << 62)) + F.monotonically_increasing_id())))
    grouped = named.filter("valid").groupBy("label", "vector").agg(F.min("place").alias("least"), F.count("*").alias("n"))
    # an id that repeats may be the least of two classes: classes have numbers of their own
    classes = cut(grouped.select(F.monotonically_increasing_id().alias("rep"), "label", "n", F.size("vector").alias("width"), "vector", "least"))
    alone = named.filter("NOT valid").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    number = classes.count()
    points = _points(classes, number, least)
    if points is None:
        return alone
    described = cut(_describe(classes.drop("least"), points))
    links = cut(_links(described, least))
    weights = links.groupBy("rep").agg(F.sum("weight").alias("weight"))
    roots = cut(connected_components(links.select(F.col("rep").alias("src"), F.col("root").alias("dst"))).select(F.col("node").alias("rep"), "root"))
    rooted = classes.select("rep", "least", "n").join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component"))
    known = (
        rooted.join(names, "root").join(weights, "rep", "left")
        .select("rep", "component", (F.col("n") - 1 + F.coalesce("weight", F.lit(0))).alias("n_links"))
    )
    component = F.when(F.col("component") < (1 << 62), F.col("component"))
    linked = named.filter("valid").join(classes.select("rep", "label", "vector"), ["label", "vector"]).select("vec_id", "place", "rep").join(known, "rep")
    return linked.select(
        "vec_id", "n_links", component.alias("component_id"), (F.col("place") == F.col("component")).alias("kept")
    ).unionByName(alone)
