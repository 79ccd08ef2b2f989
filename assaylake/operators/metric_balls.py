"""Exact nearest neighbour of unit vectors by a ball partition, the triangle bound and the planes between pivots.

The indexed points are dealt to their nearest pivot; a ball is cut into rings of its members' distance to the pivot.
For a query at distance D from a pivot, no member of the ring [low, high] is closer than max(D - high, low - D, 0), and none is
closer than the plane halfway between that pivot and the query's own, as members lie on their pivot's side of it. Every
query visits the ring around it in the ball of its nearest pivot, then a few more, near pivots first, and then all that are left,
except each ring whose bound is above the best distance found so far; a ring that cannot win is never visited, one that can always
is. Pivots and rings are bounded in number and go to every task; points and queries meet only by ring at first, then by group of
rings, in blocks of bounded rows on both sides, so a query is copied for every group of rings and not for every ring. Inside a block
the members of a ring are dealt to cells around some of them, and a query meets the cells that can win under the same two bounds: what
a query costs does not grow with the size of the rings.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, widen

MAX_PIVOTS = 1024
MAX_RINGS = 64
BALL_ROWS = 1024
BLOCK_ROWS = 16_384
#: Members of a cell, on average; a ring of less than two cells is not cut.
CELL_ROWS = 256
#: Chord lengths come from square roots of rounded differences; bounds give way by this much, so no tie is lost.
SLACK = 1e-6
#: Pivots closer than this have no plane between them: rounding would move it by more than the slack.
_LEAST_GAP = 1e-6
#: Cells of a matrix that a task works on at once; some of them fit its cache.
_CELLS = 1 << 18
#: Rings in visiting order that are visited one by one, by round; what is left is visited by groups of rings.
FIRST_STEPS = (1, 4)
#: Rows of a group of rings at least: smaller blocks only add groups.
LEAST_GROUP = 4_096
#: Cosines further apart than this differ in the twelfth decimal.
_TIE = 4e-12


def chords(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of unit vectors."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def cosine_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.round(1.0 - np.clip(a @ b.T, -1.0, 1.0), 12)


def _least(a: np.ndarray, b: np.ndarray, skip: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """For each row of `a` the least of its `cosine_distances` to the rows of `b` and the first place of it; only rows with a near tie are rounded whole."""
    cosine = a @ b.T
    if skip is not None:
        cosine[skip] = -np.inf
    top = cosine.max(1)
    place = cosine.argmax(1)
    distance = np.round(1.0 - np.clip(top, -1.0, 1.0), 12)
    tied = np.nonzero(np.count_nonzero(cosine >= top[:, None] - _TIE, axis=1) > 1)[0]
    if len(tied):
        whole = np.round(1.0 - np.clip(cosine[tied], -1.0, 1.0), 12)
        if skip is not None:
            whole[skip[tied]] = np.inf
        place[tied] = whole.argmin(1)
    distance[np.isneginf(top)] = np.inf
    return distance, place


def _matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The rows of an array<double> column, none of them null."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(vectors), -1)


def _listed(lists: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The rows and the values of the elements of an array<int> column."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(lists)), counts), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _lists(rows: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
    """An array<int> column of n rows; `rows` is sorted."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)), pa.array(values.astype(np.int32)))


def _limit(distance: np.ndarray) -> np.ndarray:
    """Chord within which something at this cosine distance or nearer lies."""
    return np.where(np.isfinite(distance), np.sqrt(2.0 * np.minimum(distance, 2.0)), np.inf) + SLACK


def _gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between pivots; infinite where no plane is to be used."""
    gap = chords(a, b)
    return np.where(gap < _LEAST_GAP, np.inf, gap)


class _Index:
    """What tasks need to bound distances to rings; `ball` is sorted and every pivot has a ring."""

    def __init__(self, pivots: np.ndarray, ball: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.pivots, self.ball, self.low, self.high = pivots, ball, low, high
        self.count = np.bincount(ball, minlength=len(pivots))
        self.first = np.cumsum(self.count) - self.count
        self.slice_rows = max(1, _CELLS // len(ball))

    @cached_property
    def gap(self) -> np.ndarray:
        return _gaps(self.pivots, self.pivots)

    def home(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query its nearest pivot, and of that ball the ring around it or nearest to it."""
        cosine = queries @ self.pivots.T
        home = cosine.argmax(1)
        away = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine[np.arange(len(home)), home]))[:, None]
        step = np.arange(self.count.max())[None, :]
        ring = np.minimum(self.first[home][:, None] + step, len(self.ball) - 1)
        bound = np.maximum(away - self.high[ring], self.low[ring] - away)
        bound[step >= self.count[home][:, None]] = np.inf
        return home, self.first[home] + bound.argmin(1)

    def open(self, queries: np.ndarray, home: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs of a query and a ring that can hold something within the limit, by query, and the place of a ring in its visiting order."""
        cosine = queries @ self.pivots.T
        ahead = cosine[np.arange(len(home)), home][:, None] - cosine
        query, ball = np.nonzero(ahead <= limit[:, None] * self.gap[home])
        away = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine[query, ball]))
        apart = ahead[query, ball] / self.gap[home[query], ball]
        count = self.count[ball]
        ring = np.repeat(self.first[ball] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        query, away, apart = np.repeat(query, count), np.repeat(away, count), np.repeat(apart, count)
        bound = np.maximum(np.maximum(away - self.high[ring], self.low[ring] - away), np.maximum(apart, 0.0))
        worth = bound <= limit[query]
        return query[worth], ring[worth], (bound + away)[worth]


@dataclass
class Balls:
    pivots: np.ndarray
    ball: np.ndarray     # of each ring
    low: np.ndarray      # distances of the ring's members to the pivot
    high: np.ndarray
    parts: np.ndarray    # blocks of each ring
    sizes: np.ndarray    # members of each ring
    members: DataFrame   # ring, part, point, v
    rows: int

    @property
    def plain(self) -> tuple:
        """What tasks need to bound distances."""
        return self.pivots, self.ball, self.low, self.high


def build_balls(points: DataFrame, *, ball_rows: int = BALL_ROWS, block_rows: int = BLOCK_ROWS) -> Balls:
    """Index `point, v` (unit vectors, staged: they are read more than once). Pivots are the points of least hash, so every layout gives the same balls."""
    points = points.select("point", "v")
    rows = points.count()
    wanted = min(MAX_PIVOTS, max(1, ceil(rows / ball_rows)))
    chosen = points.orderBy(F.xxhash64("v"), "point").limit(wanted).toPandas()  # MAX_PIVOTS vectors at most
    pivots = np.stack(chosen["v"].to_numpy()).astype(np.float64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v, found = _matrix(batch.column("v")), []
                for start in range(0, len(v), max(1, _CELLS // len(pivots))):
                    cosine = v[start:start + max(1, _CELLS // len(pivots))] @ pivots.T
                    ball = cosine.argmax(1)
                    found.append((ball, cosine[np.arange(len(ball)), ball]))
                ball, cosine = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(ball.astype(np.int32)), pa.array(np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine)))], [*batch.schema.names, "ball", "r"])

    dealt = cut_lineage(widen(points).mapInArrow(deal, T.StructType([*points.schema.fields, T.StructField("ball", T.IntegerType()), T.StructField("r", T.DoubleType())])))
    steps = [F.lit(k / MAX_RINGS) for k in range(1, MAX_RINGS)]
    balls = dealt.groupBy("ball").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("r", F.array(*steps)).alias("edges"))
    rings = F.least(F.lit(MAX_RINGS), F.ceil(F.col("n") / block_rows))
    inner = F.size(F.filter("edges", lambda e: e < F.col("r")))
    ringed = dealt.join(F.broadcast(balls), "ball").withColumn("cut", F.floor(inner * rings / MAX_RINGS).cast("int")).drop("edges", "n")
    about = ringed.groupBy("ball", "cut").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("low"), F.max("r").alias("high"))
    catalog = about.orderBy("ball", "cut").toPandas()  # MAX_PIVOTS * MAX_RINGS rows at most
    sizes = catalog["n"].to_numpy()
    parts = np.maximum(1, -(-sizes // block_rows)).astype(int)
    numbered = points.sparkSession.createDataFrame(
        [(int(b), int(c), k, int(p)) for k, (b, c, p) in enumerate(zip(catalog["ball"], catalog["cut"], parts))], "ball int, cut int, ring int, parts int")
    members = ringed.join(F.broadcast(numbered), ["ball", "cut"]).select(
        "ring", F.pmod(F.xxhash64(F.lit(5), "point"), F.col("parts")).cast("int").alias("part"), "point", "v")
    used, ball = np.unique(catalog["ball"].to_numpy(), return_inverse=True)
    return Balls(pivots[used], ball, catalog["low"].to_numpy(), catalog["high"].to_numpy(), parts, sizes, cut_lineage(members), rows)


def _started(queries: DataFrame, balls: Balls) -> DataFrame:
    """The queries with their state: nearest pivot, best distance, its point, comparisons, rings seen, and what to visit next (one ring)."""
    plain = balls.plain

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _Index(*plain)
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column("v"))
                found = [index.home(v[k:k + index.slice_rows]) for k in range(0, len(v), index.slice_rows)]
                home, ring = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home.astype(np.int32)), _lists(np.arange(len(v)), ring, len(v))], [*batch.schema.names, "home", "next"])

    queries = queries.select("id", "v")
    added = [T.StructField("home", T.IntegerType()), T.StructField("next", T.ArrayType(T.IntegerType()))]
    point = balls.members.schema["point"].dataType
    return widen(queries).mapInArrow(start, T.StructType([*queries.schema.fields, *added])).select(
        "id", "v", "home", F.lit(float("inf")).alias("distance"), F.lit(None).cast(point).alias("point"), F.lit(0).cast("long").alias("compared"),
        F.array().cast("array<int>").alias("seen"), "next")


def _planned(state: DataFrame, balls: Balls, width: int | None, group: np.ndarray) -> DataFrame:
    """Adds `next`: of the rings that a query has not seen and that can win the first `width`, or the groups of all of them."""
    plain = balls.plain

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _Index(*plain)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, chosen = [], []
            for start in range(0, batch.num_rows, index.slice_rows):
                part = batch.slice(start, index.slice_rows)
                query, ring, place = index.open(_matrix(part.column("v")), part.column("home").to_numpy(), _limit(part.column("distance").to_numpy()))
                seen = np.zeros((part.num_rows, len(index.ball)), dtype=bool)
                seen[_listed(part.column("seen"))] = True
                new = np.nonzero(~seen[query, ring])[0]
                query, ring, place = query[new], ring[new], place[new]
                if width is None:
                    query, ring = np.divmod(np.unique(query * (group.max() + 1) + group[ring]), group.max() + 1)
                else:
                    order = np.lexsort((place, query))
                    query, ring = query[order], ring[order]
                    early = np.arange(len(query)) - np.searchsorted(query, query) < width
                    query, ring = query[early], ring[early]
                rows.append(query + start)
                chosen.append(ring)
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(np.concatenate(rows), np.concatenate(chosen), batch.num_rows)], [*batch.schema.names, "next"])

    return state.mapInArrow(plan, T.StructType([*state.schema.fields, T.StructField("next", T.ArrayType(T.IntegerType()))]))


def _visits(state: DataFrame, balls: Balls) -> DataFrame:
    """The blocks of rings each query has to visit in this round: `to` (ring), `part` and what the query brings."""
    return _sent(state, balls.parts)


def _sent(state: DataFrame, parts: np.ndarray) -> DataFrame:
    """A row for each query and block of what it visits next."""
    blocks = state.sparkSession.createDataFrame([(k, int(p)) for k, p in enumerate(parts)], "to int, parts int")  # as many rows as rings at most
    return (state.select(F.explode("next").alias("to"), "id", "v", "home", "distance", "seen").join(F.broadcast(blocks), "to")
            .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts"))


class _Block:
    """Members of some rings in cells: those of a ring of two cells or more are dealt to some of them, evenly spaced."""

    def __init__(self, index: _Index, v: np.ndarray, ring: np.ndarray):
        self.index, self.rings = index, np.unique(ring)
        order, pivots, low, high, ends, ring_of, self.families = [], [], [], [], [], [], []
        by_ring = np.argsort(ring, kind="stable")
        for k, inside in enumerate(np.split(by_ring, np.searchsorted(ring[by_ring], self.rings[1:]))):
            before, cells = len(ring_of), len(inside) // CELL_ROWS
            if cells < 2:
                pivots.append(index.pivots[index.ball[self.rings[k]]][None, :])
                low.append(index.low[self.rings[k]][None])
                high.append(index.high[self.rings[k]][None])
                ends.append(np.array([len(inside)]))
            else:
                own = v[inside[np.arange(cells) * len(inside) // cells]]
                cosine = v[inside] @ own.T
                cell = cosine.argmax(1)
                away = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine[np.arange(len(cell)), cell]))
                by_cell = np.argsort(cell, kind="stable")
                inside, away = inside[by_cell], away[by_cell]
                used, starts = np.unique(cell[by_cell], return_index=True)
                pivots.append(own[used])
                low.append(np.minimum.reduceat(away, starts))
                high.append(np.maximum.reduceat(away, starts))
                ends.append(np.append(starts[1:], len(inside)))
                self.families.append((slice(before, before + len(used)), _gaps(own[used], own[used])))
            order.append(inside)
            ends[-1] = ends[-1] + sum(map(len, order[:-1]))
            ring_of += [k] * len(pivots[-1])
        self.order, self.pivots, self.ring_of = np.concatenate(order), np.concatenate(pivots), np.array(ring_of)
        self.low, self.high, self.ends = np.concatenate(low)[:, None], np.concatenate(high)[:, None], np.concatenate(ends)
        self.starts = np.append(0, self.ends[:-1])
        self.v = v[self.order]
        self.slice_rows = max(1, _CELLS // len(self.ends))
        self.gap = _gaps(index.pivots[index.ball[self.rings]], index.pivots)

    def bounds(self, queries: np.ndarray, home: np.ndarray, seen: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Of each cell (rows) for each query: least distance of its members, infinite in rings seen, and distance of its pivot."""
        index, at = self.index, np.arange(len(queries))
        cosine = self.pivots @ queries.T
        away = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine))
        bound = np.maximum(away - self.high, self.low - away)
        for cells, gap in self.families:
            nearest_one = cosine[cells].argmax(0)
            np.maximum(bound[cells], (cosine[cells][nearest_one, at] - cosine[cells]) / gap[:, nearest_one], out=bound[cells])
        ball = index.ball[self.rings]
        cosine = index.pivots[ball] @ queries.T
        ring_away = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine))
        whole = np.maximum(ring_away - index.high[self.rings][:, None], index.low[self.rings][:, None] - ring_away)
        np.maximum(whole, (np.einsum("ij,ij->i", queries, index.pivots[home]) - cosine) / self.gap[:, home], out=whole)
        query, ring = seen
        place = np.minimum(np.searchsorted(self.rings, ring), len(self.rings) - 1)
        here = self.rings[place] == ring
        whole[place[here], query[here]] = np.inf
        return np.maximum(bound, whole[self.ring_of]), away

    def search(self, queries: np.ndarray, home: np.ndarray, seen: tuple[np.ndarray, np.ndarray], known: np.ndarray, self_place: np.ndarray | None
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each query the least distance, the first member (as dealt) that has it, and the members compared; infinite if none can be within `known`."""
        bound, away = self.bounds(queries, home, seen)
        limit = _limit(known)
        best, at, met = np.full(len(queries), np.inf), np.zeros(len(queries), dtype=np.int64), np.zeros(len(queries), dtype=np.int64)

        def visit(cell: int, all_rows: np.ndarray) -> None:
            inside, v = self.order[self.starts[cell]:self.ends[cell]], self.v[self.starts[cell]:self.ends[cell]]
            step = max(1, _CELLS // len(inside))
            for rows in (all_rows[k:k + step] for k in range(0, len(all_rows), step)):
                skip = None if self_place is None else self_place[rows][:, None] == inside[None, :]
                distance, place = _least(queries[rows], v, skip)
                place = inside[place]
                met[rows] += len(inside) - (0 if skip is None else skip.sum(1))
                better = (distance < best[rows]) | ((distance == best[rows]) & (place < at[rows]))
                rows, distance = rows[better], distance[better]
                best[rows], at[rows] = distance, place[better]
                limit[rows] = np.minimum(limit[rows], _limit(distance))

        everyone = np.arange(len(queries))
        first = (bound + away).argmin(0)
        now = everyone[(bound[first, everyone] <= limit) & (bound[first, everyone] < np.inf)]
        now = now[np.argsort(first[now], kind="stable")]
        cells, starts = np.unique(first[now], return_index=True)
        for cell, rows in zip(cells, np.split(now, starts[1:])):
            visit(cell, rows)
        bound[first, everyone] = np.inf
        for cell in np.argsort(bound.min(1), kind="stable"):
            rows = np.nonzero((bound[cell] <= limit) & (bound[cell] < np.inf))[0]
            if len(rows):
                visit(cell, rows)
        return best, at, met


def _compared(visits: DataFrame, members: DataFrame, balls: Balls, block_rows: int, own: bool) -> DataFrame:
    """Best member of each visited block: `id, distance, point, compared`. A block met by many queries is copied for every block_rows of them."""
    plain = balls.plain
    met = F.broadcast(visits.groupBy("to", "part").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("slices")))  # as many rows as blocks
    left = visits.join(met, ["to", "part"]).withColumn("slice", F.pmod(F.xxhash64(F.lit(7), "id"), F.col("slices")).cast("int")).drop("slices")
    right = members.join(met, ["to", "part"]).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
    kind, point = visits.schema["id"].dataType.simpleString(), members.schema["point"].dataType.simpleString()

    def kernel(queries: pa.Table, found: pa.Table) -> pa.Table:
        if not (queries.num_rows and found.num_rows):
            none = [queries.column("id").slice(0, 0), pa.array([], pa.float64()), found.column("point").slice(0, 0), pa.array([], pa.int64())]
            return pa.table(none, ["id", "distance", "point", "compared"])
        found = found.take(pc.sort_indices(found, sort_keys=[("point", "ascending")]))
        block = _Block(_Index(*plain), _matrix(found.column("v")), found.column("ring").to_numpy())
        ids, results = queries.column("id"), []
        for start in range(0, queries.num_rows, block.slice_rows):
            part = queries.slice(start, block.slice_rows)
            self_place = None
            if own:
                self_place = pc.fill_null(pc.index_in(part.column("id"), value_set=found.column("point").combine_chunks()), -1).to_numpy()
            results.append(block.search(_matrix(part.column("v")), part.column("home").to_numpy(), _listed(part.column("seen")), part.column("distance").to_numpy(), self_place))
        distance, at, compared = (np.concatenate(x) for x in zip(*results))
        return pa.table([ids, pa.array(distance), found.column("point").take(pa.array(at)), pa.array(compared)], ["id", "distance", "point", "compared"])

    keys = ("to", "part", "slice")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(kernel, f"id {kind}, distance double, point {point}, compared long")


def _grouped(balls: Balls, block_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The group of each ring, and the blocks of each group; a group holds rings of about `block_rows` members (LEAST_GROUP at least) in a block."""
    inside = -(-balls.sizes // balls.parts)
    _, group = np.unique((np.cumsum(inside) - inside) // max(block_rows, LEAST_GROUP), return_inverse=True)
    parts = np.zeros(group.max() + 1, dtype=np.int64)
    np.maximum.at(parts, group, balls.parts)
    return group, parts


def nearest(queries: DataFrame, balls: Balls, *, own: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Nearest indexed point of every query `id, v` (unit vectors): `id, distance` (cosine, 12 decimals), `point`, `compared`.

    Ties go to the lowest point. `own` leaves out the point whose name is the query's id. `compared` counts the indexed
    points a query was compared with. Two rounds visit single rings, one all that is left, by groups of rings.
    """
    group, group_parts = _grouped(balls, block_rows)
    state, finished = cut_lineage(_started(queries, balls)), []
    for later in (*FIRST_STEPS[1:], None, 0):  # what the round after this one visits: some rings, all that are left, nothing
        last = later == 0
        if last:
            numbered = state.sparkSession.createDataFrame([(k, int(g)) for k, g in enumerate(group)], "ring int, to int")
            met = _compared(_sent(state, group_parts), balls.members.join(F.broadcast(numbered), "ring"), balls, max(block_rows, LEAST_GROUP), own)
        else:
            met = _compared(_visits(state, balls), balls.members.withColumn("to", F.col("ring")), balls, block_rows, own)
        hits = met.where(F.col("distance") < float("inf")).groupBy("id").agg(
            F.min(F.struct("distance", "point")).alias("hit"), F.sum("compared").alias("more"))
        mine = F.struct("distance", "point")
        best = F.when(F.col("hit").isNull() | (mine < F.col("hit")), mine).otherwise(F.col("hit"))
        state = state.join(hits.hint("merge"), "id", "left").select(
            "id", "v", "home", best["distance"].alias("distance"), best["point"].alias("point"),
            (F.col("compared") + F.coalesce("more", F.lit(0))).alias("compared"), F.concat("seen", "next").alias("seen"))
        if last:
            finished.append(state)
            break
        state = cut_lineage(_planned(state, balls, later, group))
        finished.append(state.where(F.size("next") == 0))
        state = state.where(F.size("next") > 0)
        if state.isEmpty():
            break
    out = finished[0].select("id", "distance", "point", "compared")
    for more in finished[1:]:
        out = out.unionByName(more.select("id", "distance", "point", "compared"))
    return out
