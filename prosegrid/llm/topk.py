"""Exact top-k by inner product: dual-tree search over cover trees.

Queries and data are indexed together.  The top level is a net of pivots, the
first points of a farthest-first order of a bounded sample; every vector lies
in the cell of its nearest pivot, whose covering radius is the distance of its
farthest member.  Under that every block of a cell has a cover tree: a node's
points lie within its covering radius of its centre, which is one of them, and
its children are a net at half that radius, down to single points.

For centres ``q``, ``r`` and radii ``a``, ``b`` no inner product exceeds
``q.r + a|r| + b|q| + ab``.  A pair of nodes is pruned if that is below the
worst kth score of the query node's queries; pairs are visited best bound
first.  Every query is first searched for in a block of its own cell; the kth
score found there goes with it, and the query is sent only to those other
cells whose bound reaches that score.

Vectors without structure have nets of single points and bounds that hardly
prune; the search then costs what scoring all pairs costs, and building a tree
grows with the square of its block.  ``Best.counts`` tells how many pairs of
points were pruned unscored.

Scores are of integers and exact: in floating point as long as no sum can
reach 2^53, else in Python's integers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prosegrid.llm.blocks import lean
from prosegrid.llm.scratch import Scratch

#: Rows of a block, which has one tree; queries that a task searches for at a time.
DATA_BLOCK, QUERY_BLOCK = 16384, 4096
#: Queries of one cell beyond which its blocks are searched by several tasks.
QUERY_SHARE = 1 << 16
#: Pivots at most, and sampled vectors for each.
PIVOTS, SAMPLE = 1024, 32
LEAF = 32
#: Rows and columns of one product.
ROWS, COLUMNS = 1024, 2048


class Tree:
    """A cover tree: for each node its centre (a point), covering radius, points and children."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.x, self.sq = x, (x * x).sum(1)
        self.norm = np.sqrt(self.sq)
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.points: list[np.ndarray] = []
        self.kids: list[np.ndarray | None] = []
        self.single: list[np.ndarray] = []
        if not len(x):
            return
        far = self._squares(np.arange(len(x)), x.mean(0)[None])[:, 0]
        first = int(far.argmin())
        todo = [self._node(np.arange(len(x)), first)]
        while todo:
            node = todo.pop()
            points, radius = self.points[node], self.radius[node]
            if len(points) <= leaf or radius == 0:
                self.single[node] = points
                continue
            centres, of = self._net(points, self.centre[node], radius / 2)
            order = np.argsort(of, kind="stable")
            bound = np.searchsorted(of[order], np.arange(len(centres) + 1))
            size = np.diff(bound)
            self.single[node] = centres[size == 1]
            kids = [self._node(points[order[bound[i] : bound[i + 1]]], int(centres[i])) for i in np.flatnonzero(size > 1)]
            self.kids[node] = np.array(kids, np.int64)
            todo += kids

    def _squares(self, points: np.ndarray, centres: np.ndarray) -> np.ndarray:
        out = self.sq[points][:, None] + (centres * centres).sum(1) - 2 * (self.x[points] @ centres.T)
        return np.maximum(out, 0)

    def _node(self, points: np.ndarray, centre: int) -> int:
        self.centre.append(centre)
        self.radius.append(float(np.sqrt(self._squares(points, self.x[centre][None]).max())) * (1 + 1e-12))
        self.points.append(points)
        self.kids.append(None)
        self.single.append(points[:0])
        return len(self.centre) - 1

    def _net(self, points: np.ndarray, centre: int, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """Centres over ``radius`` apart, ``centre`` first, and for each point the number of one that covers it."""
        centres, of, most = [centre], np.zeros(len(points), np.int64), radius * radius
        for lo in range(0, len(points), 256):
            some = points[lo : lo + 256]
            d = self._squares(some, self.x[centres])
            near = d.argmin(1)
            of[lo : lo + 256] = near
            left = np.flatnonzero(d[np.arange(len(some)), near] > most)
            while len(left):
                c = int(some[left[0]])
                covered = self._squares(some[left], self.x[c][None])[:, 0] <= most
                covered[0] = True
                of[lo + left[covered]] = len(centres)
                centres.append(c)
                left = left[~covered]
        return np.array(centres, np.int64), of


class Best:
    """The k best scores of every query so far, none of them below ``floor``; ties to the smaller id."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None):
        self.k, self.scores, self.ids = k, [np.empty(0)] * n, [np.empty(0, np.int64)] * n
        self.worst = np.full(n, -np.inf) if floor is None else floor.copy()
        #: Pairs of points that were scored, and that a bound of nodes pruned.
        self.counts = {"scored": 0, "pruned": 0}

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > self.k:
            least = max(self.worst[q], np.partition(scores, len(scores) - self.k)[len(scores) - self.k])
            keep = scores >= least
            scores, ids = scores[keep], ids[keep]
        scores, ids = np.concatenate((self.scores[q], scores)), np.concatenate((self.ids[q], ids))
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores[q], self.ids[q] = scores[order], ids[order]
        if len(order) == self.k:
            self.worst[q] = max(self.worst[q], self.scores[q][-1])


def dual_search(left: Tree, query_ids: np.ndarray, right: Tree, data_ids: np.ndarray, k: int, floor: np.ndarray | None = None) -> Best:
    """Trees over float64 matrices that hold integers -> the k best data ids of each query, its own id left out."""
    best = Best(len(left.x), k, floor)
    if not len(left.x) or not len(right.x):
        return best
    counts, size = best.counts, np.array([len(p) for p in left.points])
    centre, radius = np.array(left.centre), np.array(left.radius)

    def score(points: np.ndarray, single: np.ndarray) -> None:
        """Queries against single points of the data."""
        for lo in range(0, len(points), ROWS):
            rows = points[lo : lo + ROWS]
            for at in range(0, len(single), COLUMNS):
                columns = single[at : at + COLUMNS]
                found = left.x[rows] @ right.x[columns].T
                ids = data_ids[columns]
                good = found >= best.worst[rows][:, None]
                good &= ids != query_ids[rows][:, None]
                for i in np.flatnonzero(good.any(1)).tolist():
                    best.add(int(rows[i]), found[i, good[i]], ids[good[i]])
        counts["scored"] += len(points) * len(single)

    def bounds(nodes: np.ndarray, r: int) -> np.ndarray:
        """For query nodes and a data node."""
        c, b = right.centre[r], right.radius[r]
        dot = left.x[centre[nodes]] @ right.x[c]
        a, nq, nr = radius[nodes], left.norm[centre[nodes]], right.norm[c]
        slack = a * nr + b * nq + a * b
        return dot + slack + 1e-9 * (np.abs(dot) + slack + nq * nr) + 1e-6

    def kept(nodes: np.ndarray, bound: np.ndarray, r: int) -> np.ndarray:
        worst = np.array([best.worst[left.points[n]].min() for n in nodes.tolist()])
        keep = bound >= worst
        counts["pruned"] += int(size[nodes[~keep]].sum()) * len(right.points[r])
        return keep

    def kept_points(points: np.ndarray, r: int) -> np.ndarray:
        """Of single queries, those that the data node may have something for."""
        c, b = right.centre[r], right.radius[r]
        dot, slack = left.x[points] @ right.x[c], b * left.norm[points]
        bound = dot + slack + 1e-9 * (np.abs(dot) + slack + left.norm[points] * right.norm[c]) + 1e-6
        keep = bound >= best.worst[points]
        counts["pruned"] += int((~keep).sum()) * len(right.points[r])
        return points[keep]

    # Each entry: the best bound, query nodes, single queries, and a data node.
    none = np.empty(0, np.int64)
    stack = [(np.inf, np.zeros(1, np.int64), none, 0)]
    while stack:
        _, nodes, points, r = stack.pop()
        nodes = nodes[kept(nodes, bounds(nodes, r), r)]
        points = kept_points(points, r)
        # Query nodes as wide as the data node are replaced by their children.
        wide = radius[nodes] >= right.radius[r]
        while wide.any():
            some = nodes[wide].tolist()
            new = np.concatenate([none, *(left.kids[n] for n in some if left.kids[n] is not None)])
            single = np.concatenate([none, *(left.single[n] for n in some)])
            new = new[kept(new, bounds(new, r), r)]
            points = np.concatenate((points, kept_points(single, r)))
            nodes = np.concatenate((nodes[~wide], new))
            wide = radius[nodes] >= right.radius[r] if right.radius[r] > 0 else np.ones(len(nodes), bool)
        if not len(nodes) and not len(points):
            continue
        if len(right.single[r]):
            score(np.concatenate([points, *(left.points[n] for n in nodes.tolist())]), right.single[r])
        if right.kids[r] is not None:
            entries = []
            for c in right.kids[r].tolist():
                top = bounds(nodes, c).max(initial=-np.inf)
                if len(points):
                    dot = left.x[points] @ right.x[right.centre[c]]
                    top = max(top, float((dot + right.radius[c] * left.norm[points]).max()))
                entries.append((float(top), nodes, points, c))
            stack += sorted(entries, key=lambda e: e[0])
    return best


def _wide(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
    """Scores that floating point can't hold, in Python's integers."""
    out, d = [], data.astype(object)
    for q, own in zip(queries.astype(object), query_ids.tolist()):
        scores = [(s, i) for s, i in zip((d * q).sum(1).tolist(), data_ids.tolist()) if i != own]
        best = sorted(scores, key=lambda s: (-s[0], s[1]))[:k]
        if any(abs(s) >= 1 << 63 for s, _ in best):
            raise OverflowError(f"an inner product of vector {own} does not fit 64 bits")
        out.append(best)
    return out


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.empty((0, 0), np.int64)


def _exact(*sides: np.ndarray) -> bool:
    """Whether inner products and squares of these integers are exact in floating point."""
    most = max((float(np.abs(m.astype(np.float64)).max(initial=0.0)) for m in sides), default=0.0)
    return sides[0].shape[1] * most * most < 2**50


def _search(k: int, query_block: int) -> Callable:
    """Rows ``(dim, cell, part, share, asked, id, floor, v)`` sorted by the first five -> ``(query_id, id, score)``.

    Of each block the data come first; its tree stays while queries pass.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, data, ids = None, [], []
        tree = mine = matrix = None

        def answer(own: np.ndarray, floor: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
            nonlocal tree, mine, matrix
            if mine is None:
                mine = np.concatenate(ids)
                matrix = np.concatenate(data)
            out: list[tuple[int, int, int]] = []
            if _exact(q, matrix):
                tree = tree or Tree(matrix.astype(np.float64))
                best = dual_search(Tree(q.astype(np.float64)), own, tree, mine, k, floor)
                for i, scores, found in zip(own.tolist(), best.scores, best.ids):
                    out += [(i, j, int(s)) for j, s in zip(found.tolist(), scores.tolist())]
            else:
                for i, found in zip(own.tolist(), _wide(q, own, matrix, mine, k)):
                    out += [(i, j, s) for s, j in found]
            cols = list(zip(*out)) if out else [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_id", "id", "score"])

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            key = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)])
            edge = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
            for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), n]):
                block, asked = tuple(key[:4, lo].tolist()), bool(key[4, lo])
                if block != group:
                    group, data, ids, tree, mine, matrix = block, [], [], None, None, None
                some = batch.slice(lo, hi - lo)
                own = some.column(5).to_numpy(zero_copy_only=False)
                x = _matrix(some.column(7), hi - lo)
                if not asked:
                    ids.append(own)
                    data.append(x)
                elif ids:
                    floor = some.column(6).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False).astype(np.float64)
                    # One below: a float may round the floor up.
                    floor = np.where(np.abs(floor) < 2**53, floor, -np.inf)
                    for at in range(0, hi - lo, query_block):
                        yield answer(own[at : at + query_block], floor[at : at + query_block], x[at : at + query_block])

    return run


def _pivots(rows: DataFrame, number: int) -> dict[int, np.ndarray]:
    """For each length of vector, up to ``number`` centres: a farthest-first order of the sample."""
    sample = rows.orderBy(F.xxhash64("id", "v"), "id").limit(number * SAMPLE).select("v").collect()
    by_dim: dict[int, list] = {}
    for (v,) in sample:
        by_dim.setdefault(len(v), []).append(v)
    out = {}
    for dim, vectors in by_dim.items():
        x = np.array(vectors, np.float64).reshape(len(vectors), dim)
        picked, far = [0], ((x - x[0]) ** 2).sum(1)
        while len(picked) < min(number, len(x)) and far.max() > 0:
            picked.append(int(far.argmax()))
            far = np.minimum(far, ((x - x[picked[-1]]) ** 2).sum(1))
        out[dim] = x[picked]
    return out


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distances, and never less: where sums are not exact in floating point they are made larger by what may be missing."""
    own, its = (x * x).sum(1)[:, None], (centres * centres).sum(1)
    d = np.sqrt(np.maximum(own + its - 2 * (x @ centres.T), 0))
    return d * (1 + 1e-12) if _exact(x, centres) else d + np.sqrt(x.shape[1] * 1e-15) * (np.sqrt(own) + np.sqrt(its))


def _by_length(v: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of a list column: each length, its rows, and these as a matrix of floats."""
    size = v.value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(size).tolist():
        rows = np.flatnonzero(size == dim)
        yield dim, rows, v.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), dim)


def _cells(pivots) -> Callable:
    """``(id, v)`` -> the same with its length, cell and distance from the cell's pivot."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            dims, cell, far = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n)
            for dim, rows, x in _by_length(batch.column(1)) if n else ():
                centres = pivots.value.get(dim, np.zeros((1, dim)))
                for at in range(0, len(rows), ROWS):
                    d = _distances(x[at : at + ROWS], centres)
                    some = rows[at : at + ROWS]
                    cell[some], far[some] = d.argmin(1), d.min(1)
                dims[rows] = dim
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dims), pa.array(cell), pa.array(far)], ["id", "v", "dim", "cell", "far"])

    return run


def _elsewhere(pivots, table) -> Callable:
    """Queries ``(id, v, dim, cell, floor)`` -> one row for each other block whose cell's bound reaches the floor."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_dim: dict[int, list] = {}
        for dim, cell, parts, radius in table.value:
            by_dim.setdefault(dim, []).append((cell, parts, radius))
        for batch in batches:
            for dim, rows, x in _by_length(batch.column(1)) if batch.num_rows else ():
                if dim not in by_dim:
                    continue
                cells, parts, radius = (np.array(c) for c in zip(*by_dim[dim]))
                centres = pivots.value.get(dim, np.zeros((1, dim)))[cells]
                own = batch.column(3).to_numpy(zero_copy_only=False)[rows]
                floor = batch.column(4).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)[rows].astype(np.float64)
                for at in range(0, len(rows), ROWS):
                    some = x[at : at + ROWS]
                    dot, slack = some @ centres.T, np.sqrt((some * some).sum(1))[:, None] * radius * (1 + 1e-9)
                    top = dot + slack + 1e-6 * (1 + np.abs(dot) + slack)
                    q, c = np.nonzero(top >= floor[at : at + ROWS][:, None])
                    q, c = np.repeat(q, parts[c]), np.repeat(c, parts[c])
                    part = np.arange(len(c)) - np.searchsorted(q * len(cells) + c, q * len(cells) + c)
                    other = (cells[c] != own[at + q]) | (part > 0)  # the first block of its cell has been searched
                    q, c, part = rows[at + q[other]], cells[c[other]], part[other]
                    for lo in range(0, len(q), 8192):
                        take = pa.array(q[lo : lo + 8192])
                        yield pa.RecordBatch.from_arrays(
                            [
                                batch.column(0).take(take),
                                batch.column(1).take(take),
                                batch.column(2).take(take),
                                pa.array(c[lo : lo + 8192].astype(np.int32)),
                                pa.array(part[lo : lo + 8192].astype(np.int32)),
                                batch.column(4).take(take),
                            ],
                            ["id", "v", "dim", "cell", "part", "floor"],
                        )

    return run


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """``(id, v)``: floor(scale * x) of every component; rows with a null or non-finite one are left out."""
    x = F.col(vector_col)
    good = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return vectors.where(x.isNotNull() & F.col(id_col).isNotNull() & good).select(
        F.col(id_col).cast("long").alias("id"),
        F.transform(x, lambda c: F.floor(c.cast("double") * float(scale))).cast("array<bigint>").alias("v"),
    )


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    data_block: int = DATA_BLOCK,
    query_block: int = QUERY_BLOCK,
    query_share: int = QUERY_SHARE,
) -> DataFrame:
    """``vectors(id, v)`` and ``queries(id, v)`` -> ``(query_id, rank, id, score)``, exact.

    A query's candidates are all vectors of its length with another id; those
    of another length have no inner product with it.  Equal scores go to the
    smaller id; fewer than ``k`` candidates are all returned.  Rows that repeat
    an id and its vector count once, and of a vector that many ids have only
    the ``k + 1`` smallest can be among the best and are searched; an id that
    has several vectors may hold several places.  Empty vectors have score 0
    with each other.  Nulls are for ``quantised`` to leave out.  No candidates
    or no queries: no rows.  A score beyond 64 bits raises ``OverflowError``.

    A task holds one block of ``data_block`` vectors, its tree, and
    ``query_block`` queries.  What is broadcast are the pivots (``PIVOTS``
    at most for each length) and one row for each cell.
    """
    scratch = Scratch(vectors.sparkSession, "topk")
    sc = vectors.sparkSession.sparkContext
    one = Window.partitionBy("v").orderBy("id")
    once = vectors.select("id", "v").distinct()
    rows = scratch.store(once.withColumn("_n", F.row_number().over(one)).where(F.col("_n") <= k + 1).drop("_n"))
    number = max(1, min(PIVOTS, -(-rows.count() // data_block)))
    pivots = sc.broadcast(_pivots(rows, number))
    placed = "id long, v array<bigint>, dim int, cell int, far double"
    data = scratch.store(rows.mapInArrow(_cells(pivots), placed))
    asked = scratch.store(queries.select("id", "v").distinct().mapInArrow(_cells(pivots), placed).drop("far"))
    cells = data.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius"))
    cells = scratch.store(cells.withColumn("parts", F.ceil(F.col("n") / data_block).cast("int")))
    table = sc.broadcast([(r["dim"], r["cell"], r["parts"], r["radius"]) for r in cells.collect()])
    own = ["dim", "cell"]
    dealt = data.join(F.broadcast(cells.select(*own, "parts")), own)
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("id", "v"), F.col("parts")).cast("int"))

    def searched(blocks: DataFrame, sent: DataFrame) -> DataFrame:
        """``blocks(dim, cell, part, id, v)`` and ``sent`` with the same and ``floor``."""
        key = ["dim", "cell", "part"]
        shares = sent.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / query_share).cast("int").alias("shares"))
        left = blocks.join(shares, key).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
        right = sent.join(shares, key).withColumn("share", F.pmod(F.xxhash64("id", F.lit(3)), F.col("shares")).cast("int"))
        cols = [*key, "share", "asked", "id", "floor", "v"]
        left = left.withColumn("asked", F.lit(0)).withColumn("floor", F.lit(None).cast("long")).select(*cols)
        both = left.unionByName(right.withColumn("asked", F.lit(1)).select(*cols))
        both = both.repartition(*key, "share").sortWithinPartitions(*key, "share", "asked", "id")
        return both.mapInArrow(_search(k, query_block), "query_id long, id long, score long")

    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    best = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    home = asked.withColumn("part", F.lit(0)).withColumn("floor", F.lit(None).cast("long"))
    first = scratch.store(best(searched(dealt.where("part = 0"), home)))
    floors = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
    sent = asked.join(floors, "id", "left").select("id", "v", "dim", "cell", "floor")
    sent = scratch.store(
        sent.mapInArrow(_elsewhere(pivots, table), "id long, v array<bigint>, dim int, cell int, part int, floor long")
    )
    found = first.drop("rank")
    if not sent.isEmpty():
        found = found.unionByName(searched(dealt, sent))
    return best(found).select("query_id", "rank", "id", "score")
