"""Exact top-k search by inner product, with dual trees.

Queries and data get the same kind of index. A net of points, the top of the cover tree, is taken
farthest first from a bounded sample, so each prefix of it is a level; every vector of the table goes to its
nearest net point. A cell is cut into blocks of bounded size, and each block is a cover
tree: a node's points lie within its radius, its children's centres lie apart by more than half
of that and cover it within half. Equal vectors are one point that keeps its first k + 1 ids: no query needs more.

Two nodes with centres q and p and radii r and s hold no pair with more than
q.p + r|p| + s|q| + rs. A pair is pruned if that is below the worst k-th score of the query group:

1. every query block is searched in one block of its own cell, which gives its k-th scores;
2. it then meets the blocks of the cells that this bound leaves; inside, both trees are walked
   down together, the query group carrying the data nodes still open, best bound first;
3. what the pairs of blocks found is merged per query block, in two levels.

Bounds are float with a margin; scores are exact integers. Only a strictly lower bound prunes, so equal
scores are decided by id.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow, with_rid, written
from tessera.llm.vectors import integer_rows, matrix, slices

CELL_ROWS = 4_096     # rows of a data block, about
QUERY_ROWS = 1_024    # rows of a query block, about
MAX_CELLS = 1_024     # net points
NET_SAMPLE = 8_192    # rows that net points are chosen from, about
LEAF = 64             # points of a leaf, of data
QUERY_LEAF = 32       # of queries: a group that shares bounds
CHUNK = 2_048         # points whose scores are computed at a time
LANES = 64            # lanes of the first merge
LOWEST = np.iinfo(np.int64).min
FOUND = np.dtype([("q", "<i8"), ("query_id", "<i8"), ("score", "<i8"), ("no_id", "i1"), ("id", "<i8"), ("rid", "<i8")])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows, as longs; one that doesn't fit a long is an error."""
    largest = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if largest < 1 << 53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    if largest < 1 << 63:
        return a.astype(np.int64) @ b.T.astype(np.int64)
    return (a.astype(object) @ b.T.astype(object)).astype(np.int64)


def norms(x: np.ndarray) -> np.ndarray:
    x = x.astype(float)
    return np.sqrt(np.einsum("ij,ij->i", x, x))


def distances(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return norms(x.astype(float) - centre.astype(float))


def most(p: np.ndarray, s: np.ndarray, q: np.ndarray, r: float) -> np.ndarray:
    """Upper bounds of the scores between points in a ball (q, r) and in balls (rows of p, s), with a margin."""
    size, of = norms(p), float(np.sqrt(q @ q))
    more = r * size + s * of + r * s
    return p @ q + more + 1e-9 * (size * of + more) + 1e-6


@dataclass
class CoverTree:
    """Nodes in breadth-first order; a node's points are rows ``start`` to ``end`` of ``points``."""
    points: np.ndarray   # distinct vectors
    start: np.ndarray
    end: np.ndarray
    centre: np.ndarray   # row of the centre in points
    radius: np.ndarray
    child: np.ndarray    # first child
    children: np.ndarray  # number of children; 0 for a leaf

    @classmethod
    def of(cls, points: np.ndarray, leaf: int = LEAF) -> tuple[CoverTree, np.ndarray]:
        """(tree, order of the points)."""
        order = np.empty(len(points), np.int64)
        start, end, centre, radius, child, children = [], [], [], [], [], []
        queue = [(np.arange(len(points)), 0, 0, distances(points, points[0]))]
        while queue:
            level, queue = queue, []
            for rows, c, at, far in level:
                start.append(at)
                end.append(at + len(rows))
                centre.append(c)
                radius.append(float(far.max()))
                child.append(0)
                children.append(0)
                if len(rows) <= leaf or radius[-1] == 0:
                    order[at:at + len(rows)] = rows
                    continue
                scale, centres = radius[-1] / 2, [c]  # farthest first: centres lie more than scale apart
                near, of = far.copy(), np.zeros(len(rows), np.int64)
                while near[k := int(near.argmax())] > scale:
                    d = distances(points[rows], points[rows[k]])
                    closer = d < near
                    near[closer], of[closer] = d[closer], len(centres)
                    centres.append(int(rows[k]))
                by = np.argsort(of, kind="stable")
                size = np.bincount(of, minlength=len(centres))
                # neighbouring centres with few points share a leaf, with a radius that covers them
                ends = np.cumsum(size)
                cuts, first, held = [], 0, 0
                for j, s in enumerate(size.tolist()):
                    held += s
                    if j == len(size) - 1 or held + size[j + 1] > leaf:
                        cuts.append((first, j))
                        first, held = j + 1, 0
                if len(cuts) == 1:  # nothing to tell apart
                    order[at:at + len(rows)] = rows
                    continue
                child[-1], children[-1] = -len(queue) - 1, len(cuts)
                for a, b in cuts:
                    lo, hi = int(ends[a] - size[a]), int(ends[b])
                    part = by[lo:hi]
                    own = centres[a]
                    queue.append((rows[part], own, at + lo,
                                  near[part] if a == b else distances(points[rows[part]], points[own])))
            base = len(start)
            for i in range(base - len(level), base):
                if child[i] < 0:
                    child[i] = base - child[i] - 1
        place = np.empty(len(points), np.int64)
        place[order] = np.arange(len(points))
        points = points[order]
        if np.abs(points).max(initial=0) < 1 << 31:
            points = points.astype(np.int32)
        return cls(points, np.array(start), np.array(end), place[centre], np.array(radius),
                   np.array(child), np.array(children)), order

    def bounds(self, nodes: np.ndarray, q: np.ndarray, r: float) -> np.ndarray:
        """Upper bounds of the scores between a ball (centre, radius) and the nodes' points."""
        return most(self.points[self.centre[nodes]].astype(float), self.radius[nodes], q.astype(float), r)


class Best:
    """The k best found for each query of a block, and the score that a find must reach."""

    def __init__(self, qrid: np.ndarray, qid: np.ndarray, k: int, reach: np.ndarray):
        self.qrid, self.qid, self.k, self.reach = qrid, qid, k, reach
        self.found = np.empty(0, FOUND)
        self.at = np.empty(0, np.int64)

    def add(self, at: np.ndarray, score: np.ndarray, no_id, ids, rids) -> None:
        new = np.empty(len(at), FOUND)
        new["q"], new["query_id"], new["score"] = self.qrid[at], self.qid[at], score
        new["no_id"], new["id"], new["rid"] = no_id, ids, rids
        other = new["rid"] != new["q"]  # not the query's own row
        self.found = np.concatenate([self.found, new[other]])
        self.at = np.concatenate([self.at, at[other]])
        order, rank = ranked(self.at, self.found)
        keep, rank = order[rank < self.k], rank[rank < self.k]
        self.found, self.at = self.found[keep], self.at[keep]
        full = np.flatnonzero(rank == self.k - 1)
        self.reach[self.at[full]] = np.maximum(self.reach[self.at[full]], self.found["score"][full])


def ranked(group: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank from 0 in it): by group, falling score, id with nulls last, row."""
    order = np.lexsort((found["rid"], found["id"], found["no_id"], -found["score"], group))
    g = group[order]
    first = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.empty(0, np.int64)
    return order, np.arange(len(g)) - np.repeat(first, np.diff(np.append(first, len(g))))


@dataclass
class Block:
    """A cover tree with, for each point, its first ids (no_id, id, rid) and where they start."""
    tree: CoverTree
    begin: np.ndarray
    ids: np.ndarray  # FOUND-like rows: no_id, id, rid

    @classmethod
    def of(cls, x: np.ndarray, no_id, ids, rids, keep: int | None, leaf: int = LEAF) -> Block:
        """Of each distinct vector the first ``keep`` rows, all without it."""
        points, which = np.unique(x, axis=0, return_inverse=True)
        which = which.ravel()
        order = np.lexsort((rids, ids, no_id, which))
        w = which[order]
        first = np.searchsorted(w, np.arange(len(points)))
        if keep is not None:
            order = order[np.arange(len(w)) - first[w] < keep]
        tree, place = CoverTree.of(points, leaf)
        at = np.empty(len(points), np.int64)
        at[place] = np.arange(len(points))
        own = at[which[order]]
        by = np.argsort(own, kind="stable")
        order, own = order[by], own[by]
        got = np.empty(len(order), FOUND)
        got["no_id"], got["id"], got["rid"], got["score"] = no_id[order], ids[order], rids[order], own
        return cls(tree, np.searchsorted(own, np.arange(len(points) + 1)), got)


def search(query: Block, data: Block, k: int, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(finds, reach): for each query row the k best rows of ``data`` whose score is ``reach`` at least.

    ``reach``, per row of ``query.ids``, is a score that k rows are known to have; it is returned raised.
    """
    qt, dt = query.tree, data.tree
    best = Best(query.ids["rid"], query.ids["id"], k, reach.copy())
    count = np.diff(data.begin)

    def leaf(node: int, open_: np.ndarray) -> None:
        a, b = int(qt.start[node]), int(qt.end[node])
        rows = slice(int(query.begin[a]), int(query.begin[b]))
        of_point = query.ids["score"][rows]  # the point that each query row stands for
        q, c, r = qt.points[a:b], qt.points[qt.centre[node]], float(qt.radius[node])
        while len(inner := open_[dt.children[open_] > 0]):
            open_ = np.concatenate([open_[dt.children[open_] == 0], *[
                np.arange(dt.child[n], dt.child[n] + dt.children[n]) for n in inner]])
            open_ = open_[dt.bounds(open_, c, r) >= best.reach[rows].min()]
        bound = dt.bounds(open_, c, r)
        order = np.argsort(-bound)
        open_, bound = open_[order], bound[order]
        size = np.cumsum(dt.end[open_] - dt.start[open_])
        at = 0
        while at < len(open_) and bound[at] >= best.reach[rows].min():
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + CHUNK, "right")))
            p = np.concatenate([np.arange(dt.start[n], dt.end[n]) for n in open_[at:to]])
            at = to
            score = products(q, dt.points[p])[of_point - a]
            need = best.reach[rows]
            if len(p) > k + 1:  # one of the k + 1 best points may be the query's own
                need = np.maximum(need, np.partition(score, len(p) - k - 1, axis=1)[:, len(p) - k - 1])
            i, j = np.nonzero(score >= need[:, None])
            p = p[j]
            times = count[p]
            source = np.repeat(data.begin[p] - np.append(0, np.cumsum(times)[:-1]), times) + np.arange(times.sum())
            got = data.ids[source]
            best.add(np.repeat(i + rows.start, times), np.repeat(score[i, j], times), got["no_id"], got["id"], got["rid"])

    def walk(node: int, open_: np.ndarray) -> None:
        rows = slice(int(query.begin[qt.start[node]]), int(query.begin[qt.end[node]]))
        c, r = qt.points[qt.centre[node]], float(qt.radius[node])
        while True:  # data nodes wider than this query group are opened first
            open_ = open_[dt.bounds(open_, c, r) >= best.reach[rows].min()]
            wide = (dt.children[open_] > 0) & (dt.radius[open_] > r)
            if not wide.any():
                break
            open_ = np.concatenate([open_[~wide], *[
                np.arange(dt.child[n], dt.child[n] + dt.children[n]) for n in open_[wide]]])
        if not len(open_):
            return
        if not qt.children[node]:
            return leaf(node, open_)
        for n in range(qt.child[node], qt.child[node] + qt.children[node]):
            walk(int(n), open_)

    walk(0, np.zeros(1, np.int64))
    return best.found, best.reach


def net(x: np.ndarray, size: int) -> np.ndarray:
    """At most ``size`` distinct rows, farthest first."""
    out = [0]
    near = distances(x, x[0])
    while len(out) < size and near.max() > 0:
        out.append(int(near.argmax()))
        near = np.minimum(near, distances(x, x[out[-1]]))
    return x[out]


def _runs(batches, key: str):
    """(key, [batches]) for runs of equal ``key`` in sorted batches."""
    held, current = [], None
    for batch in batches:
        k = batch[key].to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(k)) + 1).tolist(), len(k)] if len(k) else []
        for a, b in zip(cuts, cuts[1:]):
            if held and k[a] != current:
                yield int(current), held
                held = []
            current = k[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield int(current), held


def _blocks(rows: DataFrame, name: str, width: int, keep: int | None) -> DataFrame:
    """(no, home, blob of a Block) of rows (no, home, id, _rid, x); home is the same for all rows of a block."""
    def build(batches):
        for no, held in _runs(batches, "no"):
            x = np.concatenate([matrix(b["x"], width=width) for b in held])
            whole = pa.Table.from_batches(held)
            block = Block.of(x, whole["id"].is_null().to_numpy().astype(np.int8),
                             whole["id"].fill_null(0).to_numpy(), whole["_rid"].to_numpy(), keep,
                             LEAF if keep else QUERY_LEAF)
            yield pa.RecordBatch.from_pydict({
                "no": pa.array([no], pa.int64()), "home": held[0]["home"].slice(0, 1),
                "blob": pa.array([pickle.dumps(block, 5)], pa.binary())})

    spread = rows.select("no", "home", "id", "_rid", "x").repartition("no").sortWithinPartitions("no")
    return written(map_arrow(spread, build, "no long, home long, blob binary"), name)


def _merge(finds: DataFrame, k: int, by: list[str]) -> DataFrame:
    """The k best of each query, of rows (no, lane, blob of FOUND) sorted by ``by``."""
    def run(batches):
        current, held = None, None

        def row():
            no, lane = current[0], current[-1] if "lane" in by else 0
            return pa.RecordBatch.from_pydict({"no": pa.array([no], pa.int64()), "lane": pa.array([lane], pa.int32()),
                                               "blob": pa.array([held.tobytes()], pa.binary())})

        for batch in batches:
            for key, blob in zip(zip(*[batch[c].to_pylist() for c in by]), batch["blob"]):
                got = np.frombuffer(blob.as_buffer(), FOUND)
                if key != current:
                    if current is not None:
                        yield row()
                    current, held = key, np.empty(0, FOUND)
                got = np.concatenate([held, got])
                order, rank = ranked(got["q"], got)
                held = got[order[rank < k]]
        if current is not None:
            yield row()

    return map_arrow(finds.select("no", "lane", "blob").repartition(*by).sortWithinPartitions(*by), run,
                     "no long, lane int, blob binary")


def top_k(df: DataFrame, is_query: Column, *, k: int = 5, scale: int = 256, id_col: str = "vec_id",
          vec_col: str = "embedding", cell_rows: int = CELL_ROWS, query_rows: int = QUERY_ROWS,
          max_cells: int = MAX_CELLS, sample: int = NET_SAMPLE) -> DataFrame:
    """(query_id, rank int from 1, id long, score long): each query's ``k`` best rows, all if fewer.

    Components are integers floor(scale * component) of at most 31 bits (a larger one fails the job); the
    score is their inner product, exact. Queries are the rows for which ``is_query``, a condition on the id, is true; candidates
    are all other rows of the table. Ties go to the smaller id, null ids last, then to the earlier row. Vectors that are null
    or hold null or non-finite components take no part. A shorter vector counts as followed by zeros. Rows
    that repeat an id are separate rows, as queries too. Other columns are ignored; no rows or
    no queries give no rows. About ``sample`` rows and ``max_cells`` cells reach the driver; they shape the
    index, not the result.
    """
    spark = df.sparkSession
    schema = "query_id long, rank int, id long, score long"
    rows = written(with_rid(integer_rows(df, scale, id_col=id_col, vec_col=vec_col)), "search_rows")
    n, width = rows.agg(F.count("*"), F.max(F.octet_length("x"))).first()
    width = max(1, (width or 0) // 4)
    if not n:
        return spark.createDataFrame([], schema)
    share = min(1.0, sample / n)  # by hash, so a task sends its part of the sample only
    some = rows.where(F.pmod(F.xxhash64("_rid"), F.lit(1 << 30)) < share * (1 << 30)).orderBy("_rid").select("x").collect() \
        or rows.limit(1).select("x").collect()
    points = net(matrix(pa.array([bytes(r.x) for r in some], pa.binary()), width=width),
                 min(max_cells, -(-n // cell_rows)))
    size = norms(points)

    def route(batches):
        p = points.astype(float)
        for batch in slices(batches, 4096):
            x = matrix(batch["x"], width=width)
            cell = (size ** 2 - 2 * (x.astype(float) @ p.T)).argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell, pa.int32()), pa.array(norms(x - points[cell]))],
                names=[*batch.schema.names, "cell", "off"])

    query = rows.withColumn(id_col, F.col("id")).select("*", F.coalesce(is_query, F.lit(False)).alias("is_query"))
    routed = written(map_arrow(query.select("_rid", "id", "x", "is_query"), route,
                               "_rid long, id long, x binary, is_query boolean, cell int, off double"), "search_cells")
    cells = routed.groupBy("cell").agg(F.count("*").alias("n"), F.max("off").alias("off"),
                                       F.count_if("is_query").alias("nq")).orderBy("cell").collect()
    parts = np.array([-(-c.n // cell_rows) for c in cells])
    base = np.append(0, np.cumsum(parts)[:-1])
    qparts = np.array([-(-c.nq // query_rows) for c in cells])
    qbase = np.append(0, np.cumsum(qparts)[:-1])
    known = spark.createDataFrame([(c.cell, int(a), int(b), int(qa), int(qb)) for c, a, b, qa, qb in zip(
        cells, base, parts, qbase, qparts)], "cell int, base long, parts long, qbase long, qparts long")
    placed = routed.join(F.broadcast(known), "cell")  # at most max_cells rows
    place = F.xxhash64("_rid")
    data = _blocks(placed.withColumn("no", F.col("base") + F.pmod(place, "parts")).withColumn("home", F.col("no")),
                   "search_data", width, k + 1)
    # the query blocks of a cell start at different data blocks of it
    queries = placed.where("is_query").withColumn("i", F.pmod(place, "qparts"))
    queries = _blocks(queries.withColumn("no", F.col("qbase") + F.col("i")).withColumn(
        "home", F.col("base") + F.pmod("i", "parts")), "search_queries", width, None)
    cell_no = np.array([c.cell for c in cells])
    centre, reach_of = points[cell_no].astype(float), np.array([c.off for c in cells])

    def seed(batches):
        for batch in batches:
            for no, home, q, d in zip(*[batch[c].to_pylist() for c in ("no", "home", "q", "d")]):
                q, d = pickle.loads(q), pickle.loads(d)
                found, reach = search(q, d, k, np.full(len(q.ids), LOWEST))
                c, r = q.tree.points[q.tree.centre[0]].astype(float), float(q.tree.radius[0])
                left = cell_no[most(centre, reach_of, c, r) >= reach.min()]
                yield pa.RecordBatch.from_pydict({
                    "no": pa.array([no], pa.int64()), "home": pa.array([home], pa.int64()),
                    "blob": pa.array([found.tobytes()], pa.binary()),
                    "reach": pa.array([reach.tobytes()], pa.binary()),
                    "cells": pa.array([left.tolist()], pa.list_(pa.int32()))})

    seeded = written(map_arrow(
        queries.withColumnRenamed("blob", "q").join(
            data.select(F.col("no").alias("home"), F.col("blob").alias("d")).hint("merge"), "home").select("no", "home", "q", "d"),
        seed, "no long, home long, blob binary, reach binary, cells array<int>"), "search_seeds")
    pairs = seeded.select("no", "home", "reach", F.explode("cells").alias("cell")).join(
        F.broadcast(known.select("cell", "base", "parts")), "cell").select(
        "no", "home", "reach", F.explode(F.expr("sequence(base, base + parts - 1)")).alias("other")).where(
        "other <> home")
    pairs = pairs.join(queries.select("no", F.col("blob").alias("q")).hint("merge"), "no").join(
        data.select(F.col("no").alias("other"), F.col("blob").alias("d")).hint("merge"), "other")

    def meet(batches):
        for batch in batches:
            for no, other, reach, q, d in zip(*[batch[c] for c in ("no", "other", "reach", "q", "d")]):
                found, _ = search(pickle.loads(q.as_buffer()), pickle.loads(d.as_buffer()), k,
                                  np.frombuffer(reach.as_buffer(), np.int64))
                if len(found):
                    yield pa.RecordBatch.from_pydict({
                        "no": pa.array([no.as_py()], pa.int64()),
                        "lane": pa.array([other.as_py() % LANES], pa.int32()),
                        "blob": pa.array([found.tobytes()], pa.binary())})

    finds = map_arrow(pairs.select("no", "other", "reach", "q", "d"), meet, "no long, lane int, blob binary")
    finds = finds.unionByName(seeded.select("no", F.lit(0).alias("lane"), "blob"))
    merged = _merge(_merge(finds, k, ["no", "lane"]), k, ["no"])

    def expand(batches):
        for batch in batches:
            for blob in batch["blob"]:
                found = np.frombuffer(blob.as_buffer(), FOUND)
                order, rank = ranked(found["q"], found)
                found = found[order]
                yield pa.RecordBatch.from_pydict({
                    "query_id": pa.array(found["query_id"]), "rank": pa.array(rank + 1, pa.int32()),
                    "id": pa.array(found["id"], mask=found["no_id"] > 0), "score": pa.array(found["score"])})

    return map_arrow(merged, expand, schema)
