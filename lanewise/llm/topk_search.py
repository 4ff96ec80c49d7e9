"""Exact top-k search by inner product with two cover trees walked together."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanewise.llm import _memory as M
from lanewise.llm._tables import cut

#: Candidates and queries in a block, on average; a task holds one block of each.
CANDIDATES, QUERIES = 16_384, 4_096
#: Rows, and bytes of them, that the centres of the tree's top level are chosen from; centres, and bytes of them, at most.
SAMPLE, SAMPLE_BYTES, CENTRES, CENTRE_BYTES = 20_000, 32 << 20, 2_048, 16 << 20
#: Points of a leaf, children of a node, and the factor by which the next level's radius is smaller.
LEAF, FANOUT, BASE = 128, 12, 1.6
#: Inner products below this are exact in doubles.
EXACT = float(1 << 53)


@dataclass
class Node:
    """Points [start, end) of a tree's order, all within ``radius`` of ``center``."""

    start: int
    end: int
    center: np.ndarray
    radius: float
    norm: float
    children: list[Node] = field(default_factory=list)


def cover_tree(points: np.ndarray) -> tuple[np.ndarray, Node]:
    """(order, root): points in the tree's order, and the tree over it.

    A node's children grow around points of its own: the farthest from its centre first, then each
    time the one farthest from those chosen, until what is left lies within the next level's radius
    or FANOUT is reached. So seeds lie at least as far apart as the points that are left lie from
    them; a point goes to its nearest seed. Where one child would keep most points, as outliers can
    bring about, the node is halved along the line between its first two seeds instead, so the
    depth stays logarithmic. A node's covering radius is measured from the mean of its points.
    Nodes of up to LEAF points, or of equal points, have no children.
    """
    order = np.arange(len(points))

    def node_of(start: int, end: int) -> Node:
        mine = points[order[start:end]]
        center = mine.mean(axis=0) if len(mine) else np.zeros(points.shape[1])
        far = np.sqrt(((mine - center) ** 2).sum(axis=1))
        return Node(start, end, center, float(far.max()) if len(far) else 0.0, float(np.sqrt((center**2).sum())))

    def split(node: Node) -> np.ndarray:
        """The child of each point of a node."""
        mine = points[order[node.start : node.end]]
        seeds = [mine[int(((mine - node.center) ** 2).sum(axis=1).argmax())]]
        nearest, owner = np.sqrt(((mine - seeds[0]) ** 2).sum(axis=1)), np.zeros(len(mine), np.int64)
        while len(seeds) < FANOUT and nearest.max() > node.radius / BASE:
            seeds.append(mine[int(nearest.argmax())])
            away = np.sqrt(((mine - seeds[-1]) ** 2).sum(axis=1))
            closer = away < nearest
            owner[closer], nearest = len(seeds) - 1, np.minimum(nearest, away)
        if len(seeds) < 2 or np.bincount(owner).max() > 0.8 * len(mine):
            line = (seeds[1] if len(seeds) > 1 else node.center) - seeds[0]
            owner = (np.argsort(np.argsort(mine @ line, kind="stable")) >= len(mine) // 2).astype(np.int64)
        return owner

    root = node_of(0, len(points))
    todo = [root]
    while todo:
        node = todo.pop()
        if node.end - node.start <= LEAF or node.radius == 0:
            continue
        owner = split(node)
        order[node.start : node.end] = order[node.start : node.end][np.argsort(owner, kind="stable")]
        at = node.start
        for n in np.bincount(owner).tolist():
            if n:
                node.children.append(node_of(at, at + n))
                at += n
        todo += node.children
    return order, root


class Search:
    """The k best candidates of each query; ties to smaller ids."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int, least: np.ndarray | None = None):
        """``least``: scores that each query has k candidates of elsewhere; lower ones are not wanted."""
        self.k = k
        q_order, self.q_root = cover_tree(queries)
        self.least = np.full(len(queries), -np.inf) if least is None else least[q_order]
        p_order, self.p_root = cover_tree(points)
        self.queries, self.query_ids = queries[q_order], query_ids[q_order]
        self.points, self.ids = points[p_order], ids[p_order]
        self.scores = np.full((len(queries), k), -np.inf)
        self.found = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.pairs = 0

    def bound(self, q: Node, p: Node) -> float:
        """No inner product of a point of q and one of p is larger."""
        upper = float(q.center @ p.center) + q.radius * p.norm + p.radius * q.norm + q.radius * p.radius
        return upper + 1e-9 * (q.norm + q.radius) * (p.norm + p.radius)

    def worst(self, q: Node) -> float:
        return float(np.maximum(self.scores[q.start : q.end, -1], self.least[q.start : q.end]).min())

    def run(self) -> None:
        if len(self.queries) and len(self.points):
            self.walk(self.q_root, self.p_root, self.bound(self.q_root, self.p_root))

    def walk(self, q: Node, p: Node, bound: float) -> None:
        if bound < self.worst(q):
            return
        if not q.children and not p.children:
            self.compare(q, p)
        elif q.children and (not p.children or q.end - q.start >= p.end - p.start):
            for child in q.children:
                self.walk(child, p, self.bound(child, p))
        else:
            for bound, i in sorted(((self.bound(q, c), i) for i, c in enumerate(p.children)), reverse=True):
                self.walk(q, p.children[i], bound)

    def compare(self, q: Node, p: Node) -> None:
        self.pairs += (q.end - q.start) * (p.end - p.start)
        for start in range(p.start, p.end, 4096):
            end = min(p.end, start + 4096)
            scores = self.queries[q.start : q.end] @ self.points[start:end].T
            ids = np.broadcast_to(self.ids[start:end], scores.shape)
            scores = np.where(ids == self.query_ids[q.start : q.end, None], -np.inf, scores)
            scores[scores < self.least[q.start : q.end, None]] = -np.inf
            alive = np.flatnonzero(((scores >= self.scores[q.start : q.end, -1:]) & (scores > -np.inf)).any(axis=1))
            if not len(alive):
                continue
            rows = q.start + alive
            s = np.concatenate([self.scores[rows], scores[alive]], axis=1)
            i = np.concatenate([self.found[rows], ids[alive]], axis=1)
            best = np.lexsort((i, -s), axis=1)[:, : self.k]
            self.scores[rows], self.found[rows] = np.take_along_axis(s, best, 1), np.take_along_axis(i, best, 1)


def _matrix(column: pa.ChunkedArray) -> list[list[int]]:
    return column.to_pylist()


def _exact(queries: list[list[int]], query_ids: np.ndarray, points: list[list[int]], ids: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """For components so large that doubles are not exact: whole numbers, one query at a time."""
    out = []
    for name, q in zip(query_ids.tolist(), queries):
        scored = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(q, p)))), i) for i, p in zip(ids.tolist(), points) if i != name)
        out += [(name, i, -s) for s, i in scored[:k]]
    return out


def _search(k: int):
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        names, ids = queries["vec_id"].to_numpy(), candidates["vec_id"].to_numpy()
        a, b = queries["v"].to_pylist(), candidates["v"].to_pylist()
        width = max([len(x) for x in (*a, *b)], default=0)
        largest = [max((abs(c) for x in rows for c in x), default=0) for rows in (a, b)]
        if largest[0] * largest[1] * max(width, 1) >= EXACT:
            found = _exact(a, names, b, ids, k)
        else:
            a, b = (np.array([x + [0] * (width - len(x)) for x in rows], float).reshape(len(rows), width) for rows in (a, b))
            least = queries["least"].to_numpy(zero_copy_only=False).astype(float)
            # a long beyond 2 ** 53 is rounded as a double; a little less is safe
            least = np.where(np.isnan(least), -np.inf, least - 1e-9 * np.abs(least) * (np.abs(least) >= EXACT))
            search = Search(a, names, b, ids, k, least)
            search.run()
            row, col = np.nonzero((search.scores > -np.inf) & (search.found < np.iinfo(np.int64).max))
            found = list(zip(search.query_ids[row].tolist(), search.found[row, col].tolist(), search.scores[row, col].astype(np.int64).tolist()))
        columns = list(zip(*found)) or [(), (), ()]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    return run


def whole_numbers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as long (at most what a long holds); null if a component is
    null or not finite."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    limit = float(1 << 62)
    return F.when(sound, F.transform(vector, lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(-limit)), F.lit(limit))).cast("long")))


def _padded(vectors: list[list[int]], width: int) -> np.ndarray:
    return np.array([v + [0] * (width - len(v)) for v in vectors], float).reshape(len(vectors), width)


def centres_of(points: np.ndarray, most: int) -> np.ndarray:
    """The top level of a cover tree: each centre the point farthest from those before, from the
    mean's nearest on; fewer than ``most`` if the points are not that many."""
    points = np.unique(points, axis=0)
    if not len(points):
        return points
    chosen = [int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())]
    away = ((points - points[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < most and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return points[chosen]


def _assigned(centres: np.ndarray):
    """The nearest centre of each vector, and how far it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norms = (centres**2).sum(axis=1)
        for batch in batches:
            x = _padded(batch.column("v").to_pylist(), centres.shape[1])
            nearest = (norms - 2 * (x @ centres.T)).argmin(axis=1) if len(x) else np.zeros(0, np.int64)
            away = np.sqrt(((x - centres[nearest]) ** 2).sum(axis=1))
            yield pa.record_batch([batch.column("vec_id"), batch.column("v"), pa.array(nearest, pa.int64()), pa.array(away)], names=["vec_id", "v", "centre", "away"])

    return run


def _reached(centres: np.ndarray, radius: np.ndarray, first: bool):
    """Of each query the centre of largest inner product (first); or all around which some candidate
    may score ``least``: by the centre's score, the radius and the query's norm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norms = np.sqrt((centres**2).sum(axis=1))
        for batch in batches:
            x = _padded(batch.column("v").to_pylist(), centres.shape[1])
            scores, size = x @ centres.T, np.sqrt((x**2).sum(axis=1))[:, None]
            if first:
                some = np.zeros(scores.shape, bool)
                some[np.arange(len(x)), np.where(radius >= 0, scores, -np.inf).argmax(axis=1)] = True
            else:
                least = batch.column("least").to_numpy(zero_copy_only=False).astype(float)[:, None]
                bound = scores + size * radius + 1e-9 * size * (norms + np.abs(radius)) + 1e-9 * np.abs(least)
                some = (np.isnan(least) | (bound >= least)) & (radius >= 0)
            row, centre = np.nonzero(some)
            yield pa.record_batch([*(batch.column(c).take(pa.array(row)) for c in ("vec_id", "v", "least")), pa.array(centre, pa.int64())], names=["vec_id", "v", "least", "centre"])

    return run


def _meet(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """Searches of queries (vec_id, v, least, centre, salt) in the candidates of that centre and salt,
    the queries of a block in chunks."""
    chunks = queries.groupBy("centre", "salt").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("chunks"))
    asked = queries.join(chunks, ["centre", "salt"]).withColumn("chunk", F.pmod(F.xxhash64("vec_id", F.lit("chunk")), F.col("chunks")).cast("int"))
    offered = candidates.join(chunks, ["centre", "salt"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    key = ["centre", "salt", "chunk"]
    return asked.groupBy(*key).cogroup(offered.select("vec_id", "v", *key).groupBy(*key)).applyInArrow(M.cogroup(_search(k)), "query_id bigint, vec_id bigint, score bigint")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, columns: tuple[str, str] = ("vec_id", "embedding")) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): for each row that is_query the k other rows of largest
    inner product of whole-numbered vectors, ties to smaller ids; all of them if there are fewer.

    Equal vectors stand for one another: of each vector only the k + 1 smallest ids can be among
    anyone's best. Centres chosen from a bounded sample (SAMPLE rows of smallest hash) are the top
    level of a cover tree; every candidate goes to its nearest centre, whose covering radius is
    measured over all of them, and a centre's candidates are dealt to blocks of bounded size. A query
    is first searched in one block of its best centre. Its kth score there is a bound that most
    centres cannot reach: by their own score, radius and the query's norm. Only to the blocks of
    the others is the query sent, so candidates never meet all queries unless no bound tells them
    apart. In a pair of blocks, cover trees over both are walked together, and a pair of nodes is
    passed over if its centres, radii and norms bound every inner product below the worst kth score
    of the node's queries. Scores are exact: whole numbers in doubles below 2 ** 53, Python's
    integers beyond; a score that no long holds is the nearest that one does.

    Vectors that are null, or hold null, NaN or infinite components, take no part; nor do rows
    without id. Missing components count as 0. Rows that share an id are separate candidates, but
    never candidates of a query of that id, and their queries are one if their vectors are equal.
    An empty table gives an empty result. Other columns are ignored.
    """
    vec_id, vector = columns
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), whole_numbers(F.col(vector)).alias("v"), is_query.alias("asks")).filter("vec_id is not null and v is not null")
    rows = cut(rows)
    total, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    copies = Window.partitionBy("v").orderBy("vec_id")
    kept = rows.select("vec_id", "v").withColumn("place", F.row_number().over(copies)).filter(F.col("place") <= k + 1).select("vec_id", "v")
    bytes_each = 8 * max(1, width)
    sample = rows.select("v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, min(SAMPLE, SAMPLE_BYTES // bytes_each)))
    most = max(1, min(CENTRES, CENTRE_BYTES // bytes_each, math.ceil(total / CANDIDATES)))
    centres = centres_of(_padded([r.v for r in sample.collect()], width), most) if total else np.zeros((0, width))
    if not len(centres):
        centres = np.zeros((1, width))
    assigned = cut(kept.mapInArrow(M.batches(_assigned(centres)), "vec_id bigint, v array<bigint>, centre bigint, away double"))
    radius, salts = np.full(len(centres), -1.0), np.ones(len(centres), np.int64)
    for r in assigned.groupBy("centre").agg(F.max("away").alias("radius"), F.count("*").alias("n")).collect():
        radius[r.centre], salts[r.centre] = r.radius * (1 + 1e-9), math.ceil(r.n / CANDIDATES)
    salts_of = F.element_at(F.array(*[F.lit(int(n)) for n in salts]), (F.col("centre") + 1).cast("int"))
    salt = F.pmod(F.xxhash64("vec_id"), salts_of)
    candidates = assigned.select("vec_id", "v", "centre", salt.alias("salt"))
    queries = rows.filter("asks").select("vec_id", "v").distinct().withColumn("least", F.lit(None).cast("long"))
    schema = "vec_id bigint, v array<bigint>, least bigint, centre bigint"
    first = cut(queries.mapInArrow(M.batches(_reached(centres, radius, True)), schema).withColumn("salt", salt))
    found = cut(_meet(first, candidates, k))
    if len(centres) > 1 or salts.max() > 1:
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        least = found.withColumn("place", place).filter(F.col("place") == k).select("query_id", F.col("score").alias("least"))
        bounded = first.select("vec_id", "v", F.col("centre").alias("c"), F.col("salt").alias("s")).join(least, F.col("vec_id") == F.col("query_id"), "left")
        again = bounded.select("vec_id", "v", "least").mapInArrow(M.batches(_reached(centres, radius, False)), schema)
        again = again.withColumn("salt", F.explode(F.sequence(F.lit(0), salts_of - 1))).withColumn("salt", F.col("salt").cast("long"))
        again = again.join(first.select("vec_id", "v", "centre", "salt"), ["vec_id", "v", "centre", "salt"], "left_anti")
        found = found.union(_meet(cut(again), candidates, k))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
