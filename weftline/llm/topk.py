"""Exact top-k search by inner product with a dual tree of covers.

1. Vectors become integers; those that are null or hold a null or non-finite
   component take no part.
2. The top of the tree is a net of NODES centres, from a bounded sample of
   SAMPLE rows taken by a hash of the id. Queries and data are filed together under
   their nearest centre; a node's covering radius is the largest distance to it
   of any of its rows. The sample also gives each query a first lower bound of its
   kth score. (Both only steer the search: every row is searched.)
3. Data of a node go in blocks of BLOCK rows. In the first round a query meets the
   blocks of its own node, which raises its kth score; in the second those of all
   other nodes that can still hold a score of it.
4. A task builds a cover tree over one block, and one over each batch of queries,
   and descends both level by level: a pair of nodes is cut if no inner product
   between them can reach the worst kth score of the queries in it. Pairs of leaves
   are met best bound first, so that later ones are cut by the scores of earlier
   ones; what is left is multiplied out.
5. Each block returns k rows a query at most, and the k best over all blocks stay.

The bound of two nodes is the least of three, from covering radii, from norms and
distances (an inner product is half of what the squared norms have more than the
squared distance), and from angles. On vectors without structure in many
dimensions none of them cuts anything, and every query meets every row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, width, written

NODES, SAMPLE, BLOCK, LEAF, FAN = 64, 4096, 4096, 64, 16
#: Points of a leaf of queries: the worst kth score of a smaller set cuts more.
QUERY_LEAF = 32
#: Leaves that a leaf of queries meets at first; then twice as many each time, with the scores found so far.
FIRST_LEAVES = 8
NEVER = -np.inf


class Cover:
    """What is known of the points of a node: centre, covering radius, least and
    greatest norm, greatest angle to the centre. Arrays, one entry a node."""

    def __init__(self, center, radius, low, high, angle):
        self.center, self.radius, self.low, self.high, self.angle = (np.asarray(x, float) for x in (center, radius, low, high, angle))
        self.norm = np.sqrt((self.center ** 2).sum(axis=1))

    @staticmethod
    def of_points(x: np.ndarray) -> Cover:
        norm = np.sqrt((x ** 2).sum(axis=1))
        zero = np.zeros(len(x))
        return Cover(x, zero, norm, norm, zero)


def angles(inner, a, b):
    """Angles of vectors by inner product and norms; half a turn where a norm is zero, for then nothing is known."""
    both = a * b
    cos = np.divide(inner, both, out=np.full(np.shape(both), -1.0), where=both > 0)
    return np.arccos(np.clip(cos, -1.0, 1.0))


def bounds(q: Cover, a: np.ndarray, d: Cover, b: np.ndarray) -> np.ndarray:
    """No inner product of a point of node a[i] of q and one of node b[i] of d exceeds this."""
    inner = (q.center[a] * d.center[b]).sum(axis=1)
    r, s, m, n = q.radius[a], d.radius[b], q.norm[a], d.norm[b]
    ball = inner + r * n + s * m + r * s
    apart = np.maximum(0.0, np.sqrt(np.maximum(0.0, m * m + n * n - 2 * inner)) - r - s)
    top = q.high[a] * d.high[b]
    lifted = (q.high[a] ** 2 + d.high[b] ** 2 - apart ** 2) / 2
    known = (m > 0) & (n > 0)
    left = np.where(known, np.maximum(0.0, angles(inner, m, n) - q.angle[a] - d.angle[b]), 0.0)
    turn = np.cos(left)
    turned = np.where(turn >= 0, top * turn, q.low[a] * d.low[b] * turn)
    u = np.minimum(np.minimum(ball, lifted), turned)
    return u + 1e-7 * (top + np.abs(u)) + 1e-6  # more than rounding can take away


class Tree:
    """A cover tree, flattened. A node's children are filed under a net of its
    points: the first is the node's own centre, each next one the point farthest
    from those before, until half the covering radius or FAN of them is reached. A
    child's points are nearer to its centre than to the other centres, and centres
    are at least as far from one another as the children's covering radii. Nodes of
    ``leaf`` points or fewer, or of equal points, have no children. order lists the
    points so that each node has those from begin to end."""

    def __init__(self, x: np.ndarray, leaf: int | None = None):
        leaf = LEAF if leaf is None else leaf
        self.x, self.order = x, np.arange(len(x))
        norms = np.sqrt((x ** 2).sum(axis=1))
        rows, todo = [], [(0, len(x), 0)]
        self.first, self.kids = [], []
        while len(rows) < len(todo):
            begin, end, c = todo[len(rows)]  # c: the centre's place in order
            at = self.order[begin:end]
            center = x[self.order[c]] if len(x) else np.zeros(x.shape[1])
            gap = np.sqrt(((x[at] - center) ** 2).sum(axis=1))
            norm = norms[at]
            angle = angles(x[at] @ center, norm, np.full(len(at), np.sqrt((center ** 2).sum())))
            reach = float(gap.max()) if len(at) else 0.0
            rows.append((begin, end, center, reach, norm.min() if len(at) else 0.0, norm.max() if len(at) else 0.0, angle.max() + 1e-7 if len(at) else 0.0))
            self.first.append(len(todo))
            if len(at) <= leaf or reach == 0:
                self.kids.append(0)
                continue
            net, near, of = [c - begin], gap.copy(), np.zeros(len(at), np.int64)
            while len(net) < FAN and near.max() > reach / 2:
                net.append(int(near.argmax()))
                far = np.sqrt(((x[at] - x[at[net[-1]]]) ** 2).sum(axis=1))
                of[far < near] = len(net) - 1
                near = np.minimum(near, far)
            moved = np.argsort(of, kind="stable")
            self.order[begin:end] = at[moved]
            place, start = np.argsort(moved), begin
            for k, n in enumerate(np.bincount(of, minlength=len(net)).tolist()):
                todo.append((start, start + n, begin + int(place[net[k]])))
                start += n
            self.kids.append(len(net))
        begin, end, center, reach, low, high, angle = zip(*rows)
        self.begin, self.end = np.array(begin), np.array(end)
        self.first, self.kids = np.array(self.first), np.array(self.kids)
        self.cover = Cover(np.array(center), reach, low, high, angle)

    def points(self, node: int) -> np.ndarray:
        return self.order[self.begin[node]:self.end[node]]


class Best:
    """The k best (score, id) of each query so far; ties to the smaller id."""

    def __init__(self, kth: np.ndarray, k: int):
        self.kth, self.k = kth.copy(), k
        self.q, self.s, self.i = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)

    def add(self, q, s, i):
        q, s, i = np.concatenate([self.q, q]), np.concatenate([self.s, s]), np.concatenate([self.i, i])
        o = np.lexsort((i, -s, q))
        q, s, i = q[o], s[o], i[o]
        begin = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.empty(0, np.int64)
        rank = np.arange(len(q)) - np.repeat(begin, np.diff(np.append(begin, len(q))))
        keep = rank < self.k
        self.q, self.s, self.i = q[keep], s[keep], i[keep]
        last = rank == self.k - 1
        self.kth[q[last]] = np.maximum(self.kth[q[last]], s[last])


def search(queries: Tree, q_ids: np.ndarray, data: Tree, ids: np.ndarray, kth: np.ndarray, k: int) -> tuple[list, np.ndarray]:
    """([(query number, score, id) arrays]: the k best of each query that reach
    kth; [pairs of nodes looked at, pairs cut, products made])."""
    count = np.zeros(3, np.int64)
    if not len(queries.x) or not len(data.x):
        return [], count
    a, b, leaves = np.zeros(1, np.int64), np.zeros(1, np.int64), []
    while len(a):
        u = bounds(queries.cover, a, data.cover, b)
        nodes, of = np.unique(a, return_inverse=True)
        keep = u >= np.array([kth[queries.points(n)].min() for n in nodes.tolist()])[of]
        count += len(a), (~keep).sum(), 0
        a, b, u = a[keep], b[keep], u[keep]
        end = (queries.kids[a] == 0) & (data.kids[b] == 0)
        leaves.append((a[end], b[end], u[end]))
        a, b = a[~end], b[~end]
        down = (data.kids[b] > 0) & ((queries.kids[a] == 0) | (data.cover.radius[b] >= queries.cover.radius[a]))  # which tree is opened
        n = np.where(down, data.kids[b], queries.kids[a])
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        opened = np.repeat(np.where(down, data.first[b], queries.first[a]), n) + step
        a, b, down = np.repeat(a, n), np.repeat(b, n), np.repeat(down, n)
        a, b = np.where(down, a, opened), np.where(down, opened, b)
    a, b, u = (np.concatenate(c) for c in zip(*leaves))
    out = []
    for node in np.unique(a).tolist():
        own = a == node
        q_at, order = queries.points(node), np.argsort(-u[own])
        todo, bound = b[own][order], u[own][order]
        best, x, i, size = Best(kth[q_at], k), queries.x[q_at], 0, FIRST_LEAVES
        while i < len(todo):
            go = int(np.searchsorted(-bound[i:i + size], -best.kth.min(), "right"))
            if go:
                d_at = np.concatenate([data.points(n) for n in todo[i:i + go].tolist()])
                s = x @ data.x[d_at].T
                count[2] += s.size
                s[q_ids[q_at][:, None] == ids[d_at][None, :]] = NEVER
                r, c = np.nonzero((s >= best.kth[:, None]) & (s > NEVER))
                if len(r):
                    best.add(r, s[r, c], ids[d_at[c]])
            if go < min(size, len(todo) - i):  # what follows has no better bound
                count[1] += len(todo) - i - go
                break
            i, size = i + go, size * 2
        out.append((q_at[best.q], best.s, best.i))
    return out, count


def packed(x: np.ndarray) -> list[bytes]:
    """Rows of whole numbers: 16 bits each where they fit, else as doubles."""
    small = (np.abs(x) < 1 << 15).all(axis=1) if x.shape[1] else np.zeros(len(x), bool)
    out, short = [r.tobytes() for r in x], x.astype("<i2", copy=True) if small.all() else None
    for i in np.flatnonzero(small).tolist():
        out[i] = (short[i] if short is not None else x[i].astype("<i2")).tobytes()
    return out


def matrix(rows: list[bytes], dim: int) -> np.ndarray:
    if rows and all(len(r) == 2 * dim for r in rows):
        return np.frombuffer(b"".join(rows), "<i2").reshape(len(rows), dim).astype(float)
    out = np.empty((len(rows), dim))
    for i, r in enumerate(rows):
        out[i] = np.frombuffer(r, "<i2" if len(r) == 2 * dim else "<f8")
    return out


def integers(vectors: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """(id, dim, v): floor(scale * x) of each component, packed; only whole, finite
    vectors."""
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("x"))

    def run(batches):
        for b in batches:
            ids, dims, out = [], [], []
            for i, x in zip(b.column(0).to_pylist(), b.column(1)):
                v = x.values
                if v.null_count:
                    continue
                v = v.to_numpy(zero_copy_only=False)
                if np.isfinite(v).all():
                    ids.append(i), dims.append(len(v)), out.append(packed(np.floor(v * scale)[None])[0])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], ["id", "dim", "v"])

    return rows.mapInArrow(run, "id long, dim int, v binary")


def net(x: np.ndarray, n: int) -> np.ndarray:
    """Row numbers of a net: each next centre is the row farthest from those before."""
    at, gap = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(at) < min(n, len(x)) and gap.max() > 0:
        at.append(int(gap.argmax()))
        gap = np.minimum(gap, ((x - x[at[-1]]) ** 2).sum(axis=1))
    return np.array(at)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vec_col: str = "embedding", meter: dict | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``is_query`` (over id_col)
    holds, the k rows with the highest integer inner product, ties to the smaller
    id, without the query's own id. Fewer than k others: all of them.

    Null vectors, vectors that hold a null or a value that is not finite, and rows
    without an id take no part. Vectors meet only vectors of the same length. Of
    rows that repeat an id each is a candidate for other ids, none for its own;
    as queries they count once, by the row that sorts first. An empty table gives
    an empty table. Other columns are not read. Scores must stay below 2**53 in
    absolute value.

    meter: a dictionary that gets accumulators by name, filled as the result is
    computed: ``nodes`` and ``nodes_cut`` of the top of the tree and ``pairs`` and
    ``pairs_cut`` below it count pairs of nodes looked at and cut, ``products`` the
    scores computed.
    """
    spark = vectors.sparkSession
    prepare(spark)
    asks = F.coalesce(is_query, F.lit(False))
    tagged = vectors.select(F.col(id_col), F.col(vec_col))
    all_rows = written(integers(tagged, id_col, vec_col, scale), "vectors")
    names = ("nodes", "nodes_cut", "pairs", "pairs_cut", "products")
    counted = {n: spark.sparkContext.accumulator(0) for n in names}
    if meter is not None:
        meter.update(counted)
    out = None
    for r in all_rows.select("dim").distinct().orderBy("dim").collect():  # one dimension, as a rule
        part = one_dim(all_rows.where(F.col("dim") == r["dim"]), r["dim"], asks, k, id_col, counted)
        out = part if out is None else out.unionAll(part)
    return out if out is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def one_dim(rows: DataFrame, dim: int, asks: Column, k: int, id_col: str, meter: dict) -> DataFrame:
    spark = rows.sparkSession
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    s_ids, s_x = np.array([r["id"] for r in sample]), matrix([r["v"] for r in sample], dim)
    centers = s_x[net(s_x, NODES)]
    held = spark.sparkContext.broadcast((s_ids, s_x, centers))

    def file(batches):
        s_ids, s_x, centers = held.value
        size = np.sqrt((centers ** 2).sum(axis=1))
        for b in batches:
            if not b.num_rows:
                continue
            x, ids = matrix(b.column(1).to_pylist(), dim), b.column(0).to_numpy()
            square = (x ** 2).sum(axis=1)
            gap = np.maximum(0.0, square[:, None] + size ** 2 - 2 * (x @ centers.T))
            node = gap.argmin(axis=1)
            norm = np.sqrt(square)
            gap = ((x - centers[node]) ** 2).sum(axis=1)
            angle = angles((x * centers[node]).sum(axis=1), norm, size[node]) + 1e-7
            kth, order = np.full(len(x), NEVER), [None] * len(x)
            at = np.flatnonzero(b.column(2).to_numpy(zero_copy_only=False))
            for i in at.tolist():
                order[i] = x[i].tobytes()
            if len(at) and len(s_x) > k:
                s = x[at] @ s_x.T
                s[ids[at][:, None] == s_ids[None, :]] = NEVER
                kth[at] = np.partition(s, len(s_x) - k, axis=1)[:, len(s_x) - k]
            made = (b.column(0), b.column(1), b.column(2), pa.array(node.astype(np.int32)), pa.array(np.sqrt(gap)), pa.array(norm), pa.array(angle), pa.array(kth), pa.array(order, pa.binary()))
            yield pa.RecordBatch.from_arrays(list(made), ["id", "v", "asks", "node", "gap", "norm", "angle", "kth", "by"])

    filed = rows.withColumnRenamed("id", id_col).select(F.col(id_col).alias("id"), "v", asks.alias("asks"))
    filed = written(filed.mapInArrow(file, "id long, v binary, asks boolean, node int, gap double, norm double, angle double, kth double, by binary"), "filed")
    stats = filed.groupBy("node").agg(F.count("*").alias("n"), F.max("gap").alias("gap"), F.min("norm").alias("low"), F.max("norm").alias("high"), F.max("angle").alias("angle"))
    nodes = {r["node"]: r for r in stats.collect()}
    live = np.array(sorted(nodes))
    parts = np.array([-(-nodes[n]["n"] // BLOCK) for n in live])
    first = np.cumsum(parts) - parts
    tops = Cover(centers[live], *[[nodes[n][c] for n in live] for c in ("gap", "low", "high", "angle")])

    def literal(values: np.ndarray) -> Column:
        by_node = dict(zip(live.tolist(), values.tolist()))
        return F.array(*[F.lit(by_node.get(n, 1)) for n in range(len(centers))])[F.col("node")]

    spread = F.pmod(F.xxhash64(F.lit("block"), "id"), literal(parts)).cast("int")
    none = F.lit(None).cast("binary")
    data = filed.select((literal(first) + spread).cast("int").alias("block"), F.lit(0).alias("kind"), "id", "v", none.alias("ids"), none.alias("kth"))
    own = Window.partitionBy("id").orderBy("by")
    asked = written(filed.where("asks").withColumn("no", F.row_number().over(own)).where("no = 1").select("id", "v", "node", "gap", "kth"), "asked")
    shape = "block int, kind int, id long, v binary, ids binary, kth binary"

    def sender(home: bool):
        """Sends queries to the blocks of their own nodes, or to those of all others that can hold a score they need."""

        def send(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                ids, x, kth = b.column("id").to_numpy(), matrix(b.column("v").to_pylist(), dim), b.column("kth").to_numpy()
                at_home = b.column("node").to_numpy()[:, None] == live[None, :]
                if home:
                    go = at_home
                else:
                    each = Cover.of_points(x)
                    q, n = (c.ravel() for c in np.indices(at_home.shape))
                    go = ~at_home & (bounds(each, q, tops, n).reshape(at_home.shape) >= kth[:, None])
                    meter["nodes"].add(int((~at_home).sum())), meter["nodes_cut"].add(int((~at_home & ~go).sum()))
                for n in np.flatnonzero(go.any(axis=0)).tolist():
                    own = np.flatnonzero(go[:, n])
                    blob = [x[own].tobytes(), ids[own].tobytes(), kth[own].tobytes()]
                    to = np.arange(first[n], first[n] + parts[n])
                    for i in range(0, len(to), 64):
                        m = len(to[i:i + 64])
                        yield pa.RecordBatch.from_arrays([pa.array(to[i:i + m].astype(np.int32)), pa.array([1] * m, pa.int32()), pa.nulls(m, pa.int64()), *[pa.array([c] * m, pa.binary()) for c in blob]], ["block", "kind", "id", "v", "ids", "kth"])

        return send

    def answer(batches):
        block, ids, vs, tree = None, [], [], None
        for b in batches:
            found = []
            for blk, kind, i, v, q_ids, kth in zip(*(c.to_pylist() for c in b.columns)):
                if blk != block:
                    block, ids, vs, tree = blk, [], [], None
                if kind == 0:
                    ids.append(i), vs.append(v)
                    continue
                if tree is None:
                    tree, all_ids, vs = Tree(matrix(vs, dim)), np.array(ids), []
                q = np.frombuffer(q_ids, np.int64)
                got, count = search(Tree(np.frombuffer(v, np.float64).reshape(len(q), dim), QUERY_LEAF), q, tree, all_ids, np.frombuffer(kth, np.float64), k)
                found += [(q[at], i, s.astype(np.int64)) for at, s, i in got if len(at)]
                for name, n in zip(("pairs", "pairs_cut", "products"), count.tolist()):
                    meter[name].add(n)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["query_id", "vec_id", "score"])

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    tasks = int(max(1, min(parts.sum(), 16 * width(spark))))

    def met(queries: DataFrame, home: bool) -> DataFrame:
        """The k best of the blocks that queries are sent to."""
        near = queries.select("id", "v", "node", "gap", "kth").repartitionByRange(width(spark), "node", "gap", "id").sortWithinPartitions("node", "gap")
        dealt = data.unionAll(near.mapInArrow(sender(home), shape)).repartition(tasks, "block").sortWithinPartitions("block", "kind")
        return dealt.mapInArrow(answer, "query_id long, vec_id long, score long")

    def ranked(pairs: DataFrame) -> DataFrame:
        return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    one = written(ranked(met(asked, True)), "home")
    raised = one.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("now"))
    asked = asked.join(raised, "id", "left").withColumn("kth", F.greatest("kth", F.coalesce("now", "kth")))
    return ranked(one.drop("rank").unionAll(met(asked, False))).select("query_id", "rank", "vec_id", "score")
