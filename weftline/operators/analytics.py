"""Graph metrics over nodes (node_id, ...) and edges (src, dst, ...). Edges with an
end that is no node are left out first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .iterate import by_number, components, dropped, kept, numbered
from .resolve import LITERALS, among

__all__ = ["closed", "components", "closeness", "closeness_estimated", "colouring", "communities", "degree", "density", "isolates", "metrics", "pagerank", "label_propagation", "label_propagation_in_turn", "top_degree", "totals", "visible_subgraph"]


def closed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges both of whose ends are nodes."""
    ids = nodes.select("node_id").distinct()
    return edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, degree): ends of edges at a node; a loop counts twice, parallel edges each."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("degree"))
    return nodes.select("node_id").distinct().join(ends, "node_id", "left").select("node_id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def isolates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node_id"))
    return nodes.join(ends, "node_id", "left_anti")


def top_degree(nodes: DataFrame, edges: DataFrame, k: int = 3) -> DataFrame:
    return degree(nodes, edges).orderBy(F.desc("degree"), "node_id").limit(k)


def totals(nodes: DataFrame, edges: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """One row: nodes, edges and documents counted."""
    n, e = nodes.agg(F.count("*").alias("nodes")), edges.agg(F.count("*").alias("edges"))
    d = documents.agg(F.count("*").alias("documents")) if documents is not None else n.select(F.lit(0).cast("long").alias("documents"))
    return n.join(e, F.lit(True)).join(d, F.lit(True))  # one row each


def density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density e / n(n-1) and average degree 2e / n, not rounded; 0 for too few nodes."""
    n, e = F.col("nodes").cast("double"), F.col("edges").cast("double")
    return totals(nodes, edges).select(
        "nodes", "edges",
        F.when(n > 1, F.try_divide(e, n * (n - 1))).otherwise(0.0).alias("density"),
        F.when(n > 0, F.try_divide(2 * e, n)).otherwise(0.0).alias("average_degree"))


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, max_iterations: int = 50, eps: float = 1e-6) -> DataFrame:
    """(node_id, pagerank): parallel edges count each, what sinks hold goes evenly to
    all; ends when the ranks move by less than ``eps`` in sum. A round is one job:
    what sinks hold and how far ranks moved are measured as its table is written."""
    names = numbered(nodes)
    n = names.count()
    if not n:
        return names.select("node_id", F.lit(0.0).alias("pagerank"))
    inside, ids = kept(by_number(names, edges), "inside"), names.select(F.col("code").alias("node_id"))
    out = inside.groupBy("src").agg(F.count("*").alias("out"))
    links = kept(inside.groupBy("src", "dst").agg(F.count("*").alias("times")).join(out, "src").select("src", "dst", (F.col("times") / F.col("out")).alias("share")), "links")
    sunk = F.sum(F.when(F.col("sink"), F.col("pagerank")).otherwise(0.0))
    first = ids.join(out.withColumnRenamed("src", "node_id"), "node_id", "left").select("node_id", F.col("out").isNull().alias("sink"), F.lit(1.0 / n).alias("pagerank"))
    rank = kept(first, "rank", sunk=sunk)
    for _ in range(max_iterations):
        base = (1 - damping) / n + damping * rank.seen["sunk"] / n
        got = links.join(rank.select(F.col("node_id").alias("src"), "pagerank"), "src").groupBy("dst").agg(F.sum(F.col("share") * F.col("pagerank")).alias("got"))
        new = rank.join(got.withColumnRenamed("dst", "node_id"), "node_id", "left").select(
            "node_id", "sink", F.col("pagerank").alias("old"), (F.lit(base) + damping * F.coalesce("got", F.lit(0.0))).alias("pagerank"))
        new = kept(new, "rank", sunk=sunk, moved=F.sum(F.abs(F.col("pagerank") - F.col("old"))))
        dropped(rank)
        rank = new
        if rank.seen["moved"] < eps:
            break
    dropped(links, inside)
    return rank.join(names.select(F.col("code").alias("node_id"), F.col("node_id").alias("name")), "node_id").select(F.col("name").alias("node_id"), "pagerank")


def distances(nodes: DataFrame, edges: DataFrame, sources: DataFrame | None = None, depth: int | None = None) -> DataFrame:
    """(source, node_id, distance) for all nodes that ``sources`` (node_id; all nodes
    if none are given) reach over undirected edges in ``depth`` steps or fewer; the
    source itself at 0. All-pairs work: give sources on large graphs. Each step
    writes only what it meets first; whatever is next to the last step's nodes and
    met before was met in that step or the one before it."""
    both = closed(nodes, edges).select("src", "dst").where("src <> dst")
    pairs = kept(both.unionAll(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "pairs")
    start = (sources if sources is not None else nodes).select("node_id").distinct()
    found = [kept(start.select(F.col("node_id").alias("source"), "node_id", F.lit(0).alias("distance")), "front")]
    while depth is None or len(found) <= depth:
        met = found[-1].join(pairs, F.col("node_id") == F.col("src")).select("source", F.col("dst").alias("node_id")).distinct()
        for before in found[-2:]:
            met = met.join(before.select("source", "node_id"), ["source", "node_id"], "left_anti")
        front = kept(met.withColumn("distance", F.lit(len(found))), "front", n=F.count(F.lit(1)))
        if not front.seen["n"]:
            break
        found.append(front)
    dropped(pairs)
    out = found[0]
    for front in found[1:]:
        out = out.unionByName(front)
    return out


def closeness(nodes: DataFrame, edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(node_id, closeness): nodes reached over the sum of the distances to them, on
    undirected edges; 0 if none is reached."""
    d = distances(nodes, edges, sources).groupBy("source").agg(F.count_if(F.col("distance") > 0).alias("n"), F.sum("distance").alias("s"))
    return d.select(F.col("source").alias("node_id"), F.coalesce(F.try_divide(F.col("n").cast("double"), F.col("s").cast("double")), F.lit(0.0)).alias("closeness"))


def label_propagation(nodes: DataFrame, edges: DataFrame, max_iterations: int = 20) -> DataFrame:
    """(node_id, community): all nodes take at once the label most frequent among
    their neighbours (parallel edges count each) and their own, the smallest of
    equals, so the result does not depend on an order. Labels are node ids."""
    inside = closed(nodes, edges).where("src <> dst")
    pairs = kept(inside.select("src", "dst").unionAll(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).groupBy("src", "dst").agg(F.count("*").alias("w")), "pairs")
    label = kept(nodes.select("node_id", F.col("node_id").alias("community")).distinct(), "label")
    for _ in range(max_iterations):
        votes = pairs.join(label.select(F.col("node_id").alias("dst"), "community"), "dst").select(F.col("src").alias("node_id"), "community", "w")
        votes = votes.unionByName(label.select("node_id", "community", F.lit(1).cast("long").alias("w"))).groupBy("node_id", "community").agg(F.sum("w").alias("w"))
        best = votes.groupBy("node_id").agg(F.min_by("community", F.struct(-F.col("w"), "community")).alias("next"))
        new = label.join(best, "node_id").select("node_id", F.col("next").alias("community"), (F.col("next") != F.col("community")).alias("moved"))
        new = kept(new, "label", moved=F.count_if("moved"))
        dropped(label)
        label = new
        if not label.seen["moved"]:
            break
    dropped(pairs)
    return label.select("node_id", "community")


def colouring(nodes: DataFrame, edges: DataFrame, max_rounds: int = 500) -> DataFrame:
    """(node_id, colour from 0): neighbours differ. A round gives all nodes that come
    before their neighbours without a colour, by a hash of their ids, the least colour
    that no neighbour has (Jones and Plassmann); that takes few rounds, with any order
    of the rows. A node's neighbours meet as their set of colours, never as rows."""
    names = numbered(nodes, F.md5(F.col("node_id").cast("string").cast("binary")), "node_id")
    inside = by_number(names, edges).where("src <> dst")
    pairs = kept(inside.unionAll(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "pairs")
    order = F.col("node_id")  # the number is the place in the order of hashes
    state = kept(names.select(F.col("code").alias("node_id"), F.lit(None).cast("int").alias("colour")), "colour")
    for _ in range(max_rounds):
        to = state.select(F.col("node_id").alias("dst"), F.col("colour").alias("c"), F.when(F.col("colour").isNull(), order).alias("waits"))
        met = pairs.join(state.where("colour is null").select(F.col("node_id").alias("src")), "src", "left_semi").join(to, "dst").groupBy("src").agg(F.max("waits").alias("first"), F.collect_set("c").alias("used"))
        used = F.coalesce("used", F.array().cast("array<int>"))
        least = F.array_min(F.array_except(F.sequence(F.lit(0), F.size(used)), used))
        now = F.when(F.col("first").isNull() | (order > F.col("first")), least)
        new = kept(state.join(met.withColumnRenamed("src", "node_id"), "node_id", "left").select("node_id", F.coalesce("colour", now).alias("colour")), "colour", open=F.count_if(F.col("colour").isNull()))
        dropped(state)
        state = new
        if not state.seen["open"]:
            dropped(pairs)
            return state.join(names.select(F.col("code").alias("node_id"), F.col("node_id").alias("name")), "node_id").select(F.col("name").alias("node_id"), "colour")
    raise RuntimeError("colouring did not settle")


def label_propagation_in_turn(nodes: DataFrame, edges: DataFrame, max_iterations: int = 20) -> DataFrame:
    """(node_id, community): a node takes the label most frequent among its
    neighbours (parallel edges count each, a loop twice), the smallest of equals; a
    node without neighbours keeps its own. Nodes of one colour move at once and
    colours in turn, so each sees the newest labels about it as if nodes moved one by
    one, and no two neighbours swap labels for ever."""
    names = numbered(nodes)
    named = colouring(nodes, edges).withColumnRenamed("node_id", "name")
    shade = kept(named.join(names, F.col("name").eqNullSafe(F.col("node_id"))).select(F.col("code").alias("node_id"), "colour"), "shade")
    colours = sorted(r[0] for r in shade.select("colour").distinct().collect())  # fewer than a node's most neighbours, and two
    inside = by_number(names, edges)
    both = inside.unionAll(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).groupBy("src", "dst").agg(F.count("*").alias("w"))
    pairs = kept(both.join(shade.withColumnRenamed("node_id", "src"), "src"), "pairs")
    label = kept(shade.select("node_id", F.col("node_id").alias("community")), "label")
    for _ in range(max_iterations):
        moved = 0
        for colour in colours:
            votes = pairs.where(F.col("colour") == colour).join(label.withColumnRenamed("node_id", "dst"), "dst").groupBy("src", "community").agg(F.sum("w").alias("w"))
            best = votes.groupBy("src").agg(F.min_by("community", F.struct(-F.col("w"), "community")).alias("next"))
            new = label.join(best.withColumnRenamed("src", "node_id"), "node_id", "left").select("node_id", F.coalesce("next", "community").alias("community"), F.coalesce(F.col("next") != F.col("community"), F.lit(False)).alias("moved"))
            new = kept(new, "label", moved=F.count_if("moved"))
            moved += new.seen["moved"]
            dropped(label)
            label = new
        if not moved:
            break
    dropped(pairs)
    to = names.select(F.col("code").alias("community"), F.col("node_id").alias("name"))
    own = label.select("node_id", "community").join(names.select(F.col("code").alias("node_id"), F.col("node_id").alias("own")), "node_id")
    return own.join(to, "community").select(F.col("own").alias("node_id"), F.col("name").alias("community"))


def closeness_estimated(nodes: DataFrame, edges: DataFrame, lg_k: int = 12, max_rounds: int = 200) -> DataFrame:
    """(node_id, closeness, reached, rounds): closeness of all nodes as ``closeness``
    has it, estimated. Each node holds a HyperLogLog sketch of the nodes within t
    steps; a round joins it with its neighbours' (HyperBall), so the cost is rounds
    times edges and not pairs of nodes. ``reached`` counts the node itself. The
    standard error of a count is about 1.04 / sqrt(2 ^ lg_k), 1.6 % by default.

    A node with one neighbour, which has others, takes part in the first round
    only: from then on its ball is that neighbour's of the round before, so its
    numbers follow from the neighbour's. Sketches are small on disk and large in
    memory, so sides that hold them are shuffled, never broadcast."""
    inside = closed(nodes, edges).where("src <> dst").select("src", "dst")
    pairs = kept(inside.unionAll(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "pairs")
    ends = pairs.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("next"))
    hub = ends.where("n > 1").select(F.col("src").alias("next"))
    leaf = kept(ends.where("n = 1").join(hub, "next", "left_semi").select(F.col("src").alias("node_id"), "next"), "leaf")
    core = kept(nodes.select("node_id").distinct().join(leaf, "node_id", "left_anti"), "core")
    # a node's first ball is of ids alone, so that no sketch is sent for a leaf
    near = pairs.join(core.withColumnRenamed("node_id", "src"), "src", "left_semi").select(F.col("src").alias("node_id"), F.col("dst").alias("of"))
    near = near.unionAll(core.select("node_id", F.col("node_id").alias("of")))
    one = near.groupBy("node_id").agg(F.hll_sketch_agg(F.col("of").cast("string"), lg_k).alias("ball"), F.count("*").alias("own"))
    one = one.withColumn("reached", F.hll_sketch_estimate("ball")).withColumn("grew", F.col("own") > 1)
    ball = kept(one.select("node_id", "ball", "reached", (F.col("reached") - 1).alias("total"), "grew", F.col("grew").cast("int").alias("last")), "ball", grew=F.count_if("grew"))
    links = kept(pairs.join(leaf.withColumnRenamed("node_id", "src"), "src", "left_anti").join(leaf.select(F.col("node_id").alias("dst")), "dst", "left_anti").select("src", "dst"), "pairs")
    dropped(pairs)
    for t in range(2, max_rounds + 1):
        if not ball.seen["grew"]:
            break
        near = links.hint("merge").join(ball.select(F.col("node_id").alias("dst"), "ball"), "dst").groupBy("src").agg(F.hll_union_agg("ball").alias("near"))
        met = ball.hint("merge").join(near.withColumnRenamed("src", "node_id"), "node_id", "left").withColumn("ball", F.when(F.col("near").isNull(), F.col("ball")).otherwise(F.hll_union("ball", "near")))
        # an estimate may fall by rounding where a ball did not grow
        now = met.withColumn("now", F.greatest("reached", F.hll_sketch_estimate("ball"))).withColumn("grew", F.col("now") > F.col("reached"))
        new = kept(now.select("node_id", "ball", F.col("now").alias("reached"), (F.col("total") + t * (F.col("now") - F.col("reached"))).alias("total"), "grew", F.when(F.col("grew"), t).otherwise(F.col("last")).alias("last")), "ball", grew=F.count_if("grew"))
        dropped(ball)
        ball = new
    measured = kept(ball.select("node_id", "reached", "total", "last"), "measured")
    dropped(links, ball)
    follows = leaf.join(measured.withColumnRenamed("node_id", "next"), "next").select("node_id", "reached", (F.col("total") + F.col("reached") - 2).alias("total"), (F.col("last") + 1).alias("last"))
    out = kept(measured.unionByName(follows), "measured", last=F.max("last"))
    rounds = min((out.seen["last"] or 0) + 1, max_rounds)
    dropped(leaf, core, measured)
    return out.select("node_id", F.coalesce(F.try_divide((F.col("reached") - 1).cast("double"), F.col("total").cast("double")), F.lit(0.0)).alias("closeness"), "reached", F.lit(rounds).alias("rounds"))


def communities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, size): the connected components."""
    return components(nodes, closed(nodes, edges)).groupBy("component").agg(F.count("*").alias("size"))


def metrics(nodes: DataFrame, edges: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """One row: totals, density, average degree, number of components and isolates."""
    base = density(nodes, edges)
    docs = totals(nodes, edges, documents).select("documents")
    comps = communities(nodes, edges).agg(F.count("*").alias("components"))
    alone = isolates(nodes, edges).agg(F.count("*").alias("isolates"))
    return base.join(docs, F.lit(True)).join(comps, F.lit(True)).join(alone, F.lit(True))  # one row each


def visible_subgraph(nodes: DataFrame, edges: DataFrame, documents: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, documents array) and edges (src, dst, document_id) to show for
    a choice of documents: an edge if its own document or one of either end's is
    chosen; a node if one of its documents is, or an edge at it is shown. No choice: all."""
    if not documents:
        return nodes, edges
    if len(documents) <= LITERALS:
        linked = nodes.where(F.arrays_overlap("documents", F.array(*map(F.lit, documents))))
        own = edges.withColumn("o", F.col("document_id").isin(*documents))
    else:
        chosen = nodes.sparkSession.createDataFrame([(v,) for v in dict.fromkeys(documents)], "document_id string")
        linked = among(nodes.select("node_id", F.explode("documents").alias("document_id")), "document_id", documents)
        own = edges.join(chosen.withColumn("o", F.lit(True)), "document_id", "left")
    linked = linked.select("node_id").distinct()
    s, d = linked.select(F.col("node_id").alias("src"), F.lit(True).alias("s")), linked.select(F.col("node_id").alias("dst"), F.lit(True).alias("d"))
    shown = own.join(s, "src", "left").join(d, "dst", "left").where(F.col("o") | F.col("s") | F.col("d")).select(*edges.columns)
    ends = linked.unionByName(shown.select(F.explode(F.array("src", "dst")).alias("node_id"))).distinct()
    return nodes.join(ends, "node_id", "left_semi"), shown
