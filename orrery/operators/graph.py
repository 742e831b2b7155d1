"""Graph operators over an edge table (src, dst)."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.sources.shared import Saved, cut

#: Edges of a graph that one task may hold.
SMALL_EDGES = 4_000_000


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def distances(edges: DataFrame, seeds: DataFrame, max_distance: int, direction: str = "both") -> DataFrame:
    """(node, distance) of all nodes within ``max_distance`` steps of a seed (node); the first visit counts.

    A step joins the front with the edges, forth, back or both ways; the edges are written once, as they are.
    """
    e = edges.select("src", "dst")
    return _walk(cut(e, "edges") if max_distance > 1 else e, seeds, max_distance, direction)


def _walk(e: DataFrame, seeds: DataFrame, max_distance: int, direction: str) -> DataFrame:
    ways = {"out": [("src", "dst")], "in": [("dst", "src")], "both": [("src", "dst"), ("dst", "src")]}[direction]
    seen = seeds.select("node").distinct().withColumn("distance", F.lit(0))
    front = seen
    for hop in range(1, max_distance + 1):
        met = [front.select("node").join(e, F.col("node") == F.col(a)).select(F.col(b).alias("node")) for a, b in ways]
        step = reduce(DataFrame.unionByName, met).distinct()
        front = cut(step.join(seen.select("node"), "node", "left_anti").withColumn("distance", F.lit(hop)), "hop")
        seen = seen.unionByName(front)
    return seen


#: Hops and rows of a neighbour query, by default and at most.
HOPS, MAX_HOPS, NEIGHBORS, MAX_NEIGHBORS = 2, 8, 50, 300


def neighbors(edges: DataFrame, seeds: DataFrame, direction: str = "both", hops: int = HOPS, limit: int = NEIGHBORS) -> DataFrame:
    """(node, distance): the ``limit`` nearest nodes around the seeds, seeds left out; hops and limit are kept in their bounds."""
    hops, limit = min(max(1, hops), MAX_HOPS), min(max(1, limit), MAX_NEIGHBORS)
    return distances(edges, seeds, hops, direction).where("distance > 0").orderBy("distance", "node").limit(limit)


def neighbor_counts(edges: DataFrame) -> DataFrame:
    """(node, n_out, n_in, n_both): distinct neighbours that a node links to, is linked from, either."""
    ends = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), F.lit(True).alias("out")).unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), F.lit(False).alias("out")))
    pairs = ends.groupBy("node", "other").agg(F.max("out").alias("o"), F.min("out").alias("i"))
    return pairs.groupBy("node").agg(F.count_if("o").alias("n_out"), F.count_if(~F.col("i")).alias("n_in"), F.count("*").alias("n_both"))


def paths_at(nodes: DataFrame, paths: DataFrame, distance: int | None = None) -> DataFrame:
    """Paths (node, path) of the nodes (node, distance) around a centre, at one distance or any but 0, once each."""
    near = nodes.where("distance > 0") if distance is None else nodes.where(F.col("distance") == distance)
    return near.join(paths.select("node", "path"), "node").select("path").distinct()


def degree_rank(edges: DataFrame) -> DataFrame:
    """(node, score): ln(1 + 2 in + out) over the largest."""
    ends = edges.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    d = ends.groupBy("node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out")).withColumn("raw", F.log1p(2 * F.col("n_in") + F.col("n_out")))
    return d.crossJoin(F.broadcast(d.agg(F.max("raw").alias("most")))).select("node", "n_in", "n_out", (F.col("raw") / F.col("most")).alias("score"))  # one row


#: Rounds after which it is looked whether ranks have settled; all but the last are one plan.
ROUNDS_AT_ONCE = 5


#: Links that a task joins, about; so small graphs are dealt over few tasks.
TASK_LINKS = 1 << 18


@contextmanager
def _dealt(spark: SparkSession) -> Iterator[Callable[[int], int]]:
    """What sets the number of shuffle partitions by a number of links, the session's own at most, which comes back afterwards."""
    name = "spark.sql.shuffle.partitions"
    own = spark.conf.get(name)

    def deal(n: int) -> int:
        spark.conf.set(name, str(min(int(own), max(spark.sparkContext.defaultParallelism, n // TASK_LINKS))))
        return int(spark.conf.get(name))

    try:
        yield deal
    finally:
        spark.conf.set(name, own)


def _numbered(saved: Saved, edges: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame, DataFrame, Callable[[str], Column]]:
    """What ranks flow over: names (id, node), degrees (id, n), links (src, dst) both ways and once each, and what makes an id.

    An id is the hash of a node's name, or the name itself if two names of the graph share a hash.  Links and degrees are
    bucketed, links by source, so a join of what lies at the nodes moves no link and, by hash, sorts none.  A missing
    end counts as a neighbour and passes nothing on.
    """
    number = lambda c: F.when(F.col(c).isNotNull(), F.xxhash64(c))
    names = saved.keep(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().select(number("node").alias("id"), "node"), "names")
    if not names.groupBy("id").count().where("count > 1").isEmpty():
        number, names = F.col, names.select(F.col("node").alias("id"), "node")
    end = lambda a, b: F.struct(number(a).alias("src"), number(b).alias("dst"))
    both = edges.select(F.explode(F.array(end("src", "dst"), end("dst", "src"))).alias("e")).select("e.*").where("src IS NOT NULL")
    links = saved.keep_sorted(both.repartition(buckets, "src").distinct(), "links", ["src"], buckets)
    degrees = saved.keep_sorted(links.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n")), "degrees", ["id"], buckets)
    return names, degrees, links, number


def _flow(links: DataFrame, at: DataFrame, amount: Column) -> DataFrame:
    """What lies at the nodes (id, n, ...), dealt evenly to the neighbours: ``dst`` and ``got``; a task holds its nodes, links pass by."""
    shared = at.withColumn("got", amount / F.col("n")).drop("n").hint("shuffle_hash")
    return links.join(shared, F.col("src") == F.col("id")).drop("src", "id")


def pagerank(edges: DataFrame, seeds: DataFrame, iterations: int = 30, alpha: float = 0.85, tol: float = 1e-6) -> DataFrame:
    """Personalized PageRank (node, rank) on the undirected graph; a seed without neighbours counts for nothing.

    At most ``iterations`` rounds, and none after ranks have moved by ``tol`` or less in sum; with 0 all rounds are run.
    Only nodes that have rank pass some on, so a round shuffles what flows, once, added up before.  Once no further node
    is reached, links elsewhere are left out.
    """
    spark = edges.sparkSession
    saved = Saved(spark, "pagerank")
    with _dealt(spark) as deal:
        buckets = deal(2 * edges.count())
        names, degrees, links, number = _numbered(saved, edges, buckets)
        own = degrees.join(seeds.select(number("node").alias("id")).distinct(), "id", "left_semi").select("id")
        own = saved.keep(own.crossJoin(F.broadcast(own.agg(F.count("*").alias("m")))).select("id", (1.0 / F.col("m")).alias("restart")), "seeds")  # one row
        nodes = degrees.join(own.hint("shuffle_hash"), "id", "left").select("id", "n", F.coalesce("restart", F.lit(0.0)).alias("restart"))
        nodes = saved.keep_sorted(nodes, "nodes", ["id"], buckets)

        def after(rank: DataFrame, rounds: int) -> DataFrame:
            for _ in range(rounds):
                flow = _flow(links, rank.select("id", "n", "rank"), F.col("rank")).groupBy(F.col("dst").alias("id")).agg(F.sum("got").alias("got"))
                new = alpha * F.coalesce("got", F.lit(0.0)) + (1 - alpha) * F.col("restart")
                rank = nodes.join(flow.hint("shuffle_hash"), "id", "left").select("id", "n", new.alias("rank")).where("rank > 0")
            return saved.keep_sorted(rank, "rank", ["id"], buckets)

        def moved(new: DataFrame, old: DataFrame) -> float:
            was = old.select("id", F.col("rank").alias("was")).hint("shuffle_hash")  # a node that has rank keeps some
            return new.join(was, "id", "left").agg(F.sum(F.abs(F.col("rank") - F.coalesce("was", F.lit(0.0))))).first()[0] or 0.0

        rank = saved.keep_sorted(nodes.where("restart > 0").select("id", "n", F.col("restart").alias("rank")), "rank", ["id"], buckets)
        done, whole = 0, True
        while done < iterations:
            n = min(ROUNDS_AT_ONCE, iterations - done)
            before = after(rank, n - 1) if n > 1 else rank
            new = after(before, 1)
            if tol > 0 and moved(new, before) <= tol:  # ranks move less from round to round, so one of these rounds is the last
                new = rank
                for _ in range(n):
                    old, new = new, after(new, 1)
                    if moved(new, old) <= tol:
                        break
                rank = new
                break
            done += n
            if whole and done < iterations:
                found = new.agg(F.count("*").alias("nodes"), F.coalesce(F.sum("n"), F.lit(0)).alias("links")).first()
                if found["nodes"] == before.count():
                    whole = False
                    if 2 * found["nodes"] <= nodes.count():
                        held = new.select(F.col("id").alias("_id")).hint("shuffle_hash")
                        part, own = links.join(held, F.col("src") == F.col("_id"), "left_semi"), nodes.join(held, F.col("id") == F.col("_id"), "left_semi")
                        buckets = deal(found["links"])
                        links = saved.keep_sorted(part.repartition(buckets, "src"), "links", ["src"], buckets)
                        nodes = saved.keep_sorted(own.repartition(buckets, "id"), "nodes", ["id"], buckets)
                        new = saved.keep_sorted(new.repartition(buckets, "id"), "rank", ["id"], buckets)
            rank = new
        return names.join(rank.select("id", "rank"), "id", "left").select("node", F.coalesce("rank", F.lit(0.0)).alias("rank"))


def pushed_ranks(edges: DataFrame, seeds: DataFrame, waves: int = 30, alpha: float = 0.85, least: float = 1e-9) -> DataFrame:
    """(kernel, node, rank, missing): personalized PageRank of many kernels, groups of seeds (kernel, node), at once.

    Forward push in waves: a node keeps the share 1 - alpha of its residual and pushes the rest to its neighbours, in
    one join for all kernels.  Residuals below ``least`` are dropped, so a kernel stays around its seeds.  Mass is
    conserved, hence ``missing``, what a kernel has dropped, is a bound: no rank is lower than that of ``waves`` power
    rounds by more, none is higher, and with ``least`` 0 they are the same.  A seed without neighbours counts for nothing.
    """
    spark = edges.sparkSession
    saved = Saved(spark, "push")
    with _dealt(spark) as deal:
        names, degrees, links, number = _numbered(saved, edges, deal(2 * edges.count()))
        own = saved.keep(seeds.select("kernel", number("node").alias("id")).distinct().join(degrees, "id", "left_semi"), "seeds")
        count = own.groupBy("kernel").agg(F.count("*").alias("m"))
        residual = saved.keep(own.join(count, "kernel").select("kernel", "id", (1.0 / F.col("m")).alias("r")), "wave")
        kept = []
        for _ in range(waves):
            kept.append(residual.select("kernel", "id", ((1 - alpha) * F.col("r")).alias("r")))
            at = degrees.join(residual.hint("shuffle_hash"), "id")
            pushed = _flow(links, at, alpha * F.col("r")).groupBy("kernel", F.col("dst").alias("id")).agg(F.sum("got").alias("r"))
            residual = saved.keep(pushed.where(F.col("r") >= least), "wave")
        kept.append(residual)
        total = saved.keep(reduce(DataFrame.unionByName, kept).groupBy("kernel", "id").agg(F.sum("r").alias("rank")), "ranks")
    missing = total.groupBy("kernel").agg(F.greatest(1.0 - F.sum("rank"), F.lit(0.0)).alias("missing"))
    named = total.join(names, total["id"].eqNullSafe(names["id"])).select("kernel", "node", "rank")
    return named.join(missing, "kernel")


def fused(ranks: DataFrame) -> DataFrame:
    """(node, rank): of several kernels' ranks of a node the highest."""
    return ranks.groupBy("node").agg(F.max("rank").alias("rank"))


#: Nodes around the seeds that are ranked at most, by their distance and name.
MAX_CANDIDATES = 5000


def related(edges: DataFrame, seeds: DataFrame, max_distance: int = 2, limit: int = 20, candidates: int = MAX_CANDIDATES, iterations: int = 30, alpha: float = 0.85, tol: float = 1e-6) -> DataFrame:
    """(node, distance, score) of the nodes most related to the seeds, seeds left out.

    Nodes within ``max_distance`` of a seed, the ``candidates`` nearest at most, make the horizon; personalized PageRank
    runs on its part of the graph.  The order is by score, then distance, then node.
    """
    whole = cut(edges.select("src", "dst"), "edges")
    horizon = cut(_walk(whole, seeds, max(1, max_distance), "both"), "horizon")
    near = horizon.where("distance = 0").unionByName(horizon.where("distance > 0").orderBy("distance", "node").limit(candidates))
    near = F.broadcast(cut(near, "near")) if candidates <= 100_000 else cut(near, "near")  # and the seeds of the caller
    ends = near.select("node")
    part = whole.join(ends.withColumnRenamed("node", "src"), "src", "left_semi").join(ends.withColumnRenamed("node", "dst"), "dst", "left_semi")
    rank = pagerank(cut(part, "part"), seeds, iterations, alpha, tol)
    found = rank.join(near, "node").where("distance > 0").select("node", "distance", F.col("rank").alias("score"))
    return found.orderBy(F.desc("score"), "distance", "node").limit(limit)


def collapse(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges between clusters: ends are renamed by (node, cluster), loops and repeats go."""
    m = mapping.select("node", "cluster")
    e = edges.join(m.withColumnsRenamed({"node": "src", "cluster": "c1"}), "src", "left").join(m.withColumnsRenamed({"node": "dst", "cluster": "c2"}), "dst", "left")
    return e.select(F.coalesce("c1", "src").alias("src"), F.coalesce("c2", "dst").alias("dst")).where("src != dst").distinct()


def merge_entities(entities: DataFrame, key: str, order: str) -> DataFrame:
    """One entity for a key: the first by ``order``, the union of names, the highest confidence."""
    return entities.groupBy(key).agg(F.min_by("name", order).alias("name"), F.array_join(F.array_sort(F.collect_set("name")), ",").alias("aliases"), F.max("confidence").alias("confidence"))


def weighted_pagerank(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, alpha: float = 0.15, iterations: int = 5) -> DataFrame:
    """(node, rank) from nodes (node, saliency), edges (src, dst, weight) and seeds (node, seed); here alpha is the teleport weight.

    Mass follows edges by weight; teleport is min(1, seed + saliency / 10).
    """
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    share = cut(edges.join(out, "src").where("total > 0").select("src", "dst", (F.col("weight") / F.col("total")).alias("p")), "share")
    base = nodes.join(seeds, "node", "left").select("node", F.coalesce("seed", F.lit(0.0)).alias("rank"), F.least(F.coalesce("seed", F.lit(0.0)) + F.coalesce("saliency", F.lit(0.0)) / 10, F.lit(1.0)).alias("teleport"))
    base = cut(base, "teleport")
    rank = base.select("node", "rank")
    for _ in range(iterations):
        flow = share.join(rank, F.col("src") == F.col("node")).groupBy("dst").agg(F.sum(F.col("p") * F.col("rank")).alias("got"))
        rank = cut(base.join(flow, F.col("node") == F.col("dst"), "left").select("node", ((1 - alpha) * F.coalesce("got", F.lit(0.0)) + alpha * F.col("teleport")).alias("rank")), "rank")
    return rank


def labels(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each component, by hops of minimum labels and label jumps."""
    e = cut(undirected(edges), "edges")
    now = cut(e.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("label")).select("node", F.least("node", "label").alias("label")), "labels")
    while True:
        seen = now.join(e, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("seen"))
        step = now.join(seen, "node").select("node", F.least("label", "seen").alias("near"), F.col("label").alias("was"))
        jump = now.select(F.col("node").alias("near"), F.col("label").alias("far"))
        nxt = cut(step.join(jump, "near", "left").select("node", F.least("near", F.coalesce("far", "near")).alias("label"), "was"), "labels")
        if nxt.where("label != was").isEmpty():
            return nxt.select("node", "label")
        now = nxt.select("node", "label")


#: Sizes and least density of a dense cluster.
CLUSTER_SIZE = (3, 15)
LEAST_DENSITY = 0.4


def _density(members: set, out: dict) -> float:
    n = len(members)
    return sum(1 for m in members for x in out.get(m, ()) if x in members) / (n * (n - 1)) if n > 1 else 1.0


def grow_clusters(score: dict, out: dict) -> list[tuple[list, float, float]]:
    """(members, average score, density): greedy growth from the highest scores; ties go to the smaller name.

    Members of a grown cluster are used up even if it is too thin to keep.
    """
    least, most = CLUSTER_SIZE
    near: dict = {}
    for a, ends in out.items():
        for b in ends:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    used: set = set()
    found = []
    for seed in sorted(score, key=lambda n: (-score[n], n)):
        if seed in used:
            continue
        members = {seed}
        while len(members) < most:
            around = {x for m in members for x in near.get(m, ()) if x in score and x not in used and x not in members}
            ranked = heapq.nsmallest(1, ((-_density(members | {c}, out), c) for c in around))
            if not ranked or -ranked[0][0] < LEAST_DENSITY:
                break
            members.add(ranked[0][1])
        if len(members) >= least:
            used |= members
            found.append((sorted(members), sum(score[m] for m in members) / len(members), _density(members, out)))
    return [f for f in found if f[2] >= LEAST_DENSITY]


def dense_clusters(nodes: DataFrame, edges: DataFrame, min_score: float, min_activations: int = 3) -> DataFrame:
    """(cluster, members, avg_score, density) among nodes (node, score, activations) of high score.

    Growth depends on order, so the high nodes of one component are one group; components are found by joins.  A
    component of more than ``SMALL_EDGES`` edges is refused: choose a higher ``min_score``.
    """
    high = cut(nodes.where((F.col("score") >= min_score) & (F.col("activations") >= min_activations)).select("node", "score"), "high")
    inner = edges.select("src", "dst").where("src != dst").distinct().join(high.select(F.col("node").alias("src")), "src", "left_semi").join(high.select(F.col("node").alias("dst")), "dst", "left_semi")
    inner = cut(inner, "inner")
    parts = cut(labels(inner), "components")
    largest = inner.join(parts, F.col("src") == F.col("node")).groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest > SMALL_EDGES:
        raise ValueError(f"a component has {largest} edges, more than a task may hold; raise min_score")
    rows = high.join(parts, "node").select("label", F.col("node").alias("a"), F.lit(None).cast("string").alias("b"), "score")
    rows = rows.unionByName(inner.join(parts, F.col("src") == F.col("node")).select("label", F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(0.0).alias("score")))

    def grow(df: pd.DataFrame) -> pd.DataFrame:
        is_node = df["b"].isna()
        score = dict(zip(df["a"][is_node], df["score"][is_node], strict=True))
        out: dict = {}
        for a, b in zip(df["a"][~is_node], df["b"][~is_node], strict=True):
            out.setdefault(a, set()).add(b)
        got = grow_clusters(score, out)
        return pd.DataFrame({"cluster": [m[0] for m, _, _ in got], "members": [m for m, _, _ in got], "avg_score": [s for _, s, _ in got], "density": [d for _, _, d in got]})

    return rows.groupBy("label").applyInPandas(grow, "cluster string, members array<string>, avg_score double, density double")


def pair_priority(rank: tuple, tags: tuple, saliency: tuple):
    """Priority of a suggested link: rank and shared tags, raised by saliency, within 0 and 1; pairs hold left and right columns."""
    unit = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    least = F.least(F.size(tags[0]), F.size(tags[1]))
    shared = F.when(least > 0, unit(F.size(F.array_intersect(*tags)) / least)).otherwise(0.0)
    factor = F.least(F.greatest(1 + (saliency[0] + saliency[1]) / 2, F.lit(1.0)), F.lit(2.0))
    return unit(unit(unit((rank[0] + rank[1]) / 2) * 0.7 + shared * 0.3) * factor)


def suggest_links(docs: DataFrame, edges: DataFrame, candidates: int, limit: int) -> DataFrame:
    """(left_id, right_id, priority): pairs of the ``candidates`` best docs (id, rank, tags, saliency) without an edge.

    The candidate list is the feature's own top-k, so the self-join is bounded by its square.
    """
    best = docs.orderBy(F.desc("rank"), "id").limit(candidates)
    a = best.select(*[F.col(c).alias(f"left_{c}") for c in ("id", "rank", "tags", "saliency")])
    b = best.select(*[F.col(c).alias(f"right_{c}") for c in ("id", "rank", "tags", "saliency")])
    pairs = a.join(F.broadcast(b), F.col("left_id") < F.col("right_id"))
    known = undirected(edges).select(F.col("src").alias("left_id"), F.col("dst").alias("right_id"))
    both = [(F.col(f"left_{c}"), F.col(f"right_{c}")) for c in ("rank", "tags", "saliency")]
    return pairs.join(known, ["left_id", "right_id"], "left_anti").select("left_id", "right_id", pair_priority(*both).alias("priority")).orderBy(F.desc("priority"), "left_id", "right_id").limit(limit)
