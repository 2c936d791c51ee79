"""Traversals: frontiers are joined with the edges, step by step, and written between steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.ordering import collated
from skein.graph import Bucketed, Graph, bucketed, closed, written


#: Steps after which the files of the steps are folded into one for each bucket.
FOLD = 16
#: Ids of a frontier that a filter may list; more are joined.
FEW = 100
#: Ids of a frontier that is broadcast to a scan of all links, and the steps that may scan them; then they are put into buckets.
MANY, SCANS = 100_000, 8


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def links_of(edges: DataFrame) -> DataFrame:
    """Ends of edges without loops, written once as they come, since steps look at them again and again."""
    return written(edges.select("src", "dst").where("src <> dst"), "links")


def distances(edges: DataFrame, start: DataFrame, most: int, both: bool = False) -> DataFrame:
    """id and depth of all that is reached from ``start`` (id) over ``edges`` (src, dst), with ``both`` either way, in ``most`` steps."""
    return _reach(links_of(edges), start, most, both)


def _reach(links: DataFrame, start: DataFrame, most: int, both: bool = False) -> DataFrame:
    """``distances`` over written links.

    While a frontier is small and steps are few, the links are scanned as they lie and only the ends found are shuffled.
    Beyond that links lie in buckets of src; what has been reached always lies in buckets of id. A step then shuffles the ends
    that it finds and nothing else: the last frontier meets the edges, and the new ends what has been reached, as both lie."""
    edges = None
    seen = Bucketed(start.select("id").distinct().withColumn("depth", F.lit(0)), "id", "reached")
    for step in range(1, most + 1):
        last = seen.table().where(F.col("depth") == step - 1)
        few = [r[0] for r in last.select("id").limit(FEW + 1).collect()]
        if not few:
            break
        if edges is None and (step > SCANS or (len(few) > FEW and last.count() > MANY)):
            # dealt by src once, for the distinct pairs and the buckets
            n = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            edges = bucketed((both_ways(links) if both else links).repartition(n, "src").distinct(), "src", "edges")
        if edges is None:
            found = _scanned(links, last, few)
            if both:
                found = found.union(_scanned(links.toDF("dst", "src"), last, few))
            new = _unseen(found, seen.table())
        else:
            new = _step(edges, last, seen.table(), few)
        seen.add(new.withColumn("depth", F.lit(step)))
        if step % FOLD == 0:
            seen = Bucketed(seen.table(), "id", "reached")
    return seen.table()


def _scanned(links: DataFrame, last: DataFrame, few: list[str]) -> DataFrame:
    """id of the ends of links that begin in ``last``, at most ``MANY`` ids."""
    if len(few) <= FEW:
        return links.where(F.col("src").isin(few)).select(F.col("dst").alias("id"))
    return links.join(F.broadcast(last.select(F.col("id").alias("src"))), "src", "left_semi").select(F.col("dst").alias("id"))


def _step(edges: DataFrame, last: DataFrame, seen: DataFrame, few: list[str]) -> DataFrame:
    """id of the ends of edges that begin in ``last`` and aren't ``seen``; ``few``: the ids of ``last``, or ``FEW`` and one of them."""
    if len(few) <= FEW:  # a list of ids reaches the scan, which opens their buckets alone
        found = edges.where(F.col("src").isin(few))
    else:
        found = edges.join(last.select(F.col("id").alias("src")).hint("merge"), "src", "left_semi")
    return _unseen(found.select(F.col("dst").alias("id")), seen)


def _unseen(found: DataFrame, seen: DataFrame) -> DataFrame:
    # an outer join, as the optimizer would look for what is seen before ends are made distinct, so a hub's would all be shuffled
    found = found.distinct().join(seen.select(F.col("id").alias("_seen")).hint("merge"), F.col("id") == F.col("_seen"), "left")
    return found.where("_seen is null").select("id")


def focus(graph: Graph, node: str, depth: int) -> Graph:
    """Nodes within ``depth`` undirected steps (1 to 10) of a node, with depth_level; the graph itself if it isn't there."""
    start = graph.nodes.where(F.col("id") == node).select("id")
    if start.isEmpty():
        return graph
    near = distances(graph.edges, start, min(10, max(1, depth)), both=True)
    # written, as what is near may be little: its size then lets the edges stay where they are
    nodes = written(graph.nodes.join(near.withColumnRenamed("depth", "depth_level"), "id"), "near")
    return Graph(nodes, closed(graph.edges, nodes))


def neighbourhood(graph: Graph, node: str, hops: int) -> Graph:
    """Induced subgraph of the nodes within ``hops`` undirected steps."""
    start = graph.nodes.where(F.col("id") == node).select("id")
    near = distances(graph.edges, start, max(0, hops), both=True)
    nodes = written(graph.nodes.join(near.select("id"), "id", "left_semi"), "near")
    return Graph(nodes, closed(graph.edges, nodes))


def dependents(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """id of all from which a node of ``changed`` (id) is reached, these included; stops when a step finds none."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return distances(back, changed, 10_000).select("id")


#: Paths of one length that are gone on with together, at least.
BATCH = 16


def _nodewise():
    """Order of paths: by the collation of their nodes, one after the other."""
    return F.transform("path", lambda x: F.struct(collated(x), x)).asc()


def paths(edges: DataFrame, src: str | DataFrame, dst: str | DataFrame, max_depth: int = 10, max_paths: int = 3) -> tuple[DataFrame, bool]:
    """``_paths`` over edges that are written first."""
    return _paths(links_of(edges), src, dst, max_depth, max_paths)


def _paths(links: DataFrame, src: str | DataFrame, dst: str | DataFrame, max_depth: int = 10, max_paths: int = 3) -> tuple[DataFrame, bool]:
    """Simple directed paths, shortest first, then by collation of their nodes; and whether the list is complete.

    ``src`` and ``dst`` are a node, or a table of nodes (id). Lengths are taken in turn. For each, the nodes are known from
    which a walk of just so many steps leads to a target. Paths begun go on best first: of those of equal length a batch of
    the first in order is extended by a step, the rest waits, and what has been extended goes before what waits. So the work
    follows the number of paths that are asked for, not of those that there are; a batch whose walks all meet themselves
    again lets the next one be twice as large. Only links that begin in what is reached from ``src`` are looked at: in as many
    steps as the longest walk that is asked about has, which begins where ``max_depth`` and one steps lead and has as many."""
    spark = links.sparkSession
    max_depth, max_paths = max(1, max_depth), max(1, max_paths)
    if isinstance(src, str) and src == dst:
        return spark.createDataFrame([([src],)], "path array<string>"), True
    table = lambda x: spark.createDataFrame([(x,)], "id string") if isinstance(x, str) else x.select("id").distinct()
    goal = written(table(dst), "goal")
    begin = written(table(src).select(F.array("id").alias("path")), "begin")
    near = written(_reach(links, begin.select(F.element_at("path", -1).alias("id")), 2 * max_depth + 2), "near")
    edges = written(links.join(near.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst").distinct(), "edges")
    back = [goal.toDF("_id")]  # nodes that are so many steps before a target, without passing one
    found, n, complete = [], 0, True
    for length in range(1, max_depth + 1):
        before = edges.join(back[-1], F.col("dst") == F.col("_id"), "left_semi").select(F.col("src").alias("_id")).distinct()
        back.append(written(before.join(back[0], "_id", "left_anti"), "steps-before"))
        if back[-1].isEmpty():
            break
        stack, size = [(begin.join(back[-1], F.element_at("path", -1) == F.col("_id"), "left_semi"), 0)], max(BATCH, max_paths)
        while stack and n <= max_paths:
            some, step = stack.pop()
            if step == length:
                found.append(some)
                n += some.count()
                continue
            head = written(some.orderBy(_nodewise()).limit(size), "paths")
            taken = head.count()
            if not taken:
                size *= 2
                continue
            if taken == size:
                stack.append((some.join(head, "path", "left_anti"), step))
            last = F.element_at("path", -1)
            on = head.join(edges, last == F.col("src")).where(~F.array_contains("path", F.col("dst")))
            on = on.join(back[length - step - 1], F.col("dst") == F.col("_id"), "left_semi")
            stack.append((written(on.select(F.array_append("path", F.col("dst")).alias("path")), "paths"), step + 1))
        if n > max_paths:
            complete = False
            break
    else:
        # a longer walk may exist
        more = edges.join(back[-1], F.col("dst") == F.col("_id"), "left_semi").select(F.col("src").alias("_id")).join(back[0], "_id", "left_anti")
        complete = more.join(near.where(F.col("depth") <= len(back)).select(F.col("id").alias("_id")), "_id", "left_semi").isEmpty()
    out = spark.createDataFrame([], "path array<string>")
    for some in found:
        out = out.union(some)
    return out.orderBy(F.size("path"), _nodewise()).limit(max_paths), complete


# Raw paths looked at for each path between files, and at most.
RAW_PATHS, MOST_RAW_PATHS = 20, 1000


def path_report(graph: Graph, src: str, dst: str, max_depth: int = 10, max_paths: int = 3, expand: bool = False, project: bool = False) -> tuple[DataFrame, bool]:
    """Paths between two nodes of the graph, none if one of them isn't there; and whether the list is complete.

    Paths between the nodes themselves come first. If there is none, ``expand`` lets a file stand for its symbols too, and
    ``project`` reports the files that such paths lead through, each path of files once and none that stays in one file."""
    both = links_of(closed(graph.edges, graph.nodes))
    own = graph.nodes.where(F.col("id").isin(src, dst)).select("id", F.col("symbol_file").isNull().alias("file")).collect()  # two rows at most
    there = {r["id"]: r["file"] for r in own}
    exact, complete = None, True
    if src in there and dst in there:
        exact, complete = _paths(both, src, dst, max_depth, max_paths)
    if not (expand or project) or src == dst:
        return (exact, complete) if exact is not None else (graph.edges.sparkSession.createDataFrame([], "path array<string>"), True)
    files = project and there.get(src, True) and there.get(dst, True)
    if exact is not None:
        exact = written(exact.withColumn("ord", F.monotonically_increasing_id()), "exact")
        if not exact.isEmpty():
            return (_through_files(exact, graph) if files else exact.orderBy("ord").select("path")), complete
    ends = [graph.nodes.where((F.col("id") == x) | (F.col("symbol_file") == x)).select("id") for x in (src, dst)]
    if not files:
        return _paths(both, *ends, max_depth, max_paths)
    raw, complete = _paths(both, *ends, max_depth, min(MOST_RAW_PATHS, RAW_PATHS * max_paths))
    found = _through_files(written(raw.withColumn("ord", F.monotonically_increasing_id()), "raw"), graph).where(F.size("path") > 1)
    found = written(found.withColumn("ord", F.monotonically_increasing_id()).groupBy("path").agg(F.min("ord").alias("ord")), "found")
    return found.orderBy("ord").limit(max_paths).select("path"), complete and found.count() <= max_paths


def _through_files(found: DataFrame, graph: Graph) -> DataFrame:
    """Paths (path, ord) of nodes as paths of files in the same order; a file that follows itself counts once."""
    steps = found.select("ord", F.posexplode("path").alias("at", "id"))
    of = graph.nodes.select("id", F.coalesce("symbol_file", "id").alias("file"))
    steps = steps.join(of, "id").groupBy("ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "file"))), lambda x: x.file).alias("files"))
    return steps.orderBy("ord").select(F.filter("files", lambda f, i: (i == 0) | (f != F.get("files", i - 1))).alias("path"))


def shortest_path(edges: DataFrame, src: str, dst: str, most: int = 100) -> list[str]:
    """A shortest directed path, by least node at each step back; empty if there is none."""
    spark = edges.sparkSession
    edges = written(edges.select("src", "dst").distinct(), "edges")
    reached = distances(edges, spark.createDataFrame([(src,)], "id string"), most)
    row = reached.where(F.col("id") == dst).first()
    if row is None:
        return []
    path = [dst]
    for depth in range(row["depth"] - 1, -1, -1):
        at = reached.where(F.col("depth") == depth).join(edges.where(F.col("dst") == path[-1]), F.col("id") == F.col("src"))
        path.append(at.agg(F.min("id")).first()[0])
    return path[::-1]


def pagerank(links: DataFrame, weights: DataFrame, iterations: int = 20, damping: float = 0.85) -> DataFrame:
    """id and rank over ``links`` (src, dst, weight), which count one way each; ``weights`` (id, weight) lists all nodes
    and where a walk begins anew, evenly if all are 0. Mass of nodes without links begins anew likewise; ranks sum to 1."""
    names = numbered(weights)
    number = names.select(F.col("id").alias("_id"), "n")
    flows = links.where("weight is not null").join(number, F.col("src") == F.col("_id")).select(F.col("n").alias("_src"), "dst", "weight")
    # what flows to ends that are no nodes is lost, but counts among what its start gives away
    flows = flows.join(number, F.col("dst") == F.col("_id"), "left").select(F.col("_src").alias("src"), F.col("n").alias("dst"), "weight")
    return flowed(flows, names, iterations, damping)


def numbered(weights: DataFrame) -> DataFrame:
    """id, its number n and start, the share of walks that begin there, in buckets of id."""
    total = weights.agg(F.sum("weight").alias("_total"), F.count("*").alias("_n"))
    start = weights.join(F.broadcast(total)).select("id", F.when(F.col("_total") > 0, F.col("weight") / F.col("_total")).otherwise(1 / F.col("_n")).alias("start"))
    return bucketed(start.withColumn("n", F.monotonically_increasing_id()), "id", "names")


def flowed(flows: DataFrame, names: DataFrame, iterations: int = 20, damping: float = 0.85) -> DataFrame:
    """``pagerank`` over numbers: ``flows`` (src, dst, weight; links from one node to another add up) between ``numbered`` names.

    What flows is a number and a share and no texts. Links lie in buckets of src and nodes in buckets of their number, so a step
    shuffles what flows to each node, summed up before. Its ranks are written, and what it shuffled goes before the next step."""
    flows = bucketed(flows, "src", "links").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    share = flows.withColumn("_sum", F.sum("weight").over(Window.partitionBy("src"))).where("_sum > 0")
    share = Bucketed(share.select("src", "dst", (F.col("weight") / F.col("_sum")).alias("share")), "src", "shares", lies=True).table()
    out, share = share.select(F.col("src").alias("_from")).distinct(), share.where("dst is not null")
    start = names.select("n", "start").join(out, F.col("n") == F.col("_from"), "left")
    start = bucketed(start.select("n", "start", F.col("_from").isNull().alias("dangling")), "n", "start")
    ranks = start.select("n", "dangling", F.col("start").alias("rank"))
    for _ in range(iterations):
        lost = ranks.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0)).alias("_lost"))
        got = ranks.join(share.hint("merge"), F.col("n") == F.col("src")).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("_got"))
        new = start.join(got.hint("merge"), F.col("n") == F.col("dst"), "left").join(F.broadcast(lost)).select(
            "n", "dangling",
            ((1 - damping + damping * F.col("_lost")) * F.col("start") + damping * F.coalesce("_got", F.lit(0.0))).alias("rank"),
        )
        ranks = Bucketed(new, "n", "ranks", lies=True).table()
    return names.select("id", "n").join(ranks.select("n", "rank"), "n").select("id", "rank")
