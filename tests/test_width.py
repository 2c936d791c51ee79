"""What joins and shuffles carry: no text twice, none before the last join, and no more edges than are looked at."""

import os
import random
import re
import time

import pytest

from skein import graph as graph_module
from skein.graph import Graph, closed, file_edges, firsts, full, slim
from skein.operators import scope, traverse, visible
from skein.plans import catalogue_facts, reports
from skein.schema import EDGE, NODE, edge_id
from skein.sources import derived
from pyspark.sql import functions as F

PARTS = "array<struct<id:string,plugin_id:string,source_id:string,label:string>>"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


EDGES = [
    ("a->b#call", "a", "b", "call", None, 3), ("a->b#call", "a", "b", "call", [("s", "p", "q", "l")], 2), ("a->b#call:x", "a", "b", "call", None, 1),
    ("a->b->c#call", "a->b", "c", "call", None, 7), ("a->b->c#call", "a", "b->c", "call", None, 6), (None, "a", "b", "call", None, 4),
    (None, "a", "b", None, None, 5), ("a->b#k#k", "a", "b", "k#k", None, 8), ("é->😀#call", "é", "😀", "call", None, 9), ("other", "a", "b", "call", None, 1),
]


def test_slim_edges_are_whole_again(spark):
    df = spark.createDataFrame(EDGES, EDGE.simpleString()[7:-1])
    assert sorted(map(repr, full(slim(df)).select(*df.columns).collect())) == sorted(map(repr, df.collect()))
    assert slim(df).where("id is null").count() == 8


def test_first_edge_of_each_id(spark):
    df = spark.createDataFrame(EDGES, EDGE.simpleString()[7:-1])
    first = {}
    for r in sorted(df.collect(), key=lambda r: r["ord"]):
        first.setdefault(r["id"], r)
    assert sorted(map(repr, firsts(df).collect())) == sorted(map(repr, first.values()))


def test_closed_edges_are_joined_without_their_ids(spark, no_broadcast):
    edges = spark.createDataFrame(EDGES, EDGE.simpleString()[7:-1])
    nodes = spark.createDataFrame([(x,) for x in "abc"], "id string")
    out = closed(edges, nodes)
    assert sorted(r["ord"] for r in out.collect()) == [1, 1, 2, 3, 4, 5, 8]
    text = plan(out)
    assert text.index("_said") < text.rindex("Exchange hashpartitioning(src")


def test_texts_are_made_after_the_last_join(spark, sf, no_broadcast):
    text = plan(derived.lines(spark, sf))
    assert text.rindex("concat(") < text.index("Exchange hashpartitioning")


def scope_graph(spark):
    nodes = [("f", None, None), ("g", None, None), ("f#x", "f", "class"), ("f#y", "f", "function"), ("g#z", "g", "function"), ("h#v", "gone", "class")]
    nodes = spark.createDataFrame(nodes, "id string, symbol_file string, symbol_kind string")
    nodes = nodes.select(*[(F.col(f.name) if f.name in nodes.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in NODE.fields])
    rows = [("f#x", "g#z", "call"), ("f#y", "g#z", "call"), ("f#x", "f#y", "call"), ("f", "f#x", "contains"), ("g", "g#z", "contains"), ("h#v", "g", "call"), ("f#x", "g", "a#b"), ("f", "f", "import"), ("lost", "g", "import")]
    edges = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "src string, dst string, kind string, ord long")
    edges = edges.withColumn("id", edge_id(F.col("src"), F.col("dst"), F.col("kind"))).withColumn("sources", F.lit(None).cast(PARTS)).select(*[f.name for f in EDGE.fields])
    return Graph(nodes, edges)


def test_places_say_only_what_differs(spark):
    g = scope_graph(spark)
    shown = scope.in_scope(scope.Scope(nodes={"symbol:class": False}))
    got = {r.id: (r.state, r.to, r.file) for r in scope.places(g.nodes, shown).collect()}
    assert got == {"f": (1, None, None), "g": (1, None, None), "f#x": (2, "f", None), "f#y": (1, None, "f"), "g#z": (1, None, "g"), "h#v": (0, None, None)}


def test_scoped_edges(spark):
    g = scope_graph(spark)
    s = scope.Scope(nodes={"symbol:class": False})
    out = {(r.id, r.src, r.dst, r.kind) for r in scope.projected(g.edges, g.nodes, scope.in_scope(s)).collect()}
    calls = {("f#y->g#z#call", "f#y", "g#z", "call"), ("f->f#y#call", "f", "f#y", "call"), ("f->g#b", "f", "g", "a#b"), ("f->f#import", "f", "f", "import"), ("g->g#z#contains", "g", "g#z", "contains")}
    assert out == calls | {("f->g#z#call", "f", "g#z", "call"), ("f->f#x#contains", "f", "f#x", "contains")}
    # of the calls from f to g the one between symbols stays
    assert {(r.id, r.src, r.dst, r.kind) for r in scope.apply_scope(g, s).edges.collect()} == calls


def test_opposite_edges_meet_in_one_shuffle(spark):
    rows = [("x->y#k", "x", "y", "k"), ("y->x#k", "y", "x", "k"), ("x->z#k", "x", "z", "k"), ("x->x#k", "x", "x", "k"), ("x->x#k", "x", "x", "k")]
    out = visible.bidirectional(spark.createDataFrame(rows, "id string, src string, dst string, kind string"))
    assert plan(out).count("Exchange hashpartitioning") == 1
    assert {(r.a, r.b, r.both) for r in out.collect()} == {("x", "y", True), ("x", "z", False), ("x", "x", False)}


def test_few_ends_leave_links_where_they_lie(spark, monkeypatch):
    rows = [("a", "b"), ("b", "c"), ("b", "c"), ("d", "a"), ("c", "c")]
    df, start = spark.createDataFrame(rows, "src string, dst string"), spark.createDataFrame([("a",)], "id string")
    made, plain = [], traverse.bucketed
    monkeypatch.setattr(traverse, "bucketed", lambda df, by, name: made.append(name) or plain(df, by, name))
    assert {r.id: r.depth for r in traverse.distances(df, start, 3).collect()} == {"a": 0, "b": 1, "c": 2}
    assert {r.id: r.depth for r in traverse.distances(df, start, 3, both=True).collect()} == {"a": 0, "b": 1, "d": 1, "c": 2}
    assert made == []
    monkeypatch.setattr(traverse, "SCANS", 1)
    assert {r.id: r.depth for r in traverse.distances(df, start, 3, both=True).collect()} == {"a": 0, "b": 1, "d": 1, "c": 2}
    assert made == ["edges"]


def test_paths_look_at_reached_links_alone(spark, monkeypatch):
    rows = [("a", "b"), ("b", "c"), ("a", "c"), *[(f"x{i}", "c") for i in range(50)]]
    sizes, plain = {}, traverse.written
    monkeypatch.setattr(traverse, "written", lambda df, name: sizes.update({name: (out := plain(df, name))}) or out)
    out, complete = traverse.paths(spark.createDataFrame(rows, "src string, dst string"), "a", "c", 1, 3)
    assert [r.path for r in out.collect()] == [["a", "c"]] and not complete
    assert sizes["edges"].count() == 3


def test_ranks_flow_without_texts(spark, monkeypatch):
    links = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0), ("b", "gone", 3.0)], "src string, dst string, weight double")
    weights = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 0.0)], "id string, weight double")
    kinds, plain = {}, traverse.bucketed
    monkeypatch.setattr(traverse, "bucketed", lambda df, by, name: kinds.update({name: (out := plain(df, by, name))}) or out)
    got = {r.id: r.rank for r in traverse.pagerank(links, weights, 1).collect()}
    assert got == pytest.approx({"a": 0.075 + 0.85 * 0.125, "b": 0.075 + 0.85 * 0.5, "c": 0.0})
    assert "string" not in dict(kinds["links"].dtypes).values()


def test_relationships_of_projected_edges(spark, no_broadcast):
    nodes = [("f", None, None), ("g", None, None), ("f#s", "f", "class"), ("f#t", "f", "method"), ("h#s", "h", "class"), ("g#s", "g", "class")]
    nodes = spark.createDataFrame(nodes, "id string, symbol_file string, symbol_kind string").withColumns({c: F.lit(None).cast("string") for c in ("node_type", "symbol_name", "signature", "language", "source", "plugin_kind")})
    ends = [("f", "f#s", "contains"), ("f#s", "g", "call"), ("f#t", "g", "call"), ("f#s", "g#s", "nests"), ("f#s", "h#s", "call"), ("f", "gone", "call"), ("gone", "g", "call"), ("g", "f", "use"), ("f#s", "f#t", "call")]
    edges = spark.createDataFrame([(f"{a}->{b}#{k}", a, b, k, i) for i, (a, b, k) in enumerate(ends)], "id string, src string, dst string, kind string, ord long")
    said = [("f", "g", "call", "f#s", 1), ("f", "g", "call", "f#t", 2), ("f", "g", "call", "f#s", 3), ("f", "g", "use", None, 4), ("g", "f", "use", None, 5), ("f", "h", "call", "f#s", 6), ("f", None, "call", None, 7), ("f", "f", "call", "f#s", 8)]
    relations = spark.createDataFrame(said, "from_file string, to_file string, kind string, from_symbol string, ord long")
    relations = relations.withColumns({c: F.lit(None).cast("string") for c in ("from_node", "to_node", "to_symbol", "plugin_id", "source_id")})
    symbols = spark.createDataFrame([("f#s", "s", "class"), ("f#t", "t", "method")], "id string, name string, kind string").withColumns({c: F.lit(None).cast("int") for c in ("start_line", "end_line")})
    graph = Graph(nodes, edges)
    wanted = reports.relationships(Graph(nodes, file_edges(graph)), relations, symbols)
    out = reports.relationships(graph, relations, symbols, project=True)
    assert sorted(map(repr, out.collect())) == sorted(map(repr, wanted.collect()))
    got = {(r["from"], r["to"]): ([x.edge_type for x in r.relationships], [[s.name for s in x.symbols] for x in r.relationships]) for r in out.collect()}
    assert got == {("f", "g"): (["call", "nests"], [["s", "t"], []]), ("g", "f"): (["use"], [[]])}
    # ends are looked up once, and the aggregates of a pair share a shuffle
    again = reports.relationships(graph, relations, symbols, project=True)
    assert plan(again).count("Exchange hashpartitioning(src") == plan(again).count("Exchange hashpartitioning(src#") <= 8
    assert plan(again)[: plan(again).index("Exchange ")].count("HashAggregate") == 6


def test_legends_are_dealt_by_their_number(spark, sf, monkeypatch):
    monkeypatch.setattr(graph_module, "HELD", 1_000)
    out = catalogue_facts.edge_legends(spark, sf)
    rows = derived.edges_at_most(spark, sf)
    assert rows >= derived.edges(spark, sf).count() and -(-rows // 1_000) > 4
    assert f"{-(-rows // 1_000)}), REPARTITION_BY_NUM" in plan(out)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2_000


def shuffles(df):
    """Exchanges of a plan with all joins as sort-merge joins, each once; what reuses one isn't counted."""
    return plan(df).count("Exchange hashpartitioning")


def test_degrees_shuffle_each_pair_once(spark):
    rows = [("b", "a"), ("a", "b"), ("a", "a"), ("a", "c"), ("a", "c"), ("a", None), (None, "a"), (None, None), ("é", "a")]
    edges = spark.createDataFrame(rows, "src string, dst string")
    out = reports.degrees(edges)
    both = {(s, d) for s, d in rows} | {(d, s) for s, d in rows}
    assert {r.id: r.degree for r in out.collect()} == {x: len({d for s, d in both if s == x}) for x in {s for s, _ in both}}
    assert "Union" not in plan(out)


def test_edges_of_a_pair_are_shuffled_once(spark, sf, no_broadcast):
    from skein.plans.catalogue import edge_group

    assert shuffles(edge_group(spark, sf)) == shuffles(derived.edges(spark, sf)) + 1


def test_moved_ends_go_once_through_the_second_shuffle(spark, no_broadcast):
    g = scope_graph(spark)
    none = g.edges.where("src = 'f#x'").withColumns({"kind": F.lit(None).cast("string"), "id": F.lit("x#y")})
    shown = scope.in_scope(scope.Scope(nodes={"symbol:class": False}))
    out = scope.projected(g.edges.union(none), g.nodes, shown)
    got = {(r.id, r.src, r.dst) for r in out.where("kind is null").collect()}
    assert got == {("x#y", "f#x", "g#z"), ("x#y", "f#x", "f#y"), ("x#y", "f#x", "g")}
    lines = plan(out).splitlines()
    at = next(i for i, line in enumerate(lines) if "Exchange hashpartitioning(dst" in line)
    assert not re.search(r"[\[ ](?<!AS )a_to#\d+[,\]]", lines[at + 1])


def test_the_sort_of_all_edges_runs_no_join_twice(spark):
    g = scope_graph(spark)
    out = reports.edges_report(g, node_types=reports.ALL_TYPES)
    assert "Join" not in plan(out) and "Aggregate" not in plan(out)
    got = [(r["from"], r["to"], r.edge_types) for r in out.collect()]
    assert got and sorted(got) == sorted((r["from"], r["to"], r.edge_types) for r in reports.grouped(closed(g.edges, g.nodes)).collect())


def shuffle_files(spark):
    out = []
    for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString():
        out += [os.path.join(r, f) for r, _, fs in os.walk(d) for f in fs if f.startswith("shuffle_")]
    return out


def left_behind(spark, run):
    """Shuffle files that ``run`` leaves, some time after it."""
    before, _ = set(shuffle_files(spark)), run()
    for _ in range(50):
        if not (left := set(shuffle_files(spark)) - before):
            break
        time.sleep(0.1)
    return left


def test_what_is_written_leaves_no_shuffle_files(spark):
    df = spark.range(10_000).groupBy((F.col("id") % 97).alias("n")).count()
    assert left_behind(spark, lambda: df.write.format("noop").mode("overwrite").save())
    for step in (lambda: graph_module.written(df, "sums"), lambda: graph_module.bucketed(df, "n", "sums")):
        assert not left_behind(spark, step)
    assert spark.conf.get(graph_module.FREED, "false") == "false"
    assert sorted(r["count"] for r in graph_module.written(df, "sums").collect()) == sorted(r["count"] for r in df.collect())


def test_steps_of_ranks_leave_no_shuffle_files(spark, sf):
    from skein.plans import task_map

    g, out = derived.graph(spark, sf), []
    files = g.nodes.where("symbol_file is null").select("id", F.col("file_size").cast("double").alias("weight"))
    assert not left_behind(spark, lambda: out.append(task_map.file_ranks(g, files, 6)))
    links = task_map.file_links(g, files.withColumnRenamed("id", "path"))
    wanted = {r.id: r.rank for r in traverse.pagerank(links, files, 6).collect()}
    assert {r.id: r.rank for r in out[0].collect()} == pytest.approx(wanted)


def test_ranks_of_files_by_numbers(spark):
    from skein.plans import task_map

    g = scope_graph(spark)
    files = spark.createDataFrame([("f", 1.0), ("g", 0.0), ("alone", 0.5)], "id string, weight double")
    wanted = traverse.pagerank(task_map.file_links(g, files.withColumnRenamed("id", "path")), files, 3)
    got = task_map.file_ranks(g, files, 3)
    assert {r.id: r.rank for r in got.collect()} == pytest.approx({r.id: r.rank for r in wanted.collect()})


def pairs_graph(spark, odd=()):
    rng = random.Random(3)
    names = [f"f{i}" for i in range(4)] + [f"f{i}#s{j}" for i in range(4) for j in range(3)]
    nodes = [(n, n.split("#")[0] if "#" in n else None, rng.choice(["class", "function"]) if "#" in n else None) for n in names]
    nodes = spark.createDataFrame(nodes, "id string, symbol_file string, symbol_kind string")
    nodes = nodes.select(*[(F.col(f.name) if f.name in nodes.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in NODE.fields])
    rows = [(rng.choice([*names, "lost"]), rng.choice([*names, "lost"]), rng.choice(["call", "type-import", "contains"])) for _ in range(400)] + list(odd)
    edges = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "src string, dst string, kind string, ord long").repartition(5)
    edges = edges.withColumn("id", edge_id(F.col("src"), F.col("dst"), F.col("kind"))).withColumn("sources", F.when(F.col("ord") % 3 == 0, F.array(F.struct(F.col("ord").cast("string").alias("id"), *[F.lit("x").alias(c) for c in ("plugin_id", "source_id", "label")]))).cast(PARTS))
    return Graph(nodes, edges.select(*[f.name for f in EDGE.fields]))


ODD = [("f0->f1", "f2", "call"), ("f0", "f1->f2", "call"), ("f0", "f1", "a#call"), ("f0", "f1#a", "call"), (None, "f1", "call"), ("f0", "f1", None)]


@pytest.mark.parametrize("odd", [(), ODD])
def test_edges_dealt_by_pairs_are_those_of_aggregates(spark, monkeypatch, odd):
    g, even, seen = pairs_graph(spark, odd), scope._even, []
    asked = lambda half: seen.append(even(half)) or seen[-1]
    s = scope.Scope(nodes={"symbol:class": False})
    runs = (lambda: scope.most_specific(g.edges, g.nodes), lambda: scope.apply_scope(g, s).edges)
    for run in runs:
        monkeypatch.setattr(scope, "_even", asked)
        got = sorted(map(repr, run().collect()))
        monkeypatch.setattr(scope, "_even", lambda half: False)
        assert got and got == sorted(map(repr, run().collect()))
    assert seen[0] == (not odd)


def test_ends_are_looked_up_in_steps(spark, no_broadcast, monkeypatch):
    g, names, plain = pairs_graph(spark), [], scope.written
    monkeypatch.setattr(scope, "written", lambda df, name: names.append(name) or plain(df, name))
    for run in (lambda: scope.most_specific(g.edges, g.nodes), lambda: scope.apply_scope(g, scope.Scope()).edges):
        out = []
        assert not left_behind(spark, lambda: out.append(run()))
        assert names == ["places", "half-placed"] and not names.clear()
        # what is left to do: the join at dst, and one shuffle by pairs
        assert shuffles(out[0]) == 3 and "Aggregate" not in plan(out[0])


def test_a_file_with_very_many_edges_is_not_dealt_by_pairs(spark, monkeypatch):
    monkeypatch.setattr(scope, "HELD", 50)
    g = pairs_graph(spark, [("f0", f"f{i % 4}", "call") for i in range(400)])
    half = scope._half(scope._with_files(slim(g.edges), scope.places(g.nodes, F.lit(True)), "a"))
    assert not scope._even(half) and scope._even(half.where("ord < 150"))


def test_found_edges_meet_nodes_once(spark, no_broadcast):
    g = pairs_graph(spark)
    for patterns, query in ((["f1*", "call"], "2"), ([], "s1"), (["f2"], " ")):
        left = visible.filter_patterns(g, patterns)
        wanted, _ = visible.search(left, query)
        got, error = visible.filtered_search(g, patterns, query)
        assert error is None
        for a, b in ((got.nodes, wanted.nodes), (got.edges, wanted.edges)):
            assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
        # once at each end
        assert plan(visible.filtered_search(g, patterns, query)[0].edges).count("LeftSemi") == 2
    assert visible.filtered_search(g, ["f1*"], "(", regex=True)[1] and visible.filtered_search(g, ["f1*"], "(", regex=True)[0].nodes.count() == 0


def test_scoped_edges_are_not_looked_up_again(spark, no_broadcast, monkeypatch):
    g, sizes, plain = scope_graph(spark), {}, visible.closed
    monkeypatch.setattr(visible, "closed", lambda edges, nodes: sizes.update(n=edges.count()) or plain(edges, nodes))
    s = scope.Scope(nodes={"folder": True})
    scoped = scope.apply_scope(g, s)
    whole = visible.structural(scoped, s, g, whole=True)
    assert sizes.pop("n") == whole.nodes.count() - scoped.nodes.where("symbol_file is not null").count() - 1
    wanted = visible.structural(scoped, s, g)
    assert sizes["n"] > scoped.edges.count() > 0
    assert sorted(map(repr, whole.edges.collect())) == sorted(map(repr, wanted.edges.collect()))
    monkeypatch.setattr(visible, "closed", plain)
    out, names = [], []
    written = visible.written
    monkeypatch.setattr(visible, "written", lambda df, name: names.append(name) or written(df, name))
    view = visible.View(scope=s, patterns=("h*",), show_orphans=False, collapsed=("(root)",))
    assert not left_behind(spark, lambda: out.append(visible.visible(g, view)[0]))
    assert names.count("found-edges") == 1 and "linked-edges" not in names


def test_edges_are_closed_as_they_collapse(spark, no_broadcast, monkeypatch):
    g, names, plain, out = pairs_graph(spark, ODD), [], visible.written, []
    s = scope.Scope(nodes={"folder": True}, edges={"nests": False})
    g = Graph(g.nodes.withColumn("id", F.concat(F.lit("top/"), "id")).withColumn("symbol_file", F.concat(F.lit("top/"), "symbol_file")), g.edges)
    g = Graph(g.nodes, g.edges.withColumns({c: F.concat(F.lit("top/"), c) for c in ("src", "dst")}))
    g = Graph(g.nodes.union(pairs_graph(spark).nodes), g.edges.union(pairs_graph(spark).edges).withColumn("ord", F.xxhash64("src", "dst", "kind", "ord")))
    for folders in (["top"], ["(root)"], []):
        wanted = visible.collapse(visible.structural(g, s), folders)
        monkeypatch.setattr(visible, "written", lambda df, name: names.append(name) or plain(df, name))
        assert not left_behind(spark, lambda: out.append(visible.collapse(visible.structural(g, s, whole=True), folders, closing=True)))
        monkeypatch.setattr(visible, "written", plain)
        got = out.pop()
        for a, b in ((got.nodes, wanted.nodes), (got.edges, wanted.edges)):
            assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
        assert names == (["owners", "places", "half-collapsed"] if folders else []) and not names.clear()


def test_relationships_meet_edges_in_steps(spark, sf, no_broadcast):
    from skein.plans import catalogue

    out = []
    assert not left_behind(spark, lambda: out.append(catalogue.relationships_grouped(spark, sf)))
    # what is left is the sort of what is written
    assert "Exchange rangepartitioning" in plan(out[0]) and shuffles(out[0]) == 0
