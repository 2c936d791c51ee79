"""Literal graphs: the pipeline's rules, one by one."""

import random

import pytest
from pyspark.sql import functions as F

from skein.functions import glob, ordering, text
from skein.graph import Graph, file_edges
from skein.operators import project, traverse, visible
from skein.operators.scope import NodeType, Scope, apply_scope
from skein.plans import reports, search, task_map
from skein.schema import EDGE, NODE, package_id, uri_component


def graph_of(spark, nodes, edges):
    rows = []
    for i, n in enumerate(nodes):
        n = {"id": n} if isinstance(n, str) else n
        rows.append(tuple(n.get(f.name, i if f.name == "ord" else n["id"].split("/")[-1] if f.name == "label" else None) for f in NODE.fields))
    es = [(f"{a}->{b}#{k}", a, b, k, [], i) for i, (a, b, k) in enumerate(edges)]
    return Graph(spark.createDataFrame(rows, NODE), spark.createDataFrame(es, EDGE))


def symbol(id_, file, kind="function", **more):
    return {"id": id_, "symbol_name": id_.split("#")[-1], "symbol_kind": kind, "symbol_file": file, "node_type": "symbol", **more}


def ids(df):
    return sorted(r[0] for r in df.select("id").collect())


def test_default_scope_is_files(spark):
    g = graph_of(spark, ["a.ts", "b.ts", {"id": "r", "node_type": "plugin-route"}], [("a.ts", "b.ts", "import"), ("a.ts", "b.ts", "type-import"), ("r", "a.ts", "reference")])
    out = reports.edges_report(g).collect()
    assert [tuple(r) for r in out] == [("a.ts", "b.ts", ["import", "type-import"])]
    assert [r.path for r in reports.nodes_report(g).collect()] == ["a.ts", "b.ts"]


def test_hidden_symbols_give_way_to_files(spark):
    g = graph_of(
        spark,
        ["a", "b", symbol("a#f", "a"), symbol("b#g", "b"), symbol("b#C", "b", "class")],
        [("a#f", "b#g", "call"), ("a#f", "a", "call"), ("a", "a", "reference"), ("a", "b", "import"), ("a", "b#C", "import")],
    )
    out = apply_scope(g, Scope(nodes={"symbol": False}))
    assert ids(out.nodes) == ["a", "b"]
    assert ids(out.edges) == ["a->a#reference", "a->b#call", "a->b#import"]
    out = apply_scope(g, Scope())
    assert ids(out.edges) == ["a#f->a#call", "a#f->b#g#call", "a->a#reference", "a->b#C#import"]


def test_most_specific_definition_decides(spark):
    g = graph_of(spark, ["a", symbol("a#x", "a", "function", plugin_kind="route"), symbol("a#y", "a"), symbol("a#z", "a", "unheard")], [])
    types = (NodeType("plugin:route", "symbol", plugin_kind="route"),)
    assert ids(apply_scope(g, Scope(types=types)).nodes) == ["a", "a#x", "a#y"]
    assert ids(apply_scope(g, Scope(nodes={"plugin:route": False}, types=types)).nodes) == ["a", "a#y"]
    assert ids(apply_scope(g, Scope(nodes={"symbol:callable": False}, types=types)).nodes) == ["a"]
    assert ids(apply_scope(g, Scope(nodes={"symbol:function": False})).nodes) == ["a"]


def test_type_import_prefers_files(spark):
    g = graph_of(spark, ["a", "b", symbol("b#T", "b", "type")], [("a", "b", "type-import"), ("a", "b#T", "type-import")])
    assert ids(apply_scope(g, Scope()).edges) == ["a->b#type-import"]


def test_structure(spark):
    g = graph_of(spark, ["src/a/x.ts", "src/y.ts", "z.ts", "src/package.json"], [])
    out = visible.structural(g, Scope(nodes={"folder": True, "package": True}))
    assert ids(out.nodes.where("node_type = 'folder'")) == ["(root)", "src", "src/a"]
    got = ids(out.edges)
    assert "(root)->src#nests" in got and "(root)->z.ts#nests" in got and "src/a->src/a/x.ts#nests" in got
    assert "pkg:workspace:src->src/a/x.ts#nests" in got and not any(e.endswith("->z.ts#nests") and "pkg" in e for e in got)
    assert visible.structural(g, Scope()) is g


def test_filter_search_orphans(spark):
    g = graph_of(spark, ["src/a.ts", "src/b.test.ts", "lib/c.py"], [("src/a.ts", "lib/c.py", "import"), ("lib/c.py", "src/a.ts", "call")])
    assert ids(visible.filter_patterns(g, ["*.test.ts", "import"]).edges) == ["lib/c.py->src/a.ts#call"]
    assert ids(visible.search(g, "A.TS")[0].nodes) == ["src/a.ts"]
    assert ids(visible.search(g, "a.ts", whole_word=True)[0].nodes) == ["src/a.ts"]
    none, error = visible.search(g, "(", regex=True)
    assert error and ids(none.nodes) == []
    assert ids(visible.without_orphans(g).nodes) == ["lib/c.py", "src/a.ts"]


def test_collapse_moves_and_merges(spark):
    g = graph_of(spark, [{"id": "s", "node_type": "folder"}, {"id": "s/t", "node_type": "folder"}, "s/a", "s/t/b", "c"], [("s/a", "c", "import"), ("s/t/b", "c", "import"), ("s/a", "s/t/b", "call")])
    out = visible.collapse(g, ["s", "s/t"])
    assert ids(out.nodes) == ["c", "s"] and ids(out.edges) == ["s->c#import"]
    assert out.nodes.where("id = 's'").first()["hidden"] == 3


def test_paths_of_a_diamond(spark):
    g = graph_of(spark, list("abcd"), [("a", "c", "import"), ("a", "b", "import"), ("b", "d", "import"), ("c", "d", "import")])
    found, complete = traverse.paths(g.edges, "a", "d")
    assert [r.path for r in found.collect()] == [["a", "b", "d"], ["a", "c", "d"]] and complete
    found, complete = traverse.paths(g.edges, "a", "d", max_depth=1)
    assert found.count() == 0 and not complete
    found, complete = traverse.paths(g.edges, "d", "a")
    assert found.count() == 0 and complete
    assert [r.path for r in traverse.paths(g.edges, "a", "a")[0].collect()] == [["a"]]
    assert traverse.shortest_path(g.edges, "a", "d") == ["a", "b", "d"]
    assert ids(traverse.focus(g, "a", 1).nodes) == ["a", "b", "c"] and traverse.focus(g, "no", 1) is g
    assert ids(traverse.dependents(g.edges, spark.createDataFrame([("d",)], "id string"))) == list("abcd")


def test_pagerank_keeps_its_mass(spark):
    links = spark.createDataFrame([("left", "right", 1.0), ("right", "left", 1.0)], "src string, dst string, weight double")
    start = spark.createDataFrame([("left", 0.0), ("right", 0.0), ("alone", 1.0)], "id string, weight double")
    got = {r.id: r.rank for r in traverse.pagerank(links, start).collect()}
    assert got["alone"] == pytest.approx(1) and sum(got.values()) == pytest.approx(1)


def test_random_graphs_against_a_model(spark):
    rng = random.Random(5)
    names = [f"n{i}" for i in range(14)]
    edges = sorted({(rng.choice(names), rng.choice(names)) for _ in range(24)})
    g = graph_of(spark, names, [(a, b, "import") for a, b in edges])
    near = {names[0]: 0}
    for step in (1, 2, 3):
        for a, b in edges:
            for x, y in ((a, b), (b, a)):
                if near.get(x, 99) == step - 1 and y not in near:
                    near[y] = step
    got = {r.id: r.depth for r in traverse.distances(traverse.both_ways(g.edges), g.nodes.where("id = 'n0'").select("id"), 3).collect()}
    assert got == near


@pytest.mark.parametrize(
    "pattern, dialect, yes, no",
    [
        ("*.ts", "suffix", ["a.ts", "x/b.ts"], ["a.tsx", "a.ts\n"]),
        ("src/*", "suffix", ["src/a", "x/src/a"], ["src/a/b"]),
        ("src/**", "suffix", ["src/a", "x/src/a/b"], ["asrc/b"]),
        ("**/t/*.py", "suffix", ["t/a.py", "x/y/t/a.py"], ["t/a/b.py"]),
        ("a[bc].py", "classes", ["ab.py", "x/ac.py"], ["ad.py"]),
        ("a[!b].py", "classes", ["ac.py"], ["ab.py"]),
        ("a[b].py", "suffix", ["a[b].py"], ["ab.py"]),
        ("*.{js,ts}", "full", ["a.js", "x/y.ts"], ["a.jsx"]),
        ("src/?.py", "full", ["src/a.py"], ["src/ab.py", "x/src/a.py"]),
    ],
)
def test_globs(spark, pattern, dialect, yes, no):
    df = spark.createDataFrame([(x,) for x in yes + no], "p string")
    hit = {r.p for r in df.where(glob.matches(F.col("p"), pattern, dialect)).collect()}
    assert hit == set(yes)
    assert {r.p for r in df.where(glob.matches_any(F.col("p"), [pattern, "zzz"], dialect)).collect()} == set(yes)


def test_order_and_pages(spark):
    df = spark.createDataFrame([("b", 1), ("B", 2), ("a", 3), ("_x", 4)], "k string, ord int")
    assert [r.k for r in ordering.sort_by(df, [], ["k"], "ord").collect()] == ["_x", "a", "b", "B"]
    assert ordering.page_info(10, 8, 5) == {"offset": 8, "limit": 5, "returned": 2, "total": 10, "nextOffset": None}
    assert ordering.page_info(10, 0, 0)["nextOffset"] is None and ordering.page_info(10, 2, 3)["nextOffset"] == 5


def test_words(spark):
    assert text.query_tokens("How fooBar is parsed") == ["foo", "bar", "parsed"]
    assert text.roots("stopping") == ["stopping", "stopp", "stop"] and text.roots("loaded") == ["loaded", "load", "loade"] and text.roots("bus") == ["bus"]
    pairs = [("stopping", "stop"), ("stops", "stop"), ("stopped", "stopping"), ("used", "use"), ("using", "use"), ("loads", "load"), ("loading", "loaded"), ("seed", "see"), ("bing", "be"), ("stopd", "stop"), ("load", "loaf"), ("stoped", "stopp")]
    found = spark.createDataFrame(pairs, "w string, t string").select("w", "t", text.bases(F.array("w")).alias("b")).collect()
    assert [(r.w, r.t) for r in found if set(r.b) & set(text.roots(r.t))] == pairs[:9]


def test_identities(spark):
    df = spark.createDataFrame([("react",), ("@s/p/x",), ("node:fs/promises",), ("./a",), ("http://x",), ("#a",)], "s string")
    assert [r[0] for r in df.select(package_id(F.col("s"))).collect()] == ["pkg:react", "pkg:@s/p", "pkg:fs", None, None, None]
    assert spark.range(1).select(uri_component(F.lit("a b(c)!*~é"))).first()[0] == "a%20b(c)!*~%C3%A9"


def test_reexports_follow_to_a_single_symbol(spark):
    symbols = spark.createDataFrame([("c", "f", "c#f"), ("d", "f", "d#f"), ("e", "g", "e#g")], "file_path string, name string, id string")
    exports = spark.createDataFrame([("a", None, "b", None), ("b", "f", "c", "f"), ("b", None, "a", None), ("x", None, "c", None), ("x", None, "d", None), ("y", "h", "e", "g")], "file string, name string, to_file string, to_name string")
    wanted = spark.createDataFrame([(1, "a", "f"), (2, "x", "f"), (3, "y", "h"), (4, "b", "no")], "ord long, file string, name string")
    assert {r.ord: r.symbol for r in project.through_reexports(wanted, exports, symbols).collect()} == {1: "c#f", 3: "e#g"}


def test_reexports_of_random_exports(spark, monkeypatch):
    rng = random.Random(4)
    files, names = [f"f{i}" for i in range(12)], ["a", "b", "c"]
    exports = [(rng.choice(files), rng.choice([*names, None]), rng.choice(files), rng.choice([*names, None])) for _ in range(30)]
    symbols = [(f, n, f"{f}#{n}{k}") for f, n, k in [(rng.choice(files), rng.choice(names), rng.choice("xy")) for _ in range(7)]]
    # many rows ask for the same; one asks for two names
    wanted = [(i, files[i % 12], names[i % 3]) for i in range(144)] + [(0, "f5", "b"), (500, None, "a"), (501, "f1", None)]

    def reached(file, name):
        seen, front, out = set(), [(file, name)], set()
        while front:
            at = front.pop()
            if at in seen:
                continue
            seen.add(at)
            own = {s for f, n, s in symbols if (f, n) == at}
            out |= own
            front += [] if own else [(to, at[1] if n is None else m or n) for f, n, to, m in exports if f == at[0] and n in (None, at[1])]
        return out

    every = {}
    for ord_, file, name in wanted:
        every.setdefault(ord_, set()).update(reached(file, name) if file and name else ())
    sizes, plain = {}, project.written

    def counted(df, name):
        out = plain(df, name)
        sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    monkeypatch.setattr(project, "written", counted)
    frame = lambda rows, columns: spark.createDataFrame(rows, columns)
    out = project.through_reexports(frame(wanted, "ord long, file string, name string"), frame(exports, "file string, name string, to_file string, to_name string"), frame(symbols, "file_path string, name string, id string"))
    assert {r.ord: r.symbol for r in out.collect()} == {o: next(iter(s)) for o, s in every.items() if len(s) == 1}
    # what is followed are names in files, not the rows that ask
    assert sizes["reexports"] <= 36



def test_search_ranks(spark):
    g = graph_of(spark, ["src/runtime.ts", "docs/a.md"], [])
    s = spark.createDataFrame([("src/runtime.ts#runtime", "runtime", "function", "src/runtime.ts")], "id string, name string, kind string, file_path string")
    t = spark.createDataFrame([("src/runtime.ts", "x\nthe Runtime here"), ("docs/a.md", "no")], "path string, content string")
    out = search.search_report(g.nodes, s, t, "runtime").collect()
    assert [(r.type, r["rank"]) for r in out] == [("symbol", 0), ("text", 3), ("node", 3)]
    assert (out[1].line, out[1].column) == (2, 5)
    phrase = search.search_report(g.nodes, s, t, "runtime here now")
    assert phrase.count() == 0
    assert [r.id for r in search.search_report(g.nodes, s, t, "here runtime").collect()] == ["src/runtime.ts"]


def test_task_map(spark):
    files = [{"id": p, "node_type": "file"} for p in ("src/plugins/runtime.ts", "src/plugins/util.ts", "tests/runtime.test.ts", "docs/x.md")]
    g = graph_of(spark, files, [("src/plugins/runtime.ts", "src/plugins/util.ts", "import")])
    t = spark.createDataFrame([(f["id"], "plugin runtime cleanup" if "runtime" in f["id"] else "nothing") for f in files], "path string, content string")
    out, terms = task_map.task_map(g, t, "plugin runtime cleanup during loading")
    assert terms == ["plugin", "runtime", "cleanup"]
    assert [r.path for r in out.collect()] == ["src/plugins/runtime.ts", "tests/runtime.test.ts", "src/plugins/util.ts"]


def test_file_edges(spark):
    g = graph_of(spark, ["a", "b", symbol("a#f", "a"), symbol("b#g", "b")], [("a#f", "b#g", "call"), ("a", "a#f", "contains")])
    assert ids(file_edges(g)) == ["a->b#call"]
