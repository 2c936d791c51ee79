"""Updates of an index: the result of any edits is that of a full index, and only what they touch is written."""

import json
import random
import shutil
import subprocess
import tempfile

import pytest

from skein.analyze.languages import builtin
from skein.analyze.registry import Plugin, Registry
from skein.sources import cache
from skein.workspace import Settings, Workspace


def put(root, **files):
    for path, text in files.items():
        at = root / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)


def notes(path, content):
    """A line is ``space NAME``, ``import NAME`` or ``by NAME``: a namespace, an include, and a link from an undeclared symbol."""
    for i, line in enumerate(content.split("\n")):
        word, _, name = line.partition(" ")
        if word == "space":
            yield {"fact": "symbol", "kind": "namespace", "name": name, "id": f"{path}:namespace:{name}", "start_line": i, "end_line": i}
        if word == "import":
            yield {"fact": "relation", "kind": "include", "source_id": "note", "specifier": name}
        if word == "by":
            yield {"fact": "relation", "kind": "reference", "source_id": "note", "specifier": name, "from_symbol": f"{path}:part:intro"}


def registry():
    return Registry([*builtin(), Plugin("note", (".note",), notes)])


def workspace(spark, root, buckets=4):
    w = Workspace(spark, str(root), tempfile.mkdtemp(prefix="skein-home-"), registry())
    w.cache.buckets = buckets
    return w


def content(w):
    """All that an index holds, but the times of files and the kept order of merged sources."""
    g = w.graph()
    edges = [(r.id, r.src, r.dst, r.kind, sorted(s.id for s in r.sources or [])) for r in g.edges.collect()]
    tables = w.cache.load()
    plain = lambda t, *drop: sorted(repr(tuple(r)) for r in tables[t].drop(*drop).collect())
    files = plain("files", "mtime")
    relations = sorted(json.dumps({k: v for k, v in r.asDict().items()}, sort_keys=True, default=str) for t in ("relations", "open") for r in tables[t].collect())
    return {
        "nodes": sorted(repr(tuple(r)) for r in g.nodes.collect()), "edges": sorted(map(repr, edges)), "files": files, "symbols": plain("symbols"),
        "relations": relations, "candidates": sorted(set(plain("candidates"))), "grams": plain("grams"),
    }


def same_as_full(spark, w, root):
    other = workspace(spark, root)
    other.settings.respect_gitignore = w.settings.respect_gitignore
    other.index()
    mine, full = content(w), content(other)
    for part in full:
        assert mine[part] == full[part], part


def versions(w):
    return {(t, b): v for t, bs in w.cache.state()["tables"].items() for b, v in bs.items()}


def test_chain_of_reexports_namespaces_folders_and_undeclared_ends(spark, tmp_path):
    put(
        tmp_path,
        **{
            "src/impl.ts": "export function run() {}\n", "src/mid.ts": "export { run as go } from './impl'\n", "src/index.ts": "export * from './mid'\n",
            "app.ts": "import { go } from './src/index'\ngo()\n", "a.note": "space Core\n", "lib/b.note": "space Core\nimport a\n", "lib/c.note": "import a\nby b\n",
            ".gitignore": "ignored/\n", "ignored/x.py": "",
        },
    )
    (tmp_path / "empty").mkdir()
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    w = workspace(spark, tmp_path)
    w.index()
    g = w.graph()
    edges = {(r.src, r.dst, r.kind) for r in g.edges.collect()}
    nodes = {r.id: r for r in g.nodes.collect()}
    # the call leads behind two re-exports to the file that declares the function, the import to the file that it names
    assert ("app.ts", "src/impl.ts", "call") in edges and ("app.ts", "src/index.ts", "import") in edges
    links = {(r.from_file, r.kind): r for r in w.cache.load()["relations"].collect()}
    assert links["app.ts", "call"].to_symbol == "src/impl.ts#run:function" and links["app.ts", "call"].resolved_path == "src/index.ts"
    # of two declarations of a namespace the most included one is a node
    assert "a.note#Core:namespace" in nodes and "lib/b.note#Core:namespace" not in nodes
    # folders without files, and ignored ones
    assert nodes["empty"].node_type == "folder" and nodes["empty"].source is None
    assert nodes["ignored"].source == "ignored" and "src" not in nodes and "ignored/x.py" not in nodes
    # the undeclared end has a node and an edge
    assert nodes["lib/c.note#part:intro"].symbol_file == "lib/c.note"
    assert ("lib/c.note#part:intro", "lib/b.note", "reference") in edges
    found = {(r["from"], r["to"]) for r in w.query("edges", node_types=["file", "symbol"]).collect()}
    assert {("app.ts", "src/impl.ts"), ("lib/c.note#part:intro", "lib/b.note")} <= found
    # another end of the chain
    put(tmp_path, **{"src/mid.ts": "export { walk as go } from './other'\n", "src/other.ts": "export function walk() {}\n", "lib/d.note": "import b\nimport lib/b.note\nimport lib/b\n"})
    shutil.rmtree(tmp_path / "empty")
    w.update()
    assert ("app.ts", "src/other.ts", "call") in {(r.src, r.dst, r.kind) for r in w.graph().edges.collect()}
    assert {"a.note#Core:namespace", "lib/b.note#Core:namespace"} & {r.id for r in w.graph().nodes.collect()} == {"lib/b.note#Core:namespace"}


def test_random_edits_equal_a_full_index(spark, tmp_path):
    rng = random.Random(1)
    names = [f"{d}m{i}" for i in range(4) for d in ("", "p/", "p/q/")]

    def text(path):
        if path.endswith(".note"):
            return "\n".join(rng.choice([f"space N{rng.randrange(2)}", f"import {rng.choice(names)}", f"by {rng.choice(names)}", "x"]) for _ in range(3))
        if path.endswith(".ts"):
            to = "./" + rng.choice(names).rpartition("/")[2]
            return rng.choice([f"import {{ f }} from '{to}'\nf()\n", f"export * from '{to}'\n", f"export {{ f }} from '{to}'\n", "export function f() {}\n", "import x from 'pkg'\n"])
        module = rng.choice(names).replace("/", ".")
        return rng.choice([f"import {module}\n", f"from {module} import f\ndef g():\n    return f()\n", "def f():\n    pass\n", "import os\n", "# nothing\n"])

    paths = [n + e for n in names for e in (".py", ".ts", ".note")]
    for p in rng.sample(paths, 20):
        put(tmp_path, **{p: text(p)})
    w = workspace(spark, tmp_path)
    w.index()
    for _ in range(2):
        for p in rng.sample(paths, 5):
            if (tmp_path / p).exists() and rng.random() < 0.5:
                (tmp_path / p).unlink()
            else:
                put(tmp_path, **{p: text(p)})
        w.update()
        assert w.status() == ("fresh", [])
    same_as_full(spark, w, tmp_path)


def test_arrival_and_departure_touch_what_asks_for_them(spark, tmp_path):
    files = {f"far{i}.py": f"import os\ndef f{i}():\n    pass\n" for i in range(12)}
    put(tmp_path, **files, **{"a.py": "import lib\n", "b.py": "import other\n"})
    w = workspace(spark, tmp_path, 32)
    w.index()
    read = []
    analysed = w.analysed
    w.analysed = lambda files, paths: read.append({r.path for r in files.collect()}) or analysed(files, paths)
    before = versions(w)
    put(tmp_path, **{"lib/__init__.py": "def x():\n    pass\n"})
    w.update()
    assert read == [{"lib/__init__.py"}]  # what imports it is resolved again, not read
    assert {(r.src, r.dst) for r in w.graph().edges.where("kind = 'import' and src = 'a.py'").collect()} == {("a.py", "lib/__init__.py")}
    after = versions(w)
    assert sum(before[k] == after.get(k) for k in before) > len(before) / 3
    put(tmp_path, **{"lib.py": ""})  # a better candidate
    w.update()
    assert {r.dst for r in w.graph().edges.where("kind = 'import' and src = 'a.py'").collect()} == {"lib.py"}
    (tmp_path / "lib.py").unlink()
    w.update()
    assert {r.dst for r in w.graph().edges.where("kind = 'import' and src = 'a.py'").collect()} == {"lib/__init__.py"}
    assert read[1:] == [{"lib.py"}, set()]


def test_equal_facts_patch_metrics_alone(spark, tmp_path):
    put(tmp_path, **{"a.py": "import b\n", "b.py": "def f():\n    pass\n", "c.txt": "x"})
    w = workspace(spark, tmp_path)
    w.index()
    before = versions(w)
    put(tmp_path, **{"b.py": "def f():\n    pass\n# a longer file\n", "c.txt": "longer"})
    w.update()
    after = versions(w)
    assert {k for k in after if after[k] != before.get(k)} <= {k for k in after if k[0] in ("files", "grams")} and after != before
    sizes = {r.id: r.file_size for r in w.graph().nodes.collect()}
    assert sizes["b.py"] == len("def f():\n    pass\n# a longer file\n") and sizes["c.txt"] == 6
    assert w.status() == ("fresh", []) and w.update() is None


def test_writers_that_die_or_overtake(spark, tmp_path):
    put(tmp_path, **{"a.py": "import b\n", "b.py": ""})
    w = workspace(spark, tmp_path)
    w.index()
    folder = f"{w.home}/cache"
    number = w.cache.state()["number"]
    open(f"{folder}/state-{number + 1}", "w").close()  # written in place by a writer that died
    open(f"{folder}/.state-x", "w").close()
    assert w.cache.state()["number"] == number
    put(tmp_path, **{"c.py": "import a\n"})
    w.update()
    assert w.cache.state()["number"] == number + 2 and "c.py" in {r.id for r in w.graph().nodes.collect()}
    # two writers from one state: the second is told, and nothing of it is read
    state = w.cache.state()
    first = w.cache.save(expect=state["version"], meta={"who": "first"})
    with pytest.raises(cache.Overtaken):
        w.cache.save(expect=state["version"], meta={"who": "second"})
    with pytest.raises(cache.Overtaken):
        w.cache._commit(state, "f" * 32, {}, {})
    assert w.cache.state()["version"] == first and w.cache.state()["meta"]["who"] == "first"
    # an update that is overtaken begins again
    put(tmp_path, **{"d.py": "import a\n"})
    patch, late = w.cache.patch, []

    def overtaken(*a, **b):
        if not late:
            late.append(w.cache.save(meta={"who": "other"}))
        return patch(*a, **b)

    w.cache.patch = overtaken
    w.update()
    assert late and w.status() == ("fresh", []) and "d.py" in {r.id for r in w.graph().nodes.collect()}


def test_files_that_change_meanwhile_and_plugins_that_ask_for_all(spark, tmp_path):
    put(tmp_path, **{"a.py": "import b\n", "b.py": ""})
    w = workspace(spark, tmp_path)
    derived, done = w.derived, []

    def slow(*a):
        if not done:
            put(tmp_path, **{"late.py": "import a\n"})
            done.append(1)
        return derived(*a)

    w.derived = slow
    w.index()
    assert done and w.status() == ("fresh", []) and "late.py" in {r.id for r in w.graph().nodes.collect()}
    asked = []
    w.registry.add(Plugin("all", (".py",), lambda p, c: [], hooks={"files_changed": lambda f: asked.append(1) or spark.createDataFrame([(True,)], "full_refresh boolean"), "pre_analyze": lambda f: spark.createDataFrame([("a.py", "import late\n")], "path string, content string")}))
    w.index()
    assert {(r.src, r.dst) for r in w.graph().edges.collect()} >= {("a.py", "late.py")}
    put(tmp_path, **{"b.py": "import a\n"})
    w.update()
    assert asked and w.status() == ("fresh", [])


def test_without_symbols(spark, tmp_path):
    put(tmp_path, **{"a.py": "from b import f\ndef g():\n    f()\n", "b.py": "def f():\n    pass\n"})
    w = workspace(spark, tmp_path)
    w.settings = Settings(keep_symbols=False)
    w.index()
    assert w.cache.counts()["symbols"] == 0 and {r.id for r in w.graph().nodes.collect()} == {"a.py", "b.py"}
    assert {r.kind for r in w.graph().edges.collect()} == {"import", "call"}
    assert {(r.from_symbol, r.to_symbol) for r in w.cache.load()["relations"].collect()} == {(None, None)}


def test_watch(spark, tmp_path):
    import time

    put(tmp_path, **{"a.py": "import b\n", "b.py": ""})
    w, said = workspace(spark, tmp_path), []
    query = w.watch(said.append, "file://" + tempfile.mkdtemp(prefix="skein-watch-"))
    try:
        assert said[0]["event"] == "ready" and said[0]["indexedFiles"] == 2

        def until(test):
            end = time.time() + 90
            while not test() and time.time() < end:
                time.sleep(0.2)
            assert test(), said

        time.sleep(1.5)
        put(tmp_path, **{f"c{i:02d}.py": "import a\n" for i in range(25)})
        until(lambda: any(e["event"] == "updated" and e["changed"] for e in said))
        told = next(e for e in said if e["event"] == "updating")
        assert len(told["filePaths"]) <= 20 and told["complete"] == (told["totalFiles"] <= 20)
        until(lambda: sum(e["event"] == "updated" for e in said) == sum(e["event"] == "updating" for e in said))
        assert "c24.py" in {r.id for r in w.graph().nodes.collect()}
        w.update, kept = lambda: 1 / 0, w.update
        put(tmp_path, **{"d.py": ""})
        until(lambda: any(e["event"] == "error" for e in said))
        w.update = kept
    finally:
        query.stop()
    until(lambda: said[-1]["event"] == "stopped")
