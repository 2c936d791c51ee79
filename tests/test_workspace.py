import json
import tempfile

import pytest

from skein.analyze.languages import builtin
from skein.analyze.registry import Plugin, Registry
from skein.operators.scope import saved_scope
from skein.workspace import Settings, Workspace


def test_index_query_update(spark, tmp_path):
    files = {
        "main.py": "from lib.util import helper\ndef main():\n    return helper()\n",
        "lib/__init__.py": "",
        "lib/util.py": "import os\ndef helper():\n    return 1\n",
        "notes.md": "see [[util]]",
        "c/a.c": '#include "b.h"\n#include <stdio.h>\n',
        "c/b.h": "",
    }
    for p, c in files.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(c)
    w = Workspace(spark, str(tmp_path), tempfile.mkdtemp(prefix="skein-home-"))
    w.cache.buckets = 8
    assert w.cache.status()[0] == "missing"
    w.index()
    assert w.status() == ("fresh", [])
    nodes = {r.path for r in w.query("nodes").collect()}
    assert nodes == set(files)
    pairs = {(r["from"], r["to"]): r.edge_types for r in w.query("edges", node_types=["file", "package", "symbol"]).collect()}
    assert pairs["main.py", "lib/util.py"] == ["import", "call"] or set(pairs["main.py", "lib/util.py"]) == {"import", "call"}
    assert pairs["c/a.c", "c/b.h"] == ["include"] and pairs["notes.md", "lib/util.py"] == ["reference"]
    assert pairs["main.py#main:function:()", "lib/util.py#helper:function:()"] == ["call"] and ("main.py", "main.py#main:function:()") in pairs
    assert pairs["lib/util.py", "pkg:os"] == ["import"]
    assert {(r["from"], r["to"]) for r in w.query("dependents", path="lib/util.py").collect()} == {("main.py", "lib/util.py"), ("notes.md", "lib/util.py")}
    assert [r.id for r in w.query("symbols", file_path="lib/util.py").collect()] == ["lib/util.py#helper:function:()"]
    links = {(r["from"], r["to"]): r for r in w.query("relationships", node_types=["file", "package"]).collect()}
    assert {x.edge_type for x in links["main.py", "lib/util.py"].relationships} >= {"import"} and links["c/a.c", "c/b.h"].edge_types == ["include"]
    related = w.query("symbols", related_to="lib/util.py", edge_type="call")
    assert [r.id for r in related.collect()] == ["lib/util.py#helper:function:()"]  # the symbol that the call leads to
    found, complete = w.query("paths", src="main.py", dst="lib/util.py", expand=True, project=True)
    assert {tuple(r.path) for r in found.collect()} == {("main.py", "lib/util.py")}
    assert {r.path for r in w.query("nodes", saved=True, limit=3).collect()} < set(files)
    assert {r.edge_types[0] for r in w.query("edges", saved=True, node_types=["file", "symbol"]).collect()} == {"import", "include"}
    said = [json.loads(r.value) for r in w.query("nodes", limit=2, as_json=True).collect()]
    assert [x["command"] for x in said] == ["nodes", "nodes"] and said[0]["data"]["node_type"] == "file"
    assert said[0]["page"]["total"] == len(files) and w.page_of("nodes", limit=4)[1]["nextOffset"] == 4
    best, terms, between, symbols_ = w.query("task-map", query="what does the helper return", limit=1)
    assert best.count() == 1 and "helper" in terms and between.count() == 0 and symbols_.count() <= 3
    assert w.query("paths", src="main.py", dst="lib/util.py", limit=0)[0].count() == 0
    assert len(w.query("nodes", defaults=True).collect()) == len(files)
    shown = {r.path for r in w.query("nodes", saved=True, types=["symbol:function"], node_types=["file", "symbol"]).collect()}
    assert shown >= set(files)
    assert w.doctor()["violations"] == {"edge_source": 0, "edge_target": 0, "node_key": 0}
    (tmp_path / "lib/util.py").write_text("def other():\n    return 2\n")
    assert w.status() == ("stale", ["pending-changed-files"])
    before = w.cache.state()
    w.update()
    after = w.cache.state()
    kept = {(t, b) for t, v in before["tables"].items() for b in v if after["tables"][t].get(b) == v[b]}
    assert kept and any(v != before["version"] for v in after["tables"]["symbols"].values())
    assert w.status()[0] == "fresh" and w.update() is None
    assert [r.id for r in w.query("symbols", file_path="lib/util.py").collect()] == ["lib/util.py#other:function:()"]
    assert {(r["from"], r["to"]) for r in w.query("dependents", path="lib/util.py").collect()} == {("main.py", "lib/util.py"), ("notes.md", "lib/util.py")}
    w.settings.plugins = {"core:markdown": False}
    assert w.status() == ("stale", ["plugin-signature-changed", "settings-signature-changed"])
    assert "call" not in {x for r in w.query("relationships", node_types=["file"]).collect() for x in r.edge_types if r["from"] == "notes.md"}
    (tmp_path / "new.py").write_text("import lib.util\n")
    w.update()
    assert w.status() == ("fresh", []) and "new.py" in {r.path for r in w.query("nodes").collect()}
    assert w.cache.vacuum(1) and w.status()[0] == "fresh"


def test_settings(tmp_path):
    s = Settings(filter_patterns=["*.md"], edge_visibility={"call": True})
    s.save(f"{tmp_path}/x/settings.json")
    assert Settings.load(f"{tmp_path}/x/settings.json") == s and Settings.load(f"{tmp_path}/none") == Settings()
    assert s.scope(["call", "import", "reference"]).edges == {"call": True, "import": True, "reference": False}


def test_saved_scope():
    out = saved_scope({"symbol:method": True}, {"call": True}, ["route", "symbol"], ["odd", "x:y"], {"plugin:a": True, "made": True}, {"x:z": True, "w": False})
    on = {t for t, v in out.nodes.items() if v}
    assert on == {"file", "made", "symbol:method", "symbol:function", "symbol"}
    assert {k for k, v in out.edges.items() if v} == {"include", "import", "using", "nests", "call", "odd"}


def test_plugins_are_told_and_switched(spark, tmp_path):
    (tmp_path / "a.py").write_text("import b\n")
    (tmp_path / "b.py").write_text("")
    (tmp_path / "c.note").write_text("see b")
    heard = []

    def note(path, content):
        return [{"fact": "relation", "kind": "notes", "source_id": "note", "specifier": "b.py"}]

    def changed(files):
        heard.append(("changed", [r.path for r in files.collect()]))
        return spark.createDataFrame([("c.note",)], "path string")

    def fails(*_):
        raise ValueError("no")

    hooks = {"pre_analyze": lambda files: heard.append(("pre", files.count())), "files_changed": changed, "post_analyze": fails, "initialize": lambda: heard.append("begun"), "workspace_ready": lambda g: heard.append("ready"), "unload": lambda: heard.append("gone")}
    impact = {"toggle": "reanalyze-plugin-files", "depth": "projection-only", "odd": "nonsense"}
    plugin = Plugin("note", (".note",), note, node_types=(("plugin:note", True), ("made", True)), edge_types=(("notes", True),), hooks=hooks, impact=impact)
    r = Registry([*builtin(), plugin])
    assert [r.impact("note"), r.impact("note", "depth"), r.impact("note", "odd"), r.impact("note", "other")] == ["reanalyze-plugin-files", "projection-only", "requires-full-index", "requires-full-index"]
    with pytest.raises(ValueError):
        r.notify("other")
    w = Workspace(spark, str(tmp_path), tempfile.mkdtemp(prefix="skein-home-"), r)
    w.cache.buckets = 4
    w.index()
    assert heard == ["begun", ("pre", 3), "ready"]
    pairs = lambda: {(x["from"], x["to"]): x.edge_types for x in w.query("edges").collect()}
    assert pairs() == {("a.py", "b.py"): ["import"], ("c.note", "b.py"): ["notes"]}
    assert w.scope().edges["notes"] and w.scope().nodes["made"] and not w.scope().nodes["plugin:note"]
    (tmp_path / "b.py").write_text("x = 1\n")
    w.update()
    assert heard[-2:] == [("changed", []), ("pre", 2)] and w.status() == ("fresh", [])
    assert heard.count("ready") == 1 and heard.count("begun") == 1 and "gone" not in heard
    w.switch("note", False)
    assert "gone" in heard
    assert pairs() == {("a.py", "b.py"): ["import"]} and w.status() == ("fresh", [])
