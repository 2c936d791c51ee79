import subprocess

from pyspark.sql import functions as F

from skein.analyze.languages import builtin, javascript_candidates, python_candidates
from skein.analyze.registry import Plugin, Registry, relations, resolved, symbols
from skein.export.documents import json_rows, markdown_rows, summary, symbol_export
from skein.operators import project
from skein.plans.reports import symbols_of
from skein.sources import discovery
from tests.test_graph import graph_of, symbol

FILES = {
    "main.py": "import os\nfrom pkg.util import helper as h\nfrom .pkg import base\nclass A(base.Base):\n    def go(self, x):\n        return h(x)\n",
    "pkg/__init__.py": "",
    "pkg/util.py": "def helper(x):\n    return x\n",
    "pkg/base.py": "class Base: pass\n",
    "web/app.ts": "import React, { useState as s, type T } from 'react'\nimport type { U } from './types'\nimport { run } from './run.js'\nexport * from './types'\n// import 'no'\nexport function f() { run(); s.x() }\nclass B extends React {}\nimport('./lazy')",
    "web/types.ts": "export interface U {}",
    "web/run.ts": "",
    "web/lazy/index.ts": "",
    "a.md": "see [[b|B]] and ![[img#x]] not `[[c]]`",
    "x.c": '#include "x.h"\n',
    "bad.py": "def (",
    "node_modules/x.js": "",
}


def test_analysis_to_graph(spark):
    texts = spark.createDataFrame(list(FILES.items()), "path string, content string")
    registry = Registry(builtin())
    registry.add(Plugin("mine", ("*",), lambda p, c: [{"fact": "symbol", "kind": "file", "name": "whole", "id": f"{p}:whole"}] if p == "x.c" else []))
    facts = registry.facts(texts).cache()
    s = {(r.file_path, r.kind, r.name) for r in symbols(facts).collect()}
    assert {("main.py", "class", "A"), ("main.py", "method", "go"), ("pkg/util.py", "function", "helper"), ("web/app.ts", "function", "f"), ("web/types.ts", "interface", "U"), ("x.c", "file", "whole")} <= s
    r = relations(facts)
    files = texts.select("path", F.lit(1).cast("long").alias("size"))
    py = resolved(r.where("plugin_id = 'core:python'"), files, python_candidates)
    got = {(x.from_file, x.kind, x.specifier, x.resolved_path) for x in py.collect()}
    assert ("main.py", "import", "pkg.util", "pkg/util.py") in got and ("main.py", "import", ".pkg", "pkg/base.py") in got
    assert ("main.py", "call", "pkg.util", "pkg/util.py") in got and ("main.py", "inherit", ".pkg", "pkg/base.py") in got and ("main.py", "import", "os", None) in got
    js = resolved(r.where("plugin_id = 'core:javascript'"), files, javascript_candidates)
    got = {(x.kind, x.specifier, x.resolved_path) for x in js.collect()}
    assert got == {
        ("import", "react", None), ("type-import", "react", None), ("type-import", "./types", "web/types.ts"), ("import", "./run.js", "web/run.ts"), ("reexport", "./types", "web/types.ts"),
        ("import", "./lazy", "web/lazy/index.ts"), ("call", "./run.js", "web/run.ts"), ("call", "react", None), ("inherit", "react", None),
    }
    assert {x.specifier for x in r.where("kind = 'reference'").collect()} == {"b", "img"}
    facts_ = js.withColumns({c: F.lit(None).cast("string") for c in ("to_file", "to_symbol", "variant")})
    g = project.graph_of(facts_.where("kind in ('import', 'type-import', 'reexport')"), files)
    edges = {x.id for x in g.edges.collect()}
    assert {"web/app.ts->pkg:react#import", "web/app.ts->web/types.ts#type-import", "web/app.ts->web/types.ts#import", "web/app.ts->web/lazy/index.ts#import:dynamic"} <= edges
    assert "pkg:react" in {x.id for x in g.nodes.collect()}


def test_discovery(spark, tmp_path):
    for p, c in FILES.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(c)
    (tmp_path / "nul.py").write_bytes(b"a\0b")
    files = discovery.listed(spark, f"file://{tmp_path}", content=True)
    kept, n = discovery.discovered(files.drop("content"), exclude=["*.md"], extensions=(".py", ".c"))
    assert sorted(r.path for r in kept.collect()) == ["bad.py", "main.py", "nul.py", "pkg/__init__.py", "pkg/base.py", "pkg/util.py", "x.c"] and n["found"] == len(FILES)
    assert discovery.discovered(files.drop("content"), most=2)[1]["limited"]
    assert "nul.py" not in {r.path for r in discovery.texts(files).collect()}
    assert {r.path for r in discovery.below(files, spark.createDataFrame([("pkg",), ("x.c",)], "path string")).collect()} == {"pkg/__init__.py", "pkg/base.py", "pkg/util.py", "x.c"}
    assert {r.path for r in discovery.folders(files).collect()} == {"pkg", "web", "web/lazy"}
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    (tmp_path / ".gitignore").write_text("web/\n")
    assert "web/app.ts" not in {r.path for r in discovery.git_listed(spark, str(tmp_path)).collect()}
    assert [r.path for r in discovery.git_ignored(spark, str(tmp_path), ["web/app.ts", "x.c"]).collect()] == ["web/app.ts"]


def test_exports(spark):
    g = graph_of(spark, ["b", "a", symbol("a#f", "a")], [("a", "b", "import"), ("a", "b", "call")])
    rows = [r.value for r in json_rows(g).collect()]
    assert rows[0].startswith('{"id":"a"') and rows[-1] == '{"from":"a","to":"b","edgeTypes":["import","call"]}'
    assert tuple(summary(g).first()) == (3, 2)
    assert markdown_rows(g).first().value == "## a\n\n- `b` (import, call)\n"
    r = spark.createDataFrame([("a", "b"), ("a", "a")], "from_file string, to_file string")
    assert [tuple(x) for x in symbol_export(g.nodes, symbols_of(g.nodes), r).collect()] == [("a", 1, 2), ("b", 0, 1)]
